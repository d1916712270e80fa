import random

from hypothesis import given
from hypothesis import strategies as st

from dualview.llm import chat, registry
from oracle import assert_same, connect

HOSTILE = st.lists(st.sampled_from(["<", "\\", "|", "<|im_end|>", "<|im_start|>", "a", "\n", "\\n", "🙂"]), max_size=9).map("".join)


@given(st.lists(st.tuples(st.one_of(st.just("assistant"), HOSTILE), HOSTILE), max_size=5))
def test_any_text_comes_back(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert chat.masked(formatted, spans) == "".join(t for r, t in turns if r == "assistant")


def test_folding_events():
    log = [("message", 1, "user", "hi"), ("message", 2, "assistant", "he"), ("delta", 2, None, "llo"), ("message", 3, "user", "more"), ("edit", 1, None, "hey"), ("regenerate", 2, None, None), ("delta", 2, None, "good"), ("delta", 2, None, " day"), ("delta", 9, "user", None)]
    assert chat.fold(log) == [("user", "hey"), ("assistant", "good day"), ("user", "")]
    assert chat.fold([]) == []


def test_events_of_many_conversations(spark):
    r = random.Random(1)
    rows, want = [], {}
    for c in range(50):
        want[c] = [("user", f"q{c}"), ("assistant", "".join(str(i) for i in range(20)))]
        rows += [(c, 0, "message", 1, "user", "draft"), (c, 1, "edit", 1, None, f"q{c}"), (c, 2, "message", 2, "assistant", "")] + [(c, 3 + i, "delta", 2, None, str(i)) for i in range(20)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string")
    assert {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_conversations(df).collect()} == want


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, 1), (1, 1, None, "x", 1), (1, 1, None, "x", 1), (None, 0, "user", "y", 1), (2, None, "assistant", "last", 1), (2, 0, "assistant", "z" * 200_000, 1), (3, 0, "assistant", "", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_conversations(chat.as_events(df)).collect()}
    assert got == {1: [("user", ""), ("", "x"), ("", "x")], None: [("user", "y")], 2: [("assistant", "z" * 200_000), ("assistant", "last")], 3: [("assistant", "")]}
    assert chat.read_back(chat.format_conversations(chat.as_events(df.limit(0)))).count() == 0


def test_query_equals_sql(spark, small):
    assert_same(registry.QUERIES["op9_chat_format"](spark, small), connect(small), registry.ORACLES["op9_chat_format"])
