import random

import pytest

from dualview.llm import decontaminate as dc
from .conftest import prose


def least_edits(item, data):
    row = [0] * (len(data) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(data, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def altered(r, data, edits):
    x = bytearray(data)
    for _ in range(edits):
        p = r.randrange(len(x))
        how = r.random()
        if how < 0.33:
            x[p] = r.choice(b"abcdefgh")
        elif how < 0.66:
            del x[p]
        else:
            x.insert(p, r.choice(b"abcdefgh"))
    return bytes(x)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(seed):
    r = random.Random(seed)
    some = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    for _ in range(60):
        item = some(r.randint(40, 120))
        data = some(r.randint(0, 60)) + altered(r, item, r.randint(0, 14)) + some(r.randint(0, 60))
        found = dc.Items([(7, item)], 0.1).matches(data)
        low = least_edits(item, data)
        if low <= int(0.1 * len(item)):
            assert found[0][0] == low and least_edits(item, data[found[0][1] : found[0][2]]) <= low
        else:
            assert not found


def test_rows(spark, documents, odd, empty):
    item = prose(50, 25)
    near = item.replace("a", "o", 3)
    docs = documents([f"{prose(51)} {item.upper()} {prose(52)}", f"{prose(53)}\n{near}", prose(54), None, "", item[:60], item + " " + item])
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "short"), (4, prose(60, 30))], "item_id long, text string")
    got = dc.matches(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == [(0, 1, 0), (1, 1, 3), (6, 1, 0)]
    kept = dc.clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == docs.columns
    assert dc.clean(odd, bench).count() == odd.count()
    assert dc.matches(empty, bench).count() == 0 and dc.matches(docs, bench.limit(0)).count() == 0
    with pytest.raises(ValueError):
        dc.matches(docs, bench, share=0.2)


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    docs = documents([f"{prose(i)} {prose(100 + i, 25)}" for i in range(4)])
    bench = spark.createDataFrame([(i, prose(100 + i, 25)) for i in range(4)], "item_id long, text string")
    assert len(list(dc.item_blocks(bench.withColumnRenamed("item_id", "item"), most=200))) > 1
    assert {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, bench).collect()} == {(i, i) for i in range(4)}


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_items_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(60):
        unit = bytes(r.choice(b"ab-") for _ in range(r.randint(1, 4)))
        item = (unit * 80)[: r.randint(30, 90)]
        noise = lambda n: bytes(r.choice(b"ab-xyz") for _ in range(n))
        data = noise(r.randint(0, 200)) + altered(r, item, r.randint(0, 12)) + (unit * 60)[: r.randint(0, 200)] + noise(r.randint(0, 60))
        found = dc.Items([(7, item)], 0.1).matches(data)
        low = least_edits(item, data)
        assert (found[0][0] == low) if low <= int(0.1 * len(item)) else not found


def test_repetitive_texts_take_linear_time(monkeypatch):
    import time

    items = dc.Items([(1, b"-" * 60), (2, b"-x" * 40), (3, b"word " * 200)], 0.1)
    begun = time.time()
    assert items.matches(b"-" * 1_000_000)[0][:2] == (0, 0)
    assert items.matches(b"-----" * 100 + b"=" + b"----x" * 200_000)[0][0] == 0
    assert set(items.matches(b"word " * 200_000)) == {2}
    assert items.matches(b"---------x-" * 20_000)[0][0] == 5
    assert time.time() - begun < 20


def test_segments_give_the_same(monkeypatch):
    item = prose(5, 30).encode()
    data = b" ".join([prose(6, 200).encode(), item, prose(7, 100).encode(), item.replace(b"a", b"o", 2)])
    want = dc.Items([(1, item)], 0.1).matches(data)
    monkeypatch.setattr(dc, "SEGMENT", 97)
    monkeypatch.setattr(dc, "SPAN", 64)
    assert dc.Items([(1, item)], 0.1).matches(data) == want == {0: (0, data.index(item), data.index(item) + len(item))}


def test_rows_of_one_id_are_judged_by_their_texts(spark, documents):
    item = prose(50, 25)
    docs = documents([(2, f"{prose(1)} {item}"), (2, prose(2)), (None, item), (None, prose(3)), (4, prose(4)), (4, prose(4))])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in dc.clean(docs, bench).collect()) == [(0, prose(3)), (2, prose(2)), (4, prose(4)), (4, prose(4))]
