import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dualview.llm import lines


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, least):
    """Removed line numbers of (key, text) rows; equal rows are one."""
    every = sorted({(k is not None, k or 0, t) for k, t in rows if t is not None})
    seen, out = [], {}
    for some, k, t in every:
        gone = []
        for no, line in enumerate(t.split("\n")):
            if len(line) >= least:
                if any(within_one(line, x) for x in seen):
                    gone.append(no)
                seen.append(line)
        out[(k if some else None, t)] = gone
    return out


def edited(r, line):
    i = r.randrange(len(line) + 1)
    return r.choice([line[:i] + r.choice("abé") + line[i:], line[:i] + line[i + 1 :], line[:i] + r.choice("abé") + line[i + 1 :]])


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, documents, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("aabé ") for _ in range(r.randint(24, 60))) for _ in range(12)]
    texts = []
    for _ in range(30):
        some = [r.choice(base) for _ in range(r.randint(0, 5))]
        some = [edited(r, x) if r.random() < 0.5 else x for x in some]
        some = [edited(r, x) if r.random() < 0.3 else x for x in some]
        texts.append("\n".join([*some, "short"]))
    texts = list(dict.fromkeys(texts))
    docs = documents(texts)
    want = brute(list(enumerate(texts)), 24)
    got = {r["doc_id"]: r["removed"] for r in lines.report(docs).collect()}
    assert got == {i: ",".join(map(str, want[i, t])) for i, t in enumerate(texts)}
    kept = {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()}
    assert kept == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i, t]) for i, t in enumerate(texts)}


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = brute(rows, lines.MIN_CHARS)
    got = lines.report(odd).collect()
    assert len(got) == len(rows)
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append(t)
    for r in got:
        assert any(r["removed"] == ",".join(map(str, want.get((r["doc_id"], t), []))) for t in texts[r["doc_id"]])
    cut = lines.dedup(odd)
    assert cut.columns == odd.columns and cut.count() == len(rows)
    assert lines.report(empty).count() == 0 and lines.dedup(empty).count() == 0


def test_columns_of_any_name_pass_through(spark):
    line = "a line that is long enough to be compared"
    docs = spark.createDataFrame([(1, 7, line, 0.5), (2, 8, line + "\nand another line of more than 24 characters", 0.25)], "doc_id long, `_` int, text string, `a.b` double")
    got = lines.dedup(docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, 7, line, 0.5), (2, 8, "and another line of more than 24 characters", 0.25)]
    labelled = docs.withColumn("lang", F.lit("en"))
    kept = corpus_pipeline.identify_language(spark, labelled, "")
    assert kept.columns == labelled.columns and [tuple(r) for r in kept.orderBy("doc_id").collect()] == [tuple(r) for r in labelled.orderBy("doc_id").collect()]


def test_texts_of_a_slice_are_hashed_as_one(monkeypatch):
    texts = ["", "a line that is long enough to be compared\nshort\n" + "é" * 30, "short", "\n\n" + "x" * 24, "a line that is long enough to be compared\n"]
    apart = [lines.Lines(t, 24) for t in texts]
    passes, plain = [], lines.Lines
    monkeypatch.setattr(lines, "Lines", lambda *a: passes.append(a) or plain(*a))
    whole, rows, pick, no = lines.joined(texts, 24)
    assert len(passes) == 1
    assert list(zip(pick.tolist(), no.tolist(), strict=True)) == [(i, n) for i, x in enumerate(apart) for n in x.no.tolist()]
    assert rows == [texts[i].split("\n")[n].encode() for i, n in zip(pick.tolist(), no.tolist(), strict=True)]
    assert whole.coarse().tolist() == [h for x in apart for h in x.coarse().tolist()]
