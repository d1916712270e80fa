import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dualview.llm import simhash
from dualview.llm.components import components
from .conftest import prose


def plain_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(keys, fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    some = sorted(root)
    for i, a in enumerate(some):
        for b in some[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for k, f in zip(keys, fps, strict=True):
        if k is not None:
            least[find(f)] = min(least.get(find(f), k), k)
    return [least.get(find(f)) for f in fps]


def clusters(seed, groups=8, each=40):
    r = random.Random(seed)
    out = set()
    for _ in range(groups):
        base = r.getrandbits(64)
        for _ in range(each):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("bits", "bucket"), [(3, 4096), (3, 4), (1, 4096), (5, 4096), (2, 8)])
def test_links_equal_brute_force(spark, bits, bucket):
    fps = clusters(bits)
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    roots = components(simhash.link(df.select("fp"), bits, bucket))
    got = df.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).orderBy("doc_id").collect()
    want = plain_components(range(len(fps)), fps, bits)
    first = {}
    for r, w in zip(got, want, strict=True):
        assert first.setdefault(r["root"], w) == w
    assert len(first) == len(set(want))


def test_thresholds_meet_the_pigeonhole_bound():
    sample = np.array(clusters(1), dtype=np.uint64)
    for total in (10, 10**5, 10**8):
        for bits in (1, 3, 6):
            chosen = simhash.plan(sample, total, bits)
            assert sum(t + 1 for _, t in chosen) == bits + 1
            used = 0
            for mask, _ in chosen:
                assert mask & used == 0
                used |= mask


def test_odd_rows(spark, odd, empty):
    rows = odd.collect()
    got = simhash.near_duplicates(odd).collect()
    fps = [plain_fingerprint(r["text"], 3) for r in rows]
    want = sorted(zip((r["doc_id"] for r in rows), fps, plain_components([r["doc_id"] for r in rows], fps, 3), strict=True), key=repr)
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component"]) for r in got), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_drops_near_copies_only(spark, documents):
    base = prose(7, 400).split()
    near = base[:]
    near[200] = "changed"
    other = prose(8, 400)
    docs = documents([" ".join(base), " ".join(near), " ".join(base), other, None, ""])
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 3, 4]
    assert simhash.keep_one(docs.limit(0)).columns == docs.columns


def words_of(seed, n=100):
    r = random.Random(seed)
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def plain_keep_one(texts):
    sets, kept = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts], []
    for i, x in enumerate(sets):
        if all(len(np.intersect1d(x, sets[j])) / max(1, len(np.union1d(x, sets[j]))) < 0.8 for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize(("rounds", "sets"), [(0, 256), (1, 2), (4, 256)])
def test_keep_one_misses_no_pair(spark, documents, monkeypatch, rounds, sets):
    monkeypatch.setattr(simhash, "HEAD_ROUNDS", rounds)
    monkeypatch.setattr(simhash, "SETS", sets)
    r, texts, far = random.Random(5), [], 0
    for seed in range(12):
        base = words_of(seed)
        for _ in range(4):
            copy = base[:]
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**9)}"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            far += simhash.similarity(a, b, 5) >= 0.8 and (plain_fingerprint(a, 5) ^ plain_fingerprint(b, 5)).bit_count() > 7
    assert far > 5
    assert sorted(x["doc_id"] for x in simhash.keep_one(documents(texts)).collect()) == plain_keep_one(texts)


def test_copies_in_a_chain_do_not_both_stay(spark, documents):
    base = words_of(50)
    middle = base[:40] + ["changed"] + base[41:]
    last = middle[:80] + ["other"] + middle[81:85] + ["more"] + middle[86:]
    root, link, far = (" ".join(x) for x in (base, middle, last))
    assert simhash.similarity(root, link, 5) >= 0.8 and simhash.similarity(root, far, 5) < 0.8
    # the copies of the far end meet the root only through what goes; one of each group stays
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents([root, link, far, far, far + " ", (1, far), (None, far)])).collect() if r["doc_id"] is not None) == [0, 1]
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents([root, link, far, far, far + " "])).collect()) == [0, 2]
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents([far, far, far, root])).collect()) == [0, 3]


def test_one_id_with_several_texts(spark, documents):
    a, b = prose(31, 90), prose(32, 90)
    docs = documents([(1, a), (2, a), (2, b), (2, b), (None, a)])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(docs).collect()) == sorted([(0, a), (1, a), (2, b), (2, b)])


def test_odd_rows_of_keep_one(spark, odd, empty):
    got = simhash.keep_one(odd)
    rows = sorted({(r["doc_id"], r["text"] or "") for r in odd.collect() if r["doc_id"] is not None})
    kept = []
    for _, t in rows:
        kept.append(all(simhash.similarity(t, u, 5) < 0.8 for (_, u), k in zip(rows, kept, strict=False) if k))
    want = {r for r, k in zip(rows, kept, strict=True) if k}
    assert {(r["doc_id"], r["text"] or "") for r in got.collect() if r["doc_id"] is not None} == want and got.columns == odd.columns
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("local", [0, 50, 10_000])
def test_uncovered_equals_greedy_order(spark, local):
    r = random.Random(9)
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(300)}
    gone = set()
    for b in range(60):
        if any((a, b) in pairs and a not in gone for a in range(b)):
            gone.add(b)
    got = simhash.uncovered(spark.createDataFrame(sorted(pairs), "a long, b long").repartition(3), local)
    assert {x["node"] for x in got.collect()} == gone
