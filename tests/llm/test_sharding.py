import heapq
import random
import zlib

from dualview.llm import sharding
from .conftest import prose


def test_schedule_is_longest_first():
    r = random.Random(2)
    histogram = [(s, 0, c, s * c) for s, c in ((s, r.randint(1, 300)) for s in r.sample(range(20, 5000), 100))]
    got = [0] * 40
    for kind, _, shards, lasts in sharding.schedule(histogram, 40):
        for shard, before, last in zip(shards, [0, *lasts], lasts, strict=False):
            got[shard] += kind * (last - before)
    heap = [(0, s) for s in range(40)]
    for size, _, count, _ in sorted(histogram, reverse=True):
        for _ in range(count):
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, s))
    assert sorted(got) == sorted(load for load, _ in heap)


def check(docs, got, shards):
    rows = docs.collect()
    assert len(got) == len(rows)
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows if r["doc_id"] is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    for s in {r["shard"] for r in got}:
        assert 0 <= s < shards and sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    by = {}
    for r in got:
        assert by.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]


def test_rows(spark, documents, odd, empty):
    for docs in (documents([prose(i, 5 + i % 90) for i in range(400)] + [prose(1, 6)] * 30), odd):
        check(docs, sharding.assign(docs, 7).collect(), 7)
    loads = {}
    for r in sharding.assign(documents([prose(i, 5 + i % 90) for i in range(400)]), 7).collect():
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert max(loads.values()) - min(loads.values()) <= 60
    assert sharding.assign(empty, 3).count() == 0


def test_large_sizes_share_classes_within_bounds(spark):
    from pyspark.sql import functions as F

    exact = sharding.exact_up_to(40)
    assert exact == 1 << 16 and sharding.exact_up_to(1 << 14) == 256
    df = spark.createDataFrame([(s,) for s in (1, 4096, 4097, exact, exact + 1, 100_000, 123_456_789)], "s long").select("s", sharding.size_class(F.col("s"), exact).alias("c"))
    assert all(0 <= r["s"] - r["c"] <= (r["s"] > exact) * r["s"] / exact * 2 for r in df.collect())


def test_common_sizes_are_ranked_in_parts(documents, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 16)
    docs = documents([f"{i:06d}" for i in range(500)] + [prose(i, 20) for i in range(40)])
    got = sharding.assign(docs, 7).collect()
    check(docs, got, 7)
    counts = [sum(r["shard"] == s for r in got) for s in range(7)]
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(7)]
    assert max(loads) - min(loads) <= 22 and sum(counts) == 540
