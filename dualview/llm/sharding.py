"""Sharding by longest-processing-time scheduling of groups that must stay together.

Groups (equal texts) are scheduled largest first onto the least-loaded shard through a
heap. Groups of one size are alike to the heap, so it is fed a histogram of sizes
(size, count) and answers with how many groups of the size each shard gets; the groups
themselves never leave the executors. Sizes of up to ``exact_up_to(shards)`` bytes are classes
of their own; larger ones share a class within 1 part in that number, which bounds histogram
and plan on the driver. Loads are kept with the true bytes of each class. A class is ranked
in salted parts of about ``PART`` groups, so that a common size isn't one task.
"""

from __future__ import annotations

import heapq
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, text_key

#: Groups that one salted part of a class should have.
PART = 1 << 17
#: Entries that the plan should have for each doubling of size, classes times shards.
PLAN = 1 << 22


def exact_up_to(shards: int) -> int:
    """The size up to which sizes are classes of their own."""
    return 1 << max(8, min(16, (PLAN // shards).bit_length() - 1))


def share(count: int, size: float, heap: list[tuple[float, int]]) -> list[int]:
    """Give ``count`` groups of one size to the least loaded; counts by shard.

    All but the last few go by levelling: whole rounds that any order of the heap would
    give. The rest are popped from the heap one at a time.
    """
    n = len(heap)
    out = [0] * n
    if count > 4 * n and size > 0:
        loads = sorted(heap)
        # the level below which the greedy order surely fills
        held, level = 0.0, loads[0][0]
        for i, (load, _) in enumerate(loads):
            held += load
            level = (held + (count - n) * size) / (i + 1)
            if i + 1 == n or level <= loads[i + 1][0]:
                break
        for load, shard in loads:
            out[shard] = max(0, int((level - load) // size))
        heap[:] = [(load + out[shard] * size, shard) for load, shard in loads]
        heapq.heapify(heap)
        count -= sum(out)
    for _ in range(count):
        load, shard = heapq.heappop(heap)
        out[shard] += 1
        heapq.heappush(heap, (load + size, shard))
    return out


def schedule(histogram: list[tuple], shards: int) -> list[tuple]:
    """(class, salt, shards, lasts) for rows (class, salt, groups, bytes): ranks up to lasts[0] go to shards[0], and so on."""
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for kind, salt, count, held in sorted(histogram, key=lambda r: (-r[0], r[1])):
        done, to, last = 0, [], []
        for shard, got in enumerate(share(count, held / count, heap)):
            if got:
                done += got
                to.append(shard)
                last.append(done)
        out.append((kind, salt, to, last))
    return out


def size_class(size: F.Column, exact: int) -> F.Column:
    """The size itself up to ``exact``; above, its leading bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(size.cast("double") / exact)) + 1))
    return F.when(size <= exact, size).otherwise((F.floor(size / step) * step).cast("long"))


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """One row for each input row: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes (null: none) plus ``overhead``. Law is ``bytes``: shards'
    sums of sizes are near equal, as far as the largest group allows. Equal texts share a
    shard; null is a text of its own kind only in name: it is placed with the empty text.
    Slots run from 0 without gaps in each shard, by ``key`` (nulls first) within parts.
    Repeated rows get a slot each. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = settle(df.select(F.col(key).alias("key"), *text_key(text), (F.octet_length(plain) + F.lit(overhead)).cast("long").alias("size"), F.crc32(plain.cast("binary")).alias("text_crc32")), "sizes")
    groups = rows.groupBy("key_a", "key_b").agg(F.sum("size").alias("held"))
    groups = groups.withColumn("kind", size_class(F.col("held"), exact_up_to(shards)))
    common = groups.groupBy("kind").agg(F.ceil(F.count("*") / PART).cast("int").alias("salts")).where("salts > 1")
    # at most a row for each class, and classes are bounded by exact_up_to for each doubling of size
    salted = groups.join(F.broadcast(common), "kind", "left")
    groups = salted.withColumn("salt", F.pmod(F.col("key_b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    groups = settle(groups.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "salt").orderBy("key_a", "key_b"))), "groups")
    histogram = [tuple(r) for r in groups.groupBy("kind", "salt").agg(F.count("*"), F.sum("held")).collect()]
    plan = list(zip(*schedule(histogram, shards), strict=True)) or [()] * 4
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    planned = spark.createDataFrame(pa.table({n: pa.array(c, k) for n, c, k in zip(("kind", "salt", "to", "last"), plan, kinds, strict=True)}))
    before = F.size(F.filter("last", lambda x: x < F.col("rank")))
    placed = groups.join(planned, ["kind", "salt"]).select("key_a", "key_b", F.get("to", before).alias("shard"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.join(placed, ["key_a", "key_b"]).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")), "dealt")
    before = Window.partitionBy("shard").orderBy("part")
    offsets = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(before) - F.col("n")).select("shard", "part", "offset")
    within = Window.partitionBy("shard", "part").orderBy("key", "text_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(within)).join(offsets, ["shard", "part"])
    return ranked.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
