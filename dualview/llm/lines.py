"""Line dedup by a deletion-neighbourhood join.

A line goes if the same line, or one within one edit (a code point replaced, added or
dropped), stands earlier: in a row of smaller key, or higher up in the same row. What
counts is that the earlier line exists, not that it stays. Lines of fewer than
``min_chars`` code points are left alone.

Two lines within one edit agree after a deletion: equal length, then both without the
place i; lengths one apart, then the longer without some place. So equal hashed variants
(with i in the first case) are exactly the candidates, every group hangs on its earliest
member, and no pairs of a group are listed. Emitting a variant for each place of each line
would be far more than the text; so variants are emitted twice, coarse and fine: first
with each of ``BLOCKS`` blocks deleted as a whole, and, where such a variant meets another
line, with single places of that block deleted. No pair is lost: its edit lies in a block.
Equal variants are verified by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_slices, named, settle

BLOCKS = 4
MIN_CHARS = 24
#: Bytes of text whose lines are hashed at once; their arrays stay in a core's cache.
SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64, ``n`` at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        both = []
        for base in (BASE, UNBASE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    """Fold small numbers into hashes and spread the bits."""
    for i, x in enumerate(more):
        h = h + np.asarray(x).astype(np.uint64) * np.uint64((BASE * (2 * i + 3)) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Lines:
    """Code points of a text, its long lines, and hashes of what is left without a stretch."""

    def __init__(self, text: str, min_chars: int):
        self.points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        n = len(self.points)
        stops = np.append(np.flatnonzero(self.points == 10), n)
        starts = np.append(0, stops[:-1] + 1)
        self.count = len(stops)
        self.no = np.flatnonzero(stops - starts >= max(1, min_chars))
        self.start, self.stop = starts[self.no], stops[self.no]
        power, self.inverse = powers(n + 2)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def without(self, start, stop, first, last):
        """Hash of the stretch start..stop less first..last; arrays broadcast."""
        left = (self.sums[first] - self.sums[start]) * self.inverse[start]
        return left + (self.sums[stop] - self.sums[last]) * self.inverse[start + (last - first)]

    def blocks(self, add: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the blocks, lines by BLOCKS, as the shorter (0) or longer (1) of a pair."""
        m = (self.stop - self.start - add)[:, None]
        j = np.arange(BLOCKS)
        return self.start[:, None] + j * m // BLOCKS, self.start[:, None] + (j + 1) * m // BLOCKS + add

    def coarse(self) -> np.ndarray:
        """Hashes of every line without each block, lines by 2 * BLOCKS."""
        out = []
        for add in (0, 1):
            first, last = self.blocks(add)
            h = self.without(self.start[:, None], self.stop[:, None], first, last)
            out.append(mix(h, (self.stop - self.start - add)[:, None], np.arange(BLOCKS)))
        return np.concatenate(out, axis=1)


def joined(texts: list[str], min_chars: int) -> tuple[Lines, list[bytes], np.ndarray, np.ndarray]:
    """Long lines of many texts, handled as one text: all its lines as bytes, and text and number of each long one.

    Hashes don't depend on where a line stands, so a slice takes one pass and not one for each text.
    """
    whole = "\n".join(texts)
    lines = Lines(whole, min_chars)
    counts = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    first = np.cumsum(counts) - counts
    pick = np.searchsorted(first, lines.no, side="right") - 1
    rows = whole.encode().split(b"\n")
    return lines, [rows[i] for i in lines.no.tolist()], pick, lines.no - first[pick]


def line_keys(rows: list[bytes]) -> np.ndarray:
    """128-bit identity of each line, as pairs of int64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, rows)), dtype=np.int64).reshape(-1, 2)


def _scan(docs: DataFrame, key: str, text: str, min_chars: int, extra: str) -> DataFrame:
    """(doc, mark, no, a, b) of every long line, with its coarse hashes or its text."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).where("text is not null")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, found, pick, no = joined(batch.column(2).to_pylist(), min_chars)
        pick, ids = pa.array(pick), line_keys(found)
        out = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(no.astype(np.int32)), pa.array(np.ascontiguousarray(ids[:, 0])), pa.array(np.ascontiguousarray(ids[:, 1]))]
        names = ["doc", "mark", "no", "a", "b"]
        if extra == "keys":
            flat = lines.coarse().view(np.int64).reshape(-1)
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * BLOCKS, dtype=np.int32)), pa.array(flat)))
            names.append("keys")
        elif extra == "line":
            out.append(pa.array(found, type=pa.string()))
            names.append("line")
        return pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc {kind}, mark long, no int, a long, b long" + {"keys": ", keys array<long>", "line": ", line string", "": ""}[extra]
    return map_slices(rows, "text", step, schema, most=SLICE)


def meeting(distinct: DataFrame) -> DataFrame:
    """(a, b, slot) of the coarse variants that some other line has too.

    Rows of a key that already met in their batch are known to meet; only one of them is
    sent to the key's own partition, the others anywhere, so a crowded key is spread.
    """
    width = 2 * BLOCKS

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), width)
            slot = np.tile(np.arange(width, dtype=np.int32), n)
            order = np.argsort(key, kind="stable")
            key, row, slot = key[order], row[order], slot[order]
            again = np.concatenate(([False], key[1:] == key[:-1]))
            met = again.copy()
            met[:-1] |= again[1:]
            a, b = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            # a place of their own for those not needed at the key; they count as met wherever they come
            at = np.where(again, mix(a.view(np.uint64), slot).view(np.int64), key)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, a, b, slot, met)], names=["at", "a", "b", "slot", "met"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that may yet meet the next
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if last is not None:
                cols = [np.concatenate((x, c)) for x, c in zip(last, cols, strict=True)]
            at, a, b, slot, met = cols
            met = met.astype(bool)
            same = at[1:] == at[:-1]
            met[1:] |= same
            met[:-1] |= same
            out = np.flatnonzero(met[:-1])
            last = [c[-1:] for c in (at, a, b, slot, met)]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(a[out]), pa.array(b[out]), pa.array(slot[out])], names=["a", "b", "slot"])
        if last is not None and last[4][0]:
            yield pa.RecordBatch.from_arrays([pa.array(last[i]) for i in (1, 2, 3)], names=["a", "b", "slot"])

    rows = distinct.select("a", "b", "keys").mapInArrow(explode, "at long, a long, b long, slot int, met boolean")
    return rows.repartition("at").sortWithinPartitions("at").mapInArrow(runs, "a long, b long, slot int").distinct()


def fine(met: DataFrame) -> DataFrame:
    """Variants with one place deleted, from (a, b, first, slots, line): vkey, kind, first, a, b.

    kind 0: of a replaced place; 1: the line itself; 2: the line without one place.
    """
    first_kind = met.schema["first"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, kinds, held = [], [], [], 0
            for i, (slots, line) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                lines = Lines(line, 1)
                n = len(lines.points)
                bounds = [lines.blocks(0), lines.blocks(1)]
                for slot in slots:
                    add, j = divmod(slot, BLOCKS)
                    at = np.arange(bounds[add][0][0, j], bounds[add][1][0, j])
                    h = lines.without(np.zeros_like(at), np.full_like(at, n), at, at + 1)
                    if add == 0:
                        keys.append(mix(h, n, at, 1))
                        kinds.append(np.zeros(len(at), dtype=np.int8))
                    else:
                        keys.append(np.unique(mix(h, n - 1, 2)))
                        kinds.append(np.full(len(keys[-1]), 2, dtype=np.int8))
                    rows.append(np.full(len(keys[-1]), i))
                if any(s < BLOCKS for s in slots):
                    keys.append(mix(lines.sums[-1:], n, 2))
                    kinds.append(np.ones(1, dtype=np.int8))
                    rows.append(np.full(1, i))
                held += n * len(slots)
                if held > 1 << 18:
                    yield pack(batch, rows, keys, kinds)
                    rows, keys, kinds, held = [], [], [], 0
            if rows:
                yield pack(batch, rows, keys, kinds)

    def pack(batch, rows, keys, kinds) -> pa.RecordBatch:
        pick = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds)), batch.column(2).take(pick), batch.column(0).take(pick), batch.column(1).take(pick)], names=["vkey", "kind", "first", "a", "b"])

    return met.select("a", "b", "first", "slots", "line").mapInArrow(run, f"vkey long, kind tinyint, first {first_kind}, a long, b long")


def near(docs: DataFrame, distinct: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(a, b) of distinct lines that have an earlier line within one edit."""
    slots = meeting(distinct).groupBy("a", "b").agg(F.collect_set("slot").alias("slots"))
    wanted = slots.join(distinct.select("a", "b", "first"), ["a", "b"])
    texts = _scan(docs, key, text, min_chars, "line").withColumn("at", F.struct("doc", "mark", "no")).select("a", "b", "at", "line")
    met = settle(wanted.join(texts, ["a", "b"]).where(F.col("at").eqNullSafe(F.col("first"))).dropDuplicates(["a", "b"]).select("a", "b", "first", "slots", "line"), "met")
    variants = settle(fine(met), "variants")
    who = F.struct("first", "a", "b")
    heads = variants.groupBy("vkey").agg(F.min(F.when(F.col("kind") != 2, who)).alias("one"), F.min(F.when(F.col("kind") != 1, who)).alias("two"), F.count("*").alias("n")).where("n > 1")
    partner = F.when(F.col("kind") == 1, F.col("two")).otherwise(F.col("one"))
    pairs = variants.join(heads, "vkey").withColumn("partner", partner).where(F.col("partner.first") < F.col("first"))
    pairs = pairs.select("a", "b", F.col("partner.a").alias("pa"), F.col("partner.b").alias("pb")).distinct()
    lines = met.select("a", "b", "line")
    other = met.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("line").alias("earlier"))
    checked = pairs.join(lines, ["a", "b"]).join(other, ["pa", "pb"]).where(F.levenshtein("line", "earlier", 1) >= 0)
    return checked.select("a", "b").distinct()


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, mark, removed): line numbers to remove, ascending, for every row that loses any.

    Lines are what line feeds separate, numbered from 0. ``mark`` is the text's hash, so
    that rows sharing a key are told apart; rows equal in key and text are one row and lose
    the same lines. Null keys come first. Null and empty texts lose nothing. Extra columns
    don't matter.
    """
    occurrence = F.struct("doc", "mark", "no")
    distinct = _scan(docs, key, text, min_chars, "keys").groupBy("a", "b").agg(F.min(occurrence).alias("first"), F.first("keys").alias("keys"), F.count("*").alias("n"))
    distinct = settle(distinct, "lines")
    gone = near(docs, distinct, key, text, min_chars).withColumn("near", F.lit(True))
    # only lines that lose an occurrence, as a table of its own, so that the join can split a crowded line
    known = settle(distinct.select("a", "b", "first", "n").join(gone, ["a", "b"], "left").where("n > 1 or near").select("a", "b", "first", "near"), "losing")
    seen = _scan(docs, key, text, min_chars, "").join(known, ["a", "b"])
    out = seen.where(F.col("near") | ~occurrence.eqNullSafe(F.col("first")))
    return out.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("no")).alias("removed"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without its later duplicate lines; all rows and columns stay, a null text stays null."""
    found = removed_lines(docs, key, text, min_chars)
    rest = [c for c in docs.columns if c != text]
    # a batch holds each text once: the row's other columns travel beside it
    rows = docs.select(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"), F.col(text).alias("text"), F.col(key).alias("key"), F.xxhash64(text).alias("own"))
    joined = rows.join(found, rows["key"].eqNullSafe(found["doc"]) & (rows["own"] == found["mark"]), "left").select("row", "text", "removed")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if removed:
                gone = set(removed)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
            out.append(t)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "kept"])

    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("kept", T.StringType())])
    cut = map_slices(joined, "text", step, schema)
    return cut.select(*[(F.col("kept") if c == text else F.col("row").getField(f"c{rest.index(c)}")).alias(c) for c in docs.columns])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``key``, n_lines, n_removed and the removed line numbers of every row."""
    found = removed_lines(docs, key, text, min_chars).withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    rows = docs.select(F.col(key).alias("key"), lines.cast("long").alias("n_lines"), F.xxhash64(text).alias("mark"))
    joined = rows.join(found, rows["key"].eqNullSafe(found["_doc"]) & (rows["mark"] == found["_mark"]), "left")
    return joined.select(F.col("key").alias(key), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.concat_ws(",", F.col("removed").cast("array<string>")), F.lit("")).alias("removed"))
