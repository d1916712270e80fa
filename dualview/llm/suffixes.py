"""Suffix-array dedup with a logarithmic family of indexes.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else.
Equal strings of that length hold the same least-hashed gram at the same place, so each
text is cut into stretches whose strings share that gram (its anchor), and stretches with
an anchor seen once only are done with. The others, equal ones as one row with a count,
are dealt by anchor. In each task a family of suffix arrays takes them in batches: a
batch gets a suffix array over the places where its strings start, is merge-scanned
against every level held for common prefixes of ``length`` bytes, and levels of equal size
merge, so a place is sorted anew only logarithmically often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, parts_for, settle, text_key

LENGTH = 400
GRAM = 32
#: Bytes of a new batch of the family; bytes that a task should get; stretches beyond which an anchor is crowded.
BATCH, TASK, CROWD = 1 << 19, 2 << 20, 8192
#: Texts are scanned in segments of this many bytes, overlapping by what a string needs.
SEGMENT = 8 << 20

#: Changes the order of grams when stretches of a crowded anchor are cut again.
SALT = 0x5851F42D4C957F2D

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def gram_hashes(data: bytes, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every gram of ``GRAM`` bytes; each salt gives an order of its own."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)).astype(np.uint64)
    n = len(data) - GRAM + 1
    h = (eight[:n] ^ np.uint64(salt)) * _C[0]
    for i in range(1, GRAM // 8):
        h ^= h >> np.uint64(29)
        h += eight[8 * i : 8 * i + n]
        h *= _C[i]
    h ^= h >> np.uint64(32)
    h *= _C[0]
    return h ^ (h >> np.uint64(29))


def anchors(data: bytes, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ``data``: first start, number of starts and anchor hash of each.

    The anchor of the string at p is its gram of least hash, leftmost among equals. A
    stretch is a run of starts with one anchor.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, salt)
    w = length - GRAM + 1
    packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(packed) // w)
    block = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    block[: len(packed)] = packed
    block = block.reshape(rows, w)
    left = np.minimum.accumulate(block, axis=1).reshape(-1)
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    at = (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return start, np.diff(np.append(start, n)), h[at[start]]


def stretches(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of texts of any size, by segments."""
    if len(data) <= SEGMENT:
        return anchors(data, length)
    parts = []
    for lo in range(0, len(data) - length + 1, SEGMENT):
        s, r, h = anchors(data[lo : lo + SEGMENT + length - 1], length)
        parts.append((s + lo, r, h))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def by_key(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Order of uint64 keys of at most ``bits`` bits, and the keys in it."""
    n = len(keys)
    place = int(n).bit_length()
    if bits + place > 64:
        order = np.argsort(keys)
        return order, keys[order]
    # key and place in one word sort far faster than places by key
    ordered = np.sort((keys << np.uint64(place)) | np.arange(n, dtype=np.uint64))
    return (ordered & np.uint64((1 << place) - 1)).view(np.int64), ordered >> np.uint64(place)


def rank(keys: np.ndarray, bits: int = 64) -> np.ndarray:
    """Dense ranks of uint64 keys of at most ``bits`` bits, as uint64."""
    order, ordered = by_key(keys, bits)
    out = np.empty(len(keys), dtype=np.uint64)
    up = np.zeros(len(keys), dtype=np.uint64)
    np.cumsum(ordered[1:] != ordered[:-1], out=up[1:])
    out[order] = up
    return out


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as numbers that order like them; ``data`` has eight bytes to spare."""
    return np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))[at].astype(np.uint64)


def suffix_array(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``length`` bytes at ``places``, and which equal the one before in it.

    Ranks of prefixes double in length from five bytes on up to half the length or more; two
    that overlap give the rest. ``data`` has eight bytes to spare; what stands behind its end
    is never read for a place.
    """
    n = len(data) - 8
    size = int(n).bit_length()
    have = 5
    ranks = rank(words_at(data, np.arange(n)) >> np.uint64(24), 40)
    while have * 2 <= length:
        ranks = rank((ranks << np.uint64(size)) | np.append(ranks[have:], np.zeros(min(have, n), np.uint64)), 2 * size)
        have *= 2
    order, ordered = by_key((ranks[places] << np.uint64(size)) | ranks[places + length - have], 2 * size)
    return order, np.concatenate(([False], ordered[1:] == ordered[:-1]))


class Level:
    """A suffix array over the places where strings start: bytes, places in order of their strings, and which were met again.

    ``own`` numbers each place as it was added, so that merged levels keep track.
    """

    def __init__(self, data: np.ndarray, places: np.ndarray, own: np.ndarray, met: np.ndarray, length: int):
        order, same = suffix_array(data, places, length)
        self.data, self.places, self.own, self.met = data, places[order], own[order], met[order]
        self.met[same] = True
        self.met[np.flatnonzero(same) - 1] = True
        self.head = words_at(data, self.places)

    def __len__(self) -> int:
        return len(self.data) - 8


class Family:
    """The logarithmic family. ``add`` takes stretches; ``met`` tells their repeated starts."""

    def __init__(self, length: int = LENGTH, batch: int = BATCH):
        self.length, self.batch = length, batch
        self.levels: list[Level] = []
        self.open: list[bytes] = []
        self.size = 0
        self.bounds: list[int] = [0]
        self.done = 0
        self.merges = 0

    def add(self, stretch: bytes) -> None:
        self.open.append(stretch)
        self.size += len(stretch)
        self.bounds.append(self.bounds[-1] + len(stretch) - self.length + 1)
        if self.size >= self.batch:
            self.close()

    def close(self) -> None:
        """Index the open batch, scan it against each level, and merge levels of equal size."""
        if not self.open:
            return
        # levels merge when the next batch comes: after the last one nothing is to be scanned against them
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in ((a.data[:-8], b.data), (a.places, b.places + len(a)), (a.own, b.own), (a.met, b.met))]
            self.levels.append(Level(*both, self.length))
            self.merges += 1
        sizes = np.array([len(s) for s in self.open])
        base = np.cumsum(sizes) - sizes
        counts = sizes - self.length + 1
        places = np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        own = np.arange(self.done, self.done + len(places))
        self.done += len(places)
        new = Level(np.frombuffer(b"".join(self.open) + bytes(8), dtype=np.uint8), places, own, np.zeros(len(places), dtype=bool), self.length)
        self.open, self.size = [], 0
        for level in self.levels:
            self.scan(level, new)
        self.levels.append(new)

    def scan(self, level: Level, new: Level) -> None:
        """Merge-scan: the stretch of the level's array that agrees with each new string narrows by eight bytes at a time; what is left at the end are matches."""
        at = np.arange(len(new.places))
        low, high = (np.searchsorted(level.head, new.head, side=s) for s in ("left", "right"))
        for step in (*range(8, self.length - 7, 8), *((self.length - 8,) if self.length % 8 else ())):
            live = low < high
            at, low, high = at[live], low[live], high[live]
            if not len(at):
                return
            want = words_at(new.data, new.places[at] + step)
            low, high = (self.bound(level, step, want, low, high, s) for s in (np.less, np.less_equal))
        live = low < high
        at, low, high = at[live], low[live], high[live]
        new.met[at] = True
        edge = np.zeros(len(level.places) + 1, dtype=np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
        level.met |= np.cumsum(edge[:-1]) > 0

    @staticmethod
    def bound(level: Level, step: int, want: np.ndarray, low: np.ndarray, high: np.ndarray, before) -> np.ndarray:
        """First place in low..high of the level's array whose eight bytes at ``step`` are not ``before`` the wanted ones."""
        low, high = low.copy(), high.copy()
        left = np.arange(len(low))
        while len(left):
            middle = (low[left] + high[left]) >> 1
            up = before(words_at(level.data, level.places[middle] + step), want[left])
            low[left[up]] = middle[up] + 1
            high[left[~up]] = middle[~up]
            left = left[low[left] < high[left]]
        return low

    def met(self) -> Iterator[np.ndarray]:
        """For each stretch added, in order: a flag for each of its starts."""
        self.close()
        flags = np.zeros(self.done, dtype=bool)
        for x in self.levels:
            flags[x.own] = x.met
        for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            yield flags[a:b]


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _anchor_rows(docs: DataFrame, text: str, length: int) -> DataFrame:
    """(anchor, ka, kb, start) of every stretch of every text."""
    rows = docs.select(*text_key(text), F.col(text).alias("text")).where(F.octet_length(text) >= length)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        pick, start, anchor = [], [], []
        for i, t in enumerate(batch.column(2).to_pylist()):
            s, _, h = stretches(t.encode(), length)
            pick.append(np.full(len(s), i))
            start.append(s)
            anchor.append(h)
        pick = pa.array(np.concatenate(pick))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchor).view(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(np.concatenate(start))], names=["anchor", "key_a", "key_b", "start"])

    return map_slices(rows, "text", step, "anchor long, key_a long, key_b long, start long")


def _stretch_rows(texts: DataFrame, length: int) -> DataFrame:
    """Stretches of (key_a, key_b, text, starts) that begin at ``starts``: one row for each different one in a text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for ka, kb, t, starts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = t.encode()
            s, r, h = stretches(data, length)
            take = np.isin(s, np.array(starts, dtype=np.int64))
            own: dict[bytes, tuple] = {}
            for a, n, anchor in zip(s[take].tolist(), r[take].tolist(), h[take].view(np.int64).tolist(), strict=True):
                piece = data[a : a + n + length - 1]
                code = xxhash.xxh3_128_digest(piece)
                if code in own:
                    own[code][4].append(a)
                else:
                    own[code] = (ka, kb, code, anchor, [a], piece)
            out += own.values()
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["key_a", "key_b", "code", "anchor", "starts", "piece"])

    return map_slices(texts.select("key_a", "key_b", "text", "starts"), "text", step, "key_a long, key_b long, code binary, anchor long, starts array<long>, piece binary", most=1 << 20)


_RANGE = "code binary, first long, last long"


def _pack(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["code", "first", "last"])


def _family_ranges(pieces: DataFrame, length: int, batch: int) -> DataFrame:
    """(code, first, last): runs of starts in different stretches (code, at, piece) that were met again, by the family in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, codes = Family(length, batch), []
        for b in batches:
            for code, at, piece in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                codes.append((code, at))
                family.add(piece)
        found: list[tuple] = []
        for (code, at), flags in zip(codes, family.met(), strict=True):
            found += [(code, at + a, at + b) for a, b in ranges(flags)]
            if len(found) >= 50_000:
                yield _pack(found)
                found = []
        if found:
            yield _pack(found)

    return pieces.select("code", "at", "piece").mapInArrow(run, _RANGE)


def _cut_again(pieces: DataFrame, length: int) -> DataFrame:
    """(code, at, piece, anchor): stretches of crowded anchors cut once more, by the least gram in another order.

    Equal strings share both grams, so only stretches of one pair of them are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for code, anchor, piece in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s, r, h = anchors(piece, length, SALT)
                h = (h ^ np.uint64(anchor & 0xFFFFFFFFFFFFFFFF)) * _C[1]
                out += [(code, a, piece[a : a + n + length - 1], g) for a, n, g in zip(s.tolist(), r.tolist(), h.view(np.int64).tolist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["code", "at", "piece", "anchor"])

    rows = settle(pieces.select("code", "anchor", "piece").mapInArrow(run, "code binary, at long, piece binary, anchor long"), "again")
    sizes = rows.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    return rows.join(sizes, "anchor")


def _crowded_ranges(pieces: DataFrame, length: int) -> DataFrame:
    """The same for anchors crowded even then, whose strings are dealt one by one, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for code, at, piece in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(piece) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([digest(piece[i : i + length]) for i in range(n)], pa.binary()), pa.array([code] * n, pa.binary()), pa.array(np.arange(at, at + n))], names=["string", "code", "first"])

    rows = settle(pieces.select("code", "at", "piece").mapInArrow(run, "string binary, code binary, first long"), "strings")
    who = F.struct("code", "first")
    again = rows.groupBy("string").agg(F.min(who).alias("low"), F.max(who).alias("high")).where("low <> high").select("string")
    return rows.join(again, "string").select("code", "first", F.col("first").alias("last"))


def spans(docs: DataFrame, text: str = "text", length: int = LENGTH, batch: int = BATCH, task: int = TASK, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Repeated starts of each different text, and those texts.

    First table: (key_a, key_b, starts array<struct<first,last>>), runs of starts of strings
    of ``length`` bytes that occur elsewhere, in this text or another one. Second:
    (key_a, key_b, text) of the texts concerned. Copies of a whole text aren't counted
    here: the keys of ``text_key`` tell them.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    rows = settle(_anchor_rows(docs, text, length), "anchors")
    who = F.struct("key_a", "key_b", "start")
    # a table of its own, so that the join can split a crowded anchor
    again = settle(rows.groupBy("anchor").agg(F.min(who).alias("low"), F.max(who).alias("high")).where("low <> high").select("anchor"), "again")
    wanted = rows.join(again, "anchor").groupBy("key_a", "key_b").agg(F.collect_set("start").alias("starts"))
    distinct = docs.where(F.octet_length(text) >= length).select(*text_key(text), F.col(text).alias("text")).groupBy("key_a", "key_b").agg(F.first("text").alias("text"))
    texts = settle(distinct.join(wanted, ["key_a", "key_b"]), "texts")
    found = settle(_stretch_rows(texts, length), "stretches")
    pieces = found.groupBy("code").agg(F.first("anchor").alias("anchor"), F.sum(F.size("starts")).alias("n"), F.first("piece").alias("piece"))
    pieces = settle(pieces, "pieces")
    whole = pieces.where("n > 1").select("code", F.lit(0).cast("long").alias("first"), (F.octet_length("piece") - length).cast("long").alias("last"))
    sizes = pieces.groupBy("anchor").agg(F.count("*").alias("m"), F.max(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single"))
    # anchors with one stretch have nothing left to compare
    open_ = pieces.withColumn("at", F.lit(0).cast("long")).join(sizes.where("m > 1 and single = 1"), "anchor")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def families(rows: DataFrame) -> DataFrame:
        total = int(rows.agg(F.sum(F.octet_length("piece"))).first()[0] or 0)
        return _family_ranges(rows.repartition(parts_for(total, task, least), "anchor"), length, batch)

    met = whole.unionByName(families(open_.where(F.col("m") <= crowd)))
    if sizes.where(F.col("m") > crowd).limit(1).count():
        finer = settle(_cut_again(open_.where(F.col("m") > crowd), length), "finer")
        met = met.unionByName(families(finer.where(F.col("m") <= crowd)))
        if finer.where(F.col("m") > crowd).limit(1).count():
            met = met.unionByName(_crowded_ranges(finer.where(F.col("m") > crowd), length))
    placed = found.select("key_a", "key_b", "code", F.explode("starts").alias("start")).join(met, "code")
    runs = placed.select("key_a", "key_b", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")).alias("run"))
    return runs.groupBy("key_a", "key_b").agg(F.collect_set("run").alias("starts")), texts.select("key_a", "key_b", "text")


def union_of(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans (first, end) covered by the strings that start in the runs."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, carry: tuple = (), **sizes) -> DataFrame:
    """One row for each input row: ``key``, n_bytes, n_removed, n_spans, removed, kept, and the columns ``carry``.

    ``removed`` lists the maximal spans (first, end) of bytes taken out; ``kept`` is the
    rest as binary, null where nothing was taken out (the text itself stays). Null texts
    are empty; texts shorter than ``length`` lose nothing; of equal texts each loses all.
    Repeated rows are equal texts.
    """
    starts, texts = spans(docs, text, length, **sizes)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for ka, kb, t, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data, gone = t.encode(), union_of([(r["first"], r["last"]) for r in runs], length)
            edges = [0, *(x for s in gone for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((ka, kb, len(data) - len(kept), len(gone), [{"first": a, "end": b} for a, b in gone], kept))
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["key_a", "key_b", "n_removed", "n_spans", "removed", "kept"])

    done = map_slices(texts.join(starts, ["key_a", "key_b"]).select("key_a", "key_b", "text", "starts"), "text", step, "key_a long, key_b long, n_removed long, n_spans long, removed array<struct<first: long, end: long>>, kept binary")
    rows = docs.select(F.col(key).alias("key"), *text_key(text), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.struct(F.lit(0).alias("_none"), *carry).alias("carried"))
    copies = rows.where(F.col("n_bytes") >= length).groupBy("key_a", "key_b").agg(F.count("*").alias("copies")).where("copies > 1")
    joined = rows.join(done, ["key_a", "key_b"], "left").join(copies, ["key_a", "key_b"], "left")
    twice = F.col("copies").isNotNull()
    return joined.select(
        F.col("key").alias(key), *(F.col(f"carried.`{f.name}`") for f in rows.schema["carried"].dataType.fields[1:]), "n_bytes",
        F.when(twice, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(twice, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twice, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end")))).otherwise(F.col("removed")).alias("removed"),
        F.when(twice, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
