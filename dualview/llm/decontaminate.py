"""Benchmark decontamination by q-gram lemma filtering over diagonal bands.

A text and a benchmark item are normalised (A-Z lower-cased, white space runs to one space)
and read as UTF-8 bytes. If some region of the text is within k edits of an item of n
bytes, the two share at least (n - q + 1) - k*q q-grams, whose diagonals (place in the
text less place in the item) lie within k of each other. Hits are counted in overlapping
bands of 2(k+1) diagonals, one starting every k+1, so one band holds them all; bands that
reach the count give regions, neighbours are joined, and a banded alignment of each decides.

An item that repeats a gram often would meet a text like it at every pair of places. It is
counted by its different grams instead, in overlapping blocks of 2(n+k) bytes: k edits
destroy at most k*q grams, so only so many different ones, the rarest within it first.

The items' q-gram table goes to the executors whole while it is below ``TABLE_BYTES``;
a larger benchmark is worked through in blocks of items below that bound, one after another,
each with a scan of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, named, slices

Q = 8
#: Most bytes of items that one broadcast table holds.
TABLE_BYTES = 16 << 20
#: An item in which a gram stands more often than this is counted by different grams.
REPEATS = 8
#: Bytes of text whose hits are held at once; diagonals that one alignment covers.
SEGMENT, SPAN = 1 << 20, 1 << 16

#: Lower case for A-Z; the other white space of bytes.split becomes a space.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def normalise(text: str) -> bytes:
    """Lower-case A-Z; white space runs become one space; none at the ends."""
    return b" ".join(text.encode().translate(_LOWER).split())


def grams(data: bytes) -> np.ndarray:
    """Every q-gram of 8 bytes as one integer."""
    if len(data) < Q:
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray((len(data) - Q + 1,), dtype="<u8", buffer=data, strides=(1,)).astype(np.uint64)


class Items:
    """q-gram table of benchmark items: grams by hash slot, with a bit filter before it.

    ``shift`` is a gram's place in its item, 0 in items counted by blocks; ``mark`` tells the
    grams of an item apart.
    """

    def __init__(self, items: list[tuple[int, bytes]], share: float):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.budget = np.array([int(share * n) for n in sizes], dtype=np.int64)
        self.needed = np.maximum(1, sizes - Q + 1 - self.budget * Q)
        self.step = self.budget + 1
        parts: list[tuple] = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
        for i, t in enumerate(self.texts):
            g = grams(t)
            kinds, counts = np.unique(g, return_counts=True)
            place = np.arange(len(g))
            shift = place
            if counts.max(initial=0) > REPEATS:
                lost = int(np.searchsorted(np.cumsum(np.sort(counts)), self.budget[i] * Q, side="right"))
                self.needed[i], self.step[i] = max(1, len(kinds) - lost), len(t) + self.budget[i]
                g, place = kinds, np.arange(len(kinds))
                shift = np.zeros(len(kinds), np.int64)
            parts.append((g, np.full(len(g), i), shift, place))
        gram, item, shift, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
        #: What a region can span at most, with a gram to spare.
        self.reach = int((sizes + self.budget).max(initial=0)) + Q
        self.width = max(16, int(len(gram)).bit_length() + 4)
        slot = self.slot(gram)
        order = np.argsort(slot, kind="stable")
        self.gram, self.item, self.shift, self.mark = (x[order] for x in (gram, item, shift, mark))
        counts = np.bincount(slot.astype(np.int64), minlength=1 << self.width)
        self.bits = counts > 0
        self.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.width)

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place in data, row of the table) of all shared q-grams."""
        g = grams(data)
        slot = self.slot(g)
        at = np.flatnonzero(self.bits[slot])
        slot = slot[at]
        low = self.first[slot].astype(np.int64)
        count = self.first[slot + np.uint64(1)] - low
        which = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        at = np.repeat(at, count)
        same = self.gram[which] == g[at]
        return at[same], which[same]

    def bands(self, data: bytes, base: int) -> np.ndarray:
        """Item and number, in one integer, of every band with enough different shared q-grams; ``data`` starts at ``base``."""
        at, which = self.hits(data)
        if len(at) < self.needed.min(initial=1 << 30):
            return np.zeros(0, np.int64)
        item = self.item[which]
        # each hit counts in the band that starts at its step and in the one before
        own = (item << 40) + (at + base - self.shift[which]) // self.step[item] + (1 << 39)
        key, mark = np.concatenate((own, own - 1)), np.concatenate((self.mark[which],) * 2)
        found, of, count = np.unique(key, return_inverse=True, return_counts=True)
        enough = (count >= self.needed[found >> 40])[of]
        key, mark = key[enough], mark[enough]
        # a gram that the text repeats counts once
        order = np.lexsort((mark, key))
        key, mark = key[order], mark[order]
        key = key[np.concatenate(([True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])))[: len(key)]]
        found, count = np.unique(key, return_counts=True)
        return found[count >= self.needed[found >> 40]]

    def regions(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, diagonals) of runs of bands that hold enough shared q-grams, by item and place."""
        parts = [np.zeros(0, np.int64)]
        for lo in range(0, max(1, len(data)), SEGMENT):
            parts.append(self.bands(data[lo : lo + SEGMENT + self.reach], lo))
        keys = np.unique(np.concatenate(parts))
        item, band = keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 39)
        fresh = np.flatnonzero(np.concatenate(([True], np.diff(keys) > 1))[: len(keys)]).tolist()
        for a, b in zip(fresh, [*fresh, len(keys)][1:], strict=True):
            i = int(item[a])
            step = int(self.step[i])
            each = max(1, SPAN // step)
            for lo in range(a, b, each):
                yield i, int(band[lo]) * step, (min(b, lo + each) - lo + 1) * step

    def matches(self, data: bytes) -> dict[int, tuple[int, int, int]]:
        """Best (edits, first, last) by item, for items that a region of ``data`` is within budget of."""
        best: dict[int, tuple[int, int, int]] = {}
        for i, diagonal, width in self.regions(data):
            if i in best and best[i][0] == 0:
                continue
            text, k = self.texts[i], int(self.budget[i])
            found = data.find(text, max(0, diagonal), max(0, diagonal) + width + len(text))
            hit = (0, found, found + len(text)) if found >= 0 else align(text, data, diagonal - k, diagonal + width + k, k)
            if hit:
                best[i] = min(best.get(i, hit), hit)
        return best


def align(item: bytes, data: bytes, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Least edits between the whole item and any region of data on diagonals low..high, if at most k.

    Row by row over the item, the band as one vector: deletions, matches and replacements
    come from the row above, insertions by a running minimum along the row.
    """
    width = high - low + 1
    big = 1 << 20
    pad = np.full(len(item) + width + 1, 256, dtype=np.int16)
    a, b = max(0, low), min(len(data), low + len(pad))
    if b > a:
        pad[a - low : b - low] = np.frombuffer(data[a:b], dtype=np.uint8)
    steps = np.arange(width)
    inside = (low + steps >= 0) & (low + steps <= len(data))
    row = np.where(inside, 0, big)
    start = low + steps
    for r, c in enumerate(item):
        cost = row + (pad[r : r + width] != c)
        cost[pad[r : r + width] == 256] = big
        up = np.concatenate((row[1:] + 1, [big]))
        take = up < cost
        best = np.where(take, up, cost)
        begun = np.where(take, np.concatenate((start[1:], [0])), start)
        lowest = np.minimum.accumulate((best - steps) * width + steps)  # the least, and where from
        source = lowest % width
        row = best[source] + steps - source
        start = begun[source]
        if row.min() > k:
            return None
    end = int(row.argmin())
    edits = int(row[end])
    return (edits, int(start[end]), low + end + len(item)) if edits <= k else None


def matches(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each input row and item found in it: ``key``, item_id, edits, first, last.

    An item is found if a region of the text is within ``share`` of the item's bytes in
    edits; first and last are byte places in the normalised text. Items shorter than 24
    bytes after normalising, null ones and null texts match nothing. Repeated rows match
    each on their own; a repeated item id matches if any of its texts does.
    """
    _check(share)
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key), F.col(text).alias("text")).where("text is not null")
    schema = f"`{key}` {kind}, item_id long, edits int, first long, last long"
    blocks = item_blocks(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")))
    out = spark.createDataFrame([], schema)
    for n, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(Items(block, share))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items: Items = sent.value
            for batch in batches:
                for piece in slices(batch, "text"):
                    keys, found = [], []
                    for j, t in enumerate(piece.column(1).to_pylist()):
                        best: dict[int, tuple[int, int, int]] = {}
                        for i, hit in items.matches(normalise(t)).items():
                            best[items.ids[i]] = min(best.get(items.ids[i], hit), hit)
                        for i, hit in sorted(best.items()):
                            keys.append(j)
                            found.append((i, *hit))
                    if found:
                        cols = list(zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(keys)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=[key, "item_id", "edits", "first", "last"])

        part = rows.mapInArrow(run, schema)
        out = part if n == 0 else out.unionByName(part)
    return out


def item_blocks(items: DataFrame, most: int = TABLE_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of at most ``most`` bytes; one block at a time on the driver."""
    held, size = [], 0
    for row in items.where("item is not null and text is not null").toLocalIterator():
        data = normalise(row["text"])
        if len(data) < 24:
            continue
        if held and size + len(data) > most:
            yield held
            held, size = [], 0
        held.append((int(row["item"]), data))
        size += len(data)
    if held:
        yield held


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, all columns kept.

    Each row is judged by its own text, so repeated ids and null ids are no matter; equal
    texts go or stay together. Null and empty texts stay.
    """
    _check(share)
    at = docs.columns.index(text)
    out = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = out.schema
    for block in item_blocks(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))):
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, share))

        def step(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            good = [t is None or not sent.value.matches(normalise(t)) for t in batch.column(at).to_pylist()]
            return batch.filter(pa.array(good, pa.bool_()))

        out = map_slices(out, f"c{at}", step, schema)
    return out.toDF(*docs.columns)


def _check(share: float) -> None:
    if not 0 <= share < 1 / Q:
        raise ValueError("share must be in [0, 1/8): beyond, the q-gram lemma asks for no shared q-gram")
