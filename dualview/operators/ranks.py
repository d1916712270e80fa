"""Every row's rank under several scores: ids are sorted once for all scores, ties are counted, and what is written is compressed."""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking
from .settled import settle, small_batches

#: Rows of a range of ids, rows that lie in a range of scores, and rows that a task sorts before it deals them out.
PART, SPAN, HELD = 1 << 18, 1 << 21, 1 << 20
#: Bytes of ids in a range of ids at most, and in the rows that a task sorts.
PART_BYTES, HELD_BYTES = 64 << 20, 128 << 20
#: Rows of a piece that is unpacked at once; sampled rows for each range of ids.
PIECE, SAMPLED = 1 << 16, 32

_LAST = np.int64(2**63 - 1)
_HEAD = "<qqBB"
_PACKED = "part int, kind int, at int, n long, data array<binary>"
_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("data", pa.list_(pa.binary()))])


def ranked_by_each(df: DataFrame, id: str, scores: Sequence[str], parts: int | None = None, spans: int | None = None) -> DataFrame:
    """One row (model, id, rank, n, rank_percentile) for each row and score, ``model`` being the score's name.

    Ranks go by (score, id) with nulls last. ``id`` is a string; rows alike in both take following ranks.

    A small table takes one window for each score. Of a larger one each row is written and shuffled once, not once for each score:
    rows are dealt out by ranges of ids, which are sorted and settled. Each range counts its rows by score. These counts, summed
    in the order of (score, range), give the rank at which a range's rows of a score begin; the rest is counted along the range.
    """
    narrow = df.select(F.col(id).alias("id"), *[F.col(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)])
    m, rows = len(scores), None
    if parts is None:
        size = ranking.estimated_bytes(narrow)
        if size * m <= ranking.RANGE:
            each = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(f"s{i}").alias("score")) for i, s in enumerate(scores)]))
            return ranking.ranked(narrow.select("id", each.alias("m")).select("m.model", "id", "m.score"), ["model"], [F.col("score").asc_nulls_last(), F.col("id").asc_nulls_last()], 1).select("model", "id", "rank", "n", "rank_percentile")
        rows = size // (32 + 8 * m)
        parts, spans = -(-rows // PART), -(-rows // SPAN)
    small_batches(df.sparkSession)
    sample = narrow.sample(min(1.0, SAMPLED * parts / rows) if rows else 1.0, 1).toArrow()
    ids = sorted(sample.column("id").drop_null().to_pylist())
    if rows:
        parts = max(parts, -(-rows * sum(map(len, ids)) // (max(1, len(ids)) * PART_BYTES)))
    bounds = [ids[len(ids) * i // parts] for i in range(1, parts)] if ids else []
    edges = []
    for i in range(m):
        keys = np.sort(score_keys(sample.column(f"s{i}").combine_chunks()))
        edges.append(np.unique(keys[[len(keys) * j // spans for j in range(1, spans)]]) if len(keys) else keys)

    packed = narrow.mapInArrow(lambda b: _dealt(b, bounds, m), _PACKED)
    placed = settle(packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lambda b: _sorted(b, edges), _PACKED), "ranks", True)
    counted = placed.where(F.col("kind") < m)
    totals, before = {i: 0 for i in range(m)}, {}
    for r in counted.groupBy("kind", "at").agg(F.sum("n").alias("n")).orderBy("kind", "at").collect():
        before[r["kind"], r["at"]] = totals[r["kind"]]
        totals[r["kind"]] += r["n"]
    starts = counted.repartition(max(1, len(before)), "kind", "at").groupBy("kind", "at").applyInArrow(lambda t: _starts(t, before), _PACKED)
    told = placed.where(F.col("kind") == m).unionByName(starts).repartition(parts, "part").sortWithinPartitions("part", "kind", "at")
    wide = told.mapInArrow(lambda b: _ranks(b, m), f"id string, {', '.join(f'r{i} long' for i in range(m))}")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(f"r{i}").alias("rank")) for i, s in enumerate(scores)]))
    long = wide.select("id", each.alias("m")).select("m.model", "id", "m.rank", F.lit(totals[0]).cast("long").alias("n"))
    return long.withColumn("rank_percentile", F.col("rank") / F.col("n"))


def score_keys(column: pa.Array) -> np.ndarray:
    """Whole numbers in the order of doubles: -0.0 is 0.0, NaN follows all numbers, null comes last."""
    x = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False) + 0.0
    x[np.isnan(x)] = np.nan
    keys = _mirrored(x.view(np.int64))
    keys[pc.is_null(column).to_numpy(zero_copy_only=False)] = _LAST
    return keys


def _mirrored(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as whole numbers in their order, and back."""
    return bits ^ ((bits >> 63) & _LAST)


def squeezed(values: np.ndarray, rising: bool = False, scale: int = 0) -> bytes:
    """64-bit whole numbers, or the steps of rising ones, less the least, as byte planes."""
    u = values.view(np.uint64)
    if rising:
        u = np.diff(u, prepend=np.uint64(0))
    base = u.view(np.int64).min() if len(u) else np.int64(0)
    if rising and len(u):
        base, u = u.view(np.int64)[0], np.concatenate((np.zeros(1, np.uint64), u[1:]))
    else:
        u = u - base.view(np.uint64)
    width = (int(u.max()).bit_length() + 7) // 8 if len(u) else 0
    planes = np.ascontiguousarray(u.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack(_HEAD, len(u), int(base), width, scale) + (pa.compress(planes, codec="zstd", asbytes=True) if width else b"")


def expanded(data: bytes, rising: bool = False) -> np.ndarray:
    """The numbers that ``squeezed`` was given."""
    n, base, width, _ = struct.unpack_from(_HEAD, data)
    planes = np.zeros((n, 8), np.uint8)
    if width:
        raw = pa.decompress(memoryview(data)[struct.calcsize(_HEAD) :], decompressed_size=n * width, codec="zstd", asbytes=True)
        planes[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    u = planes.reshape(-1).view(np.uint64)
    if rising:
        u = np.cumsum(u, dtype=np.uint64)
    return (u + np.int64(base).view(np.uint64)).view(np.int64)


def squeezed_scores(keys: np.ndarray, rising: bool = False) -> bytes:
    """Keys of scores; where all are whole numbers or hundredths, exactly, these instead."""
    x = _mirrored(keys).view(np.float64)
    with np.errstate(all="ignore"):
        for scale in (1, 100):
            c = np.rint(x * scale)
            if (np.abs(c) < 2**53).all() and (_mirrored((c / scale).view(np.int64)) == keys).all():
                return squeezed(c.astype(np.int64), rising, scale)
    return squeezed(keys, rising)


def expanded_scores(data: bytes, rising: bool = False) -> np.ndarray:
    """The keys that ``squeezed_scores`` was given."""
    values, scale = expanded(data, rising), struct.unpack_from(_HEAD, data)[3]
    return _mirrored((values / scale).view(np.int64)) if scale else values


def squeezed_ids(ids: pa.Array) -> list[bytes]:
    """Strings as lengths, 0 for null, and text."""
    lengths = pc.fill_null(pc.add(pc.binary_length(ids).cast(pa.int64()), 1), 0).to_numpy(zero_copy_only=False)
    text = _text(ids)
    return [squeezed(lengths), struct.pack("<q", len(text)) + pa.Codec("zstd", 3).compress(text, asbytes=True)]


def _text(ids: pa.Array) -> pa.Buffer:
    ids = pc.fill_null(ids, "")
    _, offsets, data = ids.buffers()
    edges = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1]
    return data.slice(int(edges[0]), int(edges[-1] - edges[0])) if data else pa.py_buffer(b"")


def expanded_ids(lengths: bytes, text: bytes) -> pa.Array:
    """The strings that ``squeezed_ids`` was given."""
    sizes = expanded(lengths)
    data = pa.decompress(memoryview(text)[8:], decompressed_size=struct.unpack_from("<q", text)[0], codec="zstd")
    offsets = np.concatenate(([0], np.cumsum(np.maximum(sizes - 1, 0)))).astype(np.int32)
    nulls = sizes == 0
    valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes()) if nulls.any() else None
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), data, valid)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def _batches(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r[4]))
        if size >= most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def cuts(ids: pa.Array, bounds: Sequence[str]) -> list[int]:
    """Where each range of sorted ids begins, and the end. An id that is several bounds is dealt evenly over the ranges between them."""
    n = len(ids) - ids.null_count
    at = lambda i: ids[i].as_py()
    found, i, view = [0], 0, range(n)
    while i < len(bounds):
        same = bisect_right(bounds, bounds[i], i) - i
        left, right = bisect_left(view, bounds[i], key=at), bisect_right(view, bounds[i], key=at)
        found += [left + (right - left) * (j + 1) // same for j in range(same)]
        i += same
    return [*found, len(ids)]


def _in_order(ids: pa.Array, keys: list[np.ndarray]) -> tuple[pa.Array, list[np.ndarray]]:
    order = pc.array_sort_indices(ids, null_placement="at_end")
    at = order.to_numpy()
    return ids.take(order), [k[at] for k in keys]


def _dealt(batches: Iterator[pa.RecordBatch], bounds: Sequence[str], m: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, scores) as pieces of ranges of ids."""

    def pieces(held: list[pa.RecordBatch]) -> Iterator[tuple]:
        ids, *columns = [c.combine_chunks() for c in pa.Table.from_batches(held).columns]
        held.clear()
        ids, keys = _in_order(ids, [score_keys(c) for c in columns])
        edges = cuts(ids, bounds)
        for part, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                yield part, m, 0, b - a, [*squeezed_ids(ids.slice(a, b - a)), *[squeezed_scores(k[a:b]) for k in keys]]

    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= HELD or size >= HELD_BYTES:
            yield from _batches(pieces(held))
            held, rows, size = [], 0, 0
    if rows:
        yield from _batches(pieces(held))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        part, kind, at, n = (batch.column(i).to_numpy() for i in range(4))
        for i in range(batch.num_rows):
            yield int(part[i]), int(kind[i]), int(at[i]), int(n[i]), batch.column(4)[i].as_py()


def _sorted(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each range of ids in order, cut into pieces, and its counts by score, cut at ``edges``."""
    m = len(edges)

    def pieces(part: int, held: list[list[bytes]]) -> Iterator[tuple]:
        ids = pa.concat_arrays([expanded_ids(*d[:2]) for d in held])
        keys = [np.concatenate([expanded_scores(d[2 + i]) for d in held]) for i in range(m)]
        held.clear()
        ids, keys = _in_order(ids, keys)
        for i, k in enumerate(keys):
            values, counts = np.unique(k, return_counts=True)
            spans = np.concatenate(([0], np.searchsorted(values, edges[i], "right"), [len(values)]))
            for at, (a, b) in enumerate(zip(spans, spans[1:])):
                if a < b:
                    yield part, i, at, int(counts[a:b].sum()), [squeezed_scores(values[a:b], True), squeezed(counts[a:b].astype(np.int64))]
        for at, a in enumerate(range(0, len(ids), PIECE)):
            piece = ids.slice(a, PIECE)
            yield part, m, at, len(piece), [*squeezed_ids(piece), *[squeezed_scores(k[a : a + PIECE]) for k in keys]]

    last, held = None, []
    for part, _, _, _, data in _rows(batches):
        if part != last and held:
            yield from _batches(pieces(last, held))
            held = []
        last = part
        held.append(data)
    if held:
        yield from _batches(pieces(last, held))


def _starts(table: pa.Table, before: dict[tuple[int, int], int]) -> pa.Table:
    """Counts of one span of a score in all ranges of ids, as the number of rows before each of them in the order of (score, range)."""
    rows = sorted(_rows(table.to_batches()), key=lambda r: r[0])
    kind, at = rows[0][1:3]
    values, counts = [expanded_scores(r[4][0], True) for r in rows], np.concatenate([expanded(r[4][1]) for r in rows])
    order = np.argsort(np.concatenate(values), kind="stable")
    ends = np.cumsum(counts[order])
    starts = np.empty(len(order), np.int64)
    starts[order] = ends - counts[order] + before[kind, at]
    pieces = np.split(starts, np.cumsum([len(v) for v in values])[:-1])
    return pa.Table.from_batches([_batch([(r[0], kind, at, r[3], [r[4][0], squeezed(s, True)]) for r, s in zip(rows, pieces, strict=True)])])


def _ranks(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """Ids and their ranks, from the starts of a range of ids and its pieces in order."""
    last, told, values, starts = None, [], [], []
    for part, kind, _, _, data in _rows(batches):
        if part != last:
            last, told, values = part, [([], []) for _ in range(m)], []
        if kind < m:
            told[kind][0].append(expanded_scores(data[0], True))
            told[kind][1].append(expanded(data[1], True))
            continue
        if not values:
            values, starts = [np.concatenate(t[0]) for t in told], [np.concatenate(t[1]) for t in told]
        found = []
        for i in range(m):
            spot = np.searchsorted(values[i], expanded_scores(data[2 + i]))
            order = np.argsort(spot, kind="stable")
            own = spot[order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            many = np.diff(first, append=len(own))
            ranks = np.empty(len(own), np.int64)
            ranks[order] = starts[i][own] + np.arange(1, len(own) + 1) - np.repeat(first, many)
            starts[i][own[first]] += many
            found.append(pa.array(ranks))
        yield pa.RecordBatch.from_arrays([expanded_ids(*data[:2]), *found], names=["id", *[f"r{i}" for i in range(m)]])
