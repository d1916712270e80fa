"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are computed in batches. To find all pairs that differ in at most
``bits`` bits, the 64 bits are dealt to m partitions, correlated bits together, and each
partition i gets a threshold t_i >= -1 with sum(t_i + 1) = bits + 1: two fingerprints within
``bits`` are within t_i on some partition i. m and the t_i come from dynamic programming
over candidate counts estimated on a bounded sample of fingerprints; whatever is chosen,
the result is the same, only its cost differs. Partitions are probed by hashed keys, and
candidates are verified on all 64 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, named, numbered, settle, sorted_ranges, text_key
from .components import components

#: Fingerprints looked at to plan the partitions. The plan changes cost, never results.
PLAN_SAMPLE = 4096
#: Buckets beyond this many fingerprints are linked through variants instead of pairs.
BUCKET = 4096
WIDTH = 64
#: Shingles in more prefixes than this come last in their order, the commonest at the very end; so many at most.
COMMON = 4
MOST_COMMON = 1 << 18
#: Rounds in which near copies are compared with the least of their group only, and how many sets make a block after that.
HEAD_ROUNDS, SETS = 4, 256
#: Edges that one task may hold.
LOCAL_EDGES = 1 << 21


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included, as uint64."""
    parts = text.encode().lower().split()
    n = len(parts)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    line = b" ".join(parts)
    if n <= words:
        return np.array([h(line, 42)], dtype=np.uint64)
    ends = list(itertools.accumulate(map(len, parts)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[: n - words])]
    return np.fromiter((h(line[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)), dtype=np.uint64, count=n - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; 0 for none."""
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros(WIDTH, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a signed long) of every row; null text: zero."""
    kind = dict(df.dtypes)[key]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t or "", words)) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return map_slices(df.select(key, F.col(text).alias("text")), "text", step, f"`{key}` {kind}, fp long")


def deal_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits to m partitions of near equal size, correlated bits together."""
    bits = ((sample[:, None] >> np.arange(WIDTH, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits**2).sum(axis=0))
    near = np.abs(bits.T @ bits) / np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(near, -1)
    sizes = [WIDTH // m + (i < WIDTH % m) for i in range(m)]
    left, groups = set(range(WIDTH)), []
    for size in sizes:
        seed = max(left, key=lambda b: (max((near[b, c] for c in left if c != b), default=0), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (near[b, group].mean(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def masks(groups: list[list[int]]) -> list[int]:
    return [sum(1 << b for b in g) for g in groups]


def costs(sample: np.ndarray, mask: int, width: int, total: int, most: int) -> list[float]:
    """Estimated rows for thresholds -1..most on one partition: probes plus candidates."""
    own = sample & np.uint64(mask)
    counts = np.zeros(most + 1)
    for i in range(0, len(own), 256):
        d = np.bitwise_count(own[i : i + 256, None] ^ own[None, :])
        counts += [(d <= t).sum() for t in range(most + 1)]
    pairs = max(1, len(own) * (len(own) - 1))
    share = np.maximum(counts - len(own), 0) / pairs
    # What the sample can't see is taken as for independent bits.
    out, ball = [0.0], 0.0
    for t in range(most + 1):
        ball += float(_choose(width, t))
        p = max(share[t], ball / 2.0**width)
        out.append(total * (1 + 2 * ball * (t > 0)) + p * total * total / 2)
    return out


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def plan(sample: np.ndarray, total: int, bits: int, most: int = 2) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition probed: the cheapest m and thresholds found."""
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for m in range(1, bits + 2):
        groups = deal_bits(sample, m)
        table = [costs(sample, mask, len(g), total, most) for mask, g in zip(masks(groups), groups, strict=True)]
        # state: budget used so far -> (cost, thresholds); t + 1 units for threshold t
        state = {0: (0.0, [])}
        for row in table:
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in state.items():
                for units, price in enumerate(row):
                    if used + units <= bits + 1 and (cost + price) < new.get(used + units, (float("inf"),))[0]:
                        new[used + units] = (cost + price, [*chosen, units - 1])
            state = new
        if bits + 1 in state and state[bits + 1][0] < best[0]:
            cost, chosen = state[bits + 1]
            best = (cost, [(mask, t) for mask, t in zip(masks(groups), chosen, strict=True) if t >= 0])
    return best[1]


def flips(mask: int, most: int) -> np.ndarray:
    """Every pattern of at most ``most`` bits inside ``mask``."""
    on = [b for b in range(WIDTH) if mask >> b & 1]
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(on, k)], dtype=np.uint64)


def probes(fps: DataFrame, chosen: list[tuple[int, int]]) -> DataFrame:
    """Rows (part, at, fp): each fingerprint under its own key and, for t > 0, those around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                x = batch.column(0).slice(lo, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
                for part, (mask, t) in enumerate(chosen):
                    key = x & np.uint64(mask)
                    # One side of a pair looks t bits around, the other stays: half of t each would need more partitions.
                    for flip in flips(mask, t):
                        at = key ^ flip
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, dtype=np.int32)), pa.array(at.view(np.int64)), pa.array(x.view(np.int64)), pa.array(np.full(len(x), flip == 0))], names=["part", "at", "fp", "own"])

    return fps.select("fp").mapInArrow(run, "part int, at long, fp long, own boolean")


def links_in_bucket(x: np.ndarray, own: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that connect a bucket's fingerprints just as all its verified pairs would."""
    n = len(x)
    if n < 2 or not own.any():
        return []
    if n == 2:
        return [(0, 1)] if np.bitwise_count(x[0] ^ x[1]) <= bits else []
    near = np.zeros((n, n), dtype=bool)
    for i in range(0, n, 256):
        near[i : i + 256] = np.bitwise_count(x[i : i + 256, None] ^ x[None, :]) <= bits
    np.fill_diagonal(near, False)
    out, fresh = [], near.any(axis=1)
    for root in np.flatnonzero(fresh):
        if not fresh[root]:
            continue
        fresh[root] = False
        front = np.array([root])
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & fresh)
            fresh[reached] = False
            out += [(int(root), int(r)) for r in reached]
            front = reached
    return out


def bucket_links(rows: DataFrame, bits: int) -> DataFrame:
    """Edges (a, b) from buckets of bounded size, streamed in order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 4
        edges: list[tuple[int, int]] = []

        def drain(cols: list[np.ndarray], last: bool) -> list[np.ndarray]:
            part, at, fp, own = cols
            if not len(fp):
                return cols
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (at[1:] != at[:-1])) + 1
            bounds = np.concatenate(([0], cuts, [len(fp)]))
            stop = len(bounds) - 1 if last else len(bounds) - 2
            sizes = np.diff(bounds)
            for i in np.flatnonzero(sizes[:stop] > 1):
                a, b = bounds[i], bounds[i + 1]
                x = fp[a:b].view(np.uint64)
                edges.extend((int(fp[a + p]), int(fp[a + q])) for p, q in links_in_bucket(x, own[a:b].astype(bool), bits))
            keep = bounds[stop]
            return [c[keep:] for c in cols]

        def flush() -> pa.RecordBatch:
            pairs = np.array(edges, dtype=np.int64).reshape(-1, 2)
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = drain([np.concatenate((h, c)) for h, c in zip(held, new, strict=True)], False)
            if edges:
                yield flush()
        drain(held, True)
        if edges:
            yield flush()

    return rows.select("part", "at", "fp", "own").repartition("part", "at").sortWithinPartitions("part", "at", "fp").mapInArrow(run, "a long, b long")


def variant_links(fps: DataFrame, bits: int) -> DataFrame:
    """Edges for crowded buckets without pairs: all who meet at a variant link to one of them.

    Two fingerprints within ``bits`` meet at some word within ``bits // 2`` of one and
    ``bits - bits // 2`` of the other. All at a word within the sum are linked to its least
    near member, so the count of rows is linear in the fingerprints.
    """
    near, far = bits // 2, bits - bits // 2
    around = flips((1 << WIDTH) - 1, far)
    close = np.bitwise_count(around) <= near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                yield pa.RecordBatch.from_arrays([pa.array((around ^ x).view(np.int64)), pa.array(np.full(len(around), x).view(np.int64)), pa.array(close)], names=["at", "fp", "close"])

    rows = settle(fps.select("fp").distinct().mapInArrow(run, "at long, fp long, close boolean"), "variants")
    heads = rows.groupBy("at").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.count("*").alias("n")).where("a is not null and n > 1")
    return rows.join(heads.select("at", "a"), "at").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def link(fps: DataFrame, bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints such that connectivity within ``bits`` is whole.

    ``fps`` has one row for each distinct ``fp``. Zero is a fingerprint like any other.
    """
    total = fps.count()
    empty = fps.sparkSession.createDataFrame([], "a long, b long")
    if total < 2:
        return empty
    sample = np.array([r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    chosen = plan(sample, total, bits)
    rows = probes(fps, chosen)
    sizes = rows.groupBy("part", "at").agg(F.count("*").alias("n"), F.max("own").alias("met")).where("n > 1 and met")
    sizes = settle(sizes, "buckets")
    if sizes.where(F.col("n") > bucket).limit(1).count():
        crowded = sizes.where(F.col("n") > bucket)
        dense = settle(rows.join(crowded, ["part", "at"], "left_semi").select("fp").distinct(), "crowded")
        calm = rows.join(sizes.where(F.col("n") <= bucket), ["part", "at"], "left_semi")
        found = bucket_links(calm, bits).union(variant_links(dense, bits))
    else:
        found = bucket_links(rows.join(sizes, ["part", "at"], "left_semi"), bits)
    return found.distinct()


def near_duplicates(df: DataFrame, words: int = 3, bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: ``key``, ``fp``, ``component`` (least key reachable).

    Null or wordless text has fingerprint zero and links like any other. Repeated rows stay
    repeated. Null keys count as no candidate for the least key; a component of null keys
    only has a null component. An empty table gives an empty result.
    """
    marked = settle(fingerprints(df, words, key, text), "fingerprints")
    fps = settle(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(link(fps, bits))
    joined = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    classes = joined.join(least, "root").select("fp", "component")
    return marked.join(classes, "fp").select(key, "fp", "component")


def similarity(a: str, b: str, words: int) -> float:
    """Jaccard similarity of two texts' sets of word shingles; 1 for two without words."""
    x, y = (np.unique(shingle_hashes(t, words)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    total = len(x) + len(y) - both
    return both / total if total else 1.0


def needed(n: int, least: float) -> int:
    """Shingles a set of n must share with any set that is similar by ``least`` or more."""
    return max(1, int(np.ceil(n * least - 1e-9)))


def marked(docs: DataFrame, words: int, least: float, common: np.ndarray) -> DataFrame:
    """(key, key_a, key_b, shingles, node, fp, n, prefix) of (key, key_a, key_b, text): what near-dedup needs of a text.

    ``shingles`` is a digest of the set and ``node`` 64 bits of it, ``fp`` the fingerprint,
    ``prefix`` the first n - needed(n) + 1 of the set's n shingles, in one order for all. Two
    sets similar by ``least`` have one of these in common, whatever the order. ``common``
    (rarest first) come last and the rest by hash: the order changes cost, never results.
    """
    order = np.argsort(common, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((common[order], order))
    kind = dict(docs.dtypes)["key"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        (late, rank), digests, fps, sizes, rows = sent.value, [], [], [], []
        for t in batch.column(3).to_pylist():
            every = shingle_hashes(t, words)
            x = np.unique(every)
            digests.append(xxhash.xxh3_128_digest(x.tobytes()))
            fps.append(fingerprint(every))
            sizes.append(len(x))
            first = len(x) - needed(len(x), least) + 1 if len(x) else 0
            if len(late) and len(x):
                at = np.minimum(np.searchsorted(late, x), len(late) - 1)
                x = x[np.argsort(np.where(late[at] == x, rank[at], -1), kind="stable")]
            rows.append(x[:first])
        flat = pa.array(np.concatenate([*rows, np.zeros(0, dtype=np.uint64)]).astype(np.uint64).view(np.int64))
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        more = [pa.array(digests, pa.binary()), pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *more], names=["key", "key_a", "key_b", "shingles", "node", "fp", "n", "prefix"])

    return map_slices(docs.select("key", "key_a", "key_b", "text"), "text", step, f"key {kind}, key_a long, key_b long, shingles binary, node long, fp long, n int, prefix array<long>")


def set_of(texts: DataFrame, words: int) -> DataFrame:
    """(node, block, set): the sorted shingles of each (node, block, text)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column(2).to_pylist()]
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))], names=["node", "block", "set"])

    return map_slices(texts.select("node", "block", "text"), "text", step, "node long, block long, set array<long>")


def _held(table: pa.Table) -> dict[int, tuple[int, np.ndarray]]:
    """Number of shingles and listed shingles of each node."""
    lists = table.column("set").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = table.column("n").to_pylist() if "n" in table.column_names else np.diff(ends).tolist()
    return {n: (size, flat[a:b]) for n, size, a, b in zip(table.column("node").to_pylist(), sizes, ends[:-1].tolist(), ends[1:].tolist(), strict=True)}


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return len(x) + len(y) - len(np.unique(np.concatenate((x, y))))


def can_be_similar(x: tuple, y: tuple, least: float) -> bool:
    """Whether prefixes (n, shingles) share enough: of n shingles at most n - shared may be missing in the other set."""
    (n, p), (m, q) = x, y
    shared = int(np.ceil((n + m) * least / (1 + least) - 1e-9))
    return _common(p, q) >= min(len(p) - (n - shared), len(q) - (m - shared))


def are_similar(x: tuple, y: tuple, least: float) -> bool:
    both = _common(x[1], y[1])
    total = x[0] + y[0] - both
    return (both / total if total else 1.0) >= least


def checked(pairs: DataFrame, sets: DataFrame, least: float, check) -> DataFrame:
    """The (a, b) of ``pairs`` whose rows of ``sets`` (node, block, set, and n if sets are not whole) pass ``check``.

    Pairs meet in the two blocks of their nodes, to which each set is sent once, however many
    pairs it is in.
    """
    blocks = sets.select("node", "block")
    placed = pairs.join(blocks.select(F.col("node").alias("a"), F.col("block").alias("block_a")), "a").join(blocks.select(F.col("node").alias("b"), F.col("block").alias("block_b")), "b")
    placed = settle(placed, "pairs")
    sides = [placed.select(F.col("block_a").alias("to_a"), F.col("block_b").alias("to_b"), F.col(c).alias("node")) for c in ("a", "b")]
    sent = sides[0].union(sides[1]).distinct().join(sets.drop("block"), "node")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _held(right)
        good = [check(own[a], own[b], least) for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True)]
        return left.select(["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    return placed.groupBy("block_a", "block_b").cogroup(sent.groupBy("to_a", "to_b")).applyInArrow(run, "a long, b long")


class Texts:
    """Where sets come from: the texts, the first row of each node, and the nodes' prefixes by block."""

    def __init__(self, known: DataFrame, first: DataFrame, prefixes: DataFrame, words: int, least: float):
        self.known, self.first, self.prefixes, self.words, self.least = known, first, prefixes, words, least

    def sets(self, nodes: DataFrame) -> DataFrame:
        wanted = self.first.join(nodes, "node")
        return settle(set_of(self.known.join(wanted, ["key", "key_a", "key_b"]).select("node", "block", "text").dropDuplicates(["node"]), self.words), "sets")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are similar: prefixes rule most others out, texts are read of the rest only."""
        pairs = settle(checked(pairs, self.prefixes, self.least, can_be_similar), "likely")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return checked(pairs, self.sets(nodes), self.least, are_similar)

    def similar_within(self, rows: DataFrame) -> DataFrame:
        """Similar pairs (a, b), a < b, among nodes of crowded lists (shingle, node), met in blocks that share a list.

        Blocks are full runs of ``SETS`` nodes in order of list and size, so that of a list only blocks whose sizes leave room for
        similarity meet: a long list takes its rows times those of a band of sizes, not its square.
        """
        nodes = rows.groupBy("node").agg(F.min("shingle").alias("least"))
        sets = self.sets(nodes.select("node")).select("node", "set", F.size("set").alias("size"))
        placed = sorted_ranges(settle(sets.select("node", "size").join(nodes, "node"), "crowded"), ["least", "size", "node"], 1 << 16, "placed")
        blocked = numbered(placed.withColumn("all", F.lit("")), "all").select("node", "size", F.shiftright("pos", SETS.bit_length() - 1).alias("block"))
        blocked = settle(blocked, "crowded")
        spans = blocked.groupBy("block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
        at = settle(rows.join(blocked, "node").select("shingle", "block").distinct().join(spans, "block"), "blocks")
        other = at.select("shingle", F.col("block").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
        near = (F.col("high") >= F.col("other_low") * F.lit(self.least) - F.lit(1e-9)) & (F.col("other_high") >= F.col("low") * F.lit(self.least) - F.lit(1e-9))
        blocks = at.join(other, "shingle").where((F.col("block") <= F.col("other")) & near).select("block", "other").distinct()
        sides = [blocks.select(F.col("block").alias("to_a"), F.col("other").alias("to_b"), F.col(c).alias("block")) for c in ("block", "other")]
        sets = settle(sets.join(blocked.select("node", "block"), "node").select("node", "block", "set"), "sets")
        least = self.least

        def run(found: pa.Table) -> pa.Table:
            own = _held(found)
            nodes = np.array(sorted(own), dtype=np.int64)
            sizes = np.array([own[n][0] for n in nodes.tolist()])
            flat = np.concatenate([own[n][1] for n in nodes.tolist()])
            row = np.repeat(np.arange(len(nodes)), [len(own[n][1]) for n in nodes.tolist()])
            order = np.argsort(flat, kind="stable")
            flat, row = flat[order], row[order]
            fresh = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
            of = np.cumsum(fresh) - 1
            shared = (np.bincount(of) > 1)[of]
            row, of = row[shared], of[shared]
            of = np.cumsum(np.concatenate(([True], of[1:] != of[:-1]))) - 1 if len(of) else of
            # by a few thousand shared shingles at a time, so memory doesn't grow with the texts
            both = np.zeros((len(nodes), len(nodes)), dtype=np.float32)
            for lo in range(0, int(of.max(initial=-1)) + 1, 4096):
                a, b = np.searchsorted(of, (lo, lo + 4096))
                there = np.zeros((len(nodes), 4096), dtype=np.float32)
                there[row[a:b], of[a:b] - lo] = 1
                both += there @ there.T
            total = sizes[:, None] + sizes[None, :] - both
            a, b = np.nonzero(np.triu(both / np.maximum(total, 1) >= least, 1))
            return pa.table({"a": pa.array(nodes[a]), "b": pa.array(nodes[b])})

        sent = sides[0].union(sides[1]).distinct().join(sets, "block")
        return sent.groupBy("to_a", "to_b").applyInArrow(run, "a long, b long").distinct()


def alike_in_size(n: str, m: str, least: float) -> Column:
    return F.least(n, m) >= F.greatest(n, m) * F.lit(least) - F.lit(1e-9)


def uncovered(edges: DataFrame, local: int | None = None) -> DataFrame:
    """Nodes to drop so that, of edges (a, b) with a < b, none joins two that stay and each dropped one has one to its kept.

    The least node stays, what it reaches goes, and so on; all nodes that are least among
    their undecided neighbours are settled in one round. Once at most ``local`` edges are
    left, a number that fits in any task, one task settles them in order: the same result.
    """
    local = LOCAL_EDGES if local is None else local
    gone = edges.select(F.col("b").alias("node")).limit(0)
    while edges.count() > local:
        stays = edges.select(F.col("a").alias("node")).distinct().join(edges.select(F.col("b").alias("node")), "node", "left_anti")
        out = settle(edges.join(stays.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct(), "gone")
        gone = gone.union(out)
        # edges of what stays all lead to what goes
        left = edges.join(out.withColumnRenamed("node", "a"), "a", "left_anti").join(out.withColumnRenamed("node", "b"), "b", "left_anti")
        edges = settle(left, "edges")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches]
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
        order = np.lexsort((a, b))
        dropped: set[int] = set()
        # in order of b, what stands before it is decided
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if x not in dropped:
                dropped.add(y)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(dropped), pa.int64())], names=["node"])

    return gone.union(settle(edges.select("a", "b").coalesce(1).mapInArrow(finish, "node long"), "gone"))


def fingerprint_pairs(nodes: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, fp) whose fingerprints link: equal ones with the least of them, linked ones by those."""
    fps = settle(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = nodes.join(fps, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    ends = link(fps, bits).join(fps.select(F.col("fp").alias("a"), F.col("least").alias("one")), "a").join(fps.select(F.col("fp").alias("b"), F.col("least").alias("two")), "b")
    return same.union(ends.select(F.least("one", "two"), F.greatest("one", "two"))).where("a < b").distinct()


def may_be_similar(least: float) -> Column:
    """Whether two sets of n and m, whose first common shingle in the order stands at i and j, can be similar by ``least``."""
    n, m = F.col("n"), F.col("m")
    shared = F.ceil((n + m) * F.lit(least / (1 + least)) - F.lit(1e-9))
    return alike_in_size("n", "m", least) & (F.least(n - F.col("i"), m - F.col("j")) >= shared)


def covered(rows: DataFrame, linked: DataFrame, texts: Texts, least: float) -> DataFrame:
    """Nodes to drop: the least stays, those similar to it go, then the next of the rest.

    ``rows`` (shingle, node, n, i) are the prefixes that meet others, ``linked`` pairs found by
    fingerprints. In each of a few rounds, nodes that are least at all their shingles are
    compared with all they meet, so a large group costs no more than its rows. What is left
    is compared in pairs where few meet at a shingle, as far as sizes and places leave room
    for similarity, and in blocks of ``SETS`` sets where more do.
    """
    gone = rows.select("node").limit(0)
    for _ in range(HEAD_ROUNDS):
        heads = rows.groupBy("shingle").agg(F.min(F.struct("node", "n", "i")).alias("head"), F.count("*").alias("met")).where("met > 1").select("shingle", F.col("head.node").alias("a"), F.col("head.n").alias("m"), F.col("head.i").alias("j"))
        met = settle(rows.join(heads, "shingle"), "met")
        if not met.limit(1).count():
            return gone
        stays = met.groupBy("node").agg(F.min("a").alias("low")).where("low = node").select("node")
        first = stays.withColumnRenamed("node", "a")
        pairs = met.where((F.col("a") != F.col("node")) & may_be_similar(least)).select("a", F.col("node").alias("b"))
        # what fingerprints link is not looked at again once it is decided
        pairs = pairs.union(linked.join(met.select(F.col("node").alias("b")).distinct(), "b", "left_semi").select("a", "b")).join(first, "a", "left_semi").distinct()
        out = settle(texts.similar(pairs).select(F.col("b").alias("node")).distinct(), "gone")
        gone = gone.union(out)
        rows = settle(met.select("shingle", "node", "n", "i").join(stays.union(out), "node", "left_anti"), "undecided")
    sizes = settle(rows.groupBy("shingle").agg(F.count("*").alias("met")).where("met > 1"), "sizes")
    few = rows.join(sizes.where(F.col("met") <= SETS), "shingle")
    other = few.select("shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))
    pairs = few.withColumnRenamed("node", "a").join(other, "shingle").where((F.col("a") < F.col("b")) & may_be_similar(least)).select("a", "b").distinct()
    edges = texts.similar(pairs)
    if sizes.where(F.col("met") > SETS).limit(1).count():
        edges = edges.union(texts.similar_within(rows.join(sizes.where(F.col("met") > SETS), "shingle"))).distinct()
    return gone.union(uncovered(settle(edges, "edges")))


def keep_one(docs: DataFrame, words: int = 5, bits: int = 3, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less near copies: no two that stay are similar by ``least``, and every row that goes is similar to one that stays.

    Similarity is that of the sets of word shingles. In order of keys, a row stays unless a
    row before it stays and is similar. Candidates are pairs linked by fingerprints within
    ``bits``; fingerprints of sets similar by ``least`` alone lie too far apart for any bound
    that separates them from strangers, so shared prefixes of the sets, which miss no pair,
    give the others. Rows of one key are told apart by their texts. Rows of null key stay, as
    do all equal rows of the key that stays.
    """
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *text_key(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = marked(known, words, least, np.zeros(0, dtype=np.uint64)).select(F.explode("prefix").alias("shingle")).groupBy("shingle").count().where(F.col("count") > COMMON)
    common = settle(counts, "counts").orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).select("shingle").toArrow().column(0).to_numpy().view(np.uint64)[::-1]
    marks = settle(marked(known, words, least, common), "marks")
    same = ["key", "key_a", "key_b"]
    first = marks.groupBy("shingles").agg(F.min(F.struct(*same)).alias("first"), F.first("fp").alias("fp")).select("shingles", "first.*", "fp")
    # ranges of a sorted table are numbered in its order
    nodes = settle(first.orderBy("key", "shingles").withColumn("node", F.monotonically_increasing_id()), "nodes")
    every = marks.select("shingles", F.col("node").alias("own"), "n", F.posexplode("prefix").alias("i", "shingle"))
    # of two similar sets, the smaller has its first common shingle this early
    early = F.when(F.col("i") <= F.col("n") * F.lit((1 - least) / (1 + least)) + F.lit(1e-9), F.col("n"))
    lists = every.groupBy("shingle").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.min(early).alias("small"), F.max(early).alias("large"))
    meeting = settle(lists.where("low <> high and large is not null").select("shingle", "small", "large"), "meeting")
    fits = (F.col("n") >= F.col("small") * F.lit(least) - F.lit(1e-9)) & (F.col("n") * F.lit(least) <= F.col("large") + F.lit(1e-9))
    rows = every.join(meeting, "shingle").where(fits).select("shingles", "n", "i", "shingle").distinct().join(nodes.select("shingles", "node"), "shingles").select("shingle", "node", "n", "i")
    rows = settle(rows, "prefixes")
    # near copies mostly share their least shingle, so they come into the same blocks
    wanted = nodes.join(rows.groupBy("node").agg(F.min("shingle").alias("least")), "node").orderBy("least", "node")
    wanted = settle(wanted.select(*same, "node", "fp", F.shiftright(F.monotonically_increasing_id(), SETS.bit_length() - 1).alias("block")), "wanted")
    prefixes = settle(marks.drop("node", "fp").join(wanted, same).select("node", "block", "n", F.col("prefix").alias("set")).dropDuplicates(["node"]), "sets")
    texts = Texts(known, wanted.select(*same, "node", "block"), prefixes, words, least)
    linked = settle(fingerprint_pairs(wanted.select("node", "fp"), bits), "linked")
    out = covered(rows, linked, texts, least).distinct().withColumn("out", F.lit(True))
    verdict = nodes.join(out, "node", "left").select("shingles", F.struct(*same).alias("first"), "out")
    # of each set, all but the first row go; of a set that is not kept, that one too
    gone = marks.select(*same, "shingles").distinct().join(verdict, "shingles").where(F.col("out") | (F.struct(*same) != F.col("first"))).select(*[F.col(c).alias(f"_gone_{c}") for c in same])
    rows = docs.select(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(key).alias("key"), *text_key(text))
    left = rows.join(gone, (F.col("key") == F.col("_gone_key")) & (F.col("key_a") == F.col("_gone_key_a")) & (F.col("key_b") == F.col("_gone_key_b")), "left_anti")
    return left.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
