"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Distinct vectors are dealt by hash to shards whose size grows with the table, between two bounds. A shard's graph is built in
batches: greedy beam searches on the graph so far propose neighbours, relaxed distance
pruning keeps a diverse few, and reverse edges are pruned the same way. Inner product
becomes distance by one more coordinate, sqrt(M^2 - |x|^2), which leaves the order of
neighbours as it is. Queries are answered by beam search in every shard, in blocks; the
vectors found are scored again exactly, in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: A shard's vectors: a ``SPREAD``-th of all, but between these bounds.
LEAST_SHARD, MOST_SHARD, SPREAD = 1 << 14, 1 << 18, 64
#: Queries that one task searches with; a shard's graph is sent once for each such block.
BLOCK = 1 << 15
#: Flags of visited points that a search holds at once.
FLAGS = 1 << 25
DEGREE, BEAM, ALPHA, WIDE = 32, 64, 1.2, 4
#: Beam of queries; wider than that of the build.
SEARCH_BEAM = 128


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors, scaled to length 1 at most, with the coordinate that turns inner product into distance."""
    x = x / max(np.abs(x).max(initial=0), 1e-300)  # so that no square overflows
    norms = np.einsum("nd,nd->n", x, x)
    top = norms.max(initial=0)
    return (np.concatenate((x, np.sqrt(top - norms)[:, None]), axis=1) / max(np.sqrt(top), 1e-300)).astype(np.float32)


def robust_prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each own point among candidate ids (rows; -1: none).

    Nearest first; a candidate goes once a kept neighbour is closer to it by ``alpha`` than
    the point itself. Places left over take the nearest of those that went.
    """
    out = np.full((len(own), degree), -1, dtype=np.int32)
    for lo in range(0, len(own), 128):
        p, c = own[lo : lo + 128], ids[lo : lo + 128]
        v = x[np.maximum(c, 0)]
        d = ((v - x[p][:, None]) ** 2).sum(axis=2)
        d[(c < 0) | (c == p[:, None])] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        c, d, v = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        square = (v**2).sum(axis=2)
        between = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        rows, alive, kept = np.arange(len(p)), np.isfinite(d), np.zeros(d.shape, dtype=bool)
        valid = alive.copy()
        for _ in range(degree):
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            kept[rows[some], pick[some]] = True
            alive &= ~(alpha * alpha * between[rows, pick] <= d) | ~some[:, None]
            alive[rows, pick] = False
        # first the kept, then the nearest of the rest, in order of distance
        rank = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :degree]
        good = np.take_along_axis(valid, rank, 1)
        out[lo : lo + 128, : rank.shape[1]] = np.where(good, np.take_along_axis(c, rank, 1), -1)
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int = BEAM, wide: int = WIDE) -> np.ndarray:
    """Ids of the ``beam`` nearest found for each query, nearest first (-1: none), ``wide`` nodes opened at a time."""
    out = np.full((len(queries), beam), -1, dtype=np.int32)
    many = max(16, min(512, FLAGS // len(x)))
    for lo in range(0, len(queries), many):
        q = queries[lo : lo + many]
        n = len(q)
        ids = np.full((n, beam), -1, dtype=np.int32)
        dist = np.full((n, beam), np.inf, dtype=np.float32)
        shut = np.ones((n, beam), dtype=bool)
        seen = np.zeros((n, len(x)), dtype=bool)
        ids[:, 0], dist[:, 0], shut[:, 0] = start, ((q - x[start]) ** 2).sum(axis=1), False
        seen[:, start] = True
        live = np.arange(n)
        while len(live):
            left = np.where(shut[live], np.inf, dist[live])
            pick = np.argpartition(left, wide - 1, axis=1)[:, :wide]
            good = np.isfinite(np.take_along_axis(left, pick, 1))
            going = good.any(axis=1)
            live, pick, good = live[going], pick[going], good[going]
            if not len(live):
                break
            nodes = np.where(good, ids[live[:, None], pick], -1)
            shut[live[:, None], pick] = True
            near = np.where(nodes[:, :, None] >= 0, graph[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            found = near[r, c]
            seen[live[r], found] = True
            d = np.full(near.shape, np.inf, dtype=np.float32)
            diff = x[found] - q[live[r]]
            d[r, c] = np.einsum("nd,nd->n", diff, diff)
            all_d = np.concatenate((dist[live], d), axis=1)
            all_i = np.concatenate((ids[live], near), axis=1)
            all_s = np.concatenate((shut[live], ~fresh), axis=1)
            top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids[live], dist[live], shut[live] = (np.take_along_axis(a, top, 1) for a in (all_i, all_d, all_s))
        order = np.argsort(dist, axis=1, kind="stable")
        out[lo : lo + many] = np.where(np.isfinite(np.take_along_axis(dist, order, 1)), np.take_along_axis(ids, order, 1), -1)
    return out


def build(x: np.ndarray, passes: int = 1, seed: int = 3) -> tuple[np.ndarray, int]:
    """Graph (n, DEGREE) over lifted vectors, and the point where searches start."""
    n = len(x)
    graph = np.full((n, DEGREE), -1, dtype=np.int32)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate(([start], order[order != start])).astype(np.int32)
    done = min(n, 2 * DEGREE)
    first = order[:done]
    graph[first] = robust_prune(x, first, np.repeat(first[None], done, axis=0))
    for again in (False, True)[:passes]:
        at = 0 if again else done
        while at < n:
            batch = order[at : at + (1024 if again else min(1024, at))]
            found = beam_search(x, graph, start, x[batch])
            if again:
                found = np.concatenate((found, graph[batch]), axis=1)
                found = unique_rows(found)
            graph[batch] = robust_prune(x, batch, found)
            add_reverse(x, graph, batch)
            at += len(batch)
    return graph, start


def unique_rows(ids: np.ndarray) -> np.ndarray:
    """Rows with repeats replaced by -1."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def add_reverse(x: np.ndarray, graph: np.ndarray, batch: np.ndarray) -> None:
    """Let the new points' neighbours point back, pruned to the degree."""
    to = graph[batch].reshape(-1)
    source = np.repeat(batch, DEGREE)[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    width = 2 * DEGREE
    place = np.arange(len(to)) - np.repeat(first, counts)
    new = np.full((len(targets), width), -1, dtype=np.int32)
    fits = place < width
    new[np.repeat(np.arange(len(targets)), counts)[fits], place[fits]] = source[fits]
    both = unique_rows(np.concatenate((graph[targets], new), axis=1))
    free = (both >= 0).sum(axis=1) <= DEGREE
    short = -np.sort(-both[free], axis=1)[:, :DEGREE]
    graph[targets[free]] = short
    if not free.all():
        graph[targets[~free]] = robust_prune(x, targets[~free], both[~free])


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part: finite, not zero, of the commonest length."""
    v = F.col(vector)
    fine = df.where(F.col(key).isNotNull() & v.isNotNull()).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fine = fine.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda e: e != 0))
    sizes = fine.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return fine.where(F.size("v") == (sizes[0]["size"] if sizes else -1))


def index(vectors: DataFrame, k: int, shard: int | None = None) -> tuple[DataFrame, int]:
    """Graphs of all shards (shard, vectors, graph, start, ids) and their number.

    Equal vectors are one point that carries its k + 1 least ids: no query needs more of them.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = settle(vectors.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    total = points.count()
    shard = shard or min(MOST_SHARD, max(LEAST_SHARD, math.ceil(total / SPREAD)))
    shards = max(1, math.ceil(total / shard))

    def make(key: tuple, rows: pa.Table) -> pa.Table:
        flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(rows.num_rows, -1)
        order = np.lexsort(x.T[::-1])
        graph, start = build(lifted(x[order]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "vectors": pa.array([x[order].tobytes()], pa.binary()), "graph": pa.array([graph.tobytes()], pa.binary()), "start": pa.array([start], pa.int32()), "ids": pa.array([rows.column("ids").combine_chunks().take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64())))})

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return settle(dealt.groupBy("shard").applyInArrow(make, "shard int, vectors binary, graph binary, start int, ids array<array<long>>"), "graphs"), shards


def search(graphs: DataFrame, shards: int, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (id, v), its own id left out."""
    blocks = max(1, math.ceil(queries.count() / block))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if left.num_rows and right.num_rows:
            q = right.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(right.num_rows, -1)
            unit = q / np.abs(q).max(axis=1, keepdims=True)
            unit /= np.sqrt(np.einsum("nd,nd->n", unit, unit))[:, None]
            own = right.column("id").to_pylist()
            x = np.frombuffer(left.column("vectors")[0].as_py(), dtype=np.float64).reshape(-1, q.shape[1])
            graph = np.frombuffer(left.column("graph")[0].as_py(), dtype=np.int32).reshape(-1, DEGREE)
            ids = left.column("ids")[0].as_py()
            found = beam_search(lifted(x), graph, left.column("start")[0].as_py(), np.concatenate((unit, np.zeros((len(q), 1))), axis=1).astype(np.float32), beam)
            for j, row in enumerate(found):
                row = row[row >= 0]
                scores = x[row] @ q[j]
                best = sorted((-s, i) for r, s in zip(row.tolist(), scores.tolist(), strict=True) for i in ids[r] if i != own[j])[:k]
                out_q += [own[j]] * len(best)
                out_i += [i for _, i in best]
                out_s += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_i, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, asked: F.Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard: int | None = None, beam: int = SEARCH_BEAM) -> DataFrame:
    """The k nearest found, by inner product, of every row for which ``asked`` (over ``id``) holds.

    Vectors that are null, zero, hold null or non-finite parts, or are not of the commonest
    length take no part, nor do rows of null key. Ties go to the smaller id. A repeated id
    is a row of its own but never its own neighbour. An empty table gives an empty result.
    """
    vectors = usable(df, key, vector)
    graphs, shards = index(vectors, k, shard)
    return search(graphs, shards, vectors.where(asked), k, max(beam, k, WIDE))
