"""Standardised logistic regression with a penalised intercept, and coefficient permutation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Newton's method on C * log-loss + half the squared norm of weights and intercept; intercept last.

    Columns are standardised with the population deviation; a constant column stays 0.
    """
    spread = x.std(axis=0)
    z = np.column_stack(((x - x.mean(axis=0)) / np.where(spread > 0, spread, 1), np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(np.eye(len(w)) + c * (z.T * (p * (1 - p))) @ z, w + c * z.T @ (p - y))
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return w


def coefficients(df: DataFrame, group: str, columns: Sequence[str], label: str, rounds: int = 100) -> DataFrame:
    """Coefficients by group over all rows: ``fit`` with its sums taken where the rows are.

    Each step of Newton's method is one aggregate; only sums by group reach the driver. Rows
    with a null or NaN are left out, and so are groups with one label.
    """
    k, spark = len(columns), df.sparkSession
    rows = df.select(F.col(group).cast("string").alias("_g"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)], F.col(label).cast("int").alias("_y")).where("_y is not null")
    for i in range(k):
        rows = rows.where(F.col(f"_x{i}").isNotNull() & ~F.isnan(f"_x{i}"))
    moments = [f(f"_x{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("mean", F.avg), ("dev", F.stddev_pop), ("low", F.min), ("high", F.max))]
    stats = {r["_g"]: r for r in rows.groupBy("_g").agg(F.min("_y").alias("no"), F.max("_y").alias("yes"), *moments).where("no < yes").collect()}
    w = {g: np.zeros(k + 1) for g in stats}
    z = [(F.col(f"_x{i}") - F.col("_mean")[i]) / F.col("_dev")[i] for i in range(k)] + [F.lit(1.0)]
    margin = sum((z[i] * F.col("_w")[i] for i in range(k)), F.col("_w")[k])
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = [F.sum((F.col("_p") - F.col("_y")) * z[i]).alias(f"g{i}") for i in range(k + 1)] + [F.sum(F.col("_p") * (1 - F.col("_p")) * z[i] * z[j]).alias(f"h{i}_{j}") for i, j in cells]
    moving = set(stats)
    for _ in range(rounds):
        if not moving:
            break
        now = [(g, [stats[g][f"mean{i}"] for i in range(k)], [stats[g][f"dev{i}"] if stats[g][f"low{i}"] < stats[g][f"high{i}"] else 1.0 for i in range(k)], w[g].tolist()) for g in moving]
        known = spark.createDataFrame(now, "_of string, _mean array<double>, _dev array<double>, _w array<double>")
        joined = rows.join(F.broadcast(known), F.col("_g").eqNullSafe(F.col("_of"))).withColumn("_p", 1 / (1 + F.exp(-margin)))
        for r in joined.groupBy("_g").agg(*sums).collect():
            h = np.eye(k + 1)
            for i, j in cells:
                h[i, j] += r[f"h{i}_{j}"]
                h[j, i] = h[i, j]
            step = np.linalg.solve(h, w[r["_g"]] + np.array([r[f"g{i}"] for i in range(k + 1)]))
            w[r["_g"]] = w[r["_g"]] - step
            if np.abs(step).max() < 1e-10:
                moving.discard(r["_g"])
    out = [(g, term, float(x)) for g in w for term, x in zip([*columns, "intercept"], w[g], strict=True)]
    return spark.createDataFrame(out, "model string, term string, coefficient double")


def shuffled(i: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Where each of the places ``i`` (below n) goes in one pseudo-random permutation of n places for each row of ``keys``.

    Four Feistel rounds over the least even number of bits that holds n, walked on until the place is below n. A place is computed
    from itself, so no column is shuffled between tasks. Shape (len(i), len(keys)).
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    rounds = np.ascontiguousarray(keys.T)

    def once(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(4):
            mixed = right + k[r]
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed >>= np.uint64(32)
            mixed &= mask
            mixed ^= left
            left, right = right, mixed
        left <<= half
        left |= right
        return left

    out = once(np.broadcast_to(i.astype(np.uint64)[:, None], (len(i), len(keys))), rounds)
    flat = out.reshape(-1)
    far = np.flatnonzero(flat >= n)
    left, own = flat[far], rounds[:, far % max(1, len(keys))]
    while len(far):
        left = once(left, own)
        flat[far] = left
        on = np.flatnonzero(left >= n)
        far, left, own = far[on], left[on], own[:, on]
    return out.view(np.int64)


def replicate_keys(seed: int, replicates: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, (replicates, 4), dtype=np.uint64)


def _newton_sums(x: np.ndarray, y: np.ndarray, last: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and upper Hessian sums of each column of ``last`` beside ``x`` (which ends in ones), all replicates at once; one row a replicate."""
    k = x.shape[1]
    margin = x @ w[:, :k].T + last * w[:, k]
    p = 1 / (1 + np.exp(-margin))
    r, v = p - y[:, None], p * (1 - p)
    pairs = np.stack([x[:, i] * x[:, j] for i in range(k) for j in range(i, k)], axis=1)
    lv = last * v
    return np.concatenate((r.T @ x, (last * r).sum(axis=0)[:, None], v.T @ pairs, lv.T @ x, (last * lv).sum(axis=0)[:, None]), axis=1)


def _newton_step(sums: np.ndarray, w: np.ndarray, c: float) -> np.ndarray:
    """Steps from sums; weights and intercept are all penalised."""
    d = w.shape[1]
    k = d - 1
    h = np.zeros((len(w), d, d))
    cells = [(i, j) for i in range(k) for j in range(i, k)] + [(i, k) for i in range(k)] + [(k, k)]
    for at, (i, j) in enumerate(cells):
        h[:, i, j] = h[:, j, i] = c * sums[:, d + at]
    return np.linalg.solve(h + np.eye(d), (w + c * sums[:, :d])[..., None])[..., 0]


#: Rows times replicates in one array, so few that it stays in a core's cache, and in one task.
CELLS, TASK_CELLS = 1 << 15, 1 << 23


def task_count(rows: int, replicates: int) -> int:
    """Tasks over which the refits of ``rows`` rows are dealt."""
    return max(1, -(-rows * replicates // TASK_CELLS))


def rank_permutations(df: DataFrame, group: str, columns: Sequence[str], label: str, order: Sequence[str], replicates: int, seed: int, c: float = 1.0, rounds: int = 50) -> DataFrame:
    """(model, rep, coefficient): the coefficient of the rank percentile by ``order`` beside ``columns``, observed (rep -1) and with ranks shuffled.

    The fit is that of ``fit``. All rows take part in every refit: a step of Newton's method for all replicates of all groups is one pass,
    in which each task computes the shuffled ranks of its own rows from their numbers, and adds up small matrices by replicate. Only
    those sums and the weights, replicates times predictors squared, pass through the driver. Rows with a null or NaN are left out, and
    so are groups with one label.
    """
    from .ranking import ranked
    from .settled import settle

    k = len(columns)
    rows = df.select(F.col(group).cast("string").alias("_g"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(columns)], F.col(label).cast("int").alias("_y"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]).where("_g is not null and _y is not null")
    for i in range(k):
        rows = rows.where(F.col(f"_x{i}").isNotNull() & ~F.isnan(f"_x{i}"))
    placed = settle(ranked(rows, ["_g"], [f"_o{i}" for i in range(len(order))]).select("_g", *[f"_x{i}" for i in range(k)], "_y", "rank", "n"), "ranks")
    # the work is rows times replicates, however few bytes or files the rows take
    placed = settle(placed.repartition(task_count(placed.count(), replicates), "rank"), "ranks")
    stats = {r["_g"]: r for r in placed.groupBy("_g").agg(F.max("n").alias("n"), F.min("_y").alias("no"), F.max("_y").alias("yes"), *[f(f"_x{i}").alias(f"{m}{i}") for i in range(k) for m, f in (("mean", F.avg), ("dev", F.stddev_pop), ("low", F.min), ("high", F.max))]).where("no < yes").collect()}
    known = {g: (r["n"], np.array([r[f"mean{i}"] for i in range(k)]), np.array([r[f"dev{i}"] if r[f"low{i}"] < r[f"high{i}"] else 1.0 for i in range(k)])) for g, r in stats.items()}
    keys, spark = replicate_keys(seed, replicates), df.sparkSession
    width = k + 2 + (k + 1) * (k + 2) // 2 + k + 2
    schema = "_g string, rep int, " + ", ".join(f"s{i} double" for i in range(width))

    def descend(w: dict[str, np.ndarray], shuffle: bool) -> dict[str, np.ndarray]:
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(w)

            def run(batches):
                total = {}
                for batch in batches:
                    for g, some in batch.groupby("_g", sort=False):
                        if g not in sent.value:
                            continue
                        n, mean, dev = known[g]
                        wide, now = max(1, CELLS // len(sent.value[g])), sent.value[g]
                        x = np.column_stack(((some[[f"_x{i}" for i in range(k)]].to_numpy(float) - mean) / dev, np.ones(len(some))))
                        y, places = some["_y"].to_numpy(float), some["rank"].to_numpy(np.int64) - 1
                        for a in range(0, len(some), wide):
                            place = places[a : a + wide]
                            ranks = (shuffled(place, n, keys) if shuffle else place[:, None]) + 1.0
                            last = (ranks - (n + 1) / 2) / max(((n * n - 1) / 12) ** 0.5, 1e-300)
                            total[g] = total.get(g, 0) + _newton_sums(x[a : a + wide], y[a : a + wide], last, now)
                for g, sums in total.items():
                    yield pd.DataFrame(sums, columns=[f"s{i}" for i in range(width)]).assign(_g=g, rep=np.arange(len(sums)))[["_g", "rep", *[f"s{i}" for i in range(width)]]]

            found = placed.mapInPandas(run, schema).groupBy("_g", "rep").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).toPandas()
            most, after = 0.0, {}
            for g, sums in found.groupby("_g"):
                step = _newton_step(sums.sort_values("rep")[[f"s{i}" for i in range(width)]].to_numpy(), w[g], c)
                after[g], most = w[g] - step, max(most, float(np.abs(step).max()))
            sent.destroy()
            w = after
            if most < 1e-9:
                break
        return w

    own = descend({g: np.zeros((1, k + 2)) for g in known}, False)
    free = {g: np.repeat(np.concatenate((x[:, :-1], [[0.0]]), axis=1), replicates, axis=0) for g, x in own.items()}
    other = descend(free, True) if free else {}
    out = [(g, rep, float(v)) for g in own for rep, v in [(-1, own[g][0, -1]), *enumerate(other[g][:, -1])]]
    return spark.createDataFrame(out, "model string, rep int, coefficient double")


def permuted_p(coefficients: DataFrame) -> DataFrame:
    """model, observed, p_value (#|c| >= |observed| + 1 over replicates + 1), null_mean and null_p95 of |c|, from ``rank_permutations``."""
    own = coefficients.where("rep < 0").select("model", F.col("coefficient").alias("observed"))
    hit = F.count_if(F.abs("coefficient") >= F.abs("observed"))
    return coefficients.where("rep >= 0").join(own, "model").groupBy("model", "observed").agg(((hit + 1) / (F.count("*") + 1)).alias("p_value"), F.avg("coefficient").alias("null_mean"), F.percentile(F.abs("coefficient"), F.lit(0.95)).alias("null_p95"))
