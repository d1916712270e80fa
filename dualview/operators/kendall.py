"""Kendall's tau-b by a distributed count of inversions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running_sums
from .settled import settle

#: Places of either order that one block holds.
BLOCK = 1 << 17


def inversions(y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w[i] w[j] over i < j with y[i] > y[j], by merging sorted runs of doubling length; values of y differ."""
    size = 1 << max(0, len(y) - 1).bit_length()
    y = np.concatenate((y, y.max(initial=0) + 1 + np.arange(size - len(y)))).astype(np.int64)
    w = np.concatenate((w, np.zeros(size - len(w)))).astype(np.int64)
    span, total, half = int(y.max(initial=0)) + 1, 0, 1
    while half < size:
        block = np.repeat(np.arange(size // (2 * half)), half) * span
        left, right = (y.reshape(-1, 2, half)[:, i].ravel() + block for i in (0, 1))
        weights, other = (w.reshape(-1, 2, half)[:, i].ravel() for i in (0, 1))
        upto = np.concatenate(([0], np.cumsum(weights)))
        ends = np.repeat(np.arange(1, size // (2 * half) + 1) * half, half)
        total += int((other * (upto[ends] - upto[np.searchsorted(left, right, side="right")])).sum())
        half *= 2
        order = np.argsort(y.reshape(-1, half), axis=1, kind="stable")
        y, w = np.take_along_axis(y.reshape(-1, half), order, 1).ravel(), np.take_along_axis(w.reshape(-1, half), order, 1).ravel()
    return total


def tau_b(df: DataFrame, group: Sequence[str], a: str, b: str, block: int | None = None) -> DataFrame:
    """(group, n, tau): Kendall's tau-b of two columns in each group; null where one is constant. Rows with a null or NaN don't count.

    Equal pairs are counted first. Each pair has a place in the order of (a, b) and one in that of (b, a), so that discordant pairs are
    the inversions of a permutation and ties are none. Both orders are cut into blocks of equal length. Inversions inside a block of the first
    order are counted in it; those between blocks of both orders come from a table of how many lie in each pair of blocks; those
    inside a block of the second order are counted in that, less those that share both blocks. No task holds more than a block.
    """
    block = BLOCK if block is None else block
    fine = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (a, b)]
    gone = [F.col(g).alias(f"__k{i}") for i, g in enumerate(group)]
    keys = [f"__k{i}" for i in range(len(group))]
    cells = df.where(fine[0] & fine[1]).groupBy(*gone, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__w"))
    x = running_sums(cells, keys, ["__a", "__b"], {"__x": F.lit(1)})
    both = running_sums(x, keys, ["__b", "__a"], {"__y": F.lit(1)})
    spot = lambda c: F.floor((F.col(c) - 1) / block)
    placed = settle(both.withColumns({"__r": spot("__x"), "__c": spot("__y")}), "places")

    def counted(by: str, within: bool) -> DataFrame:
        kinds = ", ".join([*[f"{k} {placed.schema[k].dataType.simpleString()}" for k in keys], "__d long"])
        other = "__c" if by == "__r" else "__r"

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("__x")
            total = inversions(rows["__y"].to_numpy(), rows["__w"].to_numpy())
            if within:  # those in one block of either order are counted in the other
                total -= sum(inversions(some["__y"].to_numpy(), some["__w"].to_numpy()) for _, some in rows.groupby(other))
            return pd.DataFrame([[*key[:-1], total]], columns=[*keys, "__d"])

        return placed.select(*keys, by, other, "__x", "__y", "__w").groupBy(*keys, by).applyInPandas(run, kinds)

    table = placed.groupBy(*keys, "__r", "__c").agg(F.sum("__w").alias("__w"))
    # of each pair of blocks: what lies in earlier blocks of the first order and later ones of the second
    rows, columns = table.select(*keys, "__r").distinct(), table.select(*keys, "__c").distinct()
    grid = rows.crossJoin(columns) if not keys else rows.join(columns.withColumnsRenamed({k: f"{k}_" for k in keys}), [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]).drop(*[f"{k}_" for k in keys])
    named = table.withColumnsRenamed({**{k: f"{k}_" for k in keys}, "__r": "__r_", "__c": "__c_"})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys] + [F.col("__r") == F.col("__r_"), F.col("__c") == F.col("__c_")]
    full = grid.join(named, on, "left").select(*keys, "__r", "__c", F.coalesce("__w", F.lit(0)).alias("__w"))
    above = Window.partitionBy(*keys, "__c").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy(*keys, "__r").orderBy(F.desc("__c")).rowsBetween(Window.unboundedPreceding, -1)
    crossed = full.withColumn("__v", F.coalesce(F.sum("__w").over(above), F.lit(0))).withColumn("__d", F.col("__w") * F.coalesce(F.sum("__v").over(right), F.lit(0))).select(*keys, "__d")
    discordant = counted("__r", False).unionByName(counted("__c", True)).unionByName(crossed).groupBy(*keys).agg(F.sum("__d").alias("__d"))

    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    ties = lambda c: cells.groupBy(*keys, c).agg(F.sum("__w").alias("__t")).groupBy(*keys).agg(pairs("__t").alias(f"{c}_ties"))
    sums = cells.groupBy(*keys).agg(F.sum("__w").alias("n"), pairs("__w").alias("__both"))
    for other in (ties("__a"), ties("__b"), discordant):
        renamed = other.withColumnsRenamed({k: f"{k}_" for k in keys})
        sums = sums.join(renamed, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]).drop(*[f"{k}_" for k in keys]) if keys else sums.crossJoin(renamed)
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    top = every - F.col("__a_ties") - F.col("__b_ties") + F.col("__both") - 2 * F.col("__d")
    bottom = F.sqrt((every - F.col("__a_ties")) * (every - F.col("__b_ties")))
    return sums.select(*[F.col(k).alias(g) for k, g in zip(keys, group, strict=True)], "n", F.try_divide(top, bottom).alias("tau"))
