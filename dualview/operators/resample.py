"""Samples, bootstrap and permutation inference over md5 streams, and closed forms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import scalars as S
from . import draws
from .conditions import count_if

#: Replicates of the protocol, those that one task draws at once, and different values of a group at most.
REPLICATES, BLOCK, MOST_VALUES = DEFAULT.bootstraps, 100, 1000


def hash_sample(df: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, by the md5 of seed and id."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")))).orderBy("_h", id).limit(n).drop("_h")


def stratified_sample(df: DataFrame, id: str, stratum: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """The same in each stratum; groups are limited before the shuffle."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", id))
    most = F.coalesce(*[F.when(F.col(stratum).cast("string") == k, n) for k, n in sizes.items()], F.lit(0))
    return df.withColumn("_h", h).withColumn("_n", place).where(F.col("_n") <= max(sizes.values())).where(F.col("_n") <= most).drop("_h", "_n")


def random_scores(df: DataFrame, id: str, seed: int, name: str = "random_score") -> DataFrame:
    """A reproducible uniform score for each row: the random ranking baseline."""
    return df.withColumn(name, S.uniform(seed, F.col(id)))


def uniforms(label: str, replicates: range) -> np.ndarray:
    """Numbers in (0, 1) from the md5 of ``label:replicate``, the stream that SQL can read too."""
    return (np.array([int(hashlib.md5(f"{label}:{r}".encode()).hexdigest()[:8], 16) for r in replicates]) + 0.5) / 4294967296


def _blocks(df: DataFrame, group: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Each row once for every block of replicates, with the label of its stream: seed and group joined by colons."""
    label = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group]).alias("_label")
    return df.select("*", label, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(BLOCK))).alias("_first"))


def _schema(df: DataFrame, group: Sequence[str], rest: str) -> str:
    return ", ".join([*[f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group], rest])


def bootstrap_means(cells: DataFrame, group: Sequence[str], value: str, count: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(group, rep, mean): means of as many draws with replacement as a group has rows, in each replicate.

    ``cells`` holds each group's rows added up: a few distinct values with their counts, which is what a draw
    depends on. A replicate is one multinomial draw of those counts, value after value: how many of the draws left
    fall on it is binomial, read off the inverse distribution at the stream ``seed:group:value:rep``. So all rows take part, and a
    replicate costs no more for a large table. Values that are null are left out, and so are groups without others.
    Raises for more than ``MOST_VALUES`` different values in a group.
    """
    pair = F.struct(F.col(value).cast("double").alias("v"), F.col(count).cast("long").alias("n"))
    classes = cells.where(F.col(value).isNotNull() & (F.col(count) > 0)).groupBy(*group).agg(F.array_sort(F.collect_list(pair)).alias("_c"))
    few = F.when(F.size("_c") <= MOST_VALUES, F.col("_c")).otherwise(F.raise_error(F.lit(f"more than {MOST_VALUES} values")))
    wide = _blocks(classes.withColumns({"_v": few["v"], "_n": few["n"]}).drop("_c"), group, replicates, seed)
    names = list(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                reps = range(row["_first"], min(row["_first"] + BLOCK, replicates))
                total = rest = int(sum(row["_n"]))
                left, sums = np.full(len(reps), total), np.zeros(len(reps))
                for v, n in zip(row["_v"][:-1], row["_n"][:-1], strict=True):
                    u, got = uniforms(f"{row['_label']}:{v:g}", reps), np.zeros(len(reps), dtype=int)
                    for m in np.unique(left[left > 0]).tolist():
                        some = left == m
                        got[some] = draws.inverse(draws.binomial(m, n / rest), u[some])
                    sums, left, rest = sums + v * got, left - got, rest - int(n)
                sums += row["_v"][-1] * left
                yield pd.DataFrame({**{g: [row[g]] * len(reps) for g in names}, "rep": reps, "mean": sums / total})

    return wide.mapInPandas(run, _schema(cells, group, "rep int, mean double"))


def permuted_hits(counts: DataFrame, group: Sequence[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(group, rep, hits): marked rows among those drawn, in each random order of a group of ``counts`` (group, n, marked, drawn).

    Shuffling labels and looking at the first rows draws without replacement, so the count is hypergeometric; it is read
    off the inverse distribution at the stream ``seed:group:rep``, whatever the number of rows.
    """
    wide, names = _blocks(counts.select(*group, "n", "marked", "drawn"), group, replicates, seed), list(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                reps = range(row["_first"], min(row["_first"] + BLOCK, replicates))
                hits = draws.inverse(draws.hypergeometric(int(row["n"]), int(row["marked"]), int(row["drawn"])), uniforms(row["_label"], reps))
                yield pd.DataFrame({**{g: [row[g]] * len(reps) for g in names}, "rep": reps, "hits": hits})

    return wide.mapInPandas(run, _schema(counts, group, "rep int, hits long"))


def interval(df: DataFrame, group: Sequence[str] = (), column: str = "mean", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean and percentile bounds of a column over the replicates of each group, interpolated linearly."""
    q = F.percentile(column, F.array(F.lit(low), F.lit(high)))
    return df.groupBy(*group).agg(F.avg(column).alias("mean"), q.alias("_q")).select(*group, "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def permutation_p(counts: DataFrame, group: Sequence[str], observed: Column) -> DataFrame:
    """(#hits >= observed + 1) / (replicates + 1), the mean and the 95th percentile of the null, by group."""
    return counts.groupBy(*group).agg(((count_if(F.col("hits") >= observed) + 1) / (F.count("*") + 1)).alias("p_value"), F.avg("hits").alias("null_mean"), F.percentile("hits", F.lit(0.95)).alias("null_p95"))


def tail(n: Column, marked: Column, drawn: Column, hits: Column) -> Column:
    """``draws.hypergeometric_tail`` of columns."""

    @F.pandas_udf("double")
    def run(n: pd.Series, marked: pd.Series, drawn: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([draws.hypergeometric_tail(*map(int, r)) for r in zip(n, marked, drawn, hits, strict=True)], dtype=float)

    return run(n, marked, drawn, hits)


def bounds(n: Column, marked: Column, drawn: Column) -> Column:
    """``draws.hypergeometric_bounds`` of columns."""

    @F.pandas_udf("array<long>")
    def run(n: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
        return pd.Series([draws.hypergeometric_bounds(*map(int, r)) for r in zip(n, marked, drawn, strict=True)], dtype=object)

    return run(n, marked, drawn)


def first_by_hash(df: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """The rows of ``hash_sample``, for any n: whole ranges of the md5, and an order only in the range that is cut."""
    wide = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")))).withColumn("_bin", F.substring("_h", 1, 4))
    left, cut = n, None
    for r in wide.groupBy("_bin").count().orderBy("_bin").collect():
        if r["count"] > left:
            cut = r["_bin"]
            break
        left -= r["count"]
    if cut is None:
        return df
    return wide.where(F.col("_bin") < cut).union(wide.where(F.col("_bin") == cut).orderBy("_h", id).limit(left)).drop("_h", "_bin")
