"""The paired-label frame: one entity with two distances and two labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def pair_frame(df: DataFrame, id: Column, dist_a: Column, dist_b: Column, lab_a: Column | None = None, lab_b: Column | None = None, at: float = 0.0, **more: Column) -> DataFrame:
    """Normalise a table to (id, dist_a, dist_b, lab_a, lab_b, more...).

    Labels default to distances at or under ``at``; a null distance gives a null label.
    """
    return df.select(id.alias("id"), dist_a.cast("double").alias("dist_a"), dist_b.cast("double").alias("dist_b"), (S.stable(dist_a, at) if lab_a is None else lab_a).alias("lab_a"), (S.stable(dist_b, at) if lab_b is None else lab_b).alias("lab_b"), *[c.alias(n) for n, c in more.items()])


def labelled(pairs: DataFrame) -> DataFrame:
    """Rows with both labels, with discordant, direction, quadrant and gap."""
    a, b = F.col("lab_a"), F.col("lab_b")
    return pairs.where(a.isNotNull() & b.isNotNull()).withColumns({"discordant": S.discordant(a, b), "direction": S.direction(a, b), "quadrant": S.quadrant(a, b), "gap": S.gap(F.col("dist_a"), F.col("dist_b"))})


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def head_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, with their place as ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
