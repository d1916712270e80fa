"""Aggregates over overlapping conditions, thresholds and bins, in one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import RANGE, estimated_bytes
from .selection import quantiles


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def by_name(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Each row once for every condition it satisfies, with the condition's name."""
    names = F.filter(F.array(*[F.when(c, name) for name, c in conditions.items()]), lambda x: x.isNotNull())
    return df.withColumn("condition", F.explode(names))


def by_condition(df: DataFrame, conditions: dict[str, Column], aggregates: Sequence[Column], counts: Sequence[str] = ()) -> DataFrame:
    """One row for each condition, in their order, over the rows that satisfy it.

    A row belongs to every condition it satisfies: names are gathered in an array, exploded
    and grouped, so the table is read once and pre-aggregated before the shuffle. Conditions
    without rows stay, with 0 in the columns ``counts``.
    """
    found = by_name(df, conditions).groupBy("condition").agg(*aggregates)
    dim = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(conditions)], "place int, condition string")
    out = dim.join(found, "condition", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}) if counts else out


def summary() -> list[Column]:
    """n, discordant_n and directional counts of labelled pairs."""
    d = F.col("direction")
    return [F.count("*").alias("n"), count_if(F.col("discordant")).alias("discordant_n"), count_if(d == "a_only").alias("a_only_n"), count_if(d == "b_only").alias("b_only_n")]


def with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"discordance_rate": S.ratio(F.col("discordant_n"), F.col("n")), "direction_balance": S.ratio(F.col("a_only_n") - F.col("b_only_n"), F.col("discordant_n"))})


def selection_atlas(pairs: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """n, rates, directions, balance and median gap under each condition.

    Medians of a small table are part of the one pass; those of a larger one are looked up by rank (``selection.quantiles``).
    """
    small = estimated_bytes(pairs) <= RANGE
    median = [F.percentile("gap", F.lit(0.5)).alias("median_gap")] if small else []
    out = by_condition(pairs, conditions, [*summary(), *median], ("n", "discordant_n", "a_only_n", "b_only_n"))
    if not small:
        out = out.join(quantiles(by_name(pairs, conditions), ["condition"], "gap", {"median_gap": 0.5}, True), "condition", "left")
    return with_rates(out)


def selection_summary(pairs: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Counts, directional rates and ranges of both distances under each condition."""
    ranges = [f(c).alias(f"{c}_{n}") for c in ("dist_a", "dist_b") for n, f in (("min", F.min), ("max", F.max))]
    out = by_condition(pairs, conditions, [*summary(), *ranges], ("n", "discordant_n", "a_only_n", "b_only_n"))
    return out.withColumns({"discordance_rate": S.ratio(F.col("discordant_n"), F.col("n")), "a_only_rate": S.ratio(F.col("a_only_n"), F.col("n")), "b_only_rate": S.ratio(F.col("b_only_n"), F.col("n"))})


def threshold_sweep(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """How a near-boundary flag at each threshold captures discordance."""
    a, b, d = F.col("dist_a"), F.col("dist_b"), F.col("discordant")
    flags = [(t, S.near_either(a, b, t)) for t in thresholds]
    sums = [F.count("*").alias("n_total"), count_if(d).alias("discordant_n")]
    sums += [count_if(f).alias(f"f{i}") for i, (_, f) in enumerate(flags)] + [count_if(f & d).alias(f"c{i}") for i, (_, f) in enumerate(flags)]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"f{i}").alias("flagged_n"), F.col(f"c{i}").alias("captured_n")) for i, (t, _) in enumerate(flags)])
    one = pairs.agg(*sums).select("n_total", "discordant_n", F.explode(rows).alias("r")).select("r.*", "n_total", "discordant_n")
    n, k, f, c = (F.col(x) for x in ("n_total", "discordant_n", "flagged_n", "captured_n"))
    return one.withColumns({"flagged_fraction": S.ratio(f, n), "captured_fraction": S.ratio(c, k), "outside_n": n - f, "outside_discordant_n": k - c, "outside_rate": S.ratio(k - c, n - f), "flag_precision": S.ratio(c, f), "concordant_flagged_n": f - c, "concordant_flagged_fraction": S.ratio(f - c, n)})


def near_bands(pairs: DataFrame, at: float) -> DataFrame:
    """Discordance near both, either, neither or one boundary."""
    a, b = S.within(F.col("dist_a"), at), S.within(F.col("dist_b"), at)
    bands = {"both": a & b, "either": a | b, "neither": ~(a | b), "a": a, "b": b}
    out = by_condition(pairs, bands, summary()[:2], ("n", "discordant_n"))
    return out.withColumn("discordance_rate", S.ratio(F.col("discordant_n"), F.col("n")))


def binned(pairs: DataFrame, columns: dict[str, str], edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Counts and rates in right-closed bins of one or more columns, empty bins kept."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("source"), S.right_closed(F.col(c), edges, labels).alias("bin")) for name, c in columns.items()]))
    found = pairs.select("discordant", rows.alias("r")).groupBy("r.source", "r.bin").agg(F.count("*").alias("n"), count_if(F.col("discordant")).alias("discordant_n"))
    dim = pairs.sparkSession.createDataFrame([(s, i, b) for s in columns for i, b in enumerate(labels)], "source string, place int, bin string")
    out = dim.join(found, ["source", "bin"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "discordant_n")})
    return out.withColumn("discordance_rate", S.ratio(F.col("discordant_n"), F.col("n")))


def group_rates(pairs: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """n, discordant_n and rate by key; rows with a null key are left out."""
    some = pairs.dropna(subset=list(keys))
    return some.groupBy(*keys).agg(F.count("*").alias("n"), count_if(F.col("discordant")).alias("discordant_n"), *more).withColumn("discordance_rate", S.ratio(F.col("discordant_n"), F.col("n")))


def set_rates(pairs: DataFrame, tokens: str, name: str, *more: Column) -> DataFrame:
    """``group_rates`` by each member of a set-valued column; a row counts in several groups."""
    return group_rates(pairs.withColumn(name, F.explode(tokens)), [name], *more)


def funnel(steps: dict[str, DataFrame | tuple[DataFrame, Column]]) -> DataFrame:
    """Counts of several relations, or of their rows under a condition, as one table."""
    out = None
    for i, (name, step) in enumerate(steps.items()):
        df, c = step if isinstance(step, tuple) else (step, F.lit(True))
        row = df.agg(count_if(c).alias("n")).select(F.lit(i).alias("place"), F.lit(name).alias("step"), "n")
        out = row if out is None else out.unionByName(row)
    return out
