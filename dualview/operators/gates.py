"""Pre-declared decisions over aggregate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Protocol
from .relations import ordered_names


def verdict(ok: Column, yes: str = "GO", no: str = "NO_GO") -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), yes).otherwise(no)


def order_flips(metrics: DataFrame, source: str, model: str, value: str, a: str, b: str) -> DataFrame:
    """One row: models by value under each of two sources, whether the best or the order differs, and the largest shift."""
    wide = metrics.where(F.col(source).isin(a, b))
    names = ordered_names(wide, [source], model, value)
    pick = lambda s: F.max(F.when(F.col(source) == s, F.col("names")))
    orders = names.agg(pick(a).alias("order_a"), pick(b).alias("order_b"))
    shift = wide.groupBy(model).agg((F.max(F.when(F.col(source) == a, F.col(value))) - F.max(F.when(F.col(source) == b, F.col(value)))).alias("d")).agg(F.max(F.abs("d")).alias("max_shift"), F.count("*").alias("models"))
    both = orders.crossJoin(shift)
    first = lambda c: F.substring_index(c, "|", 1)
    return both.withColumns({"top_flip": first("order_a") != first("order_b"), "order_flip": F.col("order_a") != F.col("order_b")})


def launch_gate(flips: DataFrame, n: Column, rate: Column, models: int = 3, protocol: Protocol = DEFAULT) -> DataFrame:
    """Enough rows, enough discordance, a flip, and a large enough shift, with every model there."""
    ok = (n >= protocol.launch_n) & (rate >= protocol.launch_discordance) & (F.col("top_flip") | F.col("order_flip")) & (F.col("max_shift") >= protocol.launch_shift) & (F.col("models") == models)
    return flips.withColumn("verdict", verdict(ok))


def panel_gate(flips: DataFrame, models: int = 3, protocol: Protocol = DEFAULT) -> DataFrame:
    """A flip and a large enough shift over a full panel."""
    ok = (F.col("top_flip") | F.col("order_flip")) & (F.col("max_shift") >= protocol.launch_shift)
    return flips.withColumn("verdict", F.when(F.col("models") < models, "BLOCKED").otherwise(verdict(ok)))


def selection_gate(top: DataFrame, protocol: Protocol = DEFAULT) -> DataFrame:
    """At least so many models with a high top rate, enrichment and small p."""
    ok = (F.col("top_rate") >= protocol.select_rate) & (F.col("enrichment") >= protocol.select_enrichment) & (F.col("p_value") <= protocol.select_p)
    return top.agg(F.count_if(ok).alias("passing"), F.count("*").alias("models")).withColumn("verdict", verdict(F.col("passing") >= protocol.select_models))


def coverage_tier(n: Column, protocol: Protocol = DEFAULT) -> Column:
    return F.when(n >= protocol.coverage_full, "full").when(n >= protocol.coverage_min, "limited").otherwise("blocked")
