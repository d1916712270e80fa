"""Confusion, classification and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .conditions import count_if
from .ranking import running_sums
from .selection import quantiles


def confusion_counts(predicted: Column, truth: Column) -> list[Column]:
    return [count_if(predicted & truth).alias("tp"), count_if(predicted & ~truth).alias("fp"), count_if(~predicted & truth).alias("fn"), count_if(~predicted & ~truth).alias("tn")]


def with_metrics(df: DataFrame, absent_is_zero: bool = True) -> DataFrame:
    """Precision, recall, F1, accuracy and balanced accuracy from tp, fp, fn, tn; 0 where undefined.

    Balanced accuracy takes the recall of an absent class as 0, or, with
    ``absent_is_zero=False``, is the mean over the classes present in the truth.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = S.ratio(tp, tp + fn), S.ratio(tn, tn + fp)
    mean = (F.coalesce(recall, F.lit(0.0)) + F.coalesce(specificity, F.lit(0.0))) / 2
    balanced = mean if absent_is_zero else F.when(recall.isNull(), specificity).when(specificity.isNull(), recall).otherwise(mean)
    return df.withColumns({
        "precision": S.ratio_or_zero(tp, tp + fp), "recall": F.coalesce(recall, F.lit(0.0)),
        "f1": S.ratio_or_zero(2 * tp, 2 * tp + fp + fn), "accuracy": S.ratio_or_zero(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": F.coalesce(balanced, F.lit(0.0)),
    })


def cross_evaluation(pairs: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """Each label source as predictor of each other one, with F1 less that of the truth against itself.

    One aggregate over the table for all combinations; nothing is joined.
    """
    names = list(labels)
    combos = [(p, t) for p in names for t in names]
    sums = [c.alias(f"{kind}_{i}") for i, (p, t) in enumerate(combos) for kind, c in zip(("tp", "fp", "fn", "tn"), confusion_counts(labels[p], labels[t]), strict=True)]
    rows = F.array(*[F.struct(F.lit(p).alias("predictor"), F.lit(t).alias("truth"), *[F.col(f"{k}_{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, (p, t) in enumerate(combos)])
    out = with_metrics(pairs.agg(*sums).select(F.explode(rows).alias("r")).select("r.*"))
    own = out.where(F.col("predictor") == F.col("truth")).select("truth", F.col("f1").alias("self_f1"))
    return out.join(own, "truth").withColumn("delta_f1", F.col("f1") - F.col("self_f1")).drop("self_f1")


def _by_score(df: DataFrame, group: Sequence[str], score: str, truth: Column) -> DataFrame:
    """Positives and rows at each distinct score; ties become one row, so sums along the score are exact."""
    return df.where(F.col(score).isNotNull()).groupBy(*group, score).agg(count_if(truth).alias("p"), F.count("*").alias("m"))


def auroc(df: DataFrame, group: Sequence[str], score: str, truth: Column, ranges: int | None = None) -> DataFrame:
    """Area under the ROC curve, higher scores meaning positive, ties averaged; null for a single class."""
    each = running_sums(_by_score(df, group, score, truth), group, [score], {"cm": F.col("m")}, ranges)
    sums = each.groupBy(*group).agg(F.sum(F.col("p") * (F.col("cm") - F.col("m") + (F.col("m") + 1) / F.lit(2.0))).alias("ranks"), F.sum("p").alias("positives"), F.sum("m").alias("n"))
    p = F.col("positives").cast("double")
    return sums.withColumn("auroc", F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * (F.col("n") - p))).drop("ranks")


def average_precision(df: DataFrame, group: Sequence[str], score: str, truth: Column, ranges: int | None = None) -> DataFrame:
    """Step-wise average precision over descending scores, ties as one step; null without positives."""
    each = _by_score(df, group, score, truth).withColumn("_down", -F.col(score))
    each = running_sums(each, group, ["_down"], {"cp": F.col("p"), "cm": F.col("m")}, ranges)
    out = each.groupBy(*group).agg(F.sum(F.col("p") * F.col("cp") / F.col("cm")).alias("s"), F.sum("p").alias("positives"))
    return out.select(*group, "positives", F.try_divide(F.col("s"), F.col("positives").cast("double")).alias("average_precision"))


def at_median(df: DataFrame, group: Sequence[str], score: str, truth: Column) -> DataFrame:
    """Metrics of ``score >= median`` in each group."""
    joined = df.join(quantiles(df, group, score, {"median": 0.5}), list(group))
    return with_metrics(joined.groupBy(*group, "median").agg(*confusion_counts(F.col(score) >= F.col("median"), truth)))
