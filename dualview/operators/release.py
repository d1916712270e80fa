"""Block-calibrated conformal p-values, e-values and step-up release."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import SMALL, estimated_bytes, running_sums
from .selection import rank_keys, within
from .settled import settle


def hashed_halves(df: DataFrame, block: str, seed: int) -> DataFrame:
    """Blocks halved by md5: ``is_cal`` for each row."""
    return df.withColumn("is_cal", S.hashed(seed, F.col(block)) % 2 == 0)


def test_seeds(block: str, seeds: Sequence[int]) -> Column:
    """The seeds by which ``hashed_halves`` leaves a block for the test."""
    return F.filter(F.array(*map(F.lit, seeds)), lambda s: S.hashed(s, F.col(block)) % 2 != 0)


def observed_mask(df: DataFrame, truth: Column, score: str, id: str, rho: float) -> DataFrame:
    """``observed``: the top round(rho * positives) positives by score, halves rounded to even."""
    marked = df.withColumns({"_pos": F.coalesce(truth, F.lit(False)), "_down": -F.col(score)})
    top = within(marked, ["_pos"], ["_down", id], lambda n: {"_top": S.half_even(F.lit(float(rho)) * n)})
    return top.withColumn("observed", F.col("_pos") & F.col("_top")).drop("_pos", "_down", "n", "_top")


def exceeding(test: DataFrame, maxima: DataFrame, group: Sequence[str], score: str, maximum: str, sizes: DataFrame | None = None) -> DataFrame:
    """(group, _v, _exceed, _m): for each distinct score of ``test`` how many of its group's maxima reach it, of how many.

    Both sides are put in one order of values and counted along it; no pairs are formed. Groups without maxima are left out.
    ``sizes`` (group, _m) stands for the numbers of all maxima if those below every score were left out of ``maxima``.
    """
    scores = test.select(*group, F.col(score).alias("_v")).distinct().select(*group, "_v", F.lit(0).cast("long").alias("_c"))
    both = scores.unionByName(maxima.groupBy(*group, F.col(maximum).alias("_v")).agg(F.count("*").alias("_c")))
    per = both.groupBy(*group, "_v").agg(F.sum("_c").alias("_c")).withColumn("_down", -F.col("_v"))
    counted = running_sums(per, group, ["_down"], {"_exceed": F.col("_c")}).select(*group, "_v", "_exceed")
    sizes = maxima.groupBy(*group).agg(F.count("*").alias("_m")) if sizes is None else sizes
    return counted.join(sizes, list(group)) if group else counted.crossJoin(F.broadcast(sizes))


def evidence(exceed: Column, m: Column) -> tuple[Column, Column]:
    """p = (1 + exceed) / (m + 1) and e = gamma p^(gamma - 1) with gamma = -1 / ln(1 / (m + 1)); e is 0 where gamma isn't in (0, 1)."""
    p = F.least(F.lit(1.0), (1 + exceed) / (m + 1.0))
    gamma = S.conformal_gamma(1.0 / (m + 1.0))
    return p, F.coalesce(gamma * F.pow(p, gamma - 1), F.lit(0.0))


def e_values(test: DataFrame, maxima: DataFrame, score: str, maximum: str = "block_max") -> DataFrame:
    """``p`` and ``e`` of each test row against the calibration blocks' maxima."""
    seen = exceeding(test, maxima, [], score, maximum)
    p, e = evidence(F.col("_exceed"), F.col("_m"))
    return test.join(seen, F.col(score) == F.col("_v")).withColumns({"p": p, "e": e}).drop("_v", "_exceed", "_m")


def release_grid(rows: DataFrame, block: str, seeds: Callable[[str], Column], score: str, id: str, budgets: Sequence[int], alpha: float) -> DataFrame:
    """``release`` for every seed and budget in one plan: seed, budget, released, best_mass_ratio, a_false_rate, b_false_rate.

    ``rows`` has observed, lab_a and lab_b; ``seeds`` maps the block column to the array of seeds by which a block is tested, and
    all others calibrate. What depends on blocks is found once for each block: its seeds, and the maximum of its unobserved rows.
    e falls with the number of maxima that reach a score, so the order of e is the order of scores, with one
    running count for all budgets of a seed. A seed without calibrating blocks has e = 0, so it releases nothing; a seed without rows to test is left out.
    """
    largest = max(budgets)
    rows = rows.select(block, score, id, "observed", "lab_a", "lab_b")
    blocks = rows.groupBy(block).agg(F.max(F.when(~F.col("observed"), F.col(score))).alias("_max")).withColumn("_tests", seeds(block))
    blocks = settle(blocks, "blocks")
    known = blocks.select(F.explode("_tests").alias("seed")).distinct().agg(F.collect_set("seed").alias("_every"))
    maxima = blocks.where("_max is not null").crossJoin(F.broadcast(known)).select("_max", F.explode(F.array_except("_every", "_tests")).alias("seed"))
    mine = _leading(rows, block, seeds, score, largest).select(F.col(block).alias("_block"), F.col(score).alias("_score"), F.col(id).alias("_id"), "lab_a", "lab_b").join(blocks.select(F.col(block).alias("_of"), "_tests"), F.col("_block").eqNullSafe(F.col("_of")))
    best = Window.partitionBy("seed").orderBy(F.desc("_score"), "_id")
    pool = mine.select(F.explode("_tests").alias("seed"), "_score", "_id", "lab_a", "lab_b").withColumn("k", F.row_number().over(best)).where(F.col("k") <= largest)
    upto = best.rowsBetween(Window.unboundedPreceding, 0)
    wrong = lambda c: F.sum((~F.col(c)).cast("long")).over(upto)
    told = lambda c: F.count(c).over(upto)
    pool = pool.withColumns({"_fa": wrong("lab_a"), "_fb": wrong("lab_b"), "_na": told("lab_a"), "_nb": told("lab_b")})  # at most the largest budget in each seed
    pool = settle(pool, "pool")
    sizes = maxima.groupBy("seed").agg(F.count("*").alias("_m"))
    least = F.broadcast(pool.groupBy("seed").agg(F.min("_score").alias("_least")))
    reaching = maxima.join(least, "seed").where(F.col("_least").isNull() | (F.col("_max") >= F.col("_least"))).drop("_least")
    seen = exceeding(pool, reaching, ["seed"], "_score", "_max", sizes).withColumnRenamed("seed", "_seed")
    _, e = evidence(F.col("_exceed"), F.col("_m"))
    valued = pool.join(seen, (F.col("seed") == F.col("_seed")) & (F.col("_score") == F.col("_v")), "left").withColumn("e", F.coalesce(e, F.lit(0.0)))
    cells = valued.withColumn("budget", F.explode(F.filter(F.array(*map(F.lit, budgets)), lambda b: b >= F.col("k"))))
    passes = F.col("e") >= F.col("budget") / (F.lit(alpha) * F.col("k"))
    last = lambda c: F.max_by(F.when(passes, F.col(c)), F.when(passes, F.col("k")))
    out = cells.groupBy("seed", "budget").agg(
        F.coalesce(F.max(F.when(passes, F.col("k"))), F.lit(0)).alias("released"), F.greatest(F.lit(0.0), F.max(F.lit(alpha) * F.col("k") * F.col("e") / F.col("budget"))).alias("best_mass_ratio"),
        F.coalesce(F.try_divide(last("_fa"), last("_na")), F.lit(0.0)).alias("a_false_rate"), F.coalesce(F.try_divide(last("_fb"), last("_nb")), F.lit(0.0)).alias("b_false_rate"),
    )
    return out


def _leading(rows: DataFrame, block: str, seeds: Callable[[str], Column], score: str, largest: int) -> DataFrame:
    """Rows among which every seed finds its ``largest`` best: those that reach a score which so many rows of each seed reach.

    The bound is looked for at ranks eight times further each, and is held against exact counts by seed; a small table, and one
    where a seed has fewer rows in all, is taken whole.
    """
    if estimated_bytes(rows) <= SMALL:
        return rows
    tests = rows.select((-F.col(score)).alias("_down"), F.col(block).alias("_block"))
    wanted = [largest * 8 ** (i + 1) for i in range(4)]
    keys = rank_keys(tests.select("_down"), [], ["_down"], lambda n: {f"k{i}": F.lit(x) for i, x in enumerate(wanted)}).first()
    every = None
    for i in range(len(wanted)):
        if keys is None or keys[f"k{i}"] is None or keys[f"k{i}"]["_down"] is None:
            continue
        at = keys[f"k{i}"]["_down"]
        if every is None:
            every = {r["seed"] for r in tests.select("_block").distinct().select(F.explode(seeds("_block")).alias("seed")).distinct().collect()}
        best = tests.where(F.col("_down") <= at)
        full = {r["seed"] for r in best.select(F.explode(seeds("_block")).alias("seed")).groupBy("seed").count().where(F.col("count") >= largest).collect()}
        if full == every:
            return rows.where(-F.col(score) <= at)
    return rows


def release(test: DataFrame, score: str, id: str, budget: int, alpha: float) -> DataFrame:
    """One row: how many of the ``budget`` best-scored rows are released, the best mass ratio, and false shares.

    ``test`` has e, lab_a and lab_b. False-release rates are means over the released rows, 0 for none.
    """
    pool = test.orderBy(F.desc(score), id).limit(budget)
    k = F.row_number().over(Window.orderBy(F.desc("e"), F.desc(score), id))
    rows = pool.withColumn("k", k)
    last = rows.agg(F.coalesce(F.max(F.when(F.col("e") >= F.lit(float(budget)) / (F.lit(alpha) * F.col("k")), F.col("k"))), F.lit(0)).alias("released"), F.coalesce(F.max(F.lit(alpha) * F.col("k") * F.col("e") / budget), F.lit(0.0)).alias("best_mass_ratio"))
    out = last.join(rows, F.col("k") <= F.col("released"), "left").groupBy("released", "best_mass_ratio")
    false = lambda c: F.coalesce(F.avg(F.when(F.col(c).isNotNull(), (~F.col(c)).cast("double"))), F.lit(0.0))
    return out.agg(false("lab_a").alias("a_false_rate"), false("lab_b").alias("b_false_rate"))
