"""Queries on agreement: summaries, conditions, sweeps, bins, confusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import conditions as C
from ..operators import metrics as M
from .tables import LB, LI, documents, items, query

SUMS = "count(*) AS n, count(*) FILTER (WHERE disc) AS discordant_n, count(*) FILTER (WHERE lab_a AND NOT lab_b) AS a_only_n, count(*) FILTER (WHERE lab_b AND NOT lab_a) AS b_only_n"


@query(LI + f"SELECT flag, status, {SUMS}, count(*) FILTER (WHERE disc) / count(*) AS discordance_rate, (count(*) FILTER (WHERE lab_a AND NOT lab_b) - count(*) FILTER (WHERE lab_b AND NOT lab_a)) / nullif(count(*) FILTER (WHERE disc), 0) AS direction_balance FROM li GROUP BY flag, status")
def pair_summary(spark, sf):
    return C.with_rates(items(spark, sf).groupBy("flag", "status").agg(*C.summary()))


@query(LI + "SELECT direction, count(*) AS n FROM li GROUP BY direction")
def pair_direction(spark, sf):
    return items(spark, sf).groupBy("direction").agg(F.count("*").alias("n"))


@query(LI + "SELECT quadrant, count(*) AS n, count(*) / (SELECT count(*) FROM li) AS share FROM li GROUP BY quadrant")
def pair_quadrants(spark, sf):
    cells = items(spark, sf).groupBy("quadrant").agg(F.count("*").alias("n"))
    return cells.crossJoin(F.broadcast(cells.agg(F.sum("n").alias("all")))).select("quadrant", "n", S.ratio(F.col("n"), F.col("all")).alias("share"))


@query(LB + "SELECT lang, count(*) FILTER (WHERE lab_a AND lab_b) AS tp, count(*) FILTER (WHERE lab_a AND NOT lab_b) AS fp, count(*) FILTER (WHERE lab_b AND NOT lab_a) AS fn, count(*) FILTER (WHERE NOT lab_a AND NOT lab_b) AS tn FROM lb GROUP BY lang")
def pair_cells_documents(spark, sf):
    return documents(spark, sf).groupBy("lang").agg(*M.confusion_counts(F.col("lab_a"), F.col("lab_b")))


def _conditions():
    a, b = F.col("lab_a"), F.col("lab_b")
    near = S.near_either(F.col("dist_a"), F.col("dist_b"), 0.03)
    return {"full": F.lit(True), "a_stable": a, "b_stable": b, "near_either": near, "far_stable": ~near & a & b, "far_unstable": ~near & ~a & ~b, "returned": F.col("flag") == "R", "no_such_flag": F.col("flag") == "?"}


_WHERE = {"full": "true", "a_stable": "lab_a", "b_stable": "lab_b", "near_either": "(abs(dist_a) <= 3e-2 OR abs(dist_b) <= 3e-2)", "far_stable": "NOT (abs(dist_a) <= 3e-2 OR abs(dist_b) <= 3e-2) AND lab_a AND lab_b", "far_unstable": "NOT (abs(dist_a) <= 3e-2 OR abs(dist_b) <= 3e-2) AND NOT lab_a AND NOT lab_b", "returned": "flag = 'R'", "no_such_flag": "flag = '?'"}


def _union(columns: str) -> str:
    return LI + " UNION ALL ".join(f"SELECT {i} AS place, '{name}' AS condition, {columns} FROM li WHERE {where}" for i, (name, where) in enumerate(_WHERE.items()))


@query(_union(SUMS + ", quantile_cont(gap, 0.5) AS median_gap, count(*) FILTER (WHERE disc) / nullif(count(*), 0) AS discordance_rate, (count(*) FILTER (WHERE lab_a AND NOT lab_b) - count(*) FILTER (WHERE lab_b AND NOT lab_a)) / nullif(count(*) FILTER (WHERE disc), 0) AS direction_balance"))
def selection_atlas(spark, sf):
    return C.selection_atlas(items(spark, sf), _conditions())


@query(_union(SUMS + ", min(dist_a) AS dist_a_min, max(dist_a) AS dist_a_max, min(dist_b) AS dist_b_min, max(dist_b) AS dist_b_max, count(*) FILTER (WHERE disc) / nullif(count(*), 0) AS discordance_rate, count(*) FILTER (WHERE lab_a AND NOT lab_b) / nullif(count(*), 0) AS a_only_rate, count(*) FILTER (WHERE lab_b AND NOT lab_a) / nullif(count(*), 0) AS b_only_rate"))
def selection_summary_minmax(spark, sf):
    return C.selection_summary(items(spark, sf), _conditions())


THRESHOLDS = (0.0, 0.01, 0.02, 0.04, 0.08)


@query(LI + """, s AS (SELECT t.threshold, count(*) AS n_total, count(*) FILTER (WHERE disc) AS discordant_n, count(*) FILTER (WHERE abs(dist_a) <= t.threshold OR abs(dist_b) <= t.threshold) AS flagged_n,
  count(*) FILTER (WHERE disc AND (abs(dist_a) <= t.threshold OR abs(dist_b) <= t.threshold)) AS captured_n
  FROM li, (VALUES (0e0), (1e-2), (2e-2), (4e-2), (8e-2)) AS t(threshold) GROUP BY t.threshold)
SELECT *, flagged_n / n_total AS flagged_fraction, captured_n / nullif(discordant_n, 0) AS captured_fraction, n_total - flagged_n AS outside_n, discordant_n - captured_n AS outside_discordant_n,
  (discordant_n - captured_n) / nullif(n_total - flagged_n, 0) AS outside_rate, captured_n / nullif(flagged_n, 0) AS flag_precision, flagged_n - captured_n AS concordant_flagged_n, (flagged_n - captured_n) / n_total AS concordant_flagged_fraction FROM s""")
def threshold_sweep(spark, sf):
    return C.threshold_sweep(items(spark, sf), THRESHOLDS)


_A, _B = "abs(dist_a) <= 3e-2", "abs(dist_b) <= 3e-2"


@query(LI + " UNION ALL ".join(f"SELECT {i} AS place, '{name}' AS condition, count(*) AS n, count(*) FILTER (WHERE disc) AS discordant_n, count(*) FILTER (WHERE disc) / nullif(count(*), 0) AS discordance_rate FROM li WHERE {w}" for i, (name, w) in enumerate({"both": f"{_A} AND {_B}", "either": f"({_A} OR {_B})", "neither": f"NOT ({_A} OR {_B})", "a": _A, "b": _B}.items())))
def near_boundary_bands(spark, sf):
    return C.near_bands(items(spark, sf), 0.03)


_RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
  CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END AS accuracy, (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2 AS balanced_accuracy"""
_CELLS = "count(*) FILTER (WHERE {p} AND {t}) AS tp, count(*) FILTER (WHERE {p} AND NOT {t}) AS fp, count(*) FILTER (WHERE NOT {p} AND {t}) AS fn, count(*) FILTER (WHERE NOT {p} AND NOT {t}) AS tn"


def cells(p: str, t: str) -> str:
    return _CELLS.format(p=p, t=t)


@query(LI + f", c AS (SELECT flag, {cells('lab_a', 'lab_b')} FROM li GROUP BY flag) SELECT *, {_RATES} FROM c")
def confusion_metrics(spark, sf):
    return M.with_metrics(items(spark, sf).groupBy("flag").agg(*M.confusion_counts(F.col("lab_a"), F.col("lab_b"))))


_SOURCES = {"a": "lab_a", "b": "lab_b", "returned": "(flag = 'R')"}


@query(LI + ", c AS (" + " UNION ALL ".join(f"SELECT '{p}' AS predictor, '{t}' AS truth, {cells(x, y)} FROM li" for p, x in _SOURCES.items() for t, y in _SOURCES.items()) + f"), m AS (SELECT *, {_RATES} FROM c) SELECT m.*, m.f1 - s.f1 AS delta_f1 FROM m JOIN m s ON s.predictor = m.truth AND s.truth = m.truth")
def cross_eval_delta(spark, sf):
    return M.cross_evaluation(items(spark, sf), {"a": F.col("lab_a"), "b": F.col("lab_b"), "returned": F.col("flag") == "R"})


@query(LI + """, s AS (SELECT count(*) FILTER (WHERE lab_a) AS a, count(*) FILTER (WHERE lab_b) AS b, count(*) FILTER (WHERE lab_a AND NOT lab_b) AS a_only, count(*) FILTER (WHERE lab_b AND NOT lab_a) AS b_only, count(*) FILTER (WHERE lab_a AND lab_b) AS kept FROM li)
SELECT 'a_lost_under_b' AS measure, a_only / a AS value FROM s UNION ALL SELECT 'b_lost_under_a', b_only / b FROM s UNION ALL SELECT 'a_kept_under_b', kept / a FROM s UNION ALL SELECT 'b_kept_under_a', kept / b FROM s""")
def transfer_loss(spark, sf):
    a, b = F.col("lab_a"), F.col("lab_b")
    s = items(spark, sf).agg(*[C.count_if(c).alias(n) for n, c in {"a": a, "b": b, "a_only": a & ~b, "b_only": b & ~a, "kept": a & b}.items()])
    rows = [("a_lost_under_b", "a_only", "a"), ("b_lost_under_a", "b_only", "b"), ("a_kept_under_b", "kept", "a"), ("b_kept_under_a", "kept", "b")]
    return s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), S.ratio(F.col(x), F.col(y)).alias("value")) for n, x, y in rows])).alias("r")).select("r.*")


@query(LI + " UNION ALL ".join(f"SELECT {i} AS place, '{name}' AS condition, count(*) AS n, count(*) FILTER (WHERE lab_a) AS a_n, count(*) FILTER (WHERE lab_b) AS b_n FROM li WHERE {w}" for i, (name, w) in enumerate({"full": "true", "agreement_only": "NOT disc", "conflict_only": "disc"}.items())))
def denominator_variants(spark, sf):
    d = F.col("discordant")
    return C.by_condition(items(spark, sf), {"full": F.lit(True), "agreement_only": ~d, "conflict_only": d}, [F.count("*").alias("n"), C.count_if(F.col("lab_a")).alias("a_n"), C.count_if(F.col("lab_b")).alias("b_n")], ("n", "a_n", "b_n"))


SIZES = ([200, 500, 1000, 2000, 5000, 1000000], ["<=200", "200-500", "500-1k", "1k-2k", "2k-5k", "5k-1M", ">1M"])


def _case(c: str, edges, labels) -> str:
    return "CASE " + " ".join(f"WHEN {c} <= {e:.17e} THEN '{x}'" for e, x in zip(edges, labels, strict=False)) + f" WHEN {c} IS NOT NULL THEN '{labels[-1]}' END"


def _bins(base: str, rel: str, sources: dict[str, str], edges, labels) -> str:
    dim = ", ".join(f"('{s}', {i}, '{b}')" for s in sources for i, b in enumerate(labels))
    rows = " UNION ALL ".join(f"SELECT '{s}' AS source, {_case(c, edges, labels)} AS bin, disc FROM {rel}" for s, c in sources.items())
    return base + f", r AS ({rows}) SELECT d.source, d.place, d.bin, count(r.disc) AS n, count(*) FILTER (WHERE r.disc) AS discordant_n, count(*) FILTER (WHERE r.disc) / nullif(count(r.disc), 0) AS discordance_rate FROM (VALUES {dim}) AS d(source, place, bin) LEFT JOIN r ON r.source = d.source AND r.bin = d.bin GROUP BY d.source, d.place, d.bin"


@query(_bins(LB, "lb", {"size": "n_chars"}, *SIZES))
def size_bins_right_closed(spark, sf):
    return C.binned(documents(spark, sf), {"size": "n_chars"}, *SIZES)


DISTANCES = ([0.0, 0.01, 0.02, 0.05, 0.08], ["<=0", "0-0.01", "0.01-0.02", "0.02-0.05", "0.05-0.08", ">0.08"])


@query(_bins(LI, "li", {"a": "dist_a", "b": "dist_b"}, *DISTANCES))
def dist_bins_two_source(spark, sf):
    return C.binned(items(spark, sf), {"a": "dist_a", "b": "dist_b"}, *DISTANCES)


@query(LI + "SELECT 0 AS place, 'lineitem' AS step, count(*) AS n FROM li UNION ALL SELECT 1, 'both labels', count(*) FILTER (WHERE lab_a IS NOT NULL AND lab_b IS NOT NULL) FROM li UNION ALL SELECT 2, 'near either', count(*) FILTER (WHERE abs(dist_a) <= 3e-2 OR abs(dist_b) <= 3e-2) FROM li UNION ALL SELECT 3, 'discordant', count(*) FILTER (WHERE disc) FROM li UNION ALL SELECT 4, 'orders', count(*) FROM orders")
def funnel_audit(spark, sf):
    from .tables import table

    li = items(spark, sf)
    return C.funnel({"lineitem": li, "both labels": (li, F.col("lab_a").isNotNull() & F.col("lab_b").isNotNull()), "near either": (li, S.near_either(F.col("dist_a"), F.col("dist_b"), 0.03)), "discordant": (li, F.col("discordant")), "orders": table(spark, sf, "orders")})


@query(LI + "SELECT 'lineitem' AS relation, 'a' AS source, count(*) AS n, count(*) FILTER (WHERE lab_a) AS stable_n, count(*) FILTER (WHERE lab_a) / count(*) AS fraction FROM li UNION ALL SELECT 'lineitem', 'b', count(*), count(*) FILTER (WHERE lab_b), count(*) FILTER (WHERE lab_b) / count(*) FROM li UNION ALL SELECT 'labels', 'quality', count(*), count(*) FILTER (WHERE quality = 1), count(*) FILTER (WHERE quality = 1) / count(*) FROM labels UNION ALL SELECT 'labels', 'toxic', count(*), count(*) FILTER (WHERE toxic = 1), count(*) FILTER (WHERE toxic = 1) / count(*) FROM labels")
def population_fractions(spark, sf):
    from .tables import table

    def of(df, relation, sources):
        sums = df.agg(F.count("*").alias("n"), *[C.count_if(c).alias(s) for s, c in sources.items()])
        return sums.select(F.explode(F.array(*[F.struct(F.lit(relation).alias("relation"), F.lit(s).alias("source"), F.col("n"), F.col(s).alias("stable_n"), S.ratio(F.col(s), F.col("n")).alias("fraction")) for s in sources])).alias("r")).select("r.*")

    return of(items(spark, sf), "lineitem", {"a": F.col("lab_a"), "b": F.col("lab_b")}).unionByName(of(table(spark, sf, "labels"), "labels", {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1}))


@query(LI + "SELECT CASE WHEN lab_a IS NULL OR lab_b IS NULL THEN 'common_hull_unavailable' WHEN (flag = 'R') AND NOT disc THEN 'native_only_discordance' WHEN (flag = 'R') THEN 'persistent_discordance' WHEN disc THEN 'common_only_discordance' ELSE 'concordant' END AS mechanism, count(*) AS n FROM li GROUP BY 1")
def mechanism_classifier(spark, sf):
    from ..operators.relations import mechanism

    return items(spark, sf).groupBy(mechanism(F.col("lab_a"), F.col("lab_b"), F.col("flag") == "R").alias("mechanism")).agg(F.count("*").alias("n"))
