"""Queries on ranks, prefixes and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import conditions as C
from ..operators import gates as G
from ..operators import metrics as M
from ..operators import ranking as K
from ..operators import relations as R
from ..operators import selection as L
from ..operators.ranks import ranked_by_each
from ..operators.settled import settle
from .agreement import _RATES, cells
from .tables import LI, LONG, MODELS, items, query, scores

KS = (100, 300, 500, 1000, 5000, 10000)

RANKED = LONG + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score, id) AS rank, count(*) OVER (PARTITION BY model) AS n FROM long)"""


@query(RANKED + "SELECT model, id, rank, rank / n AS rank_percentile FROM ranked")
def rank_percentile(spark, sf):
    return ranked_by_each(items(spark, sf), "id", MODELS).select("model", "id", "rank", "rank_percentile")


@query(RANKED + ", k AS (SELECT unnest([100, 300, 500, 1000, 5000, 10000]) AS k) SELECT model, CAST(k AS INTEGER) AS k, count(*) AS n, count(*) FILTER (WHERE lab_a) AS a_n, count(*) FILTER (WHERE lab_b) AS b_n, count(*) FILTER (WHERE disc) AS discordant_n, abs(count(*) FILTER (WHERE lab_a) - count(*) FILTER (WHERE lab_b)) AS shift_n FROM ranked JOIN k ON rank <= k GROUP BY model, k HAVING count(*) = k")
def topk_prefix_metrics(spark, sf):
    sums = [C.count_if(F.col("lab_a")).alias("a_n"), C.count_if(F.col("lab_b")).alias("b_n"), C.count_if(F.col("discordant")).alias("discordant_n")]
    return K.prefix_metrics(scores(items(spark, sf)), KS, ["model"], ["score", "id"], sums).withColumn("shift_n", F.abs(F.col("a_n") - F.col("b_n")))


@query(RANKED + ", k AS (SELECT unnest([100, 300, 500, 1000, 2000]) AS k) SELECT model, CAST(k AS INTEGER) AS k, quadrant, count(*) AS n FROM ranked JOIN k ON rank <= k GROUP BY model, k, quadrant")
def topk_quadrants(spark, sf):
    first = K.top_n(scores(items(spark, sf)), ["model"], ["score", "id"], 2000)
    ks = F.filter(F.array(*map(F.lit, (100, 300, 500, 1000, 2000))), lambda k: k >= F.col("rank"))
    return first.withColumn("k", F.explode(ks)).groupBy("model", "k", "quadrant").agg(F.count("*").alias("n"))


@query(RANKED + ", k AS (SELECT unnest([100, 300, 500, 1000, 2000]) AS k) SELECT model, CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE lab_a) / k AS precision_a, count(*) FILTER (WHERE lab_b) / k AS precision_b, count(*) FILTER (WHERE lab_a) / k - count(*) FILTER (WHERE lab_b) / k AS shift FROM ranked JOIN k ON rank <= k GROUP BY model, k HAVING count(*) = k")
def topk_shift(spark, sf):
    long = scores(items(spark, sf))
    out = K.prefix_metrics(long, (100, 300, 500, 1000, 2000), ["model"], ["score", "id"], [C.count_if(F.col("lab_a")).alias("a"), C.count_if(F.col("lab_b")).alias("b")])
    rows = out.select("model", "k", F.explode(F.array(*[F.struct(F.lit(s).alias("source"), S.ratio(F.col(s), F.col("k")).alias("precision")) for s in ("a", "b")])).alias("r")).select("model", "k", "r.*")
    return R.pair_by_column(rows, ["model", "k"], "source", ("a", "b"), "precision")


@query(RANKED + "SELECT model, count(*) AS selected_n, count(*) FILTER (WHERE disc) AS discordant_n FROM ranked WHERE rank <= least(n, greatest(ceil(0.05::DOUBLE * n), 20)) GROUP BY model")
def topk_fraction_floor20(spark, sf):
    rows = L.within(scores(items(spark, sf)), ["model"], ["score", "id"], lambda n: {"top": K.top_size(n, 0.05, 20)})
    return rows.where("top").groupBy("model").agg(F.count("*").alias("selected_n"), C.count_if(F.col("discordant")).alias("discordant_n"))


BINS = RANKED + """, binned AS (
  SELECT *, 0 AS place, 'top_10' AS bin FROM ranked WHERE rank <= least(n, greatest(ceil(1e-1 * n), 20))
  UNION ALL SELECT *, 1, '10_25' FROM ranked WHERE rank > floor(1e-1 * n) AND rank <= ceil(25e-2 * n)
  UNION ALL SELECT *, 2, '25_50' FROM ranked WHERE rank > floor(25e-2 * n) AND rank <= ceil(5e-1 * n)
  UNION ALL SELECT *, 3, '50_100' FROM ranked WHERE rank > floor(5e-1 * n)
), base AS (SELECT model, count(*) FILTER (WHERE disc) / count(*) AS baseline FROM ranked GROUP BY model)"""


def _bins(spark, sf):
    """Bins of every model in one pass over rows marked with the edges they stand before."""
    rows = L.within(scores(items(spark, sf)), ["model"], ["score", "id"], K.bin_edges)
    wide = rows.groupBy("model").agg(F.max("n").alias("n"), C.count_if(F.col("discordant")).alias("all"), *[C.count_if(F.col("discordant") & inside).alias(f"d{i}") for i, (_, inside) in enumerate(K.in_bins())])
    edges = K.bin_edges(F.col("n"))
    spans = [(F.lit(1), edges["top"]), (edges["low10"] + 1, edges["high25"]), (edges["low25"] + 1, edges["high50"]), (edges["low50"] + 1, F.col("n"))]
    each = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("bin"), (b - a + 1).cast("long").alias("bin_n"), F.col(f"d{i}").alias("discordant_n"), a.cast("long").alias("first"), b.cast("long").alias("last")) for i, ((name, _), (a, b)) in enumerate(zip(K.in_bins(), spans, strict=True))]
    bins = wide.select("model", S.ratio(F.col("all"), F.col("n")).alias("baseline"), F.explode(F.array(*each)).alias("b")).select("model", "b.*", "baseline").where("bin_n > 0")
    return bins.withColumn("rate", S.ratio(F.col("discordant_n"), F.col("bin_n"))).withColumn("enrichment", F.try_divide("rate", "baseline"))


@query(BINS + " SELECT model, place, bin, count(*) AS bin_n, count(*) FILTER (WHERE disc) AS discordant_n, min(rank) AS first, max(rank) AS last, count(*) FILTER (WHERE disc) / count(*) AS rate, baseline, count(*) FILTER (WHERE disc) / count(*) / nullif(baseline, 0) AS enrichment FROM binned JOIN base USING (model) GROUP BY model, place, bin, baseline")
def rank_bins_overlap(spark, sf):
    return _bins(spark, sf)


@query(BINS + " SELECT model, count(*) FILTER (WHERE disc) / count(*) AS top_rate, count(*) FILTER (WHERE disc) / count(*) / nullif(baseline, 0) AS enrichment FROM binned JOIN base USING (model) WHERE bin = 'top_10' GROUP BY model, baseline")
def top_decile_enrichment(spark, sf):
    return _bins(spark, sf).where("bin = 'top_10'").select("model", F.col("rate").alias("top_rate"), "enrichment")


def _classified(rows, keep):
    """Metrics of the top fraction as prediction, under each label source; no order is drawn up for it."""
    rows = L.within(rows, keep, ["score", "id"], lambda n: {"top": K.top_size(n, 0.10, 20)})
    predicted = F.col("top")
    sums = [c.alias(f"{k}_{s}") for s, t in (("a", F.col("lab_a")), ("b", F.col("lab_b"))) for k, c in zip(("tp", "fp", "fn", "tn"), M.confusion_counts(predicted, t), strict=True)]
    wide = settle(rows.groupBy(*keep).agg(*sums), "classified")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), *[F.col(f"{k}_{s}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for s in ("a", "b")]))
    return M.with_metrics(wide.select(*keep, each.alias("r")).select(*keep, "r.*"))


CLASSIFIED = RANKED + ", p AS (SELECT *, rank <= least(n, greatest(ceil(1e-1 * n), 20)) AS hit FROM ranked), c AS (" + " UNION ALL ".join(f"SELECT model, '{s}' AS source, {cells('hit', 'lab_' + s)} FROM p GROUP BY model" for s in "ab") + f"), m AS (SELECT *, {_RATES} FROM c)"


@query(CLASSIFIED + " SELECT * FROM m")
def classification_at_topk(spark, sf):
    return _classified(scores(items(spark, sf)), ["model"])


_BY = LONG + ", g AS (SELECT model, score, count(*) FILTER (WHERE lab_a) AS p, count(*) AS m FROM long GROUP BY model, score)"


@query(_BY + ", c AS (SELECT *, sum(m) OVER (PARTITION BY model ORDER BY score) AS cm FROM g), s AS (SELECT model, CAST(sum(p * (cm - m + (m + 1) / 2)) AS DOUBLE) AS r, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(m) AS BIGINT) AS n FROM c GROUP BY model) SELECT model, positives, n, round((r - CAST(positives AS DOUBLE) * (positives + 1) / 2) / (CAST(positives AS DOUBLE) * (n - positives)), 9) AS auroc FROM s")
def auroc_ties(spark, sf):
    return M.auroc(scores(items(spark, sf)), ["model"], "score", F.col("lab_a")).withColumn("auroc", F.round("auroc", 9))


@query(_BY + ", c AS (SELECT *, CAST(sum(p) OVER w AS DOUBLE) AS cp, CAST(sum(m) OVER w AS DOUBLE) AS cm FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC)) SELECT model, CAST(sum(p) AS BIGINT) AS positives, round(sum(p * cp / cm) / CAST(sum(p) AS DOUBLE), 9) AS average_precision FROM c GROUP BY model")
def average_precision(spark, sf):
    return M.average_precision(scores(items(spark, sf)), ["model"], "score", F.col("lab_a")).withColumn("average_precision", F.round("average_precision", 9))


@query(LONG + f", q AS (SELECT model, quantile_cont(score, 0.5) AS median FROM long GROUP BY model), c AS (SELECT model, median, {cells('score >= median', 'lab_a')} FROM long JOIN q USING (model) GROUP BY model, median) SELECT *, {_RATES} FROM c")
def median_threshold_f1(spark, sf):
    return M.at_median(scores(items(spark, sf)), ["model"], "score", F.col("lab_a"))


@query(CLASSIFIED + " SELECT source, string_agg(model, '|' ORDER BY f1 DESC, model) AS names FROM m GROUP BY source")
def model_order_string(spark, sf):
    return R.ordered_names(classification_at_topk(spark, sf), ["source"], "model", "f1")


@query(CLASSIFIED + " SELECT model, max(f1) FILTER (WHERE source = 'a') AS a, max(f1) FILTER (WHERE source = 'b') AS b FROM m GROUP BY model")
def pivot_model_source(spark, sf):
    return classification_at_topk(spark, sf).groupBy("model").pivot("source", ["a", "b"]).agg(F.first("f1"))


_FILTERED = LI + """, t AS (SELECT unnest([0e0, 1e-2, 2e-2]) AS threshold), far AS (SELECT * FROM li JOIN t ON NOT (abs(dist_a) <= threshold OR abs(dist_b) <= threshold)), flat AS (
  SELECT threshold, id, lab_a, lab_b, 'price' AS model, price AS score FROM far UNION ALL SELECT threshold, id, lab_a, lab_b, 'qty', qty FROM far UNION ALL SELECT threshold, id, lab_a, lab_b, 'day', day FROM far),
kept AS (SELECT *, row_number() OVER (PARTITION BY threshold, model ORDER BY score, id) AS rank, count(*) OVER (PARTITION BY threshold, model) AS n FROM flat)"""
_FILTERED_M = _FILTERED + ", p AS (SELECT *, rank <= least(n, greatest(ceil(1e-1 * n), 20)) AS hit FROM kept), c AS (" + " UNION ALL ".join(f"SELECT threshold, model, '{s}' AS source, {cells('hit', 'lab_' + s)} FROM p GROUP BY threshold, model" for s in "ab") + f"), m AS (SELECT *, {_RATES} FROM c)"


def _filtered(spark, sf):
    """Ranked rows outside each near-boundary threshold, none being there as an empty threshold."""
    li = items(spark, sf)
    far = F.filter(F.array(*[F.when(~S.near_either(F.col("dist_a"), F.col("dist_b"), t), F.lit(t)) for t in (0.0, 0.01, 0.02)]), lambda x: x.isNotNull())
    rows = li.withColumn("threshold", F.explode(far))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in MODELS])
    long = rows.select("threshold", "id", "lab_a", "lab_b", F.explode(models).alias("m")).select("threshold", "id", "lab_a", "lab_b", "m.*")
    return _classified(long, ["threshold", "model"])


@query(_FILTERED_M + " SELECT * FROM m")
def filtered_benchmark(spark, sf):
    return _filtered(spark, sf)


@query(_FILTERED_M + """, o AS (SELECT threshold, source, string_agg(model, '|' ORDER BY f1 DESC, model) AS names FROM m GROUP BY threshold, source), base AS (SELECT source, names AS unfiltered FROM o WHERE threshold = 0)
SELECT threshold, source, names, split_part(names, '|', 1) <> split_part(unfiltered, '|', 1) AS top_changed, names <> unfiltered AS order_changed FROM o JOIN base USING (source)""")
def rank_stability(spark, sf):
    orders = R.ordered_names(_filtered(spark, sf), ["threshold", "source"], "model", "f1")
    base = orders.where("threshold = 0").select("source", F.col("names").alias("unfiltered"))
    top = lambda c: F.substring_index(c, "|", 1)
    return orders.join(base, "source").select("threshold", "source", "names", (top("names") != top("unfiltered")).alias("top_changed"), (F.col("names") != F.col("unfiltered")).alias("order_changed"))


@query(CLASSIFIED + """, o AS (SELECT max(names) FILTER (WHERE source = 'a') AS order_a, max(names) FILTER (WHERE source = 'b') AS order_b FROM (SELECT source, string_agg(model, '|' ORDER BY f1 DESC, model) AS names FROM m GROUP BY source)),
d AS (SELECT max(abs(x)) AS max_shift, count(*) AS models FROM (SELECT model, max(f1) FILTER (WHERE source = 'a') - max(f1) FILTER (WHERE source = 'b') AS x FROM m GROUP BY model)),
r AS (SELECT count(*) AS n, count(*) FILTER (WHERE disc) / count(*) AS rate FROM li)
SELECT order_a, order_b, max_shift, models, split_part(order_a, '|', 1) <> split_part(order_b, '|', 1) AS top_flip, order_a <> order_b AS order_flip, n, rate,
  CASE WHEN n >= 200 AND rate >= 0.4::DOUBLE AND (split_part(order_a, '|', 1) <> split_part(order_b, '|', 1) OR order_a <> order_b) AND max_shift >= 0.05::DOUBLE AND models = 3 THEN 'GO' ELSE 'NO_GO' END AS verdict FROM o, d, r""")
def gate_launch(spark, sf):
    flips = G.order_flips(classification_at_topk(spark, sf), "source", "model", "f1", "a", "b")
    rate = items(spark, sf).agg(F.count("*").alias("n"), S.ratio(C.count_if(F.col("discordant")), F.count("*")).alias("rate"))
    return G.launch_gate(flips.crossJoin(rate), F.col("n"), F.col("rate"))


@query(LI + "SELECT suppkey, count(*) AS n, CASE WHEN count(*) >= 1000 THEN 'full' WHEN count(*) >= 200 THEN 'limited' ELSE 'blocked' END AS tier FROM li GROUP BY suppkey")
def gate_coverage(spark, sf):
    return items(spark, sf).groupBy("suppkey").agg(F.count("*").alias("n")).withColumn("tier", G.coverage_tier(F.col("n")))
