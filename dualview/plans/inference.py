"""Queries on sampling, resampling, release and the domain kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import chemistry, scalars
from ..functions import scalars as S
from ..operators import conditions as C
from ..operators import gates as G
from ..operators import hull, logistic
from ..operators import ranking as K
from ..operators import release as E
from ..operators import resample as P
from ..operators import selection as L
from ..operators.settled import settle
from .rankings import RANKED
from .tables import LB, LI, documents, items, query, scores, table

_H = "CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"


def _h(x: str) -> str:
    return _H.format(x=x)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('20260523:' || o_orderkey), o_orderkey LIMIT 500")
def hash_sample(spark, sf):
    return P.hash_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 20260523)


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('20260523:' || o_orderkey), o_orderkey) AS n FROM orders) WHERE n <= CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 50 ELSE 0 END")
def stratified_hash_sample(spark, sf):
    return P.stratified_sample(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", {"F": 100, "O": 50}, 20260523)


@query(f"SELECT o_orderkey, {_h(chr(39) + '20260524:' + chr(39) + ' || o_orderkey')} / 4294967296 AS random_score FROM orders")
def random_rank_baseline(spark, sf):
    return P.random_scores(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 20260524)


def _u(label: str) -> str:
    return f"(({_h(label)}) + 0.5::DOUBLE) / 4294967296"


_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"


def _near(mean: str, variance: str, low: str, high: str) -> str:
    """Counts within twelve deviations of the mean; the chance of others is under 1e-30."""
    return f"range(greatest({low}, CAST(floor({mean} - 12 * sqrt({variance})) AS BIGINT) - 60), least({high}, CAST(ceil({mean} + 12 * sqrt({variance})) AS BIGINT) + 60) + 1)"


def _bootstrap(keys: str, values: tuple[int, ...], seed: int, reps: int = 2000) -> str:
    """CTEs from ``cells`` (keys, total, c0, c1, ...: rows of each value) to ``means`` (keys, rep, mean): values take their shares of the draws one after the other."""
    label = f"concat_ws(':', '{seed}', {keys}, '{{v}}', rep)"
    out = [f"s0 AS (SELECT *, total AS left0, total AS rest0 FROM (SELECT *, unnest(range({reps})) AS rep FROM cells))"]
    for i, v in enumerate(values[:-1]):
        out.append(f"""t{i} AS (SELECT {keys}, m, hit, sum(exp({_CHOOSE.format('m', 'hit')} + hit * ln(p) + (m - hit) * ln(1 - p))) OVER (PARTITION BY {keys}, m ORDER BY hit) AS upto
  FROM (SELECT *, unnest({_near('m * p', 'm * p * (1 - p)', '0', 'm')}) AS hit FROM (SELECT DISTINCT {keys}, left{i} AS m, c{i} / rest{i} AS p FROM s{i} WHERE c{i} > 0 AND c{i} < rest{i} AND left{i} > 0)))""")
        out.append(f"x{i} AS (SELECT *, {_u(label.format(v=v))} AS u FROM s{i})")
        match = " AND ".join(f"x.{k} = t.{k}" for k in keys.split(", "))
        out.append(f"g{i} AS (SELECT x.*, CASE WHEN c{i} = 0 THEN 0 WHEN c{i} = rest{i} THEN left{i} ELSE coalesce(t.hit, 0) END AS got{i} FROM x{i} x ASOF LEFT JOIN t{i} t ON {match} AND x.left{i} = t.m AND t.upto >= x.u)")
        out.append(f"s{i + 1} AS (SELECT * EXCLUDE (u), left{i} - got{i} AS left{i + 1}, rest{i} - c{i} AS rest{i + 1} FROM g{i})")
    last = len(values) - 1
    total = " + ".join([*(f"{v} * got{i}" for i, v in enumerate(values[:-1])), f"{values[-1]} * left{last}"])
    out.append(f"means AS (SELECT {keys}, rep, ({total}) / total AS mean FROM s{last})")
    return ",\n".join(out)


def _interval(keys: str) -> str:
    return f"i AS (SELECT {keys}, round(avg(mean), 9) AS mean, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM means GROUP BY {keys})"


def _cells(df, keys, values):
    """Counts c0, c1, ... of each value as rows (value, n)."""
    each = F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"c{i}").alias("n")) for i, v in enumerate(values)])
    return df.select(*keys, F.explode(each).alias("c")).select(*keys, "c.value", "c.n")


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(LB + ", cells AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE NOT disc) AS c0, count(*) FILTER (WHERE disc) AS c1 FROM lb WHERE lang IS NOT NULL GROUP BY lang),\n"
       + _bootstrap("lang", (0, 1), 11) + ", " + _interval("lang") + " SELECT lang, total AS n, round(c1 / total, 9) AS observed, mean, low, high FROM cells JOIN i USING (lang)")
def bootstrap_rate_ci(spark, sf):
    """Discordance rate of every language with its bootstrap interval, over all labelled documents."""
    count = lambda c: C.count_if(c)
    cells = documents(spark, sf).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), count(~F.col("discordant")).alias("c0"), count(F.col("discordant")).alias("c1"))
    found = P.interval(P.bootstrap_means(_cells(cells, ["lang"], (0, 1)), ["lang"], "value", "n", seed=11), ["lang"])
    return cells.select("lang", "n", F.round(F.col("c1") / F.col("n"), 9).alias("observed")).join(_rounded(found, "lang"), "lang")


@query(RANKED + """, k AS (SELECT CAST(unnest([100, 300, 500, 1000, 2000]) AS INTEGER) AS k), cells AS (SELECT model, k, CAST(k AS BIGINT) AS total, count(*) FILTER (WHERE NOT lab_a AND lab_b) AS c0, count(*) FILTER (WHERE lab_a = lab_b) AS c1, count(*) FILTER (WHERE lab_a AND NOT lab_b) AS c2
  FROM ranked JOIN k ON rank <= k GROUP BY model, k HAVING count(*) = k),
""" + _bootstrap("model, k", (-1, 0, 1), 20260524) + ", " + _interval("model, k") + " SELECT model, k, round((c2 - c0) / total, 9) AS observed, mean, low, high FROM cells JOIN i USING (model, k)")  # fmt: skip
def paired_bootstrap_shift(spark, sf):
    """Precision under the one source less that under the other among each model's first K, with bootstrap intervals; pairs stay together."""
    keys = ["model", "k"]
    a, b = F.col("lab_a"), F.col("lab_b")
    shifts = [C.count_if(~a & b).alias("c0"), C.count_if(a == b).alias("c1"), C.count_if(a & ~b).alias("c2")]
    cells = K.prefix_metrics(scores(items(spark, sf)), DEFAULT.precision_ks, ["model"], ["score", "id"], shifts)
    found = P.interval(P.bootstrap_means(_cells(cells, keys, (-1, 0, 1)), keys, "value", "n", seed=20260524), keys)
    return cells.select(*keys, F.round((F.col("c2") - F.col("c0")) / F.col("k"), 9).alias("observed")).join(_rounded(found, *keys), keys)


def _null(population: str, marked: str, drawn: str, k: str = "k") -> str:
    return f"exp({_CHOOSE.format(marked, k)} + {_CHOOSE.format(f'({population} - {marked})', f'({drawn} - {k})')} - ({_CHOOSE.format(population, drawn)}))"


def _permutations(keys: str, seed: int, reps: int) -> str:
    """CTEs from ``tops`` (keys, n, marked, drawn, observed) to ``hits`` (keys, rep, hits) and ``p`` (keys and what is told of them)."""
    match = " AND ".join(f"r.{k} = t.{k}" for k in keys.split(", "))
    return f"""t AS (SELECT {keys}, k, sum({_null('n', 'marked', 'drawn')}) OVER (PARTITION BY {keys} ORDER BY k) AS upto FROM (SELECT *, unnest({_near('1.0::DOUBLE * drawn * marked / n', '1.0::DOUBLE * drawn * marked / n', 'greatest(0, drawn - (n - marked))', 'least(marked, drawn)')}) AS k FROM tops)),
r AS (SELECT *, {_u(f"concat_ws(':', '{seed}', {keys}, rep)")} AS u FROM (SELECT {keys}, observed, unnest(range({reps})) AS rep FROM tops)),
hits AS (SELECT r.*, t.k AS hits FROM r ASOF JOIN t ON {match} AND t.upto >= r.u),
p AS (SELECT {keys}, (count(*) FILTER (WHERE hits >= observed) + 1) / (count(*) + 1) AS p_value, round(avg(hits), 9) AS null_mean, quantile_cont(hits, 0.95) AS null_p95 FROM hits GROUP BY {keys})"""


TOPS = RANKED + ", tops AS (SELECT model, any_value(n) AS n, count(*) FILTER (WHERE disc) AS marked, CAST(least(any_value(n), greatest(ceil(0.1::DOUBLE * any_value(n)), 20)) AS BIGINT) AS drawn, count(*) FILTER (WHERE disc AND rank <= least(n, greatest(ceil(0.1::DOUBLE * n), 20))) AS observed FROM ranked GROUP BY model),\n" + _permutations("model", 20260520, 2000)


def tops(spark, sf):
    """Rows, discordant rows, size of the first tenth and discordant rows in it, for every model."""
    rows = L.within(scores(items(spark, sf)), ["model"], ["score", "id"], lambda n: {"top": K.top_size(n, DEFAULT.top_fraction, DEFAULT.top_floor)})
    hit = F.col("discordant")
    rows = rows.groupBy("model").agg(F.max("n").alias("n"), C.count_if(hit).alias("marked"), C.count_if(hit & F.col("top")).alias("observed"))
    return settle(rows.withColumn("drawn", K.top_size(F.col("n"), DEFAULT.top_fraction, DEFAULT.top_floor)), "tops")


def permuted(found):
    """``tops`` with p and null of ``permuted_hits``."""
    hits = P.permuted_hits(found, ["model"], DEFAULT.permutations, DEFAULT.seed).join(found.select("model", "observed"), "model")
    return found.join(P.permutation_p(hits, ["model"], F.col("observed")), "model")


@query(TOPS + " SELECT tops.*, p_value, null_mean, null_p95, round((SELECT sum(exp(" + _null("n", "marked", "drawn").removeprefix("exp(").removesuffix(")") + ")) FROM (SELECT unnest(range(greatest(observed, drawn - (n - marked)), least(marked, drawn) + 1)) AS k)), 6) AS p_exact FROM tops JOIN p USING (model)")
def permutation_null(spark, sf):
    """Discordant rows in every model's first tenth against 2,000 random orders of all its rows, and the same in closed form."""
    exact = F.round(P.tail(F.col("n"), F.col("marked"), F.col("drawn"), F.col("observed")), 6).alias("p_exact")
    return permuted(tops(spark, sf)).select("model", "n", "marked", "drawn", "observed", "p_value", F.round("null_mean", 9).alias("null_mean"), "null_p95", exact)


_PASSES = "top_rate >= 0.3::DOUBLE AND enrichment >= 2 AND p_value <= 0.1::DOUBLE"


@query(TOPS + f""", g AS (SELECT model, observed / drawn AS top_rate, (observed / drawn) / nullif(marked / n, 0) AS enrichment, p_value FROM tops JOIN p USING (model))
SELECT count(*) FILTER (WHERE {_PASSES}) AS passing, count(*) AS models, CASE WHEN count(*) FILTER (WHERE {_PASSES}) >= 2 THEN 'GO' ELSE 'NO_GO' END AS verdict FROM g""")
def gate_selection(spark, sf):
    """The gate on selection-conditional discordance, by every model's own permutation p."""
    found = permuted(tops(spark, sf))
    rate = S.ratio(F.col("observed"), F.col("drawn"))
    return G.selection_gate(found.select("model", rate.alias("top_rate"), F.try_divide(rate, S.ratio(F.col("marked"), F.col("n"))).alias("enrichment"), "p_value"))


_CURVE = RANKED + """, f AS (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.5::DOUBLE]) AS share), sizes AS (SELECT model, share, any_value(n) AS n, count(*) FILTER (WHERE disc) AS marked, greatest(1, CAST(ceil(share * any_value(n)) AS BIGINT)) AS drawn FROM ranked, f GROUP BY model, share),
tops AS (SELECT sizes.*, (SELECT any_value(upto) FROM (SELECT model, rank, count(*) FILTER (WHERE disc) OVER (PARTITION BY model ORDER BY rank) AS upto FROM ranked) r WHERE r.model = sizes.model AND r.rank = drawn) AS observed FROM sizes), cells AS (SELECT model, share, drawn AS total, drawn - observed AS c0, observed AS c1 FROM tops),
"""


@query(_CURVE + _bootstrap("model, share", (0, 1), 31) + ", " + _interval("model, share") + ",\n" + _permutations("model, share", 32, 10000)
       + ", nulls AS (SELECT model, share, round(quantile_cont(hits, 0.025), 9) AS null_low, round(quantile_cont(hits, 0.975), 9) AS null_high FROM hits GROUP BY model, share) SELECT model, share, n, marked, drawn, observed, low, high, null_mean, null_low, null_high, p_value FROM tops JOIN i USING (model, share) JOIN p USING (model, share) JOIN nulls USING (model, share)")
def selection_curve(spark, sf):
    """Discordance among each model's first 1 to 50 %, with bootstrap intervals and the null of 10,000 random selections."""
    keys = ["model", "share"]
    shares = (0.01, 0.05, 0.1, 0.2, 0.5)
    drawn = lambda share, n: F.greatest(F.lit(1), F.ceil(share * n)).cast("long")
    rows = L.within(scores(items(spark, sf)), ["model"], ["score", "id"], lambda n: {f"in{i}": drawn(F.lit(x), n) for i, x in enumerate(shares)})
    sums = [C.count_if(F.col("discordant") & F.col(f"in{i}")).alias(f"o{i}") for i in range(len(shares))]
    wide = settle(rows.groupBy("model").agg(F.max("n").alias("n"), C.count_if(F.col("discordant")).alias("marked"), *sums), "curve")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("share"), F.col(f"o{i}").alias("observed")) for i, x in enumerate(shares)]))
    found = wide.select("model", "n", "marked", each.alias("e")).select("model", "n", "marked", "e.*").withColumn("drawn", drawn(F.col("share"), F.col("n")))
    counts = found.select(*keys, (F.col("drawn") - F.col("observed")).alias("c0"), F.col("observed").alias("c1"))
    boot = P.interval(P.bootstrap_means(_cells(counts, keys, (0, 1)), keys, "value", "n", seed=31), keys).drop("mean")
    hits = P.permuted_hits(found, keys, 10_000, 32).join(found.select(*keys, "observed"), keys)
    q = F.percentile("hits", F.array(F.lit(0.025), F.lit(0.975)))
    null = hits.groupBy(*keys).agg(F.avg("hits").alias("null_mean"), q.alias("_q"), ((C.count_if(F.col("hits") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p_value"))
    out = found.join(boot, keys).join(null, keys)
    nine = lambda c, name: F.round(c, 9).alias(name)
    return out.select(*keys, "n", "marked", "drawn", "observed", nine("low", "low"), nine("high", "high"), nine("null_mean", "null_mean"), nine(F.col("_q")[0], "null_low"), nine(F.col("_q")[1], "null_high"), "p_value")


@query(LI + """, n AS (SELECT count(*) FILTER (WHERE lab_a) AS p FROM li), r AS (SELECT *, -price AS score, row_number() OVER (PARTITION BY lab_a ORDER BY -price DESC, id) AS pr FROM li),
o AS (SELECT r.*, lab_a AND pr <= round_even(0.1::DOUBLE * p, 0) AS observed, CAST(('0x' || substr(md5('3:' || partkey), 1, 8)) AS BIGINT) % 2 = 0 AS is_cal FROM r, n),
mx AS (SELECT partkey, max(score) AS m FROM o WHERE is_cal AND NOT observed GROUP BY partkey), k AS (SELECT count(*) AS m, -1 / ln(1 / (count(*) + 1)) AS g FROM mx),
pool AS (SELECT * FROM o WHERE NOT is_cal ORDER BY score DESC, id LIMIT 200),
e AS (SELECT pool.*, g * pow(least(1, (1 + (SELECT count(*) FROM mx WHERE mx.m >= pool.score)) / (k.m + 1)), g - 1) AS e FROM pool, k),
s AS (SELECT *, row_number() OVER (ORDER BY e DESC, score DESC, id) AS k FROM e), l AS (SELECT coalesce(max(k) FILTER (WHERE e >= 200 / (0.1::DOUBLE * k)), 0) AS released, coalesce(max(0.1::DOUBLE * k * e / 200), 0) AS best FROM s)
SELECT CAST(released AS INTEGER) AS released, round(best, 9) AS best_mass_ratio, coalesce((SELECT avg(CAST(NOT lab_a AS INTEGER)) FROM s WHERE k <= released), 0) AS a_false_rate, coalesce((SELECT avg(CAST(NOT lab_b AS INTEGER)) FROM s WHERE k <= released), 0) AS b_false_rate FROM l""")
def conformal_evalue_release(spark, sf):
    rows = E.observed_mask(items(spark, sf).withColumn("score", -F.col("price")), F.col("lab_a"), "score", "id", 0.10)
    halves = E.hashed_halves(rows, "partkey", 3)
    maxima = halves.where("is_cal and not observed").groupBy("partkey").agg(F.max("score").alias("block_max"))
    out = E.release(E.e_values(halves.where("not is_cal"), maxima, "score"), "score", "id", 200, 0.10)
    return out.withColumn("best_mass_ratio", F.round("best_mass_ratio", 9))


@query(LI + """, n AS (SELECT count(*) FILTER (WHERE lab_a) AS p FROM li), r AS (SELECT *, -price AS score, row_number() OVER (PARTITION BY lab_a ORDER BY -price DESC, id) AS pr FROM li),
o AS (SELECT r.*, lab_a AND pr <= round_even(0.1::DOUBLE * p, 0) AS observed FROM r, n),
half AS (SELECT partkey, seed, CAST(('0x' || substr(md5(seed || ':' || partkey), 1, 8)) AS BIGINT) % 2 = 0 AS is_cal FROM (SELECT DISTINCT partkey FROM o), range(20) s(seed)),
mx AS (SELECT seed, partkey, max(score) AS top FROM o JOIN half USING (partkey) WHERE is_cal AND NOT observed GROUP BY ALL), m AS (SELECT seed, count(*) AS m, -1 / ln(1 / (count(*) + 1)) AS g FROM mx GROUP BY seed),
pool AS (SELECT * FROM (SELECT seed, score, lab_a, lab_b, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS k FROM o JOIN half USING (partkey) WHERE NOT is_cal) WHERE k <= 287),
reach AS (SELECT pool.seed, pool.k, count(mx.top) AS above FROM pool LEFT JOIN mx ON mx.seed = pool.seed AND mx.top >= pool.score GROUP BY ALL),
e AS (SELECT pool.*, g * pow(least(1, (1 + above) / (m + 1)), g - 1) AS e FROM pool JOIN reach USING (seed, k) JOIN m USING (seed)),
c AS (SELECT e.*, b AS budget, e >= b / (0.1::DOUBLE * k) AS passes FROM e JOIN (SELECT unnest([50, 100, 124, 200, 287]) AS b) ON k <= b),
l AS (SELECT seed, budget, coalesce(max(k) FILTER (WHERE passes), 0) AS released, greatest(0, max(0.1::DOUBLE * k * e / budget)) AS best FROM c GROUP BY ALL)
SELECT CAST(seed AS INTEGER) AS seed, CAST(budget AS INTEGER) AS budget, CAST(released AS INTEGER) AS released, round(best, 9) AS best_mass_ratio, round(coalesce(avg(CAST(NOT lab_a AS INTEGER)), 0), 9) AS a_false_rate, round(coalesce(avg(CAST(NOT lab_b AS INTEGER)), 0), 9) AS b_false_rate
FROM l LEFT JOIN pool USING (seed) WHERE k <= released OR (released = 0 AND k = 1) GROUP BY ALL""".replace("avg(CAST(NOT lab_a AS INTEGER))", "avg(CAST(NOT lab_a AS INTEGER)) FILTER (WHERE k <= released)").replace("avg(CAST(NOT lab_b AS INTEGER))", "avg(CAST(NOT lab_b AS INTEGER)) FILTER (WHERE k <= released)"))
def release_grid(spark, sf):
    """Release under 20 block splits and five budgets, all in one plan."""
    rows = E.observed_mask(items(spark, sf).withColumn("score", -F.col("price")), F.col("lab_a"), "score", "id", DEFAULT.rho)
    out = E.release_grid(rows, "partkey", lambda block: E.test_seeds(block, DEFAULT.release_seeds), "score", "id", DEFAULT.release_ks, DEFAULT.alpha)
    nine = lambda c: F.round(c, 9).alias(c)
    return out.select("seed", "budget", F.col("released").cast("int").alias("released"), nine("best_mass_ratio"), nine("a_false_rate"), nine("b_false_rate"))


@query(LB + f""", h AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || id), id) AS place, count(*) OVER () AS n FROM lb),
c AS (SELECT any_value(n) AS n, count(*) FILTER (WHERE disc) AS d, any_value(n) // 10 AS m, count(*) FILTER (WHERE disc AND place <= n // 10) AS hits FROM h),
k AS (SELECT *, unnest(range(greatest(hits, m - (n - d)), least(m, d) + 1)) AS k FROM c)
SELECT any_value(n) AS n, any_value(d) AS marked, any_value(hits) AS hits, round(sum(exp({_CHOOSE.format('d', 'k')} + {_CHOOSE.format('(n - d)', '(m - k)')} - ({_CHOOSE.format('n', 'm')}))), 6) AS p_value FROM k""")
def hypergeometric_p(spark, sf):
    """Closed form of the permutation null over all labelled documents, the first tenth by hash drawn."""
    rows = documents(spark, sf).select("id", "discordant")
    drawn = rows.count() // 10
    all_rows = rows.agg(F.count("*").alias("n"), C.count_if(F.col("discordant")).alias("marked"))
    hits = P.first_by_hash(rows, "id", drawn, 7).agg(C.count_if(F.col("discordant")).alias("hits"))
    return all_rows.crossJoin(F.broadcast(hits)).select("n", "marked", "hits", F.round(P.tail(F.col("n"), F.col("marked"), F.lit(drawn), F.col("hits")), 6).alias("p_value"))


def _newton(rounds: int) -> str:
    """Newton's method for three standardised columns and an intercept, all penalised, as one CTE a step; 4 by 4 systems are solved by elimination."""
    z = [f"CASE WHEN s{i} > 0 THEN (x{i} - m{i}) / s{i} ELSE 0 END" for i in range(3)] + ["1.0::DOUBLE"]
    out = ["st AS (SELECT flag, " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(("price", "qty", "day"))) + " FROM li GROUP BY flag)"]
    out.append("zz AS MATERIALIZED (SELECT flag, CAST(disc AS INTEGER) AS y, " + ", ".join(f"{e} AS z{i}" for i, e in enumerate(z)) + " FROM (SELECT flag, disc, price AS x0, qty AS x1, day AS x2 FROM li) JOIN st USING (flag))")
    out.append("w0 AS (SELECT flag, " + ", ".join(f"0.0::DOUBLE AS w{i}" for i in range(4)) + " FROM st)")
    for r in range(rounds):
        sums = [f"sum((p - y) * z{i}) + any_value(w{i}) AS e{i}_4" for i in range(4)] + [f"sum(p * (1 - p) * z{i} * z{j}) + {int(i == j)} AS e{i}_{j}" for i in range(4) for j in range(4)]
        keep = ", ".join(f"any_value(w{i}) AS w{i}" for i in range(4))
        out.append(f"a{r}_0 AS (SELECT flag, {keep}, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({' + '.join(f'z{i} * w{i}' for i in range(4))}))) AS p FROM zz JOIN w{r} USING (flag)) GROUP BY flag)")
        for pivot in range(4):
            cells = [f"e{pivot}_{j} / e{pivot}_{pivot} AS e{pivot}_{j}" if i == pivot else f"e{i}_{j} - e{i}_{pivot} * e{pivot}_{j} / e{pivot}_{pivot} AS e{i}_{j}" for i in range(4) for j in range(5)]
            out.append(f"a{r}_{pivot + 1} AS (SELECT flag, w0, w1, w2, w3, {', '.join(cells)} FROM a{r}_{pivot})")
        out.append(f"w{r + 1} AS (SELECT flag, {', '.join(f'w{i} - e{i}_4 AS w{i}' for i in range(4))} FROM a{r}_4)")
    return ", ".join(out)


@query(LI + ", " + _newton(8) + " SELECT flag AS model, term, round(coefficient, 7) AS coefficient FROM (" + " UNION ALL ".join(f"SELECT flag, '{t}' AS term, w{i} AS coefficient FROM w8" for i, t in enumerate(("price", "qty", "day", "intercept"))) + ")")
def logistic_coefs(spark, sf):
    """Discordance on three scores by return flag, over all rows."""
    return logistic.coefficients(items(spark, sf), "flag", ["price", "qty", "day"], "discordant").withColumn("coefficient", F.round("coefficient", 7))


@query()
def logistic_permutation(spark, sf):
    """The rank percentile's coefficient by language against 2,000 refits with ranks shuffled, over all labelled documents."""
    rows = documents(spark, sf).withColumn("size", F.log1p("n_chars"))
    found = logistic.rank_permutations(rows, "lang", ["size"], "discordant", ["n_chars", "id"], DEFAULT.permutations, 20260521)
    return logistic.permuted_p(found)


#: Elements of the formulas that the queries below make out of parts: one of each list, by the part's key.
SITES = (("Ti", "Ca", "Er", "Nb", "Hf"), ("P", "Si", "Ge", "Co"), ("O", "S", "Te"))

_FORMULAS = f"""parts AS (SELECT *, p_partkey % 50 AS odd, {list(SITES[0])}[p_partkey % 5 + 1] AS ea, {list(SITES[1])}[p_partkey % 4 + 1] AS eb, {list(SITES[2])}[p_partkey % 3 + 1] AS ec, p_size % 6 + 1 AS a, p_partkey % 4 + 1 AS b, p_partkey % 3 + 1 AS c FROM part),
formulas AS (SELECT *, CASE odd WHEN 0 THEN NULL WHEN 1 THEN 'not a formula' ELSE ea || a || '(' || eb || ec || b || ')' || c END AS formula, [{{'e': ea, 'n': a}}, {{'e': eb, 'n': c}}, {{'e': ec, 'n': b * c}}] AS amounts, gcd(gcd(a, c), b * c) AS g FROM parts)"""
_WRITTEN = "CASE WHEN x.n // g = 1 THEN '' ELSE CAST(x.n // g AS VARCHAR) END"


def formulas(spark, sf):
    """Parts with a formula of three elements, one of them counted by its bracket; some have none, some a text that isn't one."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    count = lambda c, n: (F.col(c) % n + 1).cast("string")
    whole = F.concat(pick(SITES[0]), count("p_size", 6), F.lit("("), pick(SITES[1]), pick(SITES[2]), count("p_partkey", 4), F.lit(")"), count("p_partkey", 3))
    odd = F.col("p_partkey") % 50
    return table(spark, sf, "part").withColumn("formula", F.when(odd == 1, "not a formula").when(odd != 0, whole))


@query("WITH " + _FORMULAS + f""" SELECT p_partkey, formula,
  CASE WHEN odd > 1 THEN array_to_string(list_transform(list_sort(amounts), lambda x: x.e || {_WRITTEN}), '') ELSE formula END AS reduced,
  CASE WHEN odd > 1 THEN (SELECT string_agg(chr(CAST(64 + i AS INTEGER)) || CASE WHEN n = 1 THEN '' ELSE CAST(n AS VARCHAR) END, '' ORDER BY i) FROM (SELECT unnest(list_sort(list_transform(amounts, lambda x: x.n // g))) AS n, unnest(range(1, 4)) AS i)) END AS anonymous,
  CASE WHEN odd > 1 THEN array_to_string(list_sort(list_transform(amounts, lambda x: x.e)), '-') WHEN odd = 1 THEN '' ELSE '' END AS elements FROM formulas""")
def formula_parse(spark, sf):
    """Reduced and anonymous formulas and element sets of formulas made out of parts."""
    f = formulas(spark, sf)
    return f.select("p_partkey", "formula", chemistry.reduced_formula("formula").alias("reduced"), chemistry.anonymous_formula("formula").alias("anonymous"), F.concat_ws("-", scalars.element_tokens(F.col("formula"))).alias("elements"))


_PHASES = """phases AS (SELECT p_partkey, p_brand, p_size % 7 AS a, p_partkey % 5 AS b, p_retailprice / 1000 AS energy FROM part),
known AS (SELECT *, CASE WHEN a + b > 0 THEN CAST(a AS DOUBLE) / (a + b) END AS x FROM phases), ends AS (SELECT p_brand, count(*) FILTER (WHERE x = 0) > 0 AS has_b, count(*) FILTER (WHERE x = 1) > 0 AS has_a FROM known GROUP BY p_brand),
least AS (SELECT p_brand, x, min(energy) AS e FROM known WHERE x IS NOT NULL GROUP BY ALL),
low AS (SELECT t.p_brand, t.x, min(CASE WHEN r.x = l.x THEN l.e ELSE l.e + (r.e - l.e) * (t.x - l.x) / (r.x - l.x) END) AS e FROM least t JOIN least l ON l.p_brand = t.p_brand AND l.x <= t.x JOIN least r ON r.p_brand = t.p_brand AND r.x >= t.x GROUP BY ALL)"""


@query("WITH " + _PHASES + """ SELECT p_partkey, p_brand, CASE WHEN x IS NULL THEN 'no_composition' WHEN (x > 0 AND NOT has_a) OR (x < 1 AND NOT has_b) THEN 'missing_end_member' ELSE 'ok' END AS reason,
  CASE WHEN (x > 0 AND NOT has_a) OR (x < 1 AND NOT has_b) OR low.e IS NULL THEN NULL ELSE round(greatest(0, energy - low.e), 9) END AS e_above_hull,
  CASE WHEN (x > 0 AND NOT has_a) OR (x < 1 AND NOT has_b) THEN NULL ELSE energy - low.e <= 1e-8::DOUBLE END AS on_hull
FROM known JOIN ends USING (p_brand) LEFT JOIN low USING (p_brand, x)""")
def hull_energy(spark, sf):
    """Energy of every part above the hull of its brand, as phases of two elements in amounts taken from its size and key."""
    a, b = (F.col("p_size") % 7).cast("double"), (F.col("p_partkey") % 5).cast("double")
    there = F.filter(F.array(F.struct(F.lit("Ti").alias("key"), a.alias("value")), F.struct(F.lit("O").alias("key"), b.alias("value"))), lambda x: x["value"] > 0)
    phases = table(spark, sf, "part").select("p_partkey", "p_brand", F.map_from_entries(there).alias("amounts"), (F.col("p_retailprice") / 1000).alias("energy"))
    found = hull.system_hulls(phases, phases, "p_brand", "amounts", "energy")
    return found.select("p_partkey", "p_brand", "reason", F.round("e_above_hull", 9).alias("e_above_hull"), hull.on_hull(F.col("e_above_hull")).alias("on_hull"))
