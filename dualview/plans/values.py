"""Queries on values, static tables, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ENDPOINTS
from ..functions import chemistry, crystal
from ..functions import scalars as S
from ..operators import conditions as C
from ..operators import gates as G
from ..operators import kendall
from ..operators import relations as R
from ..operators import resample as P
from ..operators.settled import scratch
from ..operators.structures import match_status
from ..sources import files
from ..streaming import ingest
from .tables import LB, LI, documents, items, query, table


@query("SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS DOUBLE) AS number, TRY_CAST(c_mktsegment AS DOUBLE) AS bad_number, lower(c_mktsegment) = 'true' AS by_text, c_mktsegment <> '' AS by_truth, c_nationkey <> 0 AS by_number, CASE WHEN contains(c_mktsegment, 'O') THEN 'with_o' ELSE c_mktsegment END AS masked, least(abs(c_acctbal), abs(c_nationkey - 10)) AS nearest, CASE WHEN abs(c_acctbal) >= 5000 THEN 'failed_nonfinite_or_nonphysical' ELSE 'scored' END AS status FROM customer")
def lenient_values(spark, sf):
    """Casts, both readings of flags, a masked update, the lesser distance and the physical guard."""
    c, segment = table(spark, sf, "customer"), F.col("c_mktsegment")
    return c.select(
        "c_custkey", S.lenient_double(F.substring("c_name", 10, 20)).alias("number"), S.lenient_double(segment).alias("bad_number"), S.flag_of_text(segment).alias("by_text"),
        S.truthy(segment).alias("by_truth"), S.truthy(F.col("c_nationkey"), numeric=True).alias("by_number"), S.masked(segment, segment.contains("O"), "with_o").alias("masked"),
        S.least_distance(F.col("c_acctbal"), (F.col("c_nationkey") - 10).cast("double")).alias("nearest"), S.score_status(F.col("c_acctbal"), 5000.0).alias("status"),
    )


@query("SELECT v, number, flag, truth FROM (VALUES ('1.5', 1.5::DOUBLE, false, true), (' 2 ', 2.0, false, true), ('x', NULL, false, true), ('', NULL, false, false), (NULL, NULL, false, true), ('TRUE', NULL, true, true), ('False', NULL, false, true)) t(v, number, flag, truth)")
def odd_texts(spark, sf):
    """Odd texts under each reading: a null or any text but the empty one is true by truthiness."""
    rows = spark.createDataFrame([(v,) for v in ("1.5", " 2 ", "x", "", None, "TRUE", "False")], "v string")
    return rows.select("v", S.lenient_double(F.col("v")).alias("number"), S.flag_of_text(F.col("v")).alias("flag"), S.truthy(F.col("v")).alias("truth"))


_WORDS = "list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:])"
_TOKENS = f"list_sort(list_distinct(flatten(list_transform({_WORDS}, lambda x: regexp_extract_all(x, '([A-Z][a-z]?)', 1)))))"


@query(f"SELECT p_partkey, array_to_string({_TOKENS}, '-') AS system, len({_TOKENS}) AS n FROM part")
def element_systems(spark, sf):
    tokens = S.element_tokens(F.initcap("p_name"))
    return table(spark, sf, "part").select("p_partkey", S.system_key(tokens).alias("system"), F.size(tokens).cast("long").alias("n"))


@query(LI + f", t AS (SELECT li.disc, {_TOKENS} AS w FROM li JOIN part ON partkey = p_partkey), f AS ("
       + " UNION ALL ".join(f"SELECT '{g}' AS stratum, disc FROM t WHERE list_has_any(w, {m!r})" for g, m in chemistry.STRATA.items())
       + ") SELECT stratum, count(*) AS n, count(*) FILTER (WHERE disc) AS discordant_n, count(*) FILTER (WHERE disc) / count(*) AS discordance_rate FROM f GROUP BY stratum")
def atlas_strata(spark, sf):
    """Discordance in the atlas's strata, which overlap, of element tokens."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), S.tags(S.element_tokens(F.initcap("p_name")), chemistry.STRATA).alias("strata"))
    return C.set_rates(items(spark, sf).select("partkey", "discordant").join(parts, "partkey"), "strata", "stratum").where("stratum <> 'other'")


@query("WITH w AS (SELECT p_partkey, p_brand, list_sort(list_distinct(string_split(p_name, ' '))) AS t FROM part) SELECT p_brand, count(*) AS n, count(DISTINCT array_to_string(t, '-')) AS sets FROM w GROUP BY p_brand")
def equal_token_sets(spark, sf):
    """Names that are equal as sets of words count as one: sorted distinct keys decide."""
    parts = table(spark, sf, "part").withColumn("words", S.system_key(S.word_tokens(F.col("p_name"))))
    return parts.groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("words").alias("sets"))


@query(LI + "SELECT id, row_number() OVER (ORDER BY price DESC, id) AS price_rank, row_number() OVER (ORDER BY price DESC, id) / (SELECT count(*) FROM li) AS price_rank_percentile FROM li WHERE disc QUALIFY row_number() OVER (ORDER BY price DESC, id) <= 40")
def cases_by_suffix(spark, sf):
    """Top discordant cases with every column whose name ends in a rank's ending."""
    every = items(spark, sf)
    n = every.agg(F.count("*").alias("n"))
    top = every.where("discordant").orderBy(F.desc("price"), "id").limit(40)
    ranked = top.withColumn("price_rank", F.row_number().over(_order("price"))).crossJoin(F.broadcast(n)).withColumn("price_rank_percentile", F.col("price_rank") / F.col("n"))
    return R.columns_ending(ranked, "_rank", "_rank_percentile", keep=["id"])


def _order(column: str):
    return Window.orderBy(F.desc(column), "id")


@query(LI + "SELECT 'all' AS \"table\", count(*) AS n, NULL::VARCHAR AS flag, NULL::DOUBLE AS rate, NULL::DOUBLE AS largest FROM li UNION ALL SELECT 'by_flag', count(*), flag, count(*) FILTER (WHERE disc) / count(*), NULL FROM li GROUP BY flag UNION ALL SELECT 'gap', NULL, NULL, NULL, max(gap) FROM li")
def stacked_tables(spark, sf):
    """Unlike aggregates one under another."""
    li = items(spark, sf)
    flags = li.groupBy("flag").agg(F.count("*").alias("n"), S.ratio(C.count_if(F.col("discordant")), F.count("*")).alias("rate"))
    return R.stacked({"all": li.agg(F.count("*").alias("n")), "by_flag": flags, "gap": li.agg(F.max("gap").alias("largest"))})


@query("SELECT * FROM (VALUES ('E1_pairwise_binary_discordance', 0.4::DOUBLE, 0.1::DOUBLE, 200), ('E2_near_hull_localization', NULL, NULL, NULL), ('E3_model_ranking_flip', 0.05, 0.02, NULL), ('E4_discovered_stable_count_delta', 0.25, 0.1, 50), ('E5_release_decision_flip_probe', NULL, NULL, NULL)) t(endpoint, pass_at, stop_at, least_n)")
def endpoint_table(spark, sf):
    """The preregistered endpoints as a static relation."""
    return spark.createDataFrame(ENDPOINTS, "endpoint string, pass_at double, stop_at double, least_n int")


@query(LB + "SELECT 'E1_pairwise_binary_discordance' AS endpoint, count(*) AS n, count(*) FILTER (WHERE disc) / count(*) AS rate, CASE WHEN count(*) < 200 OR count(*) FILTER (WHERE disc) / count(*) <= 0.1::DOUBLE THEN 'NO_GO' WHEN count(*) FILTER (WHERE disc) / count(*) >= 0.4::DOUBLE THEN 'GO' ELSE 'BOUNDARY' END AS verdict FROM lb")
def endpoint_discordance(spark, sf):
    """The first endpoint judged by its static row."""
    gate = endpoint_table(spark, sf).where("endpoint like 'E1%'")
    seen = documents(spark, sf).agg(F.count("*").alias("n"), S.ratio(C.count_if(F.col("discordant")), F.count("*")).alias("rate"))
    stop = (F.col("n") < F.col("least_n")) | (F.col("rate") <= F.col("stop_at"))
    return seen.crossJoin(F.broadcast(gate)).select("endpoint", "n", "rate", F.when(stop, "NO_GO").when(F.col("rate") >= F.col("pass_at"), "GO").otherwise("BOUNDARY").alias("verdict"))


@query(LI + ", r AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY price) + (count(*) OVER (PARTITION BY flag, price) - 1) / 2 AS x, rank() OVER (PARTITION BY flag ORDER BY qty) + (count(*) OVER (PARTITION BY flag, qty) - 1) / 2 AS y FROM li) SELECT flag, count(*) AS n, round(corr(x, y), 9) AS rho FROM r GROUP BY flag")
def rank_correlations(spark, sf):
    """Spearman's correlation of two models' scores."""
    return R.rank_correlation(items(spark, sf), ["flag"], "price", "qty").withColumn("rho", F.round("rho", 9))


@query("""WITH o AS (SELECT o_orderpriority AS k, o_totalprice AS a, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS b FROM orders),
p AS (SELECT x.k, CAST(sum(sign(x.a - y.a) * sign(x.b - y.b)) AS DOUBLE) / 2 AS top FROM o x JOIN o y ON x.k = y.k GROUP BY x.k), n AS (SELECT k, count(*) AS n, count(*) * (count(*) - 1) / 2 AS every FROM o GROUP BY k),
ta AS (SELECT k, sum(m * (m - 1)) / 2 AS t FROM (SELECT k, a, count(*) AS m FROM o GROUP BY ALL) GROUP BY k), tb AS (SELECT k, sum(m * (m - 1)) / 2 AS t FROM (SELECT k, b, count(*) AS m FROM o GROUP BY ALL) GROUP BY k)
SELECT k AS o_orderpriority, n, round(top / sqrt((every - ta.t) * (every - tb.t)), 9) AS tau FROM p JOIN n USING (k) JOIN ta USING (k) JOIN tb USING (k)""")
def kendall_tau(spark, sf):
    """Kendall's tau-b of price and date by priority, over all orders."""
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", F.unix_date(F.to_date("o_orderdate")).cast("double").alias("day"))
    return kendall.tau_b(orders, ["o_orderpriority"], "o_totalprice", "day").withColumn("tau", F.round("tau", 9))


def _balances(ids):
    """A stand-in for a record service: every seventh key has no record."""
    return {i: {"id": int(i), "twice": 2 * int(i)} for i in ids if int(i) % 7}


@query("SELECT CAST(c_custkey AS VARCHAR) AS custkey, CASE WHEN c_custkey % 7 = 0 THEN 'missing_record' ELSE 'found' END AS status, CASE WHEN c_custkey % 7 <> 0 THEN 2 * c_custkey END AS twice FROM customer")
def resumable_lookups(spark, sf):
    """Customers' keys streamed from files in batches and looked up, with a row for each key that has no record."""
    path = scratch(spark, "lookups")
    table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("custkey")).repartition(3, "custkey").write.json(f"{path}/keys")
    schema = T.StructType([T.StructField("custkey", T.StringType())])
    rows = ingest.ingest_lookups(spark, f"{path}/keys", schema, "custkey", _balances, f"{path}/found", f"{path}/checkpoint")
    return rows.select("custkey", "status", F.get_json_object("record", "$.twice").cast("long").alias("twice"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'cubic' WHEN 2 THEN 'tetragonal' WHEN 3 THEN 'orthorhombic' WHEN 4 THEN 'hexagonal' WHEN 5 THEN 'trigonal' WHEN 6 THEN 'monoclinic' ELSE 'triclinic' END AS system FROM part""")
def crystal_systems(spark, sf):
    """Systems of lattices made out of parts: a kind of cell by the key, its size by the part's, in a setting that hides its angles."""
    kind, a = F.col("p_partkey") % 8, F.col("p_size") / F.lit(10.0) + 3
    by = lambda *values: F.coalesce(*[F.when(kind == i + 1, F.lit(float(v))) for i, v in enumerate(values)])
    b, c = a * by(1, 1, 1.37, 1, 1, 1.37, 1.37), a * by(1, 1.71, 1.71, 1.71, 1, 1.71, 1.71)
    alpha, beta, gamma = (F.cos(F.radians(by(*angles))) for angles in ((90, 90, 90, 90, 70, 90, 75), (90, 90, 90, 90, 70, 103, 83), (90, 90, 90, 120, 70, 90, 101)))
    sine = F.sqrt(1 - gamma * gamma)
    x = (alpha - beta * gamma) / sine
    rows = [[a, F.lit(0.0), F.lit(0.0)], [b * gamma, b * sine, F.lit(0.0)], [c * beta, c * x, c * F.sqrt(1 - beta * beta - x * x)]]
    turns = F.col("p_partkey") % 3
    moved = [rows[0], [rows[1][i] + turns * rows[0][i] for i in range(3)], [rows[2][i] - rows[1][i] + turns * rows[0][i] for i in range(3)]]
    cell = F.when(kind > 0, F.array(*[F.array(*r) for r in moved]))
    return table(spark, sf, "part").select("p_partkey", crystal.crystal_system(cell).alias("system"))


_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"
_PMF = f"exp({_CHOOSE.format('d', 'k')} + {_CHOOSE.format('(n - d)', '(m - k)')} - ({_CHOOSE.format('n', 'm')}))"


@query(LB + f""", c AS (SELECT count(*) AS n, count(*) FILTER (WHERE disc) AS d FROM lb), f AS (SELECT *, CAST(ceil(n * share) AS BIGINT) AS m FROM c, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE)) s(share)),
k AS (SELECT *, unnest(range(greatest(0, m - (n - d)), least(m, d) + 1)) AS k FROM f), p AS (SELECT *, sum({_PMF}) OVER (PARTITION BY share ORDER BY k) AS upto FROM k)
SELECT share, m AS drawn, round(any_value(d / n), 9) AS mean, min(k) FILTER (WHERE upto >= 0.025) AS low, min(k) FILTER (WHERE upto >= 0.975) AS high FROM p GROUP BY share, m""")
def random_selection_null(spark, sf):
    """Discordant rows among a random selection of each share: mean and bounds in closed form, over all rows."""
    counts = documents(spark, sf).agg(F.count("*").alias("n"), C.count_if(F.col("discordant")).alias("d"))
    shares = counts.withColumn("share", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.25))))).withColumn("drawn", F.ceil(F.col("n") * F.col("share")))
    return shares.withColumn("b", P.bounds(F.col("n"), F.col("d"), F.col("drawn"))).select("share", "drawn", F.round(F.col("d") / F.col("n"), 9).alias("mean"), F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'missing_record' WHEN o_orderpriority = '1-URGENT' THEN 'match_error_ValueError' WHEN o_totalprice > 100000 THEN 'strict_structure_match' ELSE 'structure_mismatch' END AS status FROM orders")
def match_statuses(spark, sf):
    """The status machine over recorded outcomes of the structure matcher."""
    outcome = F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "ValueError").alias("error"), (F.col("o_totalprice") > 100000).alias("matched"))
    return table(spark, sf, "orders").withColumn("outcome", outcome).select("o_orderkey", match_status(F.col("o_orderstatus") != "P", F.col("outcome")).alias("status"))


@query("""WITH s AS (SELECT o_orderpriority AS model, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS source, avg(o_totalprice) / 300000 AS f1 FROM orders GROUP BY 1, 2),
o AS (SELECT max(names) FILTER (WHERE source = 'a') AS order_a, max(names) FILTER (WHERE source = 'b') AS order_b FROM (SELECT source, string_agg(model, '|' ORDER BY f1 DESC, model) AS names FROM s GROUP BY source)),
d AS (SELECT max(abs(x)) AS max_shift, count(*) AS models FROM (SELECT model, max(f1) FILTER (WHERE source = 'a') - max(f1) FILTER (WHERE source = 'b') AS x FROM s GROUP BY model))
SELECT order_a, order_b, round(max_shift, 9) AS max_shift, models, split_part(order_a, '|', 1) <> split_part(order_b, '|', 1) AS top_flip, order_a <> order_b AS order_flip,
  CASE WHEN models < 3 THEN 'BLOCKED' WHEN order_a <> order_b AND max_shift >= 0.05::DOUBLE THEN 'GO' ELSE 'NO_GO' END AS verdict FROM o, d""")
def gate_panel(spark, sf):
    """The alternative panel's gate over scores by model and source."""
    o = table(spark, sf, "orders")
    metrics = o.groupBy(F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("source")).agg((F.avg("o_totalprice") / 300000).alias("f1"))
    return G.panel_gate(G.order_flips(metrics, "source", "model", "f1", "a", "b")).withColumn("max_shift", F.round("max_shift", 9))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    """A CSV with header written and read by a declared schema, of which four columns are kept."""
    path = scratch(spark, "csv")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    c.write.csv(path, header=True, escape='"')
    return files.read_csv(spark, path, c.schema, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10")
def json_lines_round_trip(spark, sf):
    """JSON lines written and read by a declared schema."""
    path = scratch(spark, "json")
    p = table(spark, sf, "part").where("p_size > 10").select("p_partkey", "p_name", "p_size")
    p.write.json(path)
    return files.read_json_lines(spark, path, p.schema, strict=True)


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def append_resumed(spark, sf):
    """An append that broke off after half its rows and was called again: every key stands once."""
    path, s = scratch(spark, "append"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    files.append_new(s.where("s_suppkey % 2 = 0"), path, "s_suppkey")
    files.append_new(s, path, "s_suppkey")
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 20000")
def rejects_split(spark, sf):
    """Rows that pass, the others up to a limit in a side file."""
    return files.split_rejects(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") >= 20000, scratch(spark, "rejects"))


@query("WITH l AS (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey), f AS (SELECT l_orderkey AS first_key, last AS first_last FROM l ORDER BY last DESC, l_orderkey LIMIT 1) SELECT l_orderkey, last, last / first_last AS share FROM l, f")
def first_row_scalars(spark, sf):
    """A prior result's first row as scalars of another."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"))
    first = files.first_row(last.orderBy(F.desc("last")).select(F.col("l_orderkey"), (-F.col("last")).alias("down")), ["down", "l_orderkey"]).select((-F.col("down")).alias("first_last"))
    return last.crossJoin(F.broadcast(first)).select("l_orderkey", "last", (F.col("last") / F.col("first_last")).alias("share"))


@query("SELECT sha256(p_name) AS digest, min(p_partkey) AS p_partkey, count(*) AS n FROM part GROUP BY p_name")
def digests(spark, sf):
    """SHA-256 of contents, with the first that holds each."""
    return table(spark, sf, "part").groupBy(F.sha2("p_name", 256).alias("digest")).agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n"))
