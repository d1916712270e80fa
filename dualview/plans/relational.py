"""Queries on grouping, joins, sets and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import conditions as C
from ..operators import relations as R
from ..operators import selection as L
from ..operators.pairs import head_n, keep_first
from .tables import LB, LI, documents, items, query, table

_RATE = "count(*) AS n, count(*) FILTER (WHERE disc) AS discordant_n, count(*) FILTER (WHERE disc) / count(*) AS discordance_rate"


@query(LI + f"SELECT partkey, {_RATE} FROM li GROUP BY partkey ORDER BY discordant_n DESC, n DESC, partkey LIMIT 50")
def group_topn_rates(spark, sf):
    return C.group_rates(items(spark, sf), ["partkey"]).orderBy(F.desc("discordant_n"), F.desc("n"), "partkey").limit(50)


@query("WITH o AS (SELECT n_name, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) SELECT n_name, count(*) AS orders_n, count(DISTINCT o_orderpriority) AS priorities, count(*) FILTER (WHERE o_totalprice > 250000) AS large_n, count(*) FILTER (WHERE o_totalprice > 250000) / count(*) AS large_rate, quantile_cont(o_totalprice, 0.5) AS median_price FROM o GROUP BY n_name")
def nation_rates(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = o.groupBy("n_name").agg(F.count("*").alias("orders_n"), F.countDistinct("o_orderpriority").alias("priorities"), C.count_if(F.col("o_totalprice") > 250000).alias("large_n"), F.percentile("o_totalprice", F.lit(0.5)).alias("median_price"))
    return out.withColumn("large_rate", S.ratio(F.col("large_n"), F.col("orders_n")))


@query(LI + "SELECT flag, status, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY flag) AS DOUBLE) AS share FROM li GROUP BY flag, status")
def group_share_of_parent(spark, sf):
    return R.share_of_parent(items(spark, sf), "flag", "status")


@query(LI + "SELECT flag, rank, id, gap FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY gap DESC, id) AS rank FROM li) WHERE rank <= 5")
def group_head_n(spark, sf):
    return head_n(items(spark, sf), ["flag"], [F.desc("gap"), "id"], 5).select("flag", "rank", "id", "gap")


@query(LI + f", t AS (SELECT li.disc, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM li JOIN part ON partkey = p_partkey) SELECT token, {_RATE} FROM t GROUP BY token")
def token_frequency(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), S.word_tokens(F.col("p_name")).alias("tokens"))
    return C.set_rates(items(spark, sf).select("partkey", "discordant").join(parts, "partkey"), "tokens", "token")


#: Groups of name tokens, standing for element families.
GROUPS = {"colour": ["red", "blue", "green"], "scale": ["small", "large"], "shape": ["ring", "gear", "bolt"]}


@query(LI + ", t AS (SELECT li.disc, string_split(p_name, ' ') AS w FROM li JOIN part ON partkey = p_partkey), f AS ("
       + " UNION ALL ".join(f"SELECT '{g}' AS family, disc FROM t WHERE list_has_any(w, {m!r})" for g, m in GROUPS.items())
       + " UNION ALL SELECT 'other', disc FROM t WHERE NOT (" + " OR ".join(f"list_has_any(w, {m!r})" for m in GROUPS.values()) + f")) SELECT family, {_RATE} FROM f GROUP BY family")
def family_multilabel(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), S.tags(S.word_tokens(F.col("p_name")), GROUPS).alias("families"))
    return C.set_rates(items(spark, sf).select("partkey", "discordant").join(parts, "partkey"), "families", "family")


@query(LI + f", t AS (SELECT li.disc, list_sort(list_distinct(string_split(p_name, ' '))) AS w FROM li JOIN part ON partkey = p_partkey), k AS (SELECT disc, concat_ws('|', len(w), array_to_string(w[1:2], '-')) AS prototype FROM t) SELECT prototype, {_RATE} FROM k GROUP BY prototype ORDER BY discordant_n DESC, n DESC, prototype LIMIT 50")
def prototype_proxy(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), S.family_pair(S.word_tokens(F.col("p_name"))).alias("prototype"))
    joined = items(spark, sf).select("partkey", "discordant").join(parts, "partkey")
    return C.group_rates(joined, ["prototype"]).orderBy(F.desc("discordant_n"), F.desc("n"), "prototype").limit(50)


@query(LB + "SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE disc) AS discordant_n, quantile_cont(n_chars, 0.5) AS median_size FROM lb GROUP BY GROUPING SETS ((lang), (lang, source))")
def grouping_sets_overall_stratum(spark, sf):
    return R.overall_and(documents(spark, sf), ["lang"], "source", [F.count("*").alias("n"), C.count_if(F.col("discordant")).alias("discordant_n"), F.percentile("n_chars", F.lit(0.5)).alias("median_size")])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf):
    return R.status_counts(table(spark, sf, "orders"), "o_orderstatus")


@query(LI + "SELECT orderkey, linenumber, id FROM (SELECT *, row_number() OVER (PARTITION BY orderkey, linenumber ORDER BY partkey, suppkey, price, qty, day, id) AS n FROM li) WHERE n = 1")
def dedup_keep_first(spark, sf):
    return keep_first(items(spark, sf), ["orderkey", "linenumber"], ["partkey", "suppkey", "price", "qty", "day", "id"]).select("orderkey", "linenumber", "id")


@query(LI + """, picks AS (
  SELECT * FROM (SELECT id, 'largest_gap' AS reason, 0 AS list, row_number() OVER (ORDER BY gap DESC, id) AS place FROM li) WHERE place <= 10
  UNION ALL SELECT * FROM (SELECT id, 'a_only', 1, row_number() OVER (ORDER BY price DESC, id) AS place FROM li WHERE direction = 'a_only') WHERE place <= 10
  UNION ALL SELECT * FROM (SELECT id, 'b_only', 2, row_number() OVER (ORDER BY price DESC, id) AS place FROM li WHERE direction = 'b_only') WHERE place <= 10
), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list, place) AS n FROM picks) WHERE n = 1)
SELECT id, reason, list, place FROM firsts ORDER BY list, place LIMIT 24""")
def case_picker(spark, sf):
    li = items(spark, sf)
    lists = [("largest_gap", li, F.desc("gap")), ("a_only", li.where("direction = 'a_only'"), F.desc("price")), ("b_only", li.where("direction = 'b_only'"), F.desc("price"))]
    out = None
    for i, (reason, df, order) in enumerate(lists):
        first = df.orderBy(order, "id").limit(10).select("id", F.lit(reason).alias("reason"), F.lit(i).alias("list"), "gap", "price")
        first = head_n(first, ["reason"], [order, "id"], 10).select("id", "reason", "list", F.col("rank").alias("place"))
        out = first if out is None else out.unionByName(first)
    return keep_first(out, ["id"], ["list", "place"]).orderBy("list", "place").limit(24)


@query("WITH c AS (SELECT * FROM customer WHERE c_acctbal > 0) SELECT o_orderkey, c_mktsegment, CASE WHEN c_custkey IS NULL THEN 'missing_customer' WHEN c_mktsegment = 'BUILDING' THEN 'match' ELSE 'segment_mismatch' END AS status FROM orders LEFT JOIN c ON o_custkey = c_custkey")
def left_join_status(spark, sf):
    customers = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    out = R.lookup_with_status(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey", "missing_customer", F.when(F.col("c_mktsegment") == "BUILDING", "match").otherwise("segment_mismatch"))
    return out.select("o_orderkey", "c_mktsegment", "status")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, sf):
    large = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(large, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) >= 3)")
def anti_join_resume(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return R.to_do(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey", F.countDistinct("l_linenumber") >= 3)


@query("""WITH p AS (SELECT p_partkey, p_brand, p_type, p_retailprice FROM part), m AS (
  SELECT a.p_partkey AS partkey, b.p_partkey AS candidate, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS n FROM p a JOIN p b USING (p_brand, p_type)
  WHERE b.p_partkey > a.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 50)
SELECT p_partkey AS partkey, candidate, CASE WHEN candidate IS NULL THEN 'no_match' ELSE 'match' END AS status FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) ON partkey = p_partkey""")
def first_candidate_match(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), "p_brand", "p_type", "p_retailprice")
    joined = R.first_near(p, ["p_brand", "p_type"], "partkey", "p_retailprice", 50.0, "candidate")
    return joined.select("partkey", "candidate", "status")


@query("""WITH t AS (SELECT p_partkey, list_sort(list_distinct(string_split(concat_ws(' ', p_name, lower(p_type)), ' '))) AS w FROM part),
f AS (SELECT array_to_string(w, '-') AS formula, any_value(w) AS fw, min(p_retailprice) AS low FROM (SELECT list_sort(list_distinct(string_split(p_name, ' '))) AS w, p_retailprice FROM part) GROUP BY 1)
SELECT p_partkey, formula, low FROM t JOIN f ON list_has_all(w, fw)""")
def containment_theta_join(spark, sf):
    p = table(spark, sf, "part")
    targets = p.select("p_partkey", S.word_tokens(F.concat_ws(" ", "p_name", F.lower("p_type"))).alias("w"))
    formulas = p.select(S.word_tokens(F.col("p_name")).alias("fw"), "p_retailprice").groupBy("fw").agg(F.min("p_retailprice").alias("low")).withColumn("formula", S.system_key(F.col("fw")))
    return R.contained_in(formulas, "fw", targets, "w").select("p_partkey", "formula", "low")


@query("WITH a AS (SELECT p_name AS formula, min(p_retailprice) AS low_a FROM part WHERE p_brand < 'Brand#2' GROUP BY 1), b AS (SELECT p_name AS formula, min(p_retailprice) AS low_b FROM part WHERE p_brand >= 'Brand#2' GROUP BY 1) SELECT formula, low_a, low_b FROM a JOIN b USING (formula)")
def min_per_formula(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_name", "formula")
    low = lambda c, n: p.where(c).groupBy("formula").agg(F.min("p_retailprice").alias(n))
    return low("p_brand < 'Brand#2'", "low_a").join(low("p_brand >= 'Brand#2'", "low_b"), "formula")


@query("""WITH w AS (SELECT p_partkey, p_size, unnest(string_split(p_name, ' ')) AS token FROM part), r AS (SELECT token, min(p_size) AS ref FROM w WHERE token <> 'red' GROUP BY token),
c AS (SELECT p_partkey, token, count(*) AS amount FROM w GROUP BY p_partkey, token)
SELECT p_partkey, CASE WHEN count(ref) = count(*) THEN sum(amount * ref) / sum(amount) END AS reference_sum FROM c LEFT JOIN r USING (token) GROUP BY p_partkey""")
def element_reference_sum(spark, sf):
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    refs = p.select("p_size", F.explode(words).alias("token")).where("token <> 'red'").groupBy("token").agg(F.min("p_size").alias("ref"))
    amounts = F.map_from_arrays(F.array_distinct(words), F.transform(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w)).cast("double")))
    return R.reference_sums(p.select("p_partkey", amounts.alias("amounts")), "p_partkey", "amounts", refs, "token", "ref")


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 6) AS low, round(quantile_cont(o_totalprice, 0.5), 6) AS middle, round(quantile_cont(o_totalprice, 0.975), 6) AS high FROM orders GROUP BY o_orderpriority")
def quantiles_interpolated(spark, sf):
    levels = {"low": 0.025, "middle": 0.5, "high": 0.975}
    found = L.quantiles(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", levels, search=True)
    return found.select("o_orderpriority", *[F.round(n, 6).alias(n) for n in levels])


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, max(value) AS high FROM events GROUP BY 1, 2")
def json_props_rollup(spark, sf):
    k = F.from_json("props", "k long")["k"] % 10
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.max("value").alias("high"))


@query("SELECT c_custkey AS k, 'both' AS side FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 'all' FROM supplier UNION ALL (SELECT DISTINCT c_nationkey, 'customers_only' FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey, 'customers_only' FROM supplier WHERE s_acctbal > 5000)")
def set_operations(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    both = c.select(F.col("c_custkey").alias("k")).intersect(s.select("s_suppkey")).withColumn("side", F.lit("both"))
    every = s.select(F.col("s_suppkey").alias("k"), F.lit("all").alias("side"))
    only = c.where("c_acctbal > 9900").select("c_nationkey").subtract(s.where("s_acctbal > 5000").select("s_nationkey")).select(F.col("c_nationkey").cast("long").alias("k"), F.lit("customers_only").alias("side"))
    return both.unionByName(every).unionByName(only)


@query(LI + "SELECT flag, count(*) AS n, count(*) FILTER (WHERE lab_a) AS a_n FROM li WHERE starts_with(flag, 'R') OR contains(status, 'F') GROUP BY flag")
def prefix_and_contains(spark, sf):
    li = items(spark, sf).where(F.col("flag").startswith("R") | F.col("status").contains("F"))
    return li.groupBy("flag").agg(F.count("*").alias("n"), C.count_if(F.col("lab_a")).alias("a_n"))
