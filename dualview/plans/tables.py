"""Adapters from the star-schema tables to paired-label frames, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import labelled, pair_frame

#: Labels of the lineitem adapter: distance at or under this.
AT = 0.02

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL for the same rows."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as pairs: discount against tax, with three scores, strata and keys."""
    li = table(spark, sf, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), F.date_format("l_shipdate", "yyyyMMdd"))
    pairs = pair_frame(
        li, id, F.col("l_discount"), F.col("l_tax"), at=AT, price=F.col("l_extendedprice"), qty=F.col("l_quantity"),
        day=F.unix_date(F.to_date("l_shipdate")).cast("double"), flag=F.col("l_returnflag"), status=F.col("l_linestatus"),
        orderkey=F.col("l_orderkey"), linenumber=F.col("l_linenumber"), partkey=F.col("l_partkey"), suppkey=F.col("l_suppkey"),
    )
    return labelled(pairs)


LI = """
WITH li AS (
  SELECT *, lab_a <> lab_b AS disc, abs(dist_a - dist_b) AS gap,
    CASE WHEN lab_a AND NOT lab_b THEN 'a_only' WHEN lab_b AND NOT lab_a THEN 'b_only' ELSE 'concordant' END AS direction,
    CASE WHEN lab_a AND lab_b THEN 'both' WHEN lab_a THEN 'a_only' WHEN lab_b THEN 'b_only' ELSE 'neither' END AS quadrant
  FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
      CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS id,
    l_discount AS dist_a, l_tax AS dist_b, l_discount <= 2e-2 AS lab_a, l_tax <= 2e-2 AS lab_b, l_extendedprice AS price, l_quantity AS qty,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS day, l_returnflag AS flag, l_linestatus AS status,
    l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem)
)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """labels with documents as pairs: quality against toxicity, strata lang and source, n_chars as size."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return labelled(pair_frame(rows, F.col("doc_id"), F.col("quality"), F.col("toxic"), F.col("quality") == 1, F.col("toxic") == 1, lang=F.col("lang"), source=F.col("source"), n_chars=F.col("n_chars")))


LB = """
WITH lb AS (
  SELECT doc_id AS id, quality = 1 AS lab_a, toxic = 1 AS lab_b, (quality = 1) <> (toxic = 1) AS disc, lang, source, n_chars
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL
)"""

MODELS = ("price", "qty", "day")


def scores(pairs: DataFrame) -> DataFrame:
    """One row for each entity and model: (model, score), the long form."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in MODELS])
    return pairs.select("id", "lab_a", "lab_b", "discordant", "quadrant", F.explode(rows).alias("m")).select("id", "lab_a", "lab_b", "discordant", "quadrant", "m.model", "m.score")


LONG = LI + """, long AS (
  SELECT id, lab_a, lab_b, disc, quadrant, 'price' AS model, price AS score FROM li
  UNION ALL SELECT id, lab_a, lab_b, disc, quadrant, 'qty', qty FROM li
  UNION ALL SELECT id, lab_a, lab_b, disc, quadrant, 'day', day FROM li
)"""
