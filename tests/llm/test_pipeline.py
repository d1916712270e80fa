import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from dualview.llm import registry
from dualview.llm.common import CLEANUP, named, settle
from oracle import assert_same, connect

from .conftest import prose


@pytest.fixture(scope="module")
def items_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("items")
    spark.createDataFrame([(1, prose(200, 30)), (2, None), (3, "short")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_columns(spark, odd, items_dir, name, stage):
    long = spark.createDataFrame([(800, " ".join(prose(1000 + i, 100) for i in range(1700))), (801, "the same text twice here. " * 3), (801, "the same text twice here. " * 3)], "doc_id long, text string")
    docs = odd.unionByName(long, allowMissingColumns=True).withColumn("a.b", F.col("doc_id") * 2).withColumn("c`d", F.lit("x")).withColumn("row", F.lit(1)).withColumn("node", F.lit(2)).withColumn("c0", F.lit(3)).withColumn("kept", F.lit(4))
    assert docs.where(F.length("text") > 1_000_000).count() == 1
    out = stage(spark, docs, items_dir)
    rows, last = out.collect(), stage is corpus_pipeline.STAGES[-1][1]
    ids = [r["doc_id"] for r in docs.collect()]
    assert all([r["doc_id"] for r in rows].count(i) <= ids.count(i) for i in {r["doc_id"] for r in rows}) and 800 in {r["doc_id"] for r in rows}
    if last:
        assert len(rows) == len(ids)
    else:
        assert out.columns == docs.columns
        seen = out.select("doc_id", named("a.b").alias("ab"), named("c`d").alias("cd"), "row", "node", "c0", "kept").collect()
        assert all(r["ab"] == (None if r["doc_id"] is None else 2 * r["doc_id"]) and (r["cd"], r["row"], r["node"], r["c0"], r["kept"]) == ("x", 1, 2, 3, 4) for r in seen)
    nothing = stage(spark, docs.limit(0), items_dir)
    assert nothing.count() == 0 and nothing.columns == out.columns


def test_stages_take_effect(spark, documents, tmp_path):
    item = prose(200, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    line = prose(9, 12)
    texts = [prose(1, 80), prose(2, 80) + "\n" + line, prose(3, 80) + "\n" + line, prose(1, 80), "1234 !!", prose(4, 50) + " " + item, None, prose(6, 80)]
    docs = documents(texts).select("doc_id", "text", "lang", "source", "n_chars")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
        if i == 1:
            assert {r["doc_id"]: r["text"] for r in docs.collect()}[2] == prose(3, 80)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept == [[0, 1, 2, 3, 5, 7], [0, 1, 2, 5, 7], [0, 1, 2, 5, 7], [0, 1, 2, 7], [0, 1, 2, 7]]


def test_registered(spark, small):
    found = entry.queries()
    assert {n for n in found if n.startswith("op")} == set(registry.QUERIES) and "pipeline" in found
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert found["pipeline"](spark, small).count() > 0


def test_line_dedup_equals_sql(spark, small):
    assert_same(registry.QUERIES["op6_line_dedup"](spark, small), connect(small), registry.ORACLES["op6_line_dedup"])


def test_settled_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(disk.getAllFiles().mkString(" ").split())
    before = files()
    rows = spark.range(20_000).repartition(4).groupBy((F.col("id") % 50).alias("k")).count()
    kept = settle(rows, "counted")
    for _ in range(50):  # Spark deletes them a moment later
        if not (left := {f for f in files() - before if "shuffle_" in f}):
            break
        time.sleep(0.2)
    assert not left and kept.count() == 50 and rows.count() == 50 and spark.conf.get(CLEANUP) == "false"
