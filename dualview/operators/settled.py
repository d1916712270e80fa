"""Tables written to the folder that all executors share, so that lineage ends and a lost executor costs a read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete a query's shuffle files when the query ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 8 << 20

_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in ``spark.checkpoint.dir``, or in the warehouse; on one machine a temporary one that goes with the process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="dualview-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = _local[0]
    return f"{root or spark.conf.get('spark.sql.warehouse.dir')}/dualview-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write a table and read it back; ``clean`` has Spark delete the shuffle files of the write when it ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if clean else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; 10,000 packed rows may make hundreds of megabytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
