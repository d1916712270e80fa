"""Resumable ingestion of record files as a stream that stops when it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.lookup import Fetch, lookup


def ingest(spark: SparkSession, source: str, schema: T.StructType, key: str, target: str, checkpoint: str) -> None:
    """Append new JSON-lines records to a Parquet table, one for each key, across restarts."""
    rows = spark.readStream.schema(schema).json(source).dropDuplicates([key])
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


def ingest_lookups(spark: SparkSession, source: str, schema: T.StructType, key: str, fetch: Fetch, target: str, checkpoint: str, files: int = 1, batch: int = 100, retries: int = 3, pause: float = 0.5) -> DataFrame:
    """Look up the keys of JSON-lines files, ``files`` of them a batch, and return the table of all that was found so far.

    (key, record, error, status): a key without a record has a row of its own (``missing_record``), and so has one whose lookup
    failed (``error``). Every key is looked up once, whatever batch brings it again; null keys are left out. A batch writes the folder
    of its number anew, so one that broke off before it was committed is done over without a trace of the first attempt,
    and a run that is resumed ends with the table of a run that never broke.
    """
    out = T.StructType([T.StructField(key, T.StringType()), *[T.StructField(c, T.StringType()) for c in ("record", "error", "status")], T.StructField("batch", T.LongType())])

    def known(before: int | None = None) -> DataFrame:
        rows = spark.read.schema(out).parquet(target)
        return rows if before is None else rows.where(F.col("batch") < before)

    def step(rows: DataFrame, number: int) -> None:
        wanted = rows.select(F.col(key).cast("string").alias(key)).distinct()
        if number:
            wanted = wanted.join(known(number).select(key), key, "left_anti")
        lookup(wanted, key, fetch, batch, retries, pause).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return known().drop("batch")
