"""Helpers shared by the training-data operators: tables, batches, settled results."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of one string column that a Python step handles at once.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and Python; several are held on both sides of each task.
BATCH_BYTES = 8 << 20


def named(column: str):
    """The column of exactly this name, whatever dots or backticks it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one made where the session names none.

    On one machine (as in tests) that is a temporary folder, on a cluster one in the warehouse.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.getCheckpointDir():
        local = sc.master.startswith("local")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="dualview-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/dualview-settled")
    return sc.getCheckpointDir()


#: Folders that this process settled tables in and has not cleared.
_settled: list[str] = []


#: Has Spark delete a query's shuffle files when the query ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Lineage ends here, so a lost executor costs a read and not the steps above, and the shuffle
    files of the write go with it. The folder stays until ``clear``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dualview-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _settled.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Delete every table settled so far but those that ``keep`` reads; call it once nothing else will be read."""
    kept = set() if keep is None else {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    left = [p for p in _settled if p.rsplit("/", 1)[-1] in kept]
    for path in set(_settled) - set(left):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    _settled[:] = left


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` (string or binary) has about ``most`` bytes in each piece."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start, n - start)


def map_slices(df: DataFrame, column: str, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` in pieces of bounded bytes. ``step`` may return None for no rows.

    Lowers the session's bound on Arrow batches to ``BATCH_BYTES``, should it be larger.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column, most):
                out = step(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; 10,000 rows of text make tens of megabytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    if not 0 < jvm.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over the whole table; one number to the driver."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def parts_for(total_bytes: int, each: int, least: int) -> int:
    """How many partitions give each about ``each`` bytes; ``least`` at least."""
    return max(least, math.ceil(total_bytes / each))


def text_key(column: str = "text") -> list:
    """Two independent 64-bit hashes of a text, null taken as empty: its identity in joins."""
    text = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(0x5EED), text, F.octet_length(text)).alias("key_b")]


def sorted_ranges(df: DataFrame, keys: list, rows: int, label: str) -> DataFrame:
    """Settle ``df`` in the order of ``keys``: ``part`` is the range a row lies in, ``idx`` its place there, from 0.

    Ranges hold about ``rows`` rows. They follow the data, so a key with a third of all rows takes
    as many ranges as it needs if the later keys tell its rows apart. ``df`` should be
    settled, as it is read to count, to draw the ranges and to deal.
    """
    n = parts_for(df.count(), rows, 1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return settle(dealt.withColumns({"part": F.spark_partition_id(), "idx": place}), label)


def numbered(placed: DataFrame, group: str) -> DataFrame:
    """Add ``pos`` (from 0) within each group and ``n``, its size, to ``sorted_ranges`` by the group first; groups aren't null."""
    spans = placed.groupBy(group, "part").agg(F.min("idx").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = spans.select(group, "part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(own).alias("n"))
    return placed.join(shifts, [group, "part"]).withColumn("pos", F.col("idx") + F.col("_shift")).drop("_shift")
