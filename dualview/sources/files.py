"""Scans and sinks: CSV with declared schemas, CSV inside ZIP, JSON lines, resumable appends, manifests."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with header, read as text by position of ``schema`` and cast leniently; blanks and bad values are null.

    Booleans are true for the text ``true`` in any case, null for blanks. Only the columns asked for are cast.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.csv(path, header=True, schema=text, escape='"', multiLine=True)
    wanted = [f for f in schema.fields if columns is None or f.name in columns]
    return raw.select(*[_cast(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in wanted])


def _cast(c: Column, kind: T.DataType) -> Column:
    blank = F.nullif(F.trim(c), F.lit(""))
    if isinstance(kind, T.StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.when(blank.isNotNull(), F.lower(blank) == "true")
    return blank.try_cast(kind)


def read_zipped_csv(spark: SparkSession, path: str, members: Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV members of ZIP archives, with ``source_file`` and ``source_order`` (place in ``members``).

    An archive is read by one task, member after member in chunks; ingest large ones to Parquet once.
    """
    names = [f.name for f in schema.fields]
    out = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("source_file", T.StringType()), T.StructField("source_order", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for order, member in enumerate(members):
                        if member in z.namelist():
                            with z.open(member) as f:
                                for part in pd.read_csv(f, dtype=str, usecols=names, keep_default_na=False, chunksize=50_000):
                                    yield part[names].assign(source_file=member, source_order=order)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, out)
    return raw.select(*[_cast(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields], "source_file", "source_order")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; bad lines are dropped, or fail the read with ``strict``. Blank lines never count."""
    return spark.read.json(path, schema=schema, mode="FAILFAST" if strict else "DROPMALFORMED")


def latest_records(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One record for each key, the last in order."""
    from ..operators.pairs import keep_first

    return keep_first(df, [key], [order.desc()])


def first_row(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A prior result's first row in an order, to be joined as scalars."""
    return df.orderBy(*order).limit(1)


def write_report(df: DataFrame, path: str) -> None:
    """A report-sized table as one CSV file with header and doubled quotes."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append to a Parquet table the rows whose key it does not hold yet; returns what was new.

    A run that broke off is resumed by calling it again.
    """
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    new = df if done is None else df.join(done, key, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def split_rejects(df: DataFrame, keep: Column, path: str, most: int = 5000) -> DataFrame:
    """Rows that satisfy a predicate; up to ``most`` of the others go to a side file."""
    good = F.coalesce(keep, F.lit(False))
    df.where(~good).limit(most).write.mode("overwrite").csv(path, header=True, escape='"')
    return df.where(good)


def manifest(root: str, exclude: Callable[[str], bool] = lambda name: False) -> list[tuple[str, str]]:
    """(SHA-256, relative path) of every file under a folder of the driver, in order of path."""
    out = []
    for p in sorted(Path(root).rglob("*")):
        name = p.relative_to(root).as_posix()
        if p.is_file() and not exclude(name):
            digest = hashlib.sha256()
            with p.open("rb") as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            out.append((digest.hexdigest(), name))
    return out


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report-sized table as Markdown."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])


def run_or_record(step: Callable[[], DataFrame], spark: SparkSession, path: str, name: str) -> DataFrame:
    """Run a step; if it fails, write a row saying so and raise again."""
    try:
        return step()
    except Exception as e:
        spark.createDataFrame([(name, "failed", type(e).__name__, str(e)[:500])], "step string, status string, error string, message string").write.mode("append").json(path)
        raise
