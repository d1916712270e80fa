"""Ranks, prefixes and bins over a total order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .settled import settle

#: Estimated bytes that one range of a running sum should have.
RANGE = 64 << 20
#: Bytes of rows up to which ranks and quantiles are left to one window or Spark's percentile, and of a plan that is believed to be small.
SMALL, BELIEVED = 4 * RANGE, 1 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows. A plan knows compressed files, not what rows are unpacked or multiplied to, so beyond ``BELIEVED`` rows are counted."""
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if planned <= BELIEVED:
        return planned
    width = sum(32 if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)) else 8 for f in df.schema.fields)
    return df.count() * width


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, Column], ranges: int | None = None, size: str | None = None) -> DataFrame:
    """Add inclusive running sums along a total order in each group, and the group's rows as ``size`` if named.

    A small table takes one window for each group. A larger one is dealt out by range of (group, order), as many
    ranges as its bytes ask for, and summed along each range as it streams through, so that no task holds a whole
    group; what is found is settled, and the sums of earlier ranges, one row for each range and group, are added.
    """
    if ranges is None:
        ranges = -(-estimated_bytes(df) // RANGE)
    whole = Window.partitionBy(*group)
    if ranges <= 1:
        w = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumns({n: F.sum(c).over(w) for n, c in values.items()})
        return out.withColumn(size, F.count("*").over(whole)) if size else out
    keys, names = [*group, *order], list(values)
    dealt = df.withColumns({f"__value_{i}": c for i, c in enumerate(values.values())}).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    summed = settle(_streamed(dealt.withColumn("__part", F.spark_partition_id()), group, [f"__value_{i}" for i in range(len(names))]), "sums")
    last = [F.max_by(f"__value_{i}", "__row").alias(f"__total_{i}") for i in range(len(names))]
    totals = summed.groupBy(*group, "__part").agg(F.max("__row").alias("__rows"), *last)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__group_{i}") for i, g in enumerate(group)], F.col("__part").alias("__at"), F.sum("__rows").over(whole).alias("__size"), *[F.coalesce(F.sum(f"__total_{i}").over(before), F.lit(0)).alias(f"__before_{i}") for i in range(len(names))])
    same = F.col("__part") == F.col("__at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__group_{i}"))
    out = summed.join(offsets, same)
    sums = {n: (F.col(f"__value_{i}") + F.col(f"__before_{i}")).alias(n) for i, n in enumerate(names)}
    sized = [F.col("__size").alias(size)] if size else []
    return out.select(*[c for c in df.columns if c not in {*sums, size}], *sums.values(), *sized)


def _streamed(df: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sorted partitions with ``values`` replaced by their running sums and ``__row`` counted, both from the start of each group; nulls add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for g in group:
                c = batch.column(g)
                a, b = c.slice(0, n - 1), c.slice(1)
                changed = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
                new[1:] |= changed.to_numpy(zero_copy_only=False)
            first = tuple(batch.column(g)[0].as_py() for g in group)
            starts = np.flatnonzero(new)
            columns = [np.ones(n, dtype=np.int64), *[np.nan_to_num(pc.fill_null(batch.column(v), 0).to_numpy(zero_copy_only=False)) for v in values]]
            done = []
            for i, x in enumerate(columns):
                s = np.cumsum(x)
                carried = sums[i] if held == first else s.dtype.type(0)
                base = np.concatenate(([-carried], s[starts - 1])) if len(starts) else np.array([-carried])
                done.append(s - base[np.cumsum(new)])
            held, sums = tuple(batch.column(g)[n - 1].as_py() for g in group), [d[-1] for d in done]
            kept = [batch.column(c) if c not in values else pa.array(done[1 + values.index(c)]) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(done[0])], names=[*batch.schema.names, "__row"])

    fields = [T.StructField(f.name, (T.DoubleType() if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else T.LongType()) if f.name in values else f.dataType) for f in df.schema.fields]
    wide = df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in fields if f.name in values})
    return wide.mapInArrow(run, T.StructType([*fields, T.StructField("__row", T.LongType())]))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Add rank (from 1), n of the group and rank_percentile, over all rows given."""
    return running_sums(df, group, order, {"rank": F.lit(1)}, ranges, "n").withColumn("rank_percentile", F.col("rank") / F.col("n"))


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group with ``rank``.

    Spark limits groups before the shuffle only up to 1,000 rows, and sorts all rows for it. Of a table that is not small rows past the n-th
    are ruled out by its key (``selection.within``) first, so that no more than n of a group are sorted.
    """
    from .selection import within

    if all(isinstance(c, str) for c in order) and estimated_bytes(df) > SMALL:
        df = within(df, group, order, lambda _: {"__first": F.lit(n)}, True).where("__first").select(*df.columns)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def prefix_metrics(df: DataFrame, ks: Sequence[int], group: Sequence[str], order: Sequence[Column | str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates over the first K rows of each group, for every K; prefixes beyond the end are left out."""
    first = top_n(df, group, order, max(ks))
    wanted = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))
    out = first.withColumn("k", F.explode(wanted)).groupBy(*group, "k").agg(F.count("*").alias("n"), *aggregates)
    return out.where(F.col("n") == F.col("k"))


def top_size(n: Column, fraction: float, floor: int = 0, cap: bool = True) -> Column:
    """ceil(fraction * n), at least ``floor``, and at most n if capped."""
    size = F.greatest(F.ceil(F.lit(float(fraction)) * n).cast("long"), F.lit(floor).cast("long"))
    return F.least(n, size) if cap else size


def rank_bins(ranks: DataFrame, group: Sequence[str], fraction: float = 0.10, floor: int = 20) -> DataFrame:
    """Rows of ``ranked`` in the bins top 10 %, 10-25, 25-50 and 50-100 %.

    Starts are floored and ends are ceiled, so a row at an edge stands in two bins; the
    first bin ends at the top size.
    """
    n = F.col("n")
    edge = lambda f: F.floor(F.lit(f) * n)
    top = F.ceil
    bins = [("top_10", F.lit(0).cast("long"), top_size(n, fraction, floor)), ("10_25", edge(0.10), top(F.lit(0.25) * n)), ("25_50", edge(0.25), top(F.lit(0.50) * n)), ("50_100", edge(0.50), n)]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("bin"), lo.alias("lo"), hi.alias("hi")) for i, (name, lo, hi) in enumerate(bins)])
    inside = F.filter(rows, lambda b: (F.col("rank") > b["lo"]) & (F.col("rank") <= b["hi"]))
    return ranks.withColumn("_b", F.explode(inside)).select("*", "_b.place", "_b.bin").drop("_b")


def bin_edges(n: Column) -> dict[str, Column]:
    """The ranks at which the bins of ``rank_bins`` begin and end, for ``selection.within``."""
    floor, ceil = (lambda f: F.floor(F.lit(f) * n)), (lambda f: F.ceil(F.lit(f) * n))
    return {"top": top_size(n, 0.10, 20), "low10": floor(0.10), "high25": ceil(0.25), "low25": floor(0.25), "high50": ceil(0.50), "low50": floor(0.50)}


def in_bins() -> list[tuple[str, Column]]:
    """Names of the bins, and which rows lie in them by the flags of ``bin_edges``."""
    c = F.col
    return [("top_10", c("top")), ("10_25", ~c("low10") & c("high25")), ("25_50", ~c("low25") & c("high50")), ("50_100", ~c("low50"))]
