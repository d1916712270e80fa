"""Rows at given ranks of a total order, found without sorting the table."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settled import settle

#: Different keys that one range of a running count should have, and groups up to which what is told of them is broadcast.
GATHER, MOST_GROUPS = 1 << 20, 4096
#: Drawn keys of the search by samples that this one replaces; nothing is drawn any more, but tests set it.
SAMPLE = 32768


def rank_keys(df: DataFrame, group: Sequence[str], order: Sequence[str], ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(group, n, a struct of ``order`` for each rank): the keys that stand at ranks of each group.

    ``ranks`` maps a group's size to named ranks, from 1; a rank outside the group gives null. Nulls sort first, NaN
    last. Equal keys may repeat.

    Rows are counted by group and first column, and a running count over the different values finds the one that holds
    each rank. Columns are taken one after the other: the next is read only in rows that equal a value found, and the rank
    left is looked for among them. So the table is scanned once for each column of the order, whatever its size and
    the ranks asked for; rows shuffle as counts, and rows tied with a key as what is left of their order.
    """
    named = ranks(F.col("_n"))
    columns = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)] + [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    found = _search(df.select(*columns), [f"_g{i}" for i in range(len(group))], [f"_o{i}" for i in range(len(order))], list(named.values()))
    keys = [F.when(F.col(f"_k{j}").isNotNull(), F.struct(*[F.col(f"_k{j}")[f"_o{i}"].alias(c) for i, c in enumerate(order)])).alias(name) for j, name in enumerate(named)]
    return found.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(group)], F.col("_n").alias("n"), *keys)


def _search(df: DataFrame, group: list[str], order: list[str], ranks: list[Column], told: DataFrame | None = None) -> DataFrame:
    """(group, _n, _k0, ...): the key at each of ``ranks`` (of a group's size ``_n``, or columns of ``told``), null beyond the group."""
    from .ranking import running_sums

    first, rest, some = order[0], order[1:], range(len(ranks))
    counts = settle(df.groupBy(*group, first).agg(F.count("*").alias("_m")), "counts")
    if told is None:
        told = counts.groupBy(*group).agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_n"))
    told = _few(told.select(*group, "_n", *[r.cast("long").alias(f"_r{i}") for i, r in enumerate(ranks)]))
    upto = running_sums(counts, group, [first], {"_upto": F.col("_m")}, -(-counts.count() // GATHER))
    before = F.col("_upto") - F.col("_m")
    at = [F.max(F.when((before < F.col(f"_r{i}")) & (F.col(f"_r{i}") <= F.col("_upto")), F.struct(F.col(first).alias("v"), (F.col(f"_r{i}") - before).alias("left")))).alias(f"_a{i}") for i in some]
    found = _few(_beside(upto, group, told).groupBy(*group).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_n"), *at))
    a = [F.col(f"_a{i}") for i in some]
    if not rest:
        return found.select(*group, "_n", *[F.when(a[i].isNotNull(), F.struct(a[i]["v"].alias(first))).alias(f"_k{i}") for i in some])
    # ranks with one value are looked for together, under the number of the first of them
    of = f"_of{len(rest)}"
    leads = [F.coalesce(*[F.when(a[i].isNotNull() & a[j].isNotNull() & a[j]["v"].eqNullSafe(a[i]["v"]), F.lit(j)) for j in range(i + 1)]) for i in some]
    found = found.withColumns({f"_l{i}": lead for i, lead in enumerate(leads)})
    hits = [(F.col(f"_l{i}") == i) & F.col(first).eqNullSafe(a[i]["v"]) for i in some]
    tied = _beside(df, group, found).where(functools.reduce(lambda x, y: x | y, hits))
    ties = tied.select(*group, F.explode(F.filter(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hits)]), lambda x: x.isNotNull())).alias(of), *rest)
    left = found.select("*", F.explode(F.array(*[F.lit(i) for i in some])).alias(of)).where(functools.reduce(lambda x, y: x | y, [F.col(f"_l{i}") == F.col(of) for i in some]))
    left = left.select(*group, of, "_n", *[F.when(F.col(f"_l{i}") == F.col(of), a[i]["left"]).alias(f"_b{i}") for i in some])
    more = _search(settle(ties, "ties") if len(rest) > 1 else ties, [*group, of], rest, [F.col(f"_b{i}") for i in some], left)
    more = _few(more.groupBy(*group).agg(*[F.max(f"_k{i}").alias(f"_k{i}") for i in some]))
    keys = [F.when(a[i].isNotNull(), F.struct(a[i]["v"].alias(first), *[F.col(f"_k{i}")[c].alias(c) for c in rest])).alias(f"_k{i}") for i in some]
    return _few(_beside(found, group, more, "left").select(*group, "_n", *keys))


def _few(df: DataFrame) -> DataFrame:
    """What is told of groups, at hand for a broadcast if there are few of them, else settled."""
    rows = df.limit(MOST_GROUPS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= MOST_GROUPS else settle(df, "told")


def _beside(df: DataFrame, group: Sequence[str], told: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with what is told of their group."""
    if not group:
        return df.crossJoin(told)
    other = told.withColumnsRenamed({c: f"__group_{i}" for i, c in enumerate(group)})
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__group_{i}")) for i, c in enumerate(group)])
    return df.join(other, same, how).drop(*[f"__group_{i}" for i in range(len(group))])


def _compare(order: Sequence[str], bound: Column) -> tuple[Column, Column]:
    """Whether a row's key is less than a bound, and whether it equals it; nulls first. Later columns are looked at on ties only."""
    less, same = F.lit(False), F.lit(True)
    for c in reversed(order):
        own, other = F.col(c), bound[c]
        before = F.coalesce(own < other, own.isNull() & other.isNotNull())
        less, same = before | (own.eqNullSafe(other) & less), own.eqNullSafe(other) & same
    return less, same


def within(df: DataFrame, group: Sequence[str], order: Sequence[str], ranks: Callable[[Column], dict[str, Column]], search: bool | None = None) -> DataFrame:
    """Add ``n`` of the group and, for each named rank, whether the row stands at it or before; ranks beyond the group take all of it.

    A small table is ranked by one window; a larger one (or with ``search``) is compared with ``rank_keys`` and not sorted.
    """
    from .ranking import SMALL, estimated_bytes, ranked

    capped = lambda n: {name: F.least(c.cast("long"), n.cast("long")) for name, c in ranks(n).items()}
    names = list(ranks(F.lit(1)))
    if not (estimated_bytes(df) > SMALL if search is None else search):
        rows = ranked(df, group, order, 1)
        return rows.select(*df.columns, "n", *[(F.col("rank") <= c).alias(name) for name, c in capped(F.col("n")).items()])
    keys = rank_keys(df, group, order, capped).withColumnsRenamed({name: f"__key_{i}" for i, name in enumerate(names)})
    joined = _beside(df, group, keys)
    flags = []
    for i, name in enumerate(names):
        less, equal = _compare(order, F.col(f"__key_{i}"))
        flags.append((F.col(f"__key_{i}").isNotNull() & (less | equal)).alias(name))
    return joined.select(*df.columns, "n", *flags)


def quantiles(df: DataFrame, group: Sequence[str], value: str, levels: dict[str, float], search: bool | None = None) -> DataFrame:
    """(group, a column for each named level): exact quantiles of ``value`` by group, interpolated linearly; nulls don't count.

    A small table takes Spark's percentile, which holds the different values of a group; a larger one (or with ``search``) takes
    the two ranks beside each quantile from ``rank_keys``, in memory that doesn't depend on how many values there are.
    Groups without values are left out.
    """
    from .ranking import SMALL, estimated_bytes

    rows = df.select(*group, F.col(value).cast("double").alias("__value")).where(F.col("__value").isNotNull())
    names = list(levels)
    if not (estimated_bytes(rows) > SMALL if search is None else search):
        found = rows.groupBy(*group).agg(F.percentile("__value", F.array(*[F.lit(float(q)) for q in levels.values()])).alias("__q"))
        return found.where("__q is not null").select(*group, *[F.col("__q")[i].alias(name) for i, name in enumerate(names)])

    def ranks(n: Column) -> dict[str, Column]:
        spot = {name: F.lit(float(q)) * (n - 1) for name, q in levels.items()}
        return {f"{side}{i}": (f(spot[name]) + 1).cast("long") for i, name in enumerate(names) for side, f in (("__low", F.floor), ("__high", F.ceil))}

    keys = rank_keys(rows, group, ["__value"], ranks)
    out = []
    for i, name in enumerate(names):
        low, high = F.col(f"__low{i}")["__value"], F.col(f"__high{i}")["__value"]
        spot = F.lit(float(levels[name])) * (F.col("n") - 1)
        share = spot - F.floor(spot)
        out.append(F.when(low == high, low).otherwise((1 - share) * low + share * high).alias(name))
    return keys.select(*group, *out)
