"""Merkle manifest of a table: a leaf for each row, a subtree for each group, a root over the groups.

Superblock reduction: rows are numbered in order within their group, ``fanout^k`` consecutive
nodes make a bucket, and one ``applyInPandas`` call collapses k levels of a bucket at once. Roots of
buckets are the nodes of the next round; when every group is down to one node, those are numbered and
reduced alike. A row's proof is the steps inside its bucket followed by those of its bucket's root.

A step of a proof is the text that was hashed at that level with ``*`` in the place of the node itself,
so a proof can be folded by ``fold`` alone, without position, fanout or sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle, sorted_ranges

#: Nodes that one bucket should hold at most.
BUCKET = 1024
#: Rows of a range of the order.
RANGE = 1 << 17


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row; equal only for equal values, nulls told from empty texts."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(node: Column, proof: Column) -> Column:
    """The root that a proof leads to from ``node``."""
    return F.aggregate(proof, node, lambda acc, step: F.sha2(F.replace(step, F.lit("*"), acc), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof but the row's own, level by level, left to right."""
    return F.replace(F.concat_ws("", proof), F.lit("*"), F.lit(""))


def depth(n: int, fanout: int) -> int:
    """Levels from n nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(nodes: list[str], levels: int, fanout: int) -> tuple[list[list[str]], str]:
    """The steps of each node up to ``levels`` levels, and what is left there."""
    steps: list[list[str]] = [[] for _ in nodes]
    width = 1
    for _ in range(levels):
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        marked = ["".join(run[:i]) + "*" + "".join(run[i + 1 :]) for run in runs for i in range(len(run))]
        for i, own in enumerate(steps):
            own.append(marked[i // width])
        nodes = [digest("".join(run)) for run in runs]
        width *= fanout
    return steps, nodes[0]


def crown(nodes: DataFrame) -> DataFrame:
    """The last nodes of all groups, taken for roots."""
    return nodes.select("grp", "pos", "node", F.array().cast("array<string>").alias("proof"), F.col("node").alias("top"), F.col("node").alias("root"))


def climb(nodes: DataFrame, fanout: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(grp, pos, n, node) to (grp, pos, node, proof, top, root); ``crown`` takes over where every group is one node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return crown(nodes)
    k = 1
    while fanout ** (k + 1) <= BUCKET:
        k += 1
    width = fanout**k

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        steps, top = collapse(rows["node"].tolist(), min(k, depth(int(rows["n"].iloc[0]), fanout)), fanout)
        return rows[["grp", "pos", "n", "node"]].assign(steps=steps, up=top)

    bucket = F.floor(F.col("pos") / width).alias("bucket")
    done = settle(nodes.groupBy("grp", bucket).applyInPandas(reduce, "grp string, pos long, n long, node string, steps array<string>, up string"), "merkle")
    tops = done.where(F.col("pos") % width == 0).select("grp", bucket.alias("pos"), F.ceil(F.col("n") / width).alias("n"), F.col("up").alias("node"))
    above = climb(tops, fanout, crown).select("grp", F.col("pos").alias("bucket"), F.col("proof").alias("rest"), "top", "root")
    return done.withColumn("bucket", bucket).join(above, ["grp", "bucket"]).select("grp", "pos", "node", F.concat("steps", "rest").alias("proof"), "top", "root")


def manifest(rows: DataFrame, order: str, group: str, columns: Sequence[str], fanout: int = 2, carry: Sequence[Column] = ()) -> DataFrame:
    """One row for each row: ``order``, those of ``carry``, leaf, pos, proof, subroot and root.

    Leaves hash ``columns`` in the order given. Within a group (null: one of its own, first) they ascend by
    ``order``, nulls first, ties by leaf; equal leaves are interchangeable and numbered as they lie. Every
    ``fanout`` consecutive nodes become one, the last run being shorter, until one is left; a
    lone leaf is its own subroot. Groups ascend by UTF-8 bytes. An empty table gives no rows; other
    columns, whatever their names, are left aside. Texts are read once and whole.

    A group holding most rows is cut into ranges and buckets like any other; equal rows are
    spread by their place. Nothing but one largest size per round reaches the driver.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    grp = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    named = [c.alias(f"c{i}") for i, c in enumerate(carry)]
    leaves = settle(rows.select(grp.alias("grp"), F.col(f"`{order}`").alias("key"), leaf([F.col(f"`{c}`") for c in columns]).alias("node"), *named, F.monotonically_increasing_id().alias("at")), "leaves")
    placed = numbered(sorted_ranges(leaves, ["grp", "key", "node", "at"], RANGE, "placed"), "grp")
    own = ["key", *[f"c{i}" for i in range(len(carry))]]

    def over_groups(nodes: DataFrame) -> DataFrame:
        subroots = settle(nodes.select("grp", "node"), "subroots")
        level = numbered(sorted_ranges(subroots, ["grp"], RANGE, "groups").withColumn("all", F.lit("")), "all")
        upper = climb(level.select(F.col("all").alias("grp"), "pos", "n", "node"), fanout, crown).select("pos", "proof", "root")
        return level.join(upper, "pos").select("grp", F.lit(0).cast("long").alias("pos"), "node", "proof", F.col("node").alias("top"), "root")

    whole = placed.select("grp", "pos", *own).join(climb(placed.select("grp", "pos", "n", "node"), fanout, over_groups), ["grp", "pos"])
    names = rows.select(*carry).columns if carry else []
    return whole.select(
        F.col("key").alias(order), *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("node").alias("leaf"), "pos",
        "proof", F.col("top").alias("subroot"), "root",
    )


def verify(found: DataFrame, now: Column) -> DataFrame:
    """``found`` with folded_root, from the leaf as it is now, and verified; a null leaf isn't verified."""
    folded = fold(now, F.col("proof"))
    return found.withColumn("folded_root", folded).withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))
