"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge: ``node``, ``root``.

    ``edges`` has long columns ``a`` and ``b``; direction and repeats don't matter, and an
    edgeless table gives an empty result. Every round takes the least label among the
    neighbours (a partial aggregate before the shuffle, so a hub costs no more than its
    rows) and then follows the label's own label; labels are written to the shared folder.
    """
    both = settle(edges.where("a is not null and b is not null and a <> b").select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    while True:  # labels only fall, so this ends
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        parent = labels.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        moved = settle(low.join(parent, "low", "left").select("node", F.least("low", "jump").alias("root"), (F.least("low", "jump") != F.col("root")).alias("moved")), "labels")
        labels = moved.select("node", "root")
        if not moved.where("moved").limit(1).count():
            return labels
