"""Connected components by smallest label, with pointer jumping; labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylode.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of edges(a, b); label: the smallest node reachable.

    A round takes the least label of each node's neighbours, then that label's own label.  The first is
    summed before the shuffle, the joins on a hub's key are ones that adaptive execution splits.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        step = scratch.write(lower)
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = scratch.write(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), drop=[labels])
        scratch.drop(step)
        changed = new.filter("old <> label").limit(1).count()
        labels = new.select("node", "label")
        labels._scratch_path = new._scratch_path
        if not changed:
            scratch.drop(both)
            return labels
