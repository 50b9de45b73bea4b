"""Connected components of a graph given by its edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """edges: a, b (long). Returns node, label: the smallest node reachable.

    Each round gives every node the smallest label around it and then follows labels
    once (pointer jumping), so the rounds grow with the logarithm of the longest
    path. A node with very many edges is dealt out before sums: minima are taken
    map-side, and Spark splits the one-row-per-key join.
    """
    both = scratch.keep(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(limit):
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("above"))
        new = scratch.keep(
            lower.join(up, "low").select("node", F.least("low", "above").alias("label"), (F.least("low", "above") < F.col("label")).alias("moved")), "labels"
        )
        old, labels = labels, new.select("node", "label")
        changed = new.filter("moved").limit(1).count()
        scratch.drop(old)
        if not changed:
            break
    else:
        raise RuntimeError("labels did not settle")
    scratch.drop(both)
    return labels
