"""Connected components as Spark joins: smallest-neighbour labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprism.llm.common import discard, lookup, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Each round takes the least label among a node and its neighbours and then the label of that
    label, so paths shrink at least by half; the loop ends when a round changes nothing. Only a
    count reaches the driver, and only the last round's tables stay. Hubs are harmless: minima by node combine before the shuffle, and
    where many rows ask for one node's label (a hub, or the root of a large component) they find
    it in a broadcast of the few nodes so often asked for.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a)))
    both = materialize(both.where("node <> other").distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    while True:
        near = lookup(both, labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("root", "near").alias("step"), F.col("root").alias("was"))
        stepped = materialize(stepped, "steps")
        jump = labels.select(F.col("node").alias("step"), F.col("root").alias("far"))
        after = materialize(lookup(stepped, jump, "step").select("node", F.least("step", "far").alias("root"), "was"), "labels")
        discard(stepped)
        discard(labels)
        labels = after.select("node", "root")
        if after.where("root <> was").limit(1).count() == 0:
            return labels
