"""Connected components of links between long ids, as rounds of joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links (a, b) -> (node, label): label is the smallest node reachable, for every linked node.

    Each round takes the smallest label among a node's neighbours (a partial minimum before the
    shuffle), hooks that onto the node's label, and then halves the label paths. Rounds
    write their labels to the shared folder; they grow with the logarithm of path lengths in
    practice, and the loop ends only when no label changes. A hub's many links meet single
    rows, so those joins can be split.
    """
    pairs = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    edges = scratch.save(pairs, f"{name}-edges")
    # the smallest neighbour is already in reach, so this first round needs no join
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        seen = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("far")), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        offers = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "far").alias("label"))
        # a node's old label learns of the smaller one too
        hooked = offers.filter("label < old").groupBy(F.col("old").alias("node")).agg(F.min("label").alias("hook"))
        lowered = scratch.save(offers.join(hooked, "node", "left").select("node", "old", F.least("label", F.coalesce("hook", "label")).alias("label")), f"{name}-{turn}a")
        up = lowered.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = scratch.save(lowered.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), f"{name}-{turn}")
        done = jumped.filter("label <> old").isEmpty()
        scratch.drop(f"{name}-{turn}a")
        labels = jumped.select("node", "label")
        if done:
            scratch.drop(f"{name}-edges")
            return labels
