"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node reachable.

    Each round maps every node to the first of itself and its neighbours in the
    round's order, rewrites links and labels by that map and drops links that
    have become loops, until none is left. Two rounds in the order of ids settle
    stars; the others use a random order of their own, which leaves a constant
    share of the nodes in expectation, so rounds grow with the logarithm of the
    nodes. The last node of a round's order never stays, so the rounds end.
    Every aggregation combines before its shuffle; a hub is one row on the small
    side of a join. Links are never collected.
    """
    edges = scratch.put(links.select("a", "b").filter("a <> b").distinct(), f"{name}_edges0")
    labels = None
    for turn in count(1):
        order = (lambda c: F.col(c)) if turn <= 2 else (lambda c: F.xxhash64(F.lit(turn), c))
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        near = ends.groupBy("node").agg(F.min_by("near", order("near")).alias("near"))
        low = scratch.put(near.select("node", F.when(order("near") < order("node"), F.col("near")).otherwise(F.col("node")).alias("low")), f"{name}_low{turn}")
        if labels is None:
            labels = low.select("node", F.col("low").alias("label"))
        else:
            up = low.select(F.col("node").alias("label"), F.col("low").alias("up"))
            labels = labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = scratch.put(labels, f"{name}_labels{turn}")
        moved = edges.join(low.select(F.col("node").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("node").alias("b"), F.col("low").alias("y")), "b")
        moved = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()
        edges = scratch.put(moved, f"{name}_edges{turn}")
        scratch.drop(f"{name}_edges{turn - 1}", f"{name}_low{turn}", f"{name}_labels{turn - 1}")
        if edges.isEmpty():
            scratch.drop(f"{name}_edges{turn}")
            break
    if turn <= 2:  # labels in the order of ids are the smallest already
        return labels
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    out = scratch.put(labels.join(least, "label").select("node", F.col("least").alias("label")), f"{name}_labels")
    scratch.drop(f"{name}_labels{turn}")
    return out
