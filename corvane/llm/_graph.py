"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _common as C


SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (a, b): the smallest id that is reachable.

    Each round takes the least label of a node and its neighbours, then the label's
    own label (pointer jumping), so rounds grow with the logarithm of the longest
    path.  It ends when no label changes.  Labels are written to the shared folder
    each round, and edges once: the joins have plain tables for sides, so a node
    with very many neighbours is split.  The label of a large component is no hot
    key: each label is looked up once, and handed to its nodes in SALTS portions.
    Both sides of all joins are shuffled, so no label goes through the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    both = C.settle(both.withColumn("salt", salt("a")), "edges")
    labels = C.settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    portions = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    while True:
        # A node with many neighbours: they look its label up in portions, and its own least is summed up in parts.
        own = labels.select(F.col("id").alias("b"), "label", portions)
        near = both.join(C.merged(own), ["b", "salt"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("least"))
        moved = C.settle(labels.join(C.merged(near), "id").select("id", F.col("label").alias("was"), F.least("label", "least").alias("now")), "moved")
        jump = moved.select("now").distinct().join(C.merged(labels.select(F.col("id").alias("now"), F.col("label").alias("further"))), "now").select("now", "further", portions)
        label = F.least("now", "further")
        new = C.settle(moved.withColumn("salt", salt("id")).join(C.merged(jump), ["now", "salt"]).select("id", label.alias("label"), (label != F.col("was")).alias("changed")), "labels")
        C.discard(labels, moved)
        labels = new
        if labels.where("changed").isEmpty():
            C.discard(both)
            return labels.select("id", F.col("label").alias("component"))
