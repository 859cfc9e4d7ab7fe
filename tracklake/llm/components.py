"""Connected components of an edge table, by the least neighbouring label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (any type that orders). Gives node and label, the least node of its component, for nodes with an edge.

    Each round takes, for every node, the least label among its neighbours', and then the label of
    that label; stars settle in two rounds and chains in the logarithm of their length. Labels are
    written to the shared folder after each round, so a lost executor repeats one round at most.
    """
    both = written(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        labels = written(least.join(jump, "least", "left").select("node", "old", F.least("least", "far").alias("label")), "labels", [labels])
        if not labels.filter(F.col("old") != F.col("label")).limit(1).count():
            discard(both)
            return labels.select("node", "label")
