"""Connected components by least labels, for edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """v, label: each vertex of edges (a, b) and the least vertex of its component.

    Each round takes the least label of a vertex's neighbours, then the label of that label.  What is known by
    vertex is combined before it is shuffled; edges and labels are tables, so that Spark can split the edges of a
    vertex with very many when it joins them.  Labels are written to the shared folder after each round; those of
    the round before go.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.select("v", "label").join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        new = materialise(step.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        discard(labels)
        labels = new
        if new.where("label < old").isEmpty():
            discard(both)
            return new.select("v", "label")
