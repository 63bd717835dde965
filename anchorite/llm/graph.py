"""Connected components of an undirected graph, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for each end of the edges (a, b): c is the smallest vertex of v's component.

    Each round takes the least label of the neighbours and then the label's own
    label, so chains shorten by half; rounds end when no label changes. Labels
    are written to the shared folder after each round. An empty graph gives no rows.
    """
    both = frames.stored(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("v", "u"), "edges")
    last = frames.stored(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
    while True:
        labels = last.select("v", "c")
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("c").alias("m"))
        least = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        after = frames.stored(least.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("cc", "c")).alias("c")), "labels")
        frames.release(last)
        last = after
        if after.where("old <> c").limit(1).count() == 0:
            frames.release(both)
            return after.select("v", "c")
