"""Connected components over an edge table, with the labels kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.runtime import staged

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(v, c): every vertex of the edges (a, b) with the least vertex of its component.

    Each round takes the least label among a vertex and its neighbours, then follows the label's own label, so
    long chains halve. Labels and edges stay distributed; a round's result is a written table. The neighbours'
    labels are combined before they are shuffled, so a vertex with very many edges is no single task's work.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    both = staged(both.where(F.col("v") != F.col("w")).distinct(), "edges")
    labels = staged(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("c")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("v").alias("w"), "c"), "w").groupBy("v").agg(F.min("c").alias("n"))
        hop = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        stepped = labels.join(near, "v").join(hop, "c", "left").select("v", F.col("c").alias("old"), F.least("c", "n", F.coalesce("up", "c")).alias("c"))
        stepped = staged(stepped, "labels")
        labels = stepped.select("v", "c")
        if stepped.where(F.col("old") != F.col("c")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
