"""Connected components of an edge table by minimum labels with pointer jumping, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, label): every node that has an edge, with the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so
    chains shorten by half; a round's labels are written to the shared folder. Ends when no label changes.
    """
    both = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v")
            .groupBy("u")
            .agg(F.min("label").alias("m"))
        )
        stepped = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("far"))
        done = staged(
            stepped.join(jump, stepped.label == jump.j, "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")),
            "labels",
        )
        labels = done.select("node", "label")
        if not done.where("old <> label").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
