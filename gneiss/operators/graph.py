"""Connected components over an edge DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.sources.storage import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    Each round takes the smallest label among a node and its neighbours and
    then follows that label's own label (pointer jumping), so a path of length
    n settles in about log2(n) rounds. Labels are written to the shared folder
    after each round; only a count of changed labels reaches the driver.

    Null ends, self loops and repeated edges are ignored. An empty edge table
    gives an empty result. Returns ``node``, ``component``.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        least = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        step = materialize(
            least.join(jump, "low", "left").select(
                "node", F.least("low", F.coalesce("far", "low")).alias("component"), (F.least("low", F.coalesce("far", "low")) < F.col("component")).alias("moved")
            ),
            "labels",
        )
        labels = step.select("node", "component")
        if not step.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
