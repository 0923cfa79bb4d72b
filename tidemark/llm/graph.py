"""Connected components of an edge list, without a driver-side structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (u, v).

    Labels start as the least neighbour; each round takes the least label around a node and then its
    label's label, until none changes: a logarithmic number of rounds on stars and chains of stars.
    Each round's labels are written to the shared folder. Sums are combined before shuffles, and a
    node with very many neighbours is a hot key of joins between written tables, which AQE splits.
    """
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sym = materialize(spark, both.where("u <> v").distinct(), "edges")
    labels = materialize(
        spark,
        sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")),
        "labels",
    )
    while True:
        around = sym.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("m"))
        stepped = labels.join(around, F.col("node") == F.col("u"), "left").select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("new")
        )
        stepped = materialize(spark, stepped, "labels")
        to = stepped.select(F.col("node").alias("at"), F.col("new").alias("component"))
        labels = materialize(
            spark,
            stepped.join(to, F.col("new") == F.col("at")).select(
                "node", "component", (F.col("component") != F.col("old")).alias("changed")
            ),
            "labels",
        )
        if labels.where("changed").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
