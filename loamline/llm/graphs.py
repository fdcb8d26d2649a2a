"""Connected components of an edge table, in rounds that Spark shuffles and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.session import scratch_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: computed once, and no task's loss recomputes it."""
    spark: SparkSession = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each node reaches, for all nodes that have an edge.

    Every round takes the smallest label around a node (a minimum per node, combined before the
    shuffle) and then follows the label's own label, which halves the distance that is left. A node
    with very many edges is one row on the label side, so a join can split its edges.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(
        edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    around = written(both.distinct(), "edges")
    labels = written(around.groupBy("u").agg(F.min("v").alias("m"))
                     .select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    while True:
        offered = (around.join(labels, around["v"] == labels["node"])
                   .groupBy(F.col("u").alias("node")).agg(F.min("component").alias("offer")))
        lower = labels.join(offered, "node").select(
            "node", F.least("component", "offer").alias("component"), F.col("component").alias("old"))
        of_label = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        root = F.coalesce("root", "component")
        jumped = written(lower.join(of_label, "component", "left").select(
            "node", root.alias("component"), (root != F.col("old")).alias("changed")), "labels")
        labels = jumped.select("node", "component")
        if jumped.filter("changed").isEmpty():
            return labels
