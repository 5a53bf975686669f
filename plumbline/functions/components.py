"""Connected components in a number of rounds that grows with the logarithm of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import drop_folder, fresh_folder


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph of (u, v).

    Every node holds a label. A round takes the smallest label of a label among
    the neighbours and gives it to the node and to the node's old label, so whole
    trees hang themselves under a smaller root, and then follows labels one step.
    Minima are combined before the shuffle; a round's table replaces the last one.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("u").alias("near"))).distinct()
    kept = fresh_folder(spark, "edges")
    both.write.parquet(kept)
    both = spark.read.schema(both.schema).parquet(kept)
    labels = both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("component"))
    old, rounds = None, 0
    while True:
        folder = fresh_folder(spark, "labels")
        labels.write.parquet(folder)
        step = spark.read.schema(labels.schema).parquet(folder)
        if old:
            drop_folder(spark, old)
            if step.filter("was IS NULL OR component <> was").isEmpty():
                break
        old, rounds = folder, rounds + 1
        labels = step.select("node", "component")
        parents = labels.select(F.col("node").alias("component"), F.col("component").alias("grand"))
        pulled = labels.join(parents, "component")
        lows = both.join(pulled.select(F.col("node").alias("near"), "grand"), "near").groupBy("node").agg(F.min("grand").alias("low"))
        seen = pulled.join(lows, "node")
        own = seen.select("node", F.least("component", "grand", "low").alias("c"), F.col("component").alias("was"))
        hooked = seen.groupBy(F.col("component").alias("node")).agg(F.min("low").alias("c")).withColumn("was", F.lit(None).cast(own.schema["was"].dataType))
        labels = own.unionByName(hooked).groupBy("node").agg(F.min("c").alias("component"), F.max("was").alias("was"))
    connected_components.rounds = rounds
    return step.select("node", "component")
