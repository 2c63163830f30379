"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.scratch import scope, stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; the root is the smallest node reachable.

    Every round a node takes the smallest label among its own, its neighbours' and its label's
    label, so long chains shorten by half. Labels go to a written table each round, which cuts
    the lineage. Minima are taken before the shuffle, so a node may have any number of links.
    """
    with scope() as own:
        return own.keep(_labelled(links)).select("node", "root")


def _labelled(links: DataFrame) -> DataFrame:
    both = stored(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("root")
        )
    )
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(
            F.col("a").alias("node"), "root"
        )
        jump = labels.select("node", F.col("root").alias("via")).join(
            labels.select(F.col("node").alias("via"), "root"), "via"
        ).select("node", "root")
        old = labels.select("node", "root", F.col("root").alias("before"))
        new = (
            near.union(jump)
            .withColumn("before", F.lit(None).cast(labels.schema["root"].dataType))
            .unionByName(old)
            .groupBy("node")
            .agg(F.min("root").alias("root"), F.max("before").alias("before"))
        )
        new = stored(new)
        if new.filter("root <> before").isEmpty():
            return new
        labels = new.select("node", "root")
