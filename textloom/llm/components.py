"""Connected components of a graph of links, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut, discard


def components(links: DataFrame) -> DataFrame:
    """v and c (and more): each end of ``links`` (a, b: bigint) with the least id of its component.

    Every round takes the least label among a vertex and its neighbours, then the
    label of that label, so rounds grow with the logarithm of a path's length. Each
    round is written to the shared folder; only a count reaches the driver.
    """
    pairs = links.filter("a <> b")
    edges = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("v"), F.least("a", "c").alias("c")))
    while True:
        theirs = edges.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("theirs"))
        hooked = labels.select("v", "c").join(theirs.withColumnRenamed("a", "v"), "v").select(
            "v", F.col("c").alias("was"), F.least("c", "theirs").alias("c")
        )
        of_label = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        new = cut(hooked.join(of_label, "c", "left").select("v", "was", F.least("c", F.coalesce("up", "c")).alias("c")))
        discard(labels)
        labels = new
        if new.filter("c <> was").isEmpty():
            discard(edges)
            return new
