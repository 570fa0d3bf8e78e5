"""Groups of linked names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut, discard


def linked(links: DataFrame) -> DataFrame:
    """(path, group): both ends of ``links`` (a, b) with the least name of all they are linked to, directly or not.

    Each round takes the least label among a name and its neighbours, then the label of
    that label, so a chain of n links takes about log(n) rounds. Only a count leaves Spark.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("path")).agg(F.min("b").alias("b")).select("path", F.least("path", "b").alias("group")))
    while True:
        near = edges.join(labels.select(F.col("path").alias("b"), "group"), "b").groupBy(F.col("a").alias("path")).agg(F.min("group").alias("near"))
        hooked = labels.join(near, "path").select("path", F.col("group").alias("was"), F.least("group", "near").alias("group"))
        up = labels.select(F.col("path").alias("group"), F.col("group").alias("up"))
        new = cut(hooked.join(up, "group").select("path", "was", F.least("group", "up").alias("group")))
        discard(labels)
        labels = new
        if new.filter("group <> was").isEmpty():
            discard(edges)
            return new.select("path", "group")
