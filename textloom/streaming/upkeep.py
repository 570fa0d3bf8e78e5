"""Keeping relations up to date: snapshot differences, incremental merges, event windows and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.catalog import report
from textloom.session import shared_dir


def snapshots(rel) -> tuple[DataFrame, DataFrame]:
    """(previous, current): of every seven files one was added since, one has changed, and one more was removed."""
    now = rel.files.select("path", "hash", "ord")
    before = now.filter("ord % 7 <> 1").withColumn("hash", F.when(F.col("ord") % 7 == 2, F.lit("old")).otherwise(F.col("hash")))
    return before.drop("ord"), now.filter("ord % 7 <> 3").drop("ord")


_SNAP = """old AS (SELECT path, CASE WHEN ord % 7 = 2 THEN 'old' ELSE hash END AS hash FROM files WHERE ord % 7 <> 1), new AS (SELECT path, hash FROM files WHERE ord % 7 <> 3)"""


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, op): add, mod or del, by a full outer join on the path."""
    a, b = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    op = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "del").when(F.col("old") != F.col("new"), "mod")
    return a.join(b, "path", "full_outer").select("path", op.alias("op")).filter("op IS NOT NULL")


def merge(known: DataFrame, touched: DataFrame, rescanned: DataFrame, key: str) -> DataFrame:
    """``known`` without the rows of touched keys, and with their rescanned rows."""
    return known.join(touched.select(key), key, "left_anti").unionByName(rescanned)


@report("files", f"WITH {_SNAP} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.hash IS NULL THEN 'add' WHEN n.hash IS NULL THEN 'del' ELSE 'mod' END AS op FROM old o FULL JOIN new n USING (path) WHERE o.hash IS DISTINCT FROM n.hash")
def snapshot_delta(rel):
    return delta(*snapshots(rel))


@report("files", f"WITH {_SNAP} SELECT path, hash FROM new")
def incremental_merge(rel):
    """The previous snapshot brought up to date from its delta alone: equal to a full rebuild."""
    before, after = snapshots(rel)
    changes = delta(before, after)
    return merge(before, changes, after.join(changes, "path", "left_semi"), "path")


@report("files", f"WITH {_SNAP}, d AS (SELECT CASE WHEN o.hash IS NULL THEN 'add' WHEN n.hash IS NULL THEN 'del' ELSE 'mod' END AS op FROM old o FULL JOIN new n USING (path) WHERE o.hash IS DISTINCT FROM n.hash) SELECT op, count(*) AS n FROM d GROUP BY op")
def delta_counts(rel):
    return delta(*snapshots(rel)).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@report("", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def events_tumbling(rel):
    hour = F.window("ts", "1 hour")["start"]
    return rel.read("events").groupBy(hour.alias("started"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@report("", """WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gaps) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(rel):
    """Bursts of events with less than 30 minutes of quiet inside."""
    session = F.session_window("ts", "30 minutes")
    return rel.read("events").groupBy("user_id", session.alias("w")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n")).drop("w")


def stream_counts(spark: SparkSession, sf_dir: str, out: str) -> None:
    """Hourly counts as a stream over the events: watermark, append, exactly once by checkpoint."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    counts = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select(F.col("window.start").alias("started"), "event_type", "n")
    query = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


@report("", """SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL)
  WHERE started + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def events_stream(rel):
    """What the stream has finished: all hours but those the watermark still holds open."""
    out = f"{shared_dir(rel.spark)}/textloom/stream-{uuid.uuid4().hex}"
    stream_counts(rel.spark, rel.sf_dir, out)
    rows = rel.spark.read.schema("started timestamp, event_type string, n bigint").parquet(f"{out}/rows")
    return rows.withColumn("started", F.col("started").cast("timestamp_ntz"))


def upkeep_stream(spark: SparkSession, changes: DataFrame, known_path: str, rescan) -> None:
    """Merge a stream of touched paths into the relation at ``known_path``, batch by batch.

    Every batch writes the next generation beside the last, so a batch that is run
    again after a failure starts from the same rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        known = spark.read.parquet(f"{known_path}/{number}")
        touched = batch.select("path").distinct()
        merge(known, touched, rescan(touched), "path").write.mode("overwrite").parquet(f"{known_path}/{number + 1}")

    changes.writeStream.foreachBatch(each).option("checkpointLocation", f"{known_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
