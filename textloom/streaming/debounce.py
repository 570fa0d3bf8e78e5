"""Debouncing a stream of changes, and merging changes into a relation by buckets.

Changes of a root gather until it has been quiet for a while and some time has passed
since the last write; then they are one write. Time is the events' own, so the writes do not depend on
how the stream falls into batches: an event waits in the state until the watermark has passed it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textloom.operators.catalog import report
from textloom.session import cut, discard, shared_dir
from textloom.streaming.upkeep import _SNAP, delta, merge, snapshots

#: Quiet before a write and least time between two writes, in milliseconds (fixed values).
QUIET_MS = 700
INTERVAL_MS = 1000
WRITES = "root string, nth bigint, written_ms bigint, events bigint, paths array<string>"
WROTE = ["root", "nth", "written_ms", "events", "paths"]

#: Groups that roots share their state in, if not said otherwise.
GROUPS = 128
#: Most events of one entry of the state, and writes of one frame.
ENTRY = 10_000


class Debounce(StatefulProcessor):
    """State of a group of roots: events the watermark has not passed, the paths of open bursts, and each root's times.

    Each call of the state is a round trip to the JVM, however little it moves: so roots share entries, what
    arrives is only put down, and nothing is read before the first time at which something may fall due.
    """

    def __init__(self, quiet_ms: int, interval_ms: int):
        self.quiet, self.interval = quiet_ms, interval_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "root array<string>, ms array<bigint>, path array<string>")
        self.paths = handle.getValueState("paths", "root array<string>, path array<string>, n array<bigint>")
        # last: of the open burst, -1 if there is none; wrote: -1 before the first write
        self.times = handle.getValueState("times", "root array<string>, last array<bigint>, wrote array<bigint>, nth array<bigint>")

    def _due(self, last: int, wrote: int) -> int:
        return last + self.quiet if wrote < 0 else max(last + self.quiet, wrote + self.interval)

    def _timers(self) -> list[int]:
        return [timer[0] if isinstance(timer, tuple) else timer for timer in self.handle.listTimers()]

    def _advance(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Take in the events up to the watermark, in order, and write what falls due."""
        ready, later = {}, []
        for entry in self.waiting.get():
            for root, ms, path in zip(*entry, strict=True):
                if ms <= watermark:
                    ready.setdefault(root, []).append((ms, path))
                else:
                    later.append((root, ms, path))
        times = {root: of for root, *of in zip(*self.times.get(), strict=True)} if self.times.exists() else {}
        bursts = {}
        for root, path, n in zip(*self.paths.get(), strict=True) if self.paths.exists() else ():
            bursts.setdefault(root, {})[path] = n
        wake = min((ms for _, ms, _ in later), default=None)
        out = []
        for root in [*times, *(root for root in ready if root not in times)]:
            last, wrote, nth = times.get(root, (-1, -1, 0))
            burst = bursts.get(root, {})
            due = self._due(last, wrote)
            for ms, path in sorted(ready.get(root, ()), key=itemgetter(0)):
                if last >= 0 and ms >= due:
                    out.append((root, nth, due, sum(burst.values()), sorted(burst)))
                    wrote, nth, burst = due, nth + 1, {}
                burst[path] = burst.get(path, 0) + 1
                last, due = ms, self._due(ms, wrote)
            if last >= 0 and due <= watermark:
                out.append((root, nth, due, sum(burst.values()), sorted(burst)))
                last, wrote, nth, burst = -1, due, nth + 1, {}
            elif last >= 0:
                wake = due if wake is None else min(wake, due)
            times[root], bursts[root] = (last, wrote, nth), burst
            if len(out) >= ENTRY:
                yield pd.DataFrame(out, columns=WROTE)
                out = []
        self.waiting.clear()
        if later:
            self.waiting.put([tuple(map(list, zip(*later[k : k + ENTRY], strict=True))) for k in range(0, len(later), ENTRY)])
        self.times.update(([*times], *map(list, zip(*times.values(), strict=True))))
        opened = [(root, path, n) for root, burst in bursts.items() for path, n in burst.items()]
        self.paths.update(tuple(map(list, zip(*opened, strict=True))) or ([], [], []))
        for timer in self._timers():
            self.handle.deleteTimer(timer)
        if wake is not None:
            self.handle.registerTimer(max(wake, watermark + 1))
        if out:
            yield pd.DataFrame(out, columns=WROTE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        firsts = []
        for part in rows:
            entry = tuple(part[name].tolist() for name in ("root", "ms", "path"))
            self.waiting.appendValue(entry)
            firsts.append(min(entry[1]))
        first = min(firsts)
        watermark = timerValues.getCurrentWatermarkInMs()
        if first <= watermark:
            yield from self._advance(watermark)
            return
        timers = self._timers()
        for timer in timers:
            if timer > first:
                self.handle.deleteTimer(timer)
        if not any(timer <= first for timer in timers):
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, delay: str = "0 seconds", quiet_ms: int = QUIET_MS, interval_ms: int = INTERVAL_MS, groups: int = GROUPS) -> DataFrame:
    """root, nth, written_ms, events, paths: the writes of a stream of changes (root, path, ts).

    A write falls due ``quiet_ms`` after the last change of its burst, and ``interval_ms`` after the write
    before; a change at that time or later begins the next burst. Paths are named once.
    The state of a root is its open burst and what ``delay`` lets wait. Roots share their state in ``groups`` by a
    hash: a task holds one group at a time, and a checkpoint keeps to its number. Needs the RocksDB state store.
    """
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select(bucket_of("root", groups).alias("bucket"), "root", "path", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("bucket").transformWithStateInPandas(Debounce(quiet_ms, interval_ms), outputStructType=WRITES, outputMode="append", timeMode="EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession, run: Callable[[], None]) -> None:
    """``run`` with RocksDB as the state store, which state with timers needs; the setting is put back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        run()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_QUIET, _INTERVAL = 2 * 3_600_000, 12 * 3_600_000
#: Events of a group of users, about.
EVENTS_OF_A_GROUP = 25_000


@report("", f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS root, event_type AS path, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_type) AS k FROM events),
s AS (SELECT root, k, ms AS last, NULL::BIGINT AS wrote, 0::BIGINT AS nth FROM e WHERE k = 1 UNION ALL
  SELECT root, k, last, wrote, nth FROM (SELECT e.root, e.k, e.ms AS last, greatest(s.last + {_QUIET}, coalesce(s.wrote + {_INTERVAL}, 0)) AS due,
    CASE WHEN e.ms >= greatest(s.last + {_QUIET}, coalesce(s.wrote + {_INTERVAL}, 0)) THEN greatest(s.last + {_QUIET}, coalesce(s.wrote + {_INTERVAL}, 0)) ELSE s.wrote END AS wrote,
    CASE WHEN e.ms >= greatest(s.last + {_QUIET}, coalesce(s.wrote + {_INTERVAL}, 0)) THEN s.nth + 1 ELSE s.nth END AS nth FROM s JOIN e ON e.root = s.root AND e.k = s.k + 1))
SELECT root, nth, greatest(max(last) + {_QUIET}, coalesce(max(wrote) + {_INTERVAL}, 0)) AS written_ms, count(*) AS events, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths
FROM s JOIN e USING (root, k) GROUP BY root, nth HAVING written_ms <= (SELECT max((epoch_us(ts) // 1000)) - 600000 FROM events)""")
def events_debounced(rel):
    """Each user's events as bursts: two hours of quiet, twelve hours between writes; all that the watermark has passed."""
    spark, out = rel.spark, f"{shared_dir(rel.spark)}/textloom/stream-{uuid.uuid4().hex}"
    batch = rel.read("events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{rel.sf_dir}/events.parquet*")
    changes = stream.select(F.col("user_id").cast("string").alias("root"), F.col("event_type").alias("path"), "ts")
    rows = debounced(changes, "10 minutes", _QUIET, _INTERVAL, max(GROUPS, batch.count() // EVENTS_OF_A_GROUP)).withColumn("paths", F.array_join("paths", ","))
    sink = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True)
    with_rocksdb(spark, lambda: sink.start().awaitTermination())
    return spark.read.schema("root string, nth bigint, written_ms bigint, events bigint, paths string").parquet(f"{out}/rows")


# merging by buckets

BUCKETS = 64


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(buckets)).cast("int")


def save_buckets(rows: DataFrame, path: str, key: str = "path", buckets: int = BUCKETS) -> None:
    """Write a relation in ``buckets`` folders by a hash of its key."""
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def merge_buckets(spark: SparkSession, path: str, touched: DataFrame, rescanned: DataFrame, key: str = "path", buckets: int = BUCKETS) -> list[int]:
    """Put ``rescanned`` in place of the rows of ``touched`` keys, rewriting only the buckets these fall into; says which.

    What a bucket will hold is written aside first, so a failure leaves the relation as it
    was or a bucket to be written again, and doing the same merge twice changes nothing.
    """
    marked = touched.select(key).distinct().withColumn("bucket", bucket_of(key, buckets))
    hit = sorted(r["bucket"] for r in marked.select("bucket").distinct().collect())  # ``buckets`` numbers at most
    if not hit:
        return hit
    known = spark.read.parquet(path).filter(F.col("bucket").isin(hit))
    fresh = rescanned.withColumn("bucket", bucket_of(key, buckets)).filter(F.col("bucket").isin(hit))
    new = cut(merge(known, marked, fresh.select(*known.columns), key))
    left = {r["bucket"] for r in new.select("bucket").distinct().collect()}
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for gone in (b for b in hit if b not in left):  # no row to overwrite it with
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={gone}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    discard(new)
    return hit


def upkeep_buckets(spark: SparkSession, changes: DataFrame, path: str, rescan, checkpoint: str, key: str = "path", buckets: int = BUCKETS) -> None:
    """Merge a stream of touched keys into the relation that ``save_buckets`` wrote, batch by batch."""

    def each(batch: DataFrame, number: int) -> None:
        touched = cut(batch.select(key).distinct())
        merge_buckets(spark, path, touched, rescan(touched), key, buckets)
        discard(touched)

    changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@report("files", f"WITH {_SNAP} SELECT path, hash FROM new")
def bucketed_merge(rel):
    """The previous snapshot in buckets, brought up to date from its delta: only buckets of touched paths are rewritten."""
    before, after = snapshots(rel)
    changes = delta(before, after)
    at = f"{shared_dir(rel.spark)}/textloom/buckets-{uuid.uuid4().hex}"
    save_buckets(before, at)
    merge_buckets(rel.spark, at, changes, after.join(changes, "path", "left_semi"))
    return rel.spark.read.parquet(at).select("path", "hash")
