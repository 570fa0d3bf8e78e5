"""Debounced writes against a plain fold, however the stream falls into batches; merges by bucket."""

import random

from pyspark.sql import functions as F

from textloom.streaming import debounce as D


def folded(events, quiet, interval, watermark):
    out, last, wrote, nth, burst = [], None, None, 0, {}
    due = lambda: last + quiet if wrote is None else max(last + quiet, wrote + interval)
    for ms, path in [*sorted(e for e in events if e[0] <= watermark), (None, None)]:
        if last is not None and (due() <= watermark if ms is None else ms >= due()):
            out.append((nth, due(), sum(burst.values()), tuple(sorted(burst))))
            wrote, nth, burst, last = due(), nth + 1, {}, None
        if ms is not None:
            burst[path], last = burst.get(path, 0) + 1, ms
    return out


def run(spark, folder, out, **how):
    stream = spark.readStream.schema("root string, path string, ms bigint").option("maxFilesPerTrigger", 1).parquet(folder)
    changes = stream.select("root", "path", F.timestamp_millis("ms").alias("ts"))
    sink = D.debounced(changes, "2 seconds", **how).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    D.with_rocksdb(spark, lambda: sink.start().awaitTermination())
    got = {}
    for r in spark.read.parquet(f"{out}/rows").collect():
        got.setdefault(r.root, []).append((r.nth, r.written_ms, r.events, tuple(r.paths)))
    return {k: sorted(v) for k, v in got.items()}


def test_bursts_are_one_write_each(spark, tmp_path):
    rng = random.Random(3)
    start, events = 1_700_000_000_000, {"a": [], "b": []}
    for root, found in events.items():
        ms = start
        for _ in range(60):
            ms += rng.choice([50, 100, 300, 699, 700, 800, 2500])
            found.append((ms, f"f{rng.randrange(5)}"))
    everything = sorted((ms, root, path) for root, found in events.items() for ms, path in found)
    top = everything[-1][0]
    folder = str(tmp_path / "in")

    def add(rows):
        spark.createDataFrame([(root, path, ms) for ms, root, path in rows], "root string, path string, ms bigint").coalesce(1).write.mode("append").parquet(folder)

    # three files, each with its rows out of order; then a restart from the checkpoint with a fourth
    for k in range(3):
        part = everything[k * 30 : (k + 1) * 30]
        rng.shuffle(part)
        add(part)
    first = run(spark, folder, str(tmp_path / "out"))
    passed = everything[89][0] - 2000
    assert first == {root: folded([e for e in found if e[0] <= everything[89][0]], D.QUIET_MS, D.INTERVAL_MS, passed) for root, found in events.items()}
    add(everything[90:])
    second = run(spark, folder, str(tmp_path / "out"))
    assert second == {root: folded(found, D.QUIET_MS, D.INTERVAL_MS, top - 2000) for root, found in events.items()}
    assert sum(len(v) for v in second.values()) < 60


def test_roots_share_their_state(spark, tmp_path):
    rng = random.Random(5)
    start, events = 1_700_000_000_000, {}
    for k in range(600):
        ms, events[f"r{k}"] = start + rng.randrange(5000), []
        for _ in range(8):
            events[f"r{k}"].append((ms, f"f{rng.randrange(3)}"))
            ms += rng.choice([0, 300, 699, 700, 2500, 6000])
    everything = sorted((ms, root, path) for root, found in events.items() for ms, path in found)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(0, len(everything), 1600):
        part = everything[k : k + 1600]
        rng.shuffle(part)
        spark.createDataFrame([(root, path, ms) for ms, root, path in part], "root string, path string, ms bigint").coalesce(1).write.mode("append").parquet(folder)
    want = {root: folded(found, D.QUIET_MS, D.INTERVAL_MS, everything[-1][0] - 2000) for root, found in events.items()}
    assert run(spark, folder, out) == {root: writes for root, writes in want.items() if writes}
    # each key of the state costs calls of its own, so there are no more keys than groups
    state = spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", "times").load()
    assert state.count() <= 128


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    at = str(tmp_path / "relation")
    rows = spark.range(500).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("old").alias("hash"))
    D.save_buckets(rows, at, buckets=32)
    times = lambda: {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "relation").glob("bucket=*/*.parquet")}
    before = times()
    touched = spark.createDataFrame([("p1",), ("p2",), ("p600",)], "path string")
    fresh = spark.createDataFrame([("p1", "new"), ("p600", "new")], "path string, hash string")
    hit = D.merge_buckets(spark, at, touched, fresh, buckets=32)
    assert 1 <= len(hit) <= 3 and {k for k, t in times().items() if before.get(k) != t} <= {f"bucket={b}" for b in hit}
    got = {r.path: r.hash for r in spark.read.parquet(at).collect()}
    assert got == {**{f"p{i}": "old" for i in range(500) if i != 2}, "p1": "new", "p600": "new"}
    assert D.merge_buckets(spark, at, touched, fresh, buckets=32) == hit and {r.path: r.hash for r in spark.read.parquet(at).collect()} == got
    assert D.merge_buckets(spark, at, touched.limit(0), fresh, buckets=32) == []
    # a bucket that loses its last row
    lone = str(tmp_path / "lone")
    D.save_buckets(rows.limit(1), lone, buckets=4)
    D.merge_buckets(spark, lone, rows.limit(1), fresh.limit(0), buckets=4)
    assert spark.read.schema("path string, hash string").parquet(lone).count() == 0


def test_a_stream_of_touched_paths(spark, tmp_path):
    at, source = str(tmp_path / "relation"), str(tmp_path / "changes")
    D.save_buckets(spark.createDataFrame([(f"p{i}", "old") for i in range(40)], "path string, hash string"), at)
    for k in range(3):
        spark.createDataFrame([(f"p{k}",), (f"p{k + 1}",)], "path string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("path string").option("maxFilesPerTrigger", 1).parquet(source)
    D.upkeep_buckets(spark, stream, at, lambda touched: touched.withColumn("hash", F.lit("new")), str(tmp_path / "checkpoint"))
    got = {r.path: r.hash for r in spark.read.parquet(at).collect()}
    assert got == {f"p{i}": "new" if i < 4 else "old" for i in range(40)}
