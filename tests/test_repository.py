"""The repository source: ignored folders are not entered, filters reach the listing, a stream follows changes."""

import os

from pyspark.sql import functions as F

from textloom.sources.repository import Listing, register

FILES = {"a.rs": "fn a() {}\n", "src/b.ts": "let b;\n", "src/deep/c.ts": "let c;\n", "src/empty.md": "", "build.rs": "fn b() {}\n", "src/x.log": "passing\n", ".github/w.yml": "on: push\n"}


def write(root, files, ns=None):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
        if ns:
            os.utime(root / name, ns=(ns, ns))


def repository(tmp_path):
    root = tmp_path / "target" / "build"  # names that are ignored below the root only
    write(root, FILES)
    for name in ("node_modules/x", "src/target"):
        (root / name).mkdir(parents=True)
        os.mkfifo(root / name / "pipe.ts")  # opening it would never end
    (root / "logo.png").write_bytes(b"\x89PNG\xff\xfe")
    return root


def test_a_batch_reads_what_is_not_ignored(spark, tmp_path):
    root = repository(tmp_path)
    register(spark)
    rows = spark.read.format("repository").load(str(root))
    got = {r.path: r.text for r in rows.collect()}
    assert got == {k: v for k, v in FILES.items() if not k.endswith(".log")}
    small = spark.read.format("repository").option("ignored", "src,node_modules").option("maxFileSize", 9).load(f"file://{root}/")
    assert {r.path for r in small.collect()} == {".github/w.yml"}
    assert rows.agg(F.sum("size")).first()[0] == sum(len(t.encode()) for t in got.values())


def test_filters_reach_the_listing(spark, tmp_path):
    root = repository(tmp_path)
    register(spark)
    rows = spark.read.format("repository").load(str(root))
    assert [r.path for r in rows.filter("path = 'src/b.ts'").collect()] == ["src/b.ts"]
    assert {r.path for r in rows.filter(F.col("path").startswith("src/") & (F.col("size") < 8)).collect()} == {"src/b.ts", "src/deep/c.ts", "src/empty.md"}
    assert {r.path for r in rows.filter(F.col("path").isin("a.rs", "src/b.ts", "gone")).collect()} == {"a.rs", "src/b.ts"}
    listing, entered = Listing({"path": str(root)}), []
    listing.prefix = "src/deep/"
    scan = os.scandir
    os.scandir = lambda at: (entered.append(os.path.relpath(at, root)), scan(at))[1]
    try:
        assert [f.path for f in listing.files()] == ["src/deep/c.ts"]
    finally:
        os.scandir = scan
    assert sorted(entered) == [".", "src", "src/deep"]


def test_a_stream_follows_changes(spark, tmp_path):
    root, out = repository(tmp_path), str(tmp_path / "out")
    register(spark)

    def run():
        stream = spark.readStream.format("repository").load(str(root)).select("path", "text")
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.text) for r in spark.read.parquet(f"{out}/rows").collect())

    first = sorted((k, v) for k, v in FILES.items() if not k.endswith(".log"))
    assert run() == first
    write(root, {"src/b.ts": "let changed;\n", "new.rs": "fn n() {}\n", "node_modules/y.ts": "let y;\n"}, 4_000_000_000 * 10**9)
    assert run() == sorted([*first, ("new.rs", "fn n() {}\n"), ("src/b.ts", "let changed;\n")])
