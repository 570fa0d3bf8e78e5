"""Snapshots of a repository: relations by level, an envelope that says what there is, and a mark of dirt.

A snapshot is reused only if its layout and root are those asked for, its level is as
high, nothing has marked it dirty and no source is newer. The relations of a level are
worked out and written when that level is first asked for; a relation whose rows are as before is not written again.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.catalog import report
from textloom.session import shared_dir
from textloom.sources.scan import IGNORED, below, bound, exists, newest, save, stale

LAYOUT = 1
#: The relations that each level adds.
LEVELS = (("files", "packages", "changed"), ("symbols", "imports"), ("occurrences", "anchors", "dependencies"))
#: What version control rewrites whenever it records something (a fixed value).
INDEX = ".git/index"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def mark_dirty(spark: SparkSession, path: str) -> None:
    """Say that what the snapshot at ``path`` was made from has changed; in any store that Spark writes."""
    at, fs = _fs(spark, f"{path}/dirty")
    fs.create(at, True).close()


def is_dirty(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, f"{path}/dirty")
    return fs.exists(at)


def clear_dirty(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, f"{path}/dirty")
    fs.delete(at, False)


def normal(root: str) -> str:
    return root.replace("\\", "/").rstrip("/")


@dataclass(frozen=True)
class Envelope:
    number: int
    layout: int
    root: str
    level: int
    written_ms: int
    #: The version of each relation that belongs to the snapshot.
    versions: dict[str, int]


@dataclass(frozen=True)
class SavedRelations:
    """The relations of a snapshot, as reports read them; one beyond its level is an error."""

    spark: SparkSession
    path: str
    envelope: Envelope

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.envelope.versions:
            raise AttributeError(f"{name} is not in a snapshot of level {self.envelope.level}")
        return self.spark.read.parquet(f"{self.path}/{name}/data-{self.envelope.versions[name]}")


def read_envelope(spark: SparkSession, path: str) -> Envelope | None:
    """The newest envelope at ``path``, or None."""
    if not exists(spark, f"{path}/envelopes"):
        return None
    row = spark.read.parquet(f"{path}/envelopes").orderBy(F.desc("number")).first()
    return Envelope(row["number"], row["layout"], row["root"], row["level"], row["written_ms"], dict(row["versions"]))


def write_snapshot(rel, path: str, root: str, level: int = 0) -> SavedRelations:
    """Write the relations of ``rel`` up to ``level``, then the envelope, and clear the mark of dirt.

    The envelope is written last, so a failure leaves the snapshot before.
    """
    if not 0 <= level < len(LEVELS):
        raise ValueError(f"level is 0 to {len(LEVELS) - 1}")
    spark = rel.spark
    last = read_envelope(spark, path)
    began = int(time.time() * 1000)
    versions = {}
    for name in (name for names in LEVELS[: level + 1] for name in names):
        save(getattr(rel, name), f"{path}/{name}")
        versions[name] = newest(spark, f"{path}/{name}").version
    row = (0 if last is None else last.number + 1, LAYOUT, normal(root), level, began, versions)
    shape = "number bigint, layout int, root string, level int, written_ms bigint, versions map<string, bigint>"
    spark.createDataFrame([row], shape).coalesce(1).write.mode("append").parquet(f"{path}/envelopes")
    clear_dirty(spark, path)
    return SavedRelations(spark, path, Envelope(*row))


def usable(envelope: Envelope | None, root: str, level: int) -> bool:
    """Whether a snapshot is of this layout and root and holds what the level needs."""
    return envelope is not None and envelope.layout == LAYOUT and envelope.level >= level and envelope.root == normal(root)


def may_be_stale(saved: SavedRelations, root: str, ignored: tuple[str, ...] = IGNORED) -> bool:
    """Marked dirty, or version control recorded something since, or a source is newer, new or gone. No text is read."""
    spark = saved.spark
    if is_dirty(spark, saved.path):
        return True
    at, fs = _fs(spark, f"{normal(root)}/{INDEX}")
    if fs.exists(at) and fs.getFileStatus(at).getModificationTime() > saved.envelope.written_ms:
        return True
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("modified"))
    inside = now.withColumn("path", below("path", root))
    folders = F.split(F.regexp_replace("path", r"[^/]*$", ""), "/")
    inside = inside.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, ignored))))
    known = saved.files.select("path", "modified")
    # files that are no text, or too large, are in no snapshot: only what it knows can be older
    newer = inside.join(known.select("path"), "path", "left_anti").filter(F.unix_millis("modified") > saved.envelope.written_ms)
    return not newer.isEmpty() or stale(inside.join(known.select("path"), "path", "left_semi"), known)


def load_or_scan(spark: SparkSession, root: str, path: str, level: int = 0, no_cache: bool = False, status: DataFrame | None = None, **options) -> tuple[SavedRelations, str]:
    """(relations, ``snapshot`` or ``scan``): the snapshot at ``path`` if it can be used, else a new one."""
    envelope = None if no_cache else read_envelope(spark, path)
    if usable(envelope, root, level):
        saved = SavedRelations(spark, path, envelope)
        if not may_be_stale(saved, root):
            return saved, "snapshot"
    return write_snapshot(bound(spark, root, status, **options), path, root, level), "scan"


@report("files packages changed symbols imports", """SELECT 'files' AS relation, count(*) AS n FROM files UNION ALL SELECT 'packages', count(*) FROM packages UNION ALL SELECT 'changed', count(*) FROM changed
  UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'imports', count(*) FROM imports""")
def snapshot_relations(rel):
    """The relations of a snapshot of level 1, with their rows as they were written."""
    saved = write_snapshot(rel, f"{shared_dir(rel.spark)}/textloom/snapshot-{uuid.uuid4().hex}", rel.sf_dir, 1)
    count = lambda name: getattr(saved, name).agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n"))
    names = [name for names in LEVELS[:2] for name in names]
    out = count(names[0])
    for name in names[1:]:
        out = out.unionByName(count(name))
    return out
