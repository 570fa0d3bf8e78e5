"""Reading a repository of source text into relations, and writing relations.

``scan`` reads whole files in parallel; the relations are projections of them:
lines exploded, patterns extracted, nothing collected. ``bound`` gives the relations
of a scan the columns that every report reads. ``save`` writes a relation only if its
rows differ from those already there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import extract, names
from textloom.functions.text import line_array, lines
from textloom.session import cut, discard

MAX_FILE_SIZE = 1_500_000
VERSION = 1
#: Folders that hold no sources (fixed values).
IGNORED = (".git", "target", "node_modules", "dist", "build", ".next", "coverage", "__pycache__")
#: Languages by file extension (fixed values).
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "css": "css", "json": "json", "md": "markdown", "toml": "toml", "yml": "yaml", "yaml": "yaml", "html": "html", "txt": "text"}
#: Declarations by language: (language pattern, symbol pattern, kind).
DECLARATIONS = (
    ("rust", r"^\s*(pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)", "fn"),
    ("rust", r"^\s*(pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)", "type"),
    ("typescript|tsx|javascript", r"^\s*(export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", "fn"),
    ("typescript|tsx|javascript", r"^\s*(export\s+)?(?:class|interface|type|enum)\s+([A-Za-z_$][\w$]*)", "type"),
)


def language_of(path: Column) -> Column:
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    out = F.when(extension == "", "none").otherwise("other")
    for ext, name in LANGUAGES.items():
        out = F.when(extension == ext, name).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, max_file_size: int = MAX_FILE_SIZE, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """files: file_id, ord, path, language, package, lines, size, hash, modified, text.

    Left out: larger files, files that are no UTF-8 text, and those in ignored
    folders below ``root`` (folders above it may have any name). Spark's file sources pass over empty files, so they have no row. The id
    is a hash of the path, so it stays the same across scans and needs no numbering of
    all files in one task. A package is the group of folders that a path lies in.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= max_file_size)
    path = F.regexp_replace("path", r"\\", "/")
    found = found.filter(F.is_valid_utf8(F.col("content").cast("string")))
    rows = found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("h"), F.col("content").cast("string").alias("text"))
    if ignored:
        folders = F.split(F.regexp_replace(below("path", root), r"[^/]*$", ""), "/")
        rows = rows.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, ignored))))
    return rows.select(
        F.concat(F.lit("f"), F.substring(F.sha2("path", 256), 1, 12)).alias("file_id"), F.xxhash64("path").alias("ord"), "path", language_of(F.col("path")).alias("language"),
        names.group_path(F.col("path")).alias("package"), F.size(line_array("text")).cast("bigint").alias("lines"), "size", F.substring("h", 1, 8).alias("hash"), "modified", "text",
    )


def below(path: str, root: str) -> Column:
    """The part of a path that lies below ``root``; the whole path without its scheme if it does not."""
    base = re.sub(r"^[A-Za-z][\w+.-]*:/*", "/", root.replace("\\", "/")).rstrip("/")
    inside = F.regexp_replace(path, r"^[A-Za-z][\w+.-]*:/*", "/")
    return F.when(inside.startswith(base + "/"), F.substring(inside, len(base) + 2, 1 << 20)).otherwise(inside)


def symbols(files: DataFrame) -> DataFrame:
    """name, kind, visibility, file_id, line, signature: declarations found line by line."""
    found = lines(files, "file_id", "language")
    each = []
    for language, pattern, kind in DECLARATIONS:
        name = F.regexp_extract("line", pattern, 2)
        public = F.regexp_extract("line", pattern, 1) != ""
        each.append(F.when(F.col("language").rlike(f"^({language})$") & (name != ""), F.struct(name.alias("name"), F.lit(kind).alias("kind"), F.when(public, "pub").otherwise("private").alias("visibility"))))
    rows = found.select("file_id", "line_no", F.trim("line").alias("signature"), F.coalesce(*each).alias("s")).filter("s IS NOT NULL")
    return rows.select("s.name", "s.kind", "s.visibility", "file_id", F.col("line_no").alias("line"), "signature")


def ranges(found: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with line_end, body_open_line and body_close_line, by the braces of their file.

    A body opens on the first line from the symbol on that has a brace, unless a line
    ends the declaration before, and closes where the depth is again what it was. Lines carry
    the next such line upwards; a line that closes depths is a row for each of them, which the
    symbols of that depth meet in one sort, so nothing grows with symbols times lines.
    """
    down = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("file_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    change = extract.depth(F.col("line"))
    rows = lines(files.join(found.select("file_id").distinct(), "file_id", "left_semi"), "file_id")
    rows = rows.select("file_id", "line_no", change.alias("change"), F.sum(change).over(down).alias("after"), F.contains("line", F.lit("{")).alias("opens"), F.col("line").rlike(r";\s*$").alias("ends"))
    stop = F.when(F.col("opens") | F.col("ends"), F.struct("line_no", "opens", "after"))
    rows = rows.select("file_id", F.col("line_no").alias("line"), (F.col("after") - F.col("change")).alias("depth"), "after", F.last(stop, ignorenulls=True).over(up).alias("stop"))
    named = found.withColumn("s", F.struct(*found.columns)).select("file_id", "line", "s").join(rows.drop("after"), ["file_id", "line"], "left")
    opened = F.when(F.col("stop.opens"), F.col("stop.line_no"))
    named = named.select("file_id", F.col("depth"), opened.alias("opened"), F.when(opened.isNotNull() & (F.col("stop.after") <= F.col("depth")), opened).alias("at_once"), "s")
    closes = rows.filter(F.col("after") < F.col("depth")).select("file_id", F.explode(F.sequence("after", F.col("depth") - 1)).alias("depth"), F.col("line").alias("closed"))
    waiting = named.filter("opened IS NOT NULL AND at_once IS NULL").select("file_id", "depth", F.col("opened").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("closed"), "opened", "s")
    none = F.lit(None)
    marks = closes.select("file_id", "depth", F.col("closed").alias("at"), F.lit(1).alias("side"), "closed", none.cast("bigint").alias("opened"), none.cast(found.select(F.struct(*found.columns)).schema[0].dataType).alias("s"))
    below_it = Window.partitionBy("file_id", "depth").orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, 0)
    met = waiting.unionByName(marks).withColumn("closed", F.last("closed", ignorenulls=True).over(below_it)).filter("side = 0").select("s", "opened", "closed")
    rest = named.filter("opened IS NULL OR at_once IS NOT NULL").select("s", "opened", F.col("at_once").alias("closed"))
    out = met.unionByName(rest).select("s.*", F.col("opened").alias("body_open_line"), F.col("closed").alias("body_close_line"))
    return out.withColumn("line_end", F.coalesce("body_close_line", "line"))


def imports(files: DataFrame) -> DataFrame:
    """file_id, line, specifier, kind."""
    return extract.imports(files, "file_id").select("file_id", F.col("line_no").alias("line"), "specifier", "kind")


def porcelain(rows: DataFrame) -> DataFrame:
    """status, path, original of the lines (column ``line``) of ``git status --porcelain``.

    The status is both letters (index, then working tree) without spaces; a rename names the
    path it came from.
    """
    code, rest = F.trim(F.substring("line", 1, 2)), F.substring("line", 4, 1 << 20)
    clean = lambda x: F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit("\\"), F.lit("/"))
    parts = F.split(rest, " -> ")
    out = rows.filter(F.length("line") > 3).select(code.alias("status"), clean(F.element_at(parts, -1)).alias("path"), F.when(F.size(parts) > 1, clean(parts[0])).alias("original"))
    return out.filter("path <> ''")


@dataclass(frozen=True)
class ScannedRelations:
    """The relations of a scanned repository, with the columns of ``textloom.sources.relations.Relations``."""

    spark: SparkSession
    files: DataFrame
    #: status, path of what version control calls changed; none if not given.
    status: DataFrame | None = None

    @cached_property
    def packages(self) -> DataFrame:
        groups = self.files.select(F.col("package").alias("name")).distinct()
        return groups.select("name", F.when(F.col("name").startswith("crates/apps/"), "app").otherwise("library").alias("kind"), F.col("name").alias("prefix"))

    @cached_property
    def changed(self) -> DataFrame:
        if self.status is None:
            return self.spark.createDataFrame([], "file_id string, status string")
        return self.status.join(self.files.select("file_id", "path"), "path").select("file_id", "status")

    @cached_property
    def symbols(self) -> DataFrame:
        found = ranges(symbols(self.files), self.files)
        return found.select(
            "name", "kind", F.lit(None).cast("string").alias("owner"), "visibility", "file_id", "line", "line_end", (F.col("line_end") - F.col("line") + 1).alias("line_count"),
            "body_open_line", "body_close_line", F.xxhash64("file_id", "line", "name").alias("ord"),
        )

    @cached_property
    def occurrences(self) -> DataFrame:
        found = lines(self.files, "file_id", "ord").withColumn("value", F.explode(F.regexp_extract_all("line", F.lit(r"\b(TODO|FIXME|HACK)\b"), F.lit(1))))
        return found.select("value", F.lit("todo").alias("kind"), "file_id", "ord", "line_no", F.col("line").alias("context"))

    @cached_property
    def anchors(self) -> DataFrame:
        """A generated anchor for each file, named by its path."""
        path = F.col("path")
        domain, _ = names.domain_and_layer(path)
        slug = F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "-"), "^-|-$", "")
        return self.files.select(slug.alias("anchor"), domain.alias("domain"), names.role_of(path).alias("role"), F.lit("P2").alias("priority"), "file_id", F.lit(1).cast("bigint").alias("line"), "ord")

    @cached_property
    def imports(self) -> DataFrame:
        """page_id, url (the importing file), specifier, ord."""
        found = imports(self.files).join(self.files.select("file_id", "path"), "file_id")
        return found.select(F.col("file_id").alias("page_id"), F.col("path").alias("url"), F.col("line").cast("int").alias("ord"), "specifier")

    @cached_property
    def dependencies(self) -> DataFrame:
        """source, target, kind: relative imports whose module is a file of the scan."""
        tries = self.imports.select("page_id", "ord", F.posexplode(names.module_candidates(F.col("url"), F.col("specifier"))).alias("preference", "candidate"))
        known = self.files.select(F.regexp_replace("path", "^/+", "").alias("at"), "file_id")
        hit = tries.join(known, F.regexp_replace("candidate", "^/+", "") == F.col("at"))
        best = hit.groupBy("page_id", "ord").agg(F.min_by("file_id", "preference").alias("target"))
        return best.select(F.col("page_id").alias("source"), "target", F.lit("imports").alias("kind")).distinct()


def bound(spark: SparkSession, root: str, status: DataFrame | None = None, **options) -> ScannedRelations:
    """Scan a repository and bind its relations; paths are those below ``root``."""
    files = scan(spark, root, **options)
    files = files.withColumn("path", below("path", root)).withColumn("package", names.group_path(F.col("path")))
    return ScannedRelations(spark, cut(files), status)


def manifest_entries(files: DataFrame) -> DataFrame:
    """file_id, section, key, value of TOML-like manifests; a key belongs to the last section above it."""
    found = lines(files.filter(F.col("language") == "toml"), "file_id")
    section = F.nullif(F.regexp_extract("line", r"^\s*\[+([^\]]+)\]+\s*$", 1), F.lit(""))
    above = F.last(section, ignorenulls=True).over(Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("section", above)
    key, value = F.regexp_extract("line", r"^\s*([\w.-]+)\s*=\s*(.+?)\s*$", 1), F.regexp_extract("line", r"^\s*([\w.-]+)\s*=\s*(.+?)\s*$", 2)
    return rows.select("file_id", "section", key.alias("key"), F.regexp_replace(value, '^"|"$', "").alias("value")).filter("key <> ''")


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, an order-free sum of row hashes): equal for equal contents."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0))).first()
    return n, int(total)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether rows can be read from a path, in any store that Spark reads."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def save(df: DataFrame, path: str) -> bool:
    """Write ``df`` unless the same rows are there already; says whether it wrote.

    Each version goes to a folder of its own below ``path`` (``latest`` reads the
    newest whole one), so a failure leaves the version before.
    """
    spark = df.sparkSession
    kept = cut(df)
    versions = f"{path}/versions"
    print_ = fingerprint(kept)
    last = newest(spark, path)
    if last is not None and (last.n, last.digest) == (print_[0], str(print_[1])):
        discard(kept)
        return False
    number = 0 if last is None else last.version + 1
    kept.write.mode("overwrite").parquet(f"{path}/data-{number}")
    discard(kept)
    mark = spark.createDataFrame([(number, VERSION, *print_[:1], str(print_[1]))], "version bigint, layout int, n bigint, digest string")
    mark.coalesce(1).write.mode("append").parquet(versions)  # the version counts from here on
    return True


def newest(spark: SparkSession, path: str):
    """The row (version, layout, n, digest) of the newest version, or None."""
    if not exists(spark, f"{path}/versions"):
        return None
    return spark.read.parquet(f"{path}/versions").orderBy(F.desc("version")).first()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of what ``save`` wrote."""
    return spark.read.parquet(f"{path}/data-{newest(spark, path).version}")


def load_or_scan(spark: SparkSession, root: str, path: str, **options) -> DataFrame:
    """The saved files of ``root`` if they are of this layout and none has changed since; else a new scan, saved."""
    now = scan(spark, root, **options)
    last = newest(spark, path)
    if last is not None and last.layout == VERSION and not stale(now, latest(spark, path)):
        return latest(spark, path)
    save(now, path)
    return latest(spark, path)


def stale(files: DataFrame, snapshot: DataFrame) -> bool:
    """Whether a file is newer than the snapshot has it, is not in it, or has gone.

    Where both have times of modification, these are compared and no text is read or
    hashed; else hashes are.
    """
    by = "modified" if "modified" in files.columns and "modified" in snapshot.columns else "hash"
    a, b = files.select("path", F.col(by).alias("now")), snapshot.select("path", F.col(by).alias("was"))
    return not a.join(b, "path", "full_outer").filter(~F.col("now").eqNullSafe(F.col("was"))).isEmpty()
