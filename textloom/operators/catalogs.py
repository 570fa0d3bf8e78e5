"""Fixed tables and memberships: taxonomy, operation schemas, areas, second bucketings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators.catalog import report
from textloom.operators.navigation import changed_files
from textloom.operators.ranking import PRIORITY_SCORES
from textloom.plans.ops import required_fields


@report("", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n}::BIGINT)" for p, n in PRIORITY_SCORES.items()) + ") t(priority, score)")
def taxonomy(rel):
    return rel.spark.createDataFrame(list(PRIORITY_SCORES.items()), "priority string, score bigint")


_SCHEMA = [(k, ",".join(fields)) for k, fields in required_fields().items()]


@report("", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{r}')" for k, r in _SCHEMA) + ") t(kind, required)")
def ops_schema(rel):
    """The fields that each kind of operation needs."""
    return rel.spark.createDataFrame(_SCHEMA, "kind string, required string")


@report("changed files", "SELECT coalesce(array_to_string(string_split(path, '/')[1:3], '/'), '-') AS area, count(*) AS n FROM changed LEFT JOIN files USING (file_id) GROUP BY ALL")
def changed_group_path(rel):
    area = F.coalesce(F.substring_index("path", "/", 3), F.lit("-"))
    return changed_files(rel).groupBy(area.alias("area")).agg(F.count(F.lit(1)).alias("n"))


@report("changed files", """SELECT CASE WHEN path IS NULL THEN 'unknown' WHEN contains(path, '/de/') OR contains(path, '/fr/') OR contains(path, '/es/') THEN 'translations' WHEN starts_with(path, 'crates/apps/src1') THEN 'libraries' ELSE 'application' END AS commit_group,
  status, count(*) AS n FROM changed LEFT JOIN files USING (file_id) GROUP BY ALL""")
def commit_files(rel):
    path = F.col("path")
    foreign = F.contains(path, F.lit("/de/")) | F.contains(path, F.lit("/fr/")) | F.contains(path, F.lit("/es/"))
    group = F.when(path.isNull(), "unknown").when(foreign, "translations").when(path.startswith("crates/apps/src1"), "libraries").otherwise("application")
    return changed_files(rel).groupBy(group.alias("commit_group"), "status").agg(F.count(F.lit(1)).alias("n"))


def areas(rel):
    """(area, file_id): a file is in its language's, its package's and, if long, the long texts' area."""
    names = F.array_compact(F.array(F.concat(F.lit("language/"), "language"), F.concat(F.lit("package/"), "package"), F.when(F.col("lines") > 20, "long")))
    return rel.files.select("file_id", "path", F.explode(names).alias("area"))


_AREAS = "SELECT file_id, path, unnest(list_filter(['language/'||language, 'package/'||package, CASE WHEN lines > 20 THEN 'long' END], lambda x: x IS NOT NULL)) AS area FROM files"


@report("files", f"SELECT area, count(*) AS files, min(path) AS first_path FROM ({_AREAS}) GROUP BY area")
def area_sizes(rel):
    return areas(rel).groupBy("area").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))


@report("files changed", f"SELECT area, count(*) AS n FROM ({_AREAS}) JOIN changed USING (file_id) GROUP BY area")
def area_changes(rel):
    return areas(rel).join(rel.changed, "file_id").groupBy("area").agg(F.count(F.lit(1)).alias("n"))


@report("dependencies", "SELECT kind, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM dependencies GROUP BY kind")
def edge_kinds(rel):
    return rel.dependencies.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


@report("occurrences files anchors", """SELECT o.value, o.file_id, o.line_no, count(a.anchor) AS commands FROM occurrences o JOIN files f USING (file_id) LEFT JOIN anchors a ON a.file_id = o.file_id AND a.role = 'entry'
  WHERE o.kind = 'license' AND starts_with(f.path, 'crates/apps/') GROUP BY o.value, o.file_id, o.line_no, o.ord""")
def invocations(rel):
    """Occurrences in application files with the entry commands of their file; commands are counted before the join."""
    entries = rel.anchors.filter("role = 'entry'").groupBy("file_id").agg(F.count("anchor").alias("commands"))
    inside = rel.files.filter(F.col("path").startswith("crates/apps/")).select("file_id")
    rows = rel.occurrences.filter("kind = 'license'").join(inside, "file_id", "left_semi").join(entries, "file_id", "left").na.fill(0, ["commands"])
    n = rows.groupBy("value", "file_id", "line_no").agg(F.count(F.lit(1)).alias("times"), F.max("commands").alias("c"))
    # an occurrence repeated on a line meets every command again
    return n.select("value", "file_id", "line_no", F.when(F.col("c") == 0, 0).otherwise(F.col("c") * F.col("times")).cast("bigint").alias("commands"))


@report("anchors", "SELECT domain, role, count(*) AS n, rank() OVER (PARTITION BY domain ORDER BY count(*) DESC) AS place FROM anchors WHERE domain IS NOT NULL AND role IS NOT NULL GROUP BY domain, role")
def anchor_domains(rel):
    groups = rel.anchors.filter("domain IS NOT NULL AND role IS NOT NULL").groupBy("domain", "role").agg(F.count(F.lit(1)).alias("n"))
    place = F.rank().over(Window.partitionBy("domain").orderBy(F.desc("n"))).cast("bigint")
    return groups.withColumn("place", place)


@report("files packages", "SELECT p.name, p.kind, count(f.file_id) AS files, coalesce(sum(f.size), 0)::BIGINT AS bytes FROM packages p LEFT JOIN files f ON starts_with(f.path, p.prefix||'/') GROUP BY p.name, p.kind")
def files_group_package(rel):
    """Files of every package by its prefix: found by the folders of each path, so the join is by equality."""
    from textloom.operators.graph import longest_prefix

    files = rel.files.select("path", "size")
    owned = longest_prefix(files.select("path"), rel.packages).join(files, "path")
    sums = owned.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return rel.packages.join(sums, "name", "left").na.fill(0, ["files", "bytes"]).select("name", "kind", "files", "bytes")


@report("files changed symbols", """SELECT status, count(DISTINCT file_id) AS files, count(s.name) AS symbols, max(s.line_count) AS longest FROM changed c LEFT JOIN symbols s USING (file_id) GROUP BY status""")
def changed_symbols(rel):
    rows = rel.changed.join(rel.symbols.select("file_id", "name", "line_count"), "file_id", "left")
    return rows.groupBy("status").agg(F.countDistinct("file_id").alias("files"), F.count("name").alias("symbols"), F.max("line_count").alias("longest"))
