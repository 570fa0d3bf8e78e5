"""Edges, prefixes, nearest rows and imports: the joins behind the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import lines
from textloom.operators.catalog import report


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``paths`` (path) with the name of the longest of ``prefixes`` (prefix, name) at a folder's end.

    Every path lists its own leading folders and meets the prefixes by equality, so
    the join is a hash join in place of one test for each pair.
    """
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    found = paths.select("path", F.explode(heads).alias("prefix")).join(prefixes.select("prefix", "name"), "prefix")
    best = found.groupBy("path").agg(F.max(F.struct(F.length("prefix"), "name"))["name"].alias("name"))
    return paths.join(best, "path", "left")


@report("files packages", """SELECT path, arg_max(name, length(prefix)) AS name FROM files JOIN packages ON starts_with(path, prefix||'/') GROUP BY path""")
def package_for_path(rel):
    return longest_prefix(rel.files.select("path"), rel.packages)


@report("dependencies", """SELECT 'out' AS way, target AS file_id, kind FROM dependencies WHERE source = 'f7' UNION ALL SELECT 'in', source, kind FROM dependencies WHERE target = 'f7'""")
def neighbors_edges(rel, file_id: str = "f7"):
    d = rel.dependencies
    out = d.filter(F.col("source") == file_id).select(F.lit("out").alias("way"), F.col("target").alias("file_id"), "kind")
    return out.unionByName(d.filter(F.col("target") == file_id).select(F.lit("in").alias("way"), F.col("source").alias("file_id"), "kind"))


@report("anchors", """WITH own AS (SELECT DISTINCT domain, role FROM anchors WHERE file_id = 'f11')
SELECT DISTINCT b.anchor, b.ord FROM anchors b WHERE b.file_id <> 'f11' AND b.priority = 'P0' AND (b.domain IN (SELECT domain FROM own WHERE domain IS NOT NULL) OR b.role IN (SELECT role FROM own WHERE role IS NOT NULL))""")
def neighbors_anchors(rel, file_id: str = "f11", priority: str = "P0"):
    """Anchors of the same domain or role: two equi-joins in place of one join on OR."""
    a = rel.anchors
    mine = F.col("file_id") == file_id
    own, others = a.filter(mine), a.filter(~mine & (F.col("priority") == priority)).select("anchor", "ord", "domain", "role")
    by = lambda c: others.join(own.select(c).distinct(), c, "left_semi").select("anchor", "ord")
    return by("domain").union(by("role")).distinct()


@report("dependencies", """SELECT file_id, sum(outgoing)::BIGINT AS outgoing, sum(incoming)::BIGINT AS incoming FROM (SELECT source AS file_id, 1 AS outgoing, 0 AS incoming FROM dependencies UNION ALL SELECT target, 0, 1 FROM dependencies) GROUP BY file_id""")
def degrees(rel):
    d = rel.dependencies
    ends = d.select(F.col("source").alias("file_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(d.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("file_id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


@report("files dependencies", "SELECT path FROM files WHERE starts_with(path, 'crates/apps/src1') AND file_id NOT IN (SELECT target FROM dependencies WHERE kind = 'imports')")
def orphan_degree(rel, prefix: str = "crates/apps/src1"):
    """Files under a prefix that nothing imports."""
    mine = rel.files.filter(F.col("path").startswith(prefix)).select("file_id", "path")
    return mine.join(rel.dependencies.filter("kind = 'imports'").select(F.col("target").alias("file_id")), "file_id", "left_anti").select("path")


@report("lines symbols", """WITH words AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word FROM lines), owners AS (SELECT DISTINCT file_id, split_part(name, ' ', 1) AS word FROM symbols)
SELECT o.file_id, o.word, count(w.file_id) AS inbound FROM owners o LEFT JOIN words w ON w.word = o.word AND w.file_id <> o.file_id GROUP BY ALL""")
def orphan_text(rel):
    """How many other files mention a symbol's first word, by an inverted index on words."""
    own = rel.symbols.select("file_id", F.substring_index("name", " ", 1).alias("word")).distinct()
    return mentions(own, rel.files, "[a-z0-9]+").withColumnRenamed("others", "inbound")


def mentions(own: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """own (file_id, word) with ``others``: the files besides its own that have the word.

    Files are counted for each word before they meet the owners, so a word that all
    files have is one row, not one for each pair of files.
    """
    found = files.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("word"))
    found = found.join(own.select("word").distinct(), "word", "left_semi")
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    itself = found.join(own, ["file_id", "word"], "left_semi").withColumn("own", F.lit(1))
    met = own.join(counts, "word", "left").join(itself, ["file_id", "word"], "left").na.fill(0, ["n", "own"])
    return met.select("file_id", "word", (F.col("n") - F.col("own")).alias("others"))


def nearest_preceding(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows (file_id, line_no) with the last of marks (file_id, line, name, ord) at or before, else the file's first.

    One sort of both sides together by file and line: the last mark seen is carried on.
    """
    both = rows.select("file_id", F.col("line_no").alias("line"), F.lit(1).alias("side"), F.lit(None).cast("struct<name:string,ord:bigint>").alias("mark"))
    both = both.unionByName(marks.select("file_id", "line", F.lit(0).alias("side"), F.struct("name", "ord").alias("mark")))
    order = Window.partitionBy("file_id").orderBy("line", "side", "mark.ord")
    seen = F.last("mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = marks.groupBy("file_id").agg(F.min(F.struct("line", "ord", "name")).alias("f")).select("file_id", F.struct("f.name", "f.ord").alias("first"))
    found = both.withColumn("mark", seen).filter("side = 1").join(first, "file_id")
    return found.select("file_id", F.col("line").alias("line_no"), F.coalesce("mark", "first")["name"].alias("name"), F.coalesce("mark", "first")["ord"].alias("ord"))


@report("lines symbols", """WITH added AS (SELECT file_id, line_no FROM lines WHERE contains(line, 'the')), best AS (
  SELECT a.file_id, a.line_no, arg_max({'name': name, 'ord': s.ord}, s.line * 1000000 + s.ord) FILTER (WHERE s.line <= a.line_no) AS b,
  arg_min({'name': name, 'ord': s.ord}, s.line * 1000000 + s.ord) AS f FROM added a JOIN symbols s USING (file_id) GROUP BY ALL)
SELECT file_id, line_no, coalesce(b, f).name AS name, coalesce(b, f).ord AS ord FROM best""")
def nearest_symbol(rel):
    added = lines(rel.files, "file_id").filter(F.contains("line", F.lit("the"))).select("file_id", "line_no")
    return nearest_preceding(added, rel.symbols.select("file_id", "line", "name", "ord"))


def import_targets(rel) -> DataFrame:
    """Links with the candidate pages they may mean, in order of preference."""
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    base = F.when(F.col("specifier").startswith("/"), F.concat(host, "specifier")).otherwise(F.col("specifier"))
    tries = F.array(base, F.concat(base, F.lit("/")), F.concat(base, F.lit("/index.html")), F.regexp_replace(base, r"\?.*$", ""), F.regexp_extract(base, r"^(https?://[^/]+)", 1))
    return rel.imports.select("page_id", "url", "ord", "specifier", F.posexplode(tries).alias("preference", "candidate"))


_RESOLVED = """tries AS (SELECT page_id, ord, specifier, unnest(range(0, 5))::INT AS preference, unnest([b, b||'/', b||'/index.html', regexp_replace(b, '\\?.*$', ''), regexp_extract(b, '^(https?://[^/]+)', 1)]) AS candidate
  FROM (SELECT *, CASE WHEN starts_with(specifier, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1)||specifier ELSE specifier END AS b FROM imports)),
places AS (SELECT page_id, url FROM pages UNION ALL SELECT min(page_id), regexp_extract(url, '^(https?://[^/]+)', 1) AS host FROM pages GROUP BY host),
resolved AS (SELECT t.page_id, t.ord, min(preference) AS preference, arg_min(p.page_id, preference::BIGINT * 1000000000 + p.page_id) AS target FROM tries t JOIN places p ON p.url = t.candidate GROUP BY ALL)"""


def resolved(rel) -> DataFrame:
    pages = rel.read("pages").select(F.col("page_id").alias("target"), F.col("url").alias("candidate"))
    # a link to nothing known leads to the first page of its host
    host = F.regexp_extract("candidate", r"^(https?://[^/]+)", 1)
    pages = pages.unionByName(pages.groupBy(host.alias("candidate")).agg(F.min("target").alias("target")))
    hit = import_targets(rel).join(pages, "candidate")
    best = F.min(F.struct("preference", "target"))
    return hit.groupBy("page_id", "ord").agg(best["preference"].alias("preference"), best["target"].alias("target"))


@report("imports", f"WITH {_RESOLVED} SELECT i.page_id, i.ord, i.specifier, r.target FROM imports i LEFT JOIN resolved r ON r.page_id = i.page_id AND r.ord = i.ord")
def import_resolution(rel):
    return rel.imports.join(resolved(rel), ["page_id", "ord"], "left").select("page_id", "ord", "specifier", "target")


@report("imports", f"WITH {_RESOLVED} SELECT specifier, count(*) AS n FROM imports i WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.page_id = i.page_id AND r.ord = i.ord AND r.preference < 4) GROUP BY specifier")
def broken_imports(rel):
    own = resolved(rel).filter("preference < 4")  # a page, not just its host
    return rel.imports.join(own, ["page_id", "ord"], "left_anti").groupBy("specifier").agg(F.count(F.lit(1)).alias("n"))


@report("imports", f"WITH {_RESOLVED} SELECT target, count(DISTINCT page_id) AS importers FROM resolved GROUP BY target")
def move_inbound(rel):
    return resolved(rel).groupBy("target").agg(F.countDistinct("page_id").alias("importers"))


def depth(path: Column) -> Column:
    """Folders a path goes through, after ``.`` and ``..`` are resolved."""
    return F.size(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".", ".."))) - F.size(F.filter(F.split(path, "/"), lambda x: x == ".."))


@report("imports", "SELECT d AS depth, count(*) AS n FROM (SELECT (len(list_filter(string_split(specifier, '/'), lambda x: x NOT IN ('', '.', '..'))) - len(list_filter(string_split(specifier, '/'), lambda x: x = '..')))::INT AS d FROM imports) GROUP BY d")
def import_depth(rel):
    return rel.imports.groupBy(depth(F.col("specifier")).alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@report("symbols anchors", """WITH d AS (SELECT DISTINCT file_id FROM symbols WHERE kind = 'fn'), r AS (SELECT DISTINCT file_id FROM anchors WHERE role = 'entry')
SELECT file_id, 'defined only' AS side FROM d WHERE file_id NOT IN (SELECT file_id FROM r) UNION ALL SELECT file_id, 'registered only' FROM r WHERE file_id NOT IN (SELECT file_id FROM d)""")
def registered_vs_defined(rel):
    d, r = rel.symbols.filter("kind = 'fn'").select("file_id").distinct(), rel.anchors.filter("role = 'entry'").select("file_id").distinct()
    one = lambda a, b, side: a.join(b, "file_id", "left_anti").withColumn("side", F.lit(side))
    return one(d, r, "defined only").unionByName(one(r, d, "registered only"))


@report("dependencies", """SELECT DISTINCT target FROM dependencies WHERE kind = 'uses' AND target NOT IN (SELECT target FROM dependencies WHERE kind = 'imports')""")
def plugins_orphans(rel):
    d = rel.dependencies
    read, written = d.filter("kind = 'uses'"), d.filter("kind = 'imports'")
    return read.select("target").join(written.select("target"), "target", "left_anti").distinct()


@report("files changed packages", """SELECT path, status, CASE WHEN package = 'src1' THEN 'prefix' ELSE 'changed' END AS via FROM files LEFT JOIN changed USING (file_id) WHERE package = 'src1' OR status = 'D'""")
def workset(rel):
    rows = rel.files.drop("text").join(rel.changed, "file_id", "left").filter((F.col("package") == "src1") | (F.col("status") == "D"))
    return rows.select("path", "status", F.when(F.col("package") == "src1", "prefix").otherwise("changed").alias("via"))


@report("files imports", """SELECT i.page_id, i.ord, i.specifier FROM imports i JOIN (SELECT DISTINCT '/'||lower(word) AS folded FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM files)) w ON lower(i.specifier) = w.folded""")
def case_mismatch(rel):
    words = rel.files.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    folded = words.select(F.concat(F.lit("/"), F.lower("word")).alias("folded")).distinct()
    return rel.imports.withColumn("folded", F.lower("specifier")).join(folded, "folded", "left_semi").select("page_id", "ord", "specifier")
