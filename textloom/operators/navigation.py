"""Finding things: lines, files, symbols, occurrences, ranges."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from textloom.functions.text import ascii_fold, ascii_lower, has, has_any, identifier, line_array, lines, shorten
from textloom.operators.catalog import report
from textloom.sources.relations import Relations

NEEDLE, TOP = "that", 20


def matching_lines(rel: Relations, needles: list[str], ignore_case: bool = True):
    return lines(rel.files, "file_id", "path", "ord", "language").filter(has_any(F.col("line"), needles, ignore_case))


def hits(rel: Relations, needles: list[str]):
    """Files with matching lines: how many, and the first eight line numbers. A file's lines are looked at in its row."""
    numbers = F.filter(F.transform(line_array("text"), lambda x, i: F.when(has_any(x, needles), i + 1)), lambda n: n.isNotNull())
    found = rel.files.select("path", numbers.alias("at")).filter(F.size("at") > 0)
    return found.select("path", F.size("at").cast("bigint").alias("matches"), F.array_join(F.slice("at", 1, 8), ",").alias("first_lines"))


_HITS = "SELECT path, count(*) AS matches, array_to_string(list_sort(list(line_no))[1:8], ',') AS first_lines FROM lines WHERE {} GROUP BY path"
_CI = "contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"


@report("lines", _HITS.format(_CI.format(NEEDLE)))
def find(rel, needle: str = NEEDLE):
    return hits(rel, [needle])


@report("lines", _HITS.format(_CI.format("license") + " OR " + _CI.format("rights")))
def refs_needles(rel, needles: tuple[str, ...] = ("License", "rights")):
    return hits(rel, list(needles))


@report("lines", f"SELECT path, line_no, trim(line) AS line FROM lines WHERE contains(line, 'Der') AND language IN ('de', 'en') ORDER BY ord, line_no LIMIT {TOP}")
def trace_field(rel, needle: str = "Der", languages: tuple[str, ...] = ("de", "en"), top: int = TOP):
    found = matching_lines(rel, [needle], ignore_case=False).filter(F.col("language").isin(*languages))
    return found.orderBy("ord", "line_no").limit(top).select("path", "line_no", F.trim("line").alias("line"))


@report("files", """SELECT language, count(*) AS files, count(*) FILTER (WHERE contains(text, chr(13)||chr(10))) AS crlf,
  count(*) FILTER (WHERE regexp_matches(text, '(^|[^\\r])\\n')) AS lf, count(*) FILTER (WHERE contains(text, chr(0))) AS binary_files, count(*) FILTER (WHERE lines > 1500) AS long_files FROM files GROUP BY language""")
def text_check(rel):
    t = F.col("text")
    return rel.files.groupBy("language").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.contains(t, F.lit("\r\n"))).alias("crlf"),
        F.count_if(t.rlike(r"(^|[^\r])\n")).alias("lf"),
        F.count_if(F.contains(t, F.lit("\x00"))).alias("binary_files"),
        F.count_if(F.col("lines") > 1500).alias("long_files"),
    )


@report("files", f"""SELECT path, len(solid)::BIGINT AS solid_lines, CASE WHEN list_bool_and(list_transform(solid, lambda x: starts_with(x, 'Licensed') OR starts_with(x, 'All rights') OR starts_with(x, 'Released'))) THEN 'forwarding' ELSE 'placeholder' END AS kind
  FROM (SELECT path, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS solid FROM files) WHERE len(solid) BETWEEN 1 AND 5""")
def shim_check(rel):
    solid = F.filter(F.transform(F.split("text", "\n", -1), F.trim), lambda x: x != "")
    starts = lambda x: x.startswith("Licensed") | x.startswith("All rights") | x.startswith("Released")
    found = rel.files.select("path", solid.alias("solid")).filter(F.size("solid").between(1, 5))
    kind = F.when(F.forall("solid", starts), "forwarding").otherwise("placeholder")
    return found.select("path", F.size("solid").cast("bigint").alias("solid_lines"), kind.alias("kind"))


def tag_query(query: str, fields: dict[str, Column]) -> Column:
    """Comma-separated terms that must all hold: ``key:value`` equality, a bare term in any field; ``!`` negates."""
    out = F.lit(True)
    for term in filter(None, map(str.strip, query.split(","))):
        bare = term.lstrip("!")
        key, _, value = bare.partition(":")
        if value:
            met = F.coalesce(ascii_lower(fields[key]) == ascii_fold(value), F.lit(False)) if key in fields else F.lit(False)
        else:
            met = F.lit(False)
            for f in fields.values():
                met = met | F.coalesce(has(f, bare), F.lit(False))
        out = out & (~met if term.startswith("!") else met)
    return out


def file_tags() -> dict[str, Column]:
    return {"lang": F.col("language"), "package": F.col("package"), "path": F.col("path")}


@report("files", "SELECT path, lines FROM files WHERE language = 'fr' AND package <> 'src0'")
def files_filter(rel):
    return rel.files.filter(tag_query("lang:FR,!package:src0", file_tags())).select("path", "lines")


@report("files", "SELECT tag, count(*) AS files FROM (SELECT unnest(['lang:'||language, 'package:'||package, CASE WHEN lines > 10 THEN 'size:long' ELSE 'size:short' END]) AS tag FROM files) GROUP BY tag")
def files_group_tag(rel):
    size = F.when(F.col("lines") > 10, "size:long").otherwise("size:short")
    tags = F.array(F.concat(F.lit("lang:"), "language"), F.concat(F.lit("package:"), "package"), size)
    return rel.files.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("files"))


@report("files", "SELECT language, count(*) AS files, sum(lines)::BIGINT AS lines FROM files GROUP BY language")
def files_group_language(rel):
    return rel.files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))


@report("files changed packages", """SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'changed', count(*) FROM changed
  UNION ALL SELECT 'language '||language, count(*) FROM files GROUP BY language UNION ALL SELECT 'package kind '||kind, count(*) FROM packages GROUP BY kind""")
def brief(rel):
    one = lambda df, what: df.groupBy(what.alias("what")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return (
        total(rel.files, "files")
        .unionByName(total(rel.changed, "changed"))
        .unionByName(one(rel.files, F.concat(F.lit("language "), "language")))
        .unionByName(one(rel.packages, F.concat(F.lit("package kind "), "kind")))
    )


@report("files symbols anchors dependencies", """SELECT 'files' AS relation, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols
  UNION ALL SELECT 'anchors', count(*) FROM anchors UNION ALL SELECT 'dependencies', count(*) FROM dependencies""")
def status_counts(rel):
    out = None
    for name in ("files", "symbols", "anchors", "dependencies"):
        one = getattr(rel, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def changed_files(rel):
    return rel.changed.join(rel.files.drop("text"), "file_id", "left")


@report("changed", "SELECT status, count(*) AS n FROM changed GROUP BY status")
def changed_group_status(rel):
    return rel.changed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@report("changed files", "SELECT coalesce(package, '-') AS package, status, count(*) AS n FROM changed LEFT JOIN files USING (file_id) GROUP BY ALL")
def changed_group_package(rel):
    return changed_files(rel).groupBy(F.coalesce("package", F.lit("-")).alias("package"), "status").agg(F.count(F.lit(1)).alias("n"))


def change_bucket() -> Column:
    """Ordered rules: the first that holds names the bucket."""
    path = F.col("path")
    return (
        F.when(path.isNull(), "unknown").when(F.col("status") == "D", "removals").when(F.contains(path, F.lit("/src0/")), "core")
        .when(F.contains(path, F.lit("/en/")), "docs").when(F.col("lines") > 20, "large").otherwise("misc")
    )


_BUCKET = """CASE WHEN path IS NULL THEN 'unknown' WHEN status = 'D' THEN 'removals' WHEN contains(path, '/src0/') THEN 'core'
  WHEN contains(path, '/en/') THEN 'docs' WHEN lines > 20 THEN 'large' ELSE 'misc' END"""


@report("changed files", f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM changed LEFT JOIN files USING (file_id) GROUP BY ALL")
def changes_buckets(rel):
    return changed_files(rel).groupBy(change_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@report("changed files", f"""SELECT bucket, count(*) AS n, array_to_string(list(path ORDER BY path)[1:5], ' ') AS first_paths FROM (SELECT {_BUCKET} AS bucket, coalesce(path, '-') AS path FROM changed LEFT JOIN files USING (file_id)) GROUP BY bucket""")
def commit_plan(rel):
    rows = changed_files(rel).select(change_bucket().alias("bucket"), F.coalesce("path", F.lit("-")).alias("path"))
    # the first five of each bucket are chosen by a window, so no bucket is gathered whole
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("path"))
    first = rows.withColumn("nth", nth).filter("nth <= 5").groupBy("bucket").agg(F.array_join(F.sort_array(F.collect_list("path")), " ").alias("first_paths"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(first, "bucket")


@report("changed files", f"""SELECT bucket, count(*) AS files, count(*) FILTER (WHERE status = 'D') AS removed, CASE WHEN count(*) FILTER (WHERE status = 'D') > 0 THEN 'removal' WHEN count(*) > 50 THEN 'broad' ELSE 'none' END AS risk
  FROM (SELECT {_BUCKET} AS bucket, status FROM changed LEFT JOIN files USING (file_id)) GROUP BY bucket""")
def commit_summary(rel):
    rows = changed_files(rel).groupBy(change_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "D").alias("removed"))
    return rows.withColumn("risk", F.when(F.col("removed") > 0, "removal").when(F.col("files") > 50, "broad").otherwise("none"))


@report("files changed", "SELECT path, lines, status IS NOT NULL AS is_changed FROM files LEFT JOIN changed USING (file_id) WHERE lines > 50 OR status = 'D'")
def risk_index(rel):
    rows = rel.files.drop("text").join(rel.changed, "file_id", "left").filter((F.col("lines") > 50) | (F.col("status") == "D"))
    return rows.select("path", "lines", F.col("status").isNotNull().alias("is_changed"))


@report("occurrences", "SELECT value, kind, file_id, line_no FROM occurrences WHERE contains(context, 'GNU') OR contains(context, 'MIT') OR contains(value, 'TODO')")
def todo_index(rel):
    c = F.col("context")
    return rel.occurrences.filter(has(c, "GNU", False) | has(c, "MIT", False) | has(F.col("value"), "TODO", False)).select("value", "kind", "file_id", "line_no")


@report("symbols", "SELECT name, owner, visibility, ord FROM symbols WHERE visibility IN ('pub', 'export')")
def api_surface(rel):
    return rel.symbols.filter(F.col("visibility").isin("pub", "export")).select("name", "owner", "visibility", "ord")


@report("symbols", "SELECT name, owner, file_id, ord FROM symbols WHERE kind = 'component'")
def component_graph(rel):
    return rel.symbols.filter("kind = 'component'").select("name", "owner", "file_id", "ord")


@report("symbols", "SELECT name, kind, owner, ord FROM symbols WHERE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = 'redwidget' AND lower(visibility) = 'pub' AND contains(lower(owner), 'brand#1')")
def symbols_filter(rel):
    named = identifier(F.col("name")) == "redwidget"
    return rel.symbols.filter(named & tag_query("visibility:PUB", {"visibility": F.col("visibility")}) & has(F.col("owner"), "Brand#1")).select("name", "kind", "owner", "ord")


@report("symbols changed", "SELECT name, kind, ord FROM symbols WHERE file_id IN (SELECT file_id FROM changed)")
def symbols_changed(rel):
    return rel.symbols.join(rel.changed, "file_id", "left_semi").select("name", "kind", "ord")


def name_match(query: str) -> Column:
    return (F.col("name") == query) | has(F.col("name"), query)


@report("symbols files", "SELECT name, kind, coalesce(path, '-') AS path, line, s.ord FROM symbols s LEFT JOIN files f USING (file_id) WHERE name = 'ring' OR contains(lower(name), 'ring')")
def where_defs(rel):
    rows = rel.symbols.filter(name_match("ring")).join(rel.files.select("file_id", "path"), "file_id", "left")
    return rows.select("name", "kind", F.coalesce("path", F.lit("-")).alias("path"), "line", "ord")


@report("symbols files", "SELECT name||'@'||owner||':'||visibility AS signature, coalesce(path, '-') AS path, line_end - line + 1 AS span, s.ord FROM symbols s LEFT JOIN files f USING (file_id) WHERE contains(lower(name), 'widget')")
def signature(rel):
    rows = rel.symbols.filter(name_match("widget")).join(rel.files.select("file_id", "path"), "file_id", "left")
    text = F.concat("name", F.lit("@"), "owner", F.lit(":"), "visibility")
    return rows.select(text.alias("signature"), F.coalesce("path", F.lit("-")).alias("path"), (F.col("line_end") - F.col("line") + 1).alias("span"), "ord")


@report("occurrences", """SELECT kind, value, file_id, line_no, nth FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord, line_no, value) AS nth FROM occurrences) WHERE nth <= 5""")
def trace_occurrences_top5(rel):
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("ord", "line_no", "value"))
    return rel.occurrences.withColumn("nth", nth).filter("nth <= 5").select("kind", "value", "file_id", "line_no", F.col("nth").cast("bigint").alias("nth"))


@report("symbols anchors occurrences", """SELECT DISTINCT file_id FROM (SELECT file_id FROM symbols WHERE contains(lower(name), 'ring') UNION ALL SELECT file_id FROM anchors WHERE contains(anchor, 'error-1')
  UNION ALL SELECT file_id FROM occurrences WHERE value = 'GNU')""")
def trace_related(rel):
    a = rel.symbols.filter(name_match("ring")).select("file_id")
    b = rel.anchors.filter(F.contains("anchor", F.lit("error-1"))).select("file_id")
    return a.union(b).union(rel.occurrences.filter("value = 'GNU'").select("file_id")).distinct()


@report("files symbols", "SELECT file_id FROM files WHERE starts_with(path, 'crates/apps/src1/') UNION SELECT file_id FROM files WHERE language = 'es' UNION SELECT file_id FROM symbols WHERE name = 'small ring'")
def scope_ids(rel):
    f = rel.files
    return (
        f.filter(F.col("path").startswith("crates/apps/src1/")).select("file_id")
        .union(f.filter("language = 'es'").select("file_id"))
        .union(rel.symbols.filter("name = 'small ring'").select("file_id"))
        .distinct()
    )


@report("files symbols", f"""SELECT path, name, line, ord FROM (SELECT f.path, s.name, s.line, s.ord, row_number() OVER (PARTITION BY f.file_id ORDER BY s.line, s.ord) AS nth
  FROM files f JOIN symbols s USING (file_id) WHERE contains(f.path, '/d7')) WHERE nth <= {TOP}""")
def explain_file(rel):
    chosen = rel.files.filter(F.contains("path", F.lit("/d7"))).select("file_id", "path")
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("line", "ord"))
    return rel.symbols.join(chosen, "file_id").withColumn("nth", nth).filter(F.col("nth") <= TOP).select("path", "name", "line", "ord")


@report("occurrences", "SELECT file_id, line_no, value FROM occurrences WHERE contains(context, 'GNU General') OR contains(value, '.MIT')")
def callsites(rel):
    return rel.occurrences.filter(F.contains("context", F.lit("GNU General")) | F.contains("value", F.lit(".MIT"))).select("file_id", "line_no", "value")


@report("lines symbols", "SELECT s.ord, l.line_no, l.line FROM symbols s JOIN lines l ON l.file_id = s.file_id AND l.line_no BETWEEN s.line AND s.line_end WHERE s.kind = 'fn'")
def slice_symbol(rel):
    s = rel.symbols.filter("kind = 'fn'").select("file_id", "line", "line_end", "ord")
    text = lines(rel.files, "file_id")
    # an interval inside a file: the symbol's lines are few, so they are listed and joined by equality
    wanted = s.select("file_id", "ord", F.explode(F.sequence("line", "line_end")).alias("line_no"))
    return text.join(wanted, ["file_id", "line_no"]).select("ord", "line_no", "line")


@report("lines", "SELECT path, line_no, line FROM lines WHERE line_no BETWEEN 3 - 2 AND 4 + 2")
def slice_window(rel):
    return lines(rel.files, "path").filter(F.col("line_no").between(1, 6)).select("path", "line_no", "line")


@report("files", f"""SELECT path, a[2] AS context_before, array_to_string(a[3:4], '|') AS body, a[5] AS context_after FROM (SELECT path, string_split_regex(regexp_replace(text, '\\n\\z', ''), '\\r?\\n') AS a FROM files WHERE text <> '') WHERE len(a) >= 5""")
def range_for_lines(rel):
    a = rel.files.filter("text <> ''").select("path", line_array("text").alias("a")).filter(F.size("a") >= 5)
    return a.select("path", F.col("a")[1].alias("context_before"), F.array_join(F.slice("a", 3, 2), "|").alias("body"), F.col("a")[4].alias("context_after"))


@report("anchors", "SELECT anchor, line, ord, lead(line) OVER (PARTITION BY file_id ORDER BY line, ord) - 1 AS until FROM anchors")
def anchor_range(rel):
    following = F.lead("line").over(Window.partitionBy("file_id").orderBy("line", "ord"))
    return rel.anchors.select("anchor", "line", "ord", (following - 1).alias("until"))


@report("symbols", """SELECT file_id, ord, score, n = 1 AS is_unique FROM (SELECT *, count(*) OVER (PARTITION BY file_id, score) AS n, max(score) OVER (PARTITION BY file_id) AS best FROM (
  SELECT file_id, ord, CASE WHEN name = 'red widget' THEN 1000 WHEN lower(name) = 'red widget' THEN 900 WHEN contains(lower(name), 'widget') THEN 850 END AS score FROM symbols) WHERE score IS NOT NULL) WHERE score = best""")
def resolve_symbol(rel):
    name, query = F.col("name"), "red widget"
    score = F.when(name == query, 1000).when(ascii_lower(name) == query, 900).when(has(name, "widget"), 850)
    rows = rel.symbols.select("file_id", "ord", score.alias("score")).filter("score IS NOT NULL")
    n, best = F.count(F.lit(1)).over(Window.partitionBy("file_id", "score")), F.max("score").over(Window.partitionBy("file_id"))
    return rows.withColumns({"n": n, "best": best}).filter("score = best").select("file_id", "ord", "score", (F.col("n") == 1).alias("is_unique"))


@report("files symbols anchors", """SELECT 'file' AS what, path AS item, ord FROM files WHERE contains(lower(path), 'src1/') OR contains(lower(path), '/fr/')
  UNION ALL SELECT 'symbol', name, ord FROM symbols WHERE contains(lower(name), 'ring') OR contains(lower(name), 'gear')
  UNION ALL SELECT 'anchor', anchor, ord FROM anchors WHERE contains(anchor, 'login') OR contains(anchor, 'purchase')""")
def change_plan(rel):
    part = lambda df, what, col, tokens: df.filter(has_any(F.col(col), tokens)).select(F.lit(what).alias("what"), F.col(col).alias("item"), "ord")
    return (
        part(rel.files, "file", "path", ["src1/", "/fr/"])
        .unionByName(part(rel.symbols, "symbol", "name", ["ring", "gear"]))
        .unionByName(part(rel.anchors, "anchor", "anchor", ["login", "purchase"]))
    )


@report("files", "SELECT path, CASE WHEN length(trim(text)) > 140 THEN substr(trim(text), 1, 140)||'...' ELSE trim(text) END AS preview FROM files")
def previews(rel):
    return rel.files.select("path", shorten(F.col("text")).alias("preview"))
