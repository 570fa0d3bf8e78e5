"""Duplicates, drift, impact and risk: grouped counts with rules on top."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from textloom.functions.text import ascii_lower, count_sub, lines, slug
from textloom.operators.catalog import report
from textloom.operators.graph import mentions


@report("symbols", "SELECT name, count(*) AS n, count(DISTINCT file_id) AS files, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM symbols GROUP BY name HAVING count(*) > 1")
def dup_names(rel):
    groups = rel.symbols.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds")
    )
    return groups.filter("n > 1")


_BODY = "regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(trim(x), '//')), ''), '[ \\t\\r\\n]', '', 'g')"


@report("files", f"SELECT min(path) AS first_path, count(*) AS n FROM (SELECT path, {_BODY} AS body FROM files) WHERE length(body) >= 12 GROUP BY body HAVING count(*) > 1")
def dup_bodies(rel):
    kept = F.filter(F.split("text", "\n", -1), lambda x: ~F.trim(x).startswith("//"))
    body = F.regexp_replace(F.array_join(kept, ""), "[ \\t\\r\\n]", "")
    rows = rel.files.select("path", body.alias("body")).filter(F.length("body") >= 12)
    # bodies are grouped by their hash: 32 bytes are shuffled in place of a text
    groups = rows.groupBy(F.sha2("body", 256).alias("h")).agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1").select("first_path", "n")


@report("symbols", "SELECT lower(name) AS folded, owner, count(*) AS n FROM symbols GROUP BY ALL HAVING count(*) > 1")
def case_collisions(rel):
    return rel.symbols.groupBy(ascii_lower("name").alias("folded"), "owner").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@report("anchors", "SELECT anchor, count(*) AS n, count(DISTINCT file_id) AS files FROM anchors GROUP BY anchor HAVING count(*) > 1")
def registry_ids(rel):
    groups = rel.anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"))
    return groups.filter("n > 1")


@report("symbols", "SELECT owner, count(*) AS exports, count(*) - count(DISTINCT name) AS repeated FROM symbols WHERE visibility = 'export' GROUP BY owner")
def barrel_exports(rel):
    groups = rel.symbols.filter("visibility = 'export'").groupBy("owner").agg(F.count(F.lit(1)).alias("exports"), F.countDistinct("name").alias("names"))
    return groups.select("owner", "exports", (F.col("exports") - F.col("names")).alias("repeated"))


@report("imports", "SELECT specifier, count(DISTINCT page_id) AS pages FROM imports GROUP BY specifier HAVING count(DISTINCT page_id) > 1")
def asset_duplicates(rel):
    return rel.imports.groupBy("specifier").agg(F.countDistinct("page_id").alias("pages")).filter("pages > 1")


def whole_word(needle: str) -> str:
    return f"(^|[^A-Za-z0-9_]){needle}([^A-Za-z0-9_]|$)"


@report("lines", f"SELECT package, count(*) FILTER (WHERE regexp_matches(line, '{whole_word('and')}')) AS exact, count(*) FILTER (WHERE NOT regexp_matches(line, '{whole_word('and')}')) AS partial FROM lines WHERE contains(line, 'and') GROUP BY package")
def rename_counts(rel, needle: str = "and"):
    exact = F.col("line").rlike(whole_word(re.escape(needle)))
    return lines(rel.files, "package").filter(F.contains("line", F.lit(needle))).groupBy("package").agg(F.count_if(exact).alias("exact"), F.count_if(~exact).alias("partial"))


PATTERNS = ("ring", "Licensed", "nowhere")


@report("lines symbols changed", f"""WITH p AS (SELECT unnest({list(PATTERNS)}) AS pattern), d AS (SELECT pattern, count(*) AS defs FROM p JOIN symbols ON contains(name, pattern) GROUP BY pattern),
r AS (SELECT pattern, count(*) AS refs, count(c.file_id) AS in_changed FROM p JOIN lines l ON contains(line, pattern) LEFT JOIN changed c USING (file_id) GROUP BY pattern),
n AS (SELECT pattern, coalesce(defs, 0) AS defs, coalesce(refs, 0) AS refs, coalesce(in_changed, 0) AS in_changed FROM p LEFT JOIN d USING (pattern) LEFT JOIN r USING (pattern))
SELECT *, CASE WHEN defs = 0 AND refs = 0 THEN 'clean' WHEN refs = 0 THEN 'safe-delete candidate' WHEN refs = in_changed THEN 'cleanup in progress' ELSE 'migration incomplete' END AS status FROM n""")
def stale_status(rel, patterns: tuple[str, ...] = PATTERNS):
    """Patterns are listed for each line that holds them: the text is read once for all of them."""
    held = lambda col: F.explode(F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.col(col), p)))
    listed = rel.spark.createDataFrame([(p,) for p in patterns], "pattern string")
    defs = rel.symbols.select(held("name").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("defs"))
    marked = lines(rel.files, "file_id").select("file_id", held("line").alias("pattern")).join(rel.changed, "file_id", "left")
    refs = marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("refs"), F.count("status").alias("in_changed"))
    n = listed.join(defs, "pattern", "left").join(refs, "pattern", "left").na.fill(0)
    status = F.when((F.col("defs") == 0) & (F.col("refs") == 0), "clean").when(F.col("refs") == 0, "safe-delete candidate")
    return n.withColumn("status", status.when(F.col("refs") == F.col("in_changed"), "cleanup in progress").otherwise("migration incomplete"))


@report("lines", "SELECT package, count(DISTINCT file_id) AS files, count(*) AS matched_lines FROM lines WHERE contains(line, 'license') OR contains(line, 'License') GROUP BY package")
def impact_groups(rel):
    found = lines(rel.files, "file_id", "package").filter(F.contains("line", F.lit("license")) | F.contains("line", F.lit("License")))
    return found.groupBy("package").agg(F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("matched_lines"))


@report("lines", """SELECT risk, count(*) AS n FROM (SELECT CASE WHEN contains(line, 'GNU') THEN 'copyleft' WHEN contains(line, 'All rights') THEN 'reserved' WHEN contains(path, '/en/') THEN 'docs' ELSE 'text' END AS risk
  FROM lines WHERE contains(line, 'icense') OR contains(line, 'rights')) GROUP BY risk""")
def impact_risks(rel):
    line, path = F.col("line"), F.col("path")
    has = lambda c, x: F.contains(c, F.lit(x))
    risk = F.when(has(line, "GNU"), "copyleft").when(has(line, "All rights"), "reserved").when(has(path, "/en/"), "docs").otherwise("text")
    return lines(rel.files, "path").filter(has(line, "icense") | has(line, "rights")).groupBy(risk.alias("risk")).agg(F.count(F.lit(1)).alias("n"))


FIELDS = ("the", "der", "les", "que")


@report("lines", f"""SELECT field, count(DISTINCT package) AS packages, CASE WHEN count(DISTINCT package) > 10 THEN 'shared' WHEN count(DISTINCT package) > 1 THEN 'cross' ELSE 'local' END AS class
  FROM (SELECT package, line, unnest({list(FIELDS)}) AS field FROM lines) WHERE contains(line, ' '||field||' ') OR contains(line, field||',') GROUP BY field""")
def service_fields(rel):
    used = F.filter(F.array(*map(F.lit, FIELDS)), lambda f: F.contains("line", F.concat(F.lit(" "), f, F.lit(" "))) | F.contains("line", F.concat(f, F.lit(","))))
    rows = lines(rel.files, "package").select("package", F.explode(used).alias("field"))
    n = F.col("packages")
    groups = rows.groupBy("field").agg(F.countDistinct("package").alias("packages"))
    return groups.withColumn("class", F.when(n > 10, "shared").when(n > 1, "cross").otherwise("local"))


@report("packages files", "SELECT p.kind, count(DISTINCT p.name) AS packages, count(DISTINCT CASE WHEN f.lines > 30 THEN p.name END) AS documented FROM packages p LEFT JOIN files f ON f.package = p.name GROUP BY p.kind")
def docs_coverage(rel):
    long = rel.files.filter("lines > 30").select(F.col("package").alias("name")).distinct().withColumn("has", F.lit(True))
    return rel.packages.join(long, "name", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("packages"), F.count("has").alias("documented"))


@report("changed files symbols", """SELECT file_id, status, coalesce(array_to_string(list(name ORDER BY line, ord) FILTER (WHERE nth <= 6), ','), '') AS names FROM (
  SELECT c.file_id, c.status, s.name, s.line, s.ord, row_number() OVER (PARTITION BY c.file_id ORDER BY s.line, s.ord) AS nth FROM changed c LEFT JOIN symbols s USING (file_id)) GROUP BY ALL""")
def diff_scope(rel):
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("line", "ord"))
    first = rel.symbols.withColumn("nth", nth).filter("nth <= 6").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line", "ord", "name"))).alias("s"))
    return rel.changed.join(first, "file_id", "left").select("file_id", "status", F.coalesce(F.array_join("s.name", ","), F.lit("")).alias("names"))


@report("lines symbols", """WITH s AS (SELECT DISTINCT split_part(name, ' ', 2) AS word, file_id FROM symbols), w AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(lower(line), '[a-z]+')) AS word FROM lines)
SELECT s.file_id, s.word, count(w.file_id) AS refs FROM s LEFT JOIN w ON w.word = s.word AND w.file_id <> s.file_id GROUP BY ALL""")
def delete_inbound(rel, file_ids: tuple[str, ...] | None = None):
    """How many other files mention the second word of a symbol of each file (or of the given ones)."""
    s = rel.symbols if file_ids is None else rel.symbols.filter(F.col("file_id").isin(*file_ids))
    own = s.select("file_id", F.split_part("name", F.lit(" "), F.lit(2)).alias("word")).distinct()
    return mentions(own, rel.files, "[a-z]+").withColumnRenamed("others", "refs")


# metrics, scores and labels of the risk ranking

#: Needles of branching code (fixed values); ``else if`` counts for ``if `` as well.
BRANCH_TOKENS = ("if ", "else if", "match ", "for ", "while ", "case ", "catch ", "switch ", "&&", "||", "?", "await ", ".unwrap(", ".expect(", "panic!")
MARKERS = ("TODO", "FIXME", "HACK", "unwrap(", "expect(", "panic!")
#: (component, column, ((at least, points), ...)): fixed values of the scoring rules.
SCORE_RULES = (
    ("size_score", "lines", ((450, 8), (700, 16), (1000, 25))),
    ("body_score", "body_lines", ((80, 8), (150, 16), (250, 25))),
    ("branch_score", "branches", ((40, 6), (80, 12), (120, 20))),
    ("coupling_score", "coupling", ((12, 5), (24, 10), (40, 15))),
    ("marker_score", "markers", ((3, 2), (8, 4), (15, 5))),
)
SEVERITIES = ((85, "critical"), (70, "high"), (50, "medium"), (30, "low"))


def scaled(value: Column, steps) -> Column:
    out = F.lit(0)
    for least, points in steps:
        out = F.when(value >= least, points).otherwise(out)
    return out


def smell_metrics(rel):
    text = F.col("text")
    tokens = lambda needles: sum((count_sub(text, n) for n in needles), F.lit(0).cast("bigint"))
    files = rel.files.select("file_id", "path", "language", "package", "lines", tokens(BRANCH_TOKENS).alias("branches"), tokens(MARKERS).alias("markers"))
    bodies = rel.symbols.groupBy("file_id").agg((F.max("line_count") * 20).alias("body_lines"))
    d = rel.dependencies
    # both ends of an edge at once: one pass over the edges, one join
    ends = F.explode(F.array(F.struct(F.col("source").alias("file_id"), F.lit(1).alias("o")), F.struct(F.col("target").alias("file_id"), F.lit(0).alias("o"))))
    degrees = d.select(ends.alias("e")).groupBy("e.file_id").agg(F.sum("e.o").alias("outgoing"), F.sum(1 - F.col("e.o")).alias("incoming"))
    joined = files.join(bodies, "file_id", "left").join(degrees, "file_id", "left").na.fill(0, ["body_lines", "outgoing", "incoming"])
    joined = joined.join(rel.changed.select("file_id", F.lit(True).alias("is_changed")), "file_id", "left")
    return joined.withColumns({"coupling": F.greatest("outgoing", "incoming"), "is_changed": F.coalesce("is_changed", F.lit(False))})


def _sql_tokens(needles) -> str:
    return " + ".join(f"((length(text) - length(replace(text, '{n}', ''))) // {len(n)})" for n in needles)


_METRICS = f"""m AS (SELECT f.file_id, path, language, package, lines, ({_sql_tokens(BRANCH_TOKENS)})::BIGINT AS branches, ({_sql_tokens(MARKERS)})::BIGINT AS markers,
  coalesce(b.body_lines, 0) AS body_lines, greatest(coalesce(o.n, 0), coalesce(i.n, 0)) AS coupling, c.file_id IS NOT NULL AS is_changed FROM files f
  LEFT JOIN (SELECT file_id, max(line_count) * 20 AS body_lines FROM symbols GROUP BY file_id) b USING (file_id) LEFT JOIN (SELECT source AS file_id, count(*) AS n FROM dependencies GROUP BY 1) o USING (file_id)
  LEFT JOIN (SELECT target AS file_id, count(*) AS n FROM dependencies GROUP BY 1) i USING (file_id) LEFT JOIN changed c USING (file_id))"""


def _sql_scaled(column, steps) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {least} THEN {points}" for least, points in reversed(steps)) + " ELSE 0 END"


_SCORED = _METRICS + ", scored AS (SELECT *, least(100, " + " + ".join(_sql_scaled(c, s) for _, c, s in SCORE_RULES) + """
  + CASE WHEN is_changed AND (lines > 450 OR branches > 60) THEN 10 WHEN is_changed THEN 4 ELSE 0 END) AS score FROM m), judged AS (SELECT *, CASE """ + " ".join(
    f"WHEN score >= {n} THEN '{x}'" for n, x in SEVERITIES
) + " ELSE 'info' END AS severity FROM scored)"
_SMELL_VIEWS = "files symbols dependencies changed"


def smell_scores(rel):
    m = smell_metrics(rel)
    score = sum((scaled(F.col(column), steps) for _, column, steps in SCORE_RULES), F.lit(0))
    change = F.when(F.col("is_changed") & ((F.col("lines") > 450) | (F.col("branches") > 60)), 10).when(F.col("is_changed"), 4).otherwise(0)
    severity = F.lit("info")
    for least, name in reversed(SEVERITIES):
        severity = F.when(F.col("score") >= least, name).otherwise(severity)
    return m.withColumn("score", F.least(F.lit(100), score + change)).withColumn("severity", severity)


@report(_SMELL_VIEWS, f"WITH {_METRICS} SELECT path, lines, branches, markers, body_lines, coupling, is_changed FROM m")
def smells_metrics(rel):
    return smell_metrics(rel).select("path", "lines", "branches", "markers", "body_lines", "coupling", "is_changed")


@report(_SMELL_VIEWS, f"WITH {_SCORED} SELECT path, score, severity FROM judged WHERE score >= 20")
def smells_score(rel):
    return smell_scores(rel).filter("score >= 20").select("path", "score", "severity")


@report(_SMELL_VIEWS, f"""WITH {_SCORED} SELECT path, array_to_string(list_filter([CASE WHEN body_lines > 150 THEN 'huge body' WHEN body_lines > 80 THEN 'long body' END, CASE WHEN branches > 80 THEN 'branchy' END,
  CASE WHEN coupling > 40 THEN 'hub' WHEN coupling > 12 THEN 'coupled' END, CASE WHEN is_changed THEN 'moving' END], lambda x: x IS NOT NULL), ',') AS labels FROM judged""")
def smells_labels(rel):
    """Ordered rules; of each chain the first that holds gives the label."""
    body, coupling = F.col("body_lines"), F.col("coupling")
    labels = F.array(
        F.when(body > 150, "huge body").when(body > 80, "long body"),
        F.when(F.col("branches") > 80, "branchy"),
        F.when(coupling > 40, "hub").when(coupling > 12, "coupled"),
        F.when(F.col("is_changed"), "moving"),
    )
    return smell_metrics(rel).select("path", F.array_join(labels, ",").alias("labels"))


@report(_SMELL_VIEWS, f"WITH {_SCORED} SELECT language, package, severity, count(*) AS n, max(score) AS max_score FROM judged GROUP BY GROUPING SETS ((language), (package), (severity))")
def smells_grouping_sets(rel):
    rows = smell_scores(rel).select("language", "package", "severity", "score")
    sets = [[F.col("language")], [F.col("package")], [F.col("severity")]]
    return rows.groupingSets(sets, "language", "package", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"))


@report(_SMELL_VIEWS, f"WITH {_SCORED} SELECT package, path, score, nth FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY score DESC, lines DESC, path) AS nth FROM judged) WHERE nth <= 3")
def smells_top3(rel):
    nth = F.row_number().over(Window.partitionBy("package").orderBy(F.desc("score"), F.desc("lines"), "path"))
    return smell_scores(rel).withColumn("nth", nth).filter("nth <= 3").select("package", "path", "score", F.col("nth").cast("bigint").alias("nth"))


@report("files symbols changed", """SELECT path, least(lines, 2000) + 10 * coalesce(n, 0) + CASE WHEN c.file_id IS NULL THEN 0 ELSE 75 END + CASE WHEN package = 'src0' THEN 100 ELSE 0 END AS score
  FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) s USING (file_id) LEFT JOIN changed c USING (file_id) ORDER BY score DESC, path LIMIT 20""")
def large_files(rel):
    n = rel.symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rel.files.drop("text").join(n, "file_id", "left").join(rel.changed, "file_id", "left")
    score = F.least("lines", F.lit(2000)) + 10 * F.coalesce("n", F.lit(0)) + F.when(F.col("status").isNull(), 0).otherwise(75) + F.when(F.col("package") == "src0", 100).otherwise(0)
    return rows.select("path", score.alias("score")).orderBy(F.desc("score"), "path").limit(20)


# build logs: an error's place comes on a later line than its code

#: Codes of two compilers and what they say (fixed values); all others are ``other``.
CODES = {
    "TS2304": "missing name/import", "TS2305": "missing export/import", "TS2322": "type mismatch", "E0308": "type mismatch", "TS2339": "missing property",
    "TS2345": "argument mismatch", "E0432": "unresolved import", "E0425": "missing function/value", "E0412": "missing type", "E0603": "visibility",
}
_TS = [c for c in CODES if c.startswith("TS")] + ["TS9999"]
_RS = [c for c in CODES if c.startswith("E")] + ["E9999"]


def _sql_pick(codes) -> str:
    return "['" + "', '".join(codes) + f"'][(event_id // 4) % {len(codes)} + 1]"


_LOG = f"""log AS (SELECT event_id // 1000 AS log_id, event_id AS n, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'src\\a'||user_id||'.ts(3,1): ' END||'error '||{_sql_pick(_TS)}||': Cannot find '||user_id||'.'
  WHEN 1 THEN 'error['||{_sql_pick(_RS)}||']: unresolved m'||user_id WHEN 2 THEN CASE WHEN event_id % 5 = 0 THEN 'note' ELSE '  --> crates/b'||user_id||'/mod.rs:7:5' END ELSE 'note: '||event_type END AS line FROM events)"""


def build_log(rel):
    """Logs of a thousand lines each: log_id, n, line."""
    u, e = F.col("user_id"), F.col("event_id")
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    pick = lambda codes: F.element_at(F.array(*map(F.lit, codes)), (F.floor(e / 4) % len(codes) + 1).cast("int"))
    line = (
        F.when(e % 4 == 0, cat(F.when(e % 3 == 0, "").otherwise(cat("src\\a", u, ".ts(3,1): ")), "error ", pick(_TS), ": Cannot find ", u, "."))
        .when(e % 4 == 1, cat("error[", pick(_RS), "]: unresolved m", u))
        .when(e % 4 == 2, F.when(e % 5 == 0, "note").otherwise(cat("  --> crates/b", u, "/mod.rs:7:5")))
        .otherwise(cat("note: ", F.col("event_type")))
    )
    return rel.read("events").select(F.floor(e / 1000).alias("log_id"), e.alias("n"), line.alias("line"))


def log_errors(log):
    """log_id, n, file, code, kind, message of every error of some build logs (log_id, n, line).

    An error of the second compiler has the last place named before its next error,
    however many lines further down; a log is one window.
    """
    line, order = F.col("line"), Window.partitionBy("log_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ts, rs = r"error (TS\d+): (.+)", r"error\[(E\d+)\]: (.+)"
    is_ts = line.rlike(ts)
    is_rs = ~is_ts & line.rlike(rs)
    place = F.when(~is_ts & ~is_rs, F.nullif(F.regexp_extract("line", r"-->\s+([^:]+):\d+:\d+", 1), F.lit("")))
    own = F.nullif(F.regexp_extract("line", r"([^()\s]+\.(?:ts|tsx))\(\d+,\d+\):\s*error TS", 1), F.lit(""))
    rows = log.select("log_id", "n", "line", is_ts.alias("ts"), is_rs.alias("rs"), place.alias("place"), own.alias("own"))
    rows = rows.withColumn("nth", F.sum(F.col("rs").cast("int")).over(order))
    last = F.max(F.when(F.col("place").isNotNull(), F.struct("n", "place"))).over(Window.partitionBy("log_id", "nth"))["place"]
    # places above the first such error belong to none
    found = rows.withColumn("last", last).filter("ts OR rs")
    either = lambda k: F.when(F.col("ts"), F.regexp_extract("line", ts, k)).otherwise(F.regexp_extract("line", rs, k))
    code = either(1)
    kind = F.coalesce(*[F.when(code == c, F.lit(what)) for c, what in CODES.items()], F.lit("other"))
    file = F.replace(F.when(F.col("ts"), F.col("own")).otherwise(F.col("last")), F.lit("\\"), F.lit("/"))
    return found.select("log_id", "n", file.alias("file"), code.alias("code"), kind.alias("kind"), either(2).alias("message"))


_KIND = "CASE code " + " ".join(f"WHEN '{c}' THEN '{w}'" for c, w in CODES.items()) + " ELSE 'other' END"
_ERRORS = _LOG + r""", marked AS (SELECT *, regexp_extract(line, 'error (TS\d+): ', 1) AS ts, regexp_extract(line, 'error\[(E\d+)\]: ', 1) AS rs, regexp_extract(line, '^([^()\s]+[.]tsx?)\(\d+,\d+\):', 1) AS own,
  regexp_extract(line, '-->\s+([^:]+):\d+:\d+', 1) AS place FROM log), numbered AS (SELECT *, sum((rs <> '')::INT) OVER (PARTITION BY log_id ORDER BY n) AS nth FROM marked),
placed AS (SELECT *, max(CASE WHEN place <> '' THEN n END) OVER (PARTITION BY log_id, nth) AS at_n FROM numbered),
errors AS (SELECT p.n, CASE WHEN p.ts <> '' THEN replace(nullif(p.own, ''), '\', '/') ELSE q.place END AS file, CASE WHEN p.ts <> '' THEN p.ts ELSE p.rs END AS code, regexp_extract(p.line, 'error.*?[0-9]\]?: (.+)', 1) AS message
  FROM placed p LEFT JOIN marked q ON q.n = p.at_n WHERE p.ts <> '' OR p.rs <> '')"""


@report("", f"WITH {_ERRORS} SELECT n, file, code, {_KIND} AS kind, message FROM errors")
def fallout(rel):
    """Errors of build logs with their files and what their codes say."""
    return log_errors(build_log(rel)).drop("log_id")


@report("", f"WITH {_ERRORS} SELECT {_KIND} AS kind, count(*) AS n, count(DISTINCT file) AS files FROM errors GROUP BY ALL")
def fallout_summary(rel):
    return log_errors(build_log(rel)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


@report("", """SELECT conv_id, count(*) AS turns, sum(tokens)::BIGINT AS tokens FROM (SELECT conv_id, len(string_split(text, ' ')) AS tokens FROM conversations) GROUP BY conv_id ORDER BY tokens DESC, conv_id LIMIT 12""")
def operations_summary(rel):
    """Log entries by size: the twelve largest."""
    rows = rel.read("conversations").select("conv_id", F.size(F.split("text", " ", -1)).alias("tokens"))
    groups = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"))
    return groups.orderBy(F.desc("tokens"), "conv_id").limit(12)


@report("symbols", "SELECT owner, kind, array_to_string(list_sort(list(DISTINCT name)), '|') AS names, count(*) AS n FROM symbols GROUP BY owner, kind")
def move_plan(rel):
    return rel.symbols.groupBy("owner", "kind").agg(F.array_join(F.sort_array(F.collect_set("name")), "|").alias("names"), F.count(F.lit(1)).alias("n"))


@report("files", "SELECT path, trim(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM files")
def path_slugs(rel):
    return rel.files.select("path", slug(F.col("path")).alias("slug"))
