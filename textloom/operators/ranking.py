"""Rankings by additive evidence: what to open first, donors, anchors, checks to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import has, line_array, lines
from textloom.operators.catalog import report

PRIORITY_SCORES = {"P0": 100, "P1": 60, "P2": 25, "P3": 10, "PX": 5}


def ranked(evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """Evidence rows (path, points, reason, ord) summed for each path, with its reasons in order.

    Rank: score, then reasons (both descending), then path.
    """
    reasons = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "reason"))), lambda x: x["reason"]), "; ")
    scored = evidence.groupBy("path").agg(F.sum("points").alias("score"), reasons.alias("reasons"))
    if limit is None:
        return scored
    return scored.orderBy(F.desc("score"), F.desc("reasons"), "path").limit(limit)


_OPEN = """WITH refs AS (SELECT path, count(*) AS n FROM lines WHERE contains(line, 'the') GROUP BY path),
defs AS (SELECT DISTINCT f.path FROM symbols s JOIN files f USING (file_id) WHERE contains(name, 'ring')),
ch AS (SELECT f.path FROM changed c JOIN files f USING (file_id)),
marks AS (SELECT f.path, max(CASE priority WHEN 'P0' THEN 100 WHEN 'P1' THEN 60 WHEN 'P2' THEN 25 WHEN 'P3' THEN 10 ELSE 5 END) AS p FROM anchors a JOIN files f USING (file_id) WHERE contains(anchor, 'error-1') GROUP BY f.path),
evidence AS (SELECT path, 1 AS ord, 100 AS points, 'definition' AS reason FROM defs UNION ALL SELECT path, 2, 80, 'changed' FROM ch WHERE path IN (SELECT path FROM refs)
  UNION ALL SELECT path, 3, least(n, 10) * 6, 'refs '||n FROM refs UNION ALL SELECT path, 4, 50, 'core package' FROM refs WHERE contains(path, '/src0/')
  UNION ALL SELECT path, 5, -20, 'translation' FROM refs WHERE NOT contains(path, '/en/') UNION ALL SELECT path, 6, p, 'anchor' FROM marks)
SELECT path, sum(points)::BIGINT AS score, array_to_string(list(reason ORDER BY ord), '; ') AS reasons FROM evidence GROUP BY path ORDER BY score DESC, reasons DESC, path LIMIT 40"""


@report("lines symbols changed anchors", _OPEN)
def open_set(rel, word: str = "the", symbol: str = "ring", anchor: str = "error-1", core: str = "/src0/", home: str = "/en/", limit: int = 40):
    """A ranked reading list for a word and a symbol, with reasons.

    Evidence is gathered in the row of its file: one pass over the texts, and three
    joins with what is known of a file.
    """
    n = F.size(F.filter(line_array("text"), lambda x: F.contains(x, F.lit(word))))
    files = rel.files.select("file_id", "path", n.alias("n"))
    defs = rel.symbols.filter(F.contains("name", F.lit(symbol))).select("file_id", F.lit(1).alias("defs")).distinct()
    touched = rel.changed.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("times"))
    points = F.lit(5)
    for p, value in PRIORITY_SCORES.items():
        points = F.when(F.col("priority") == p, value).otherwise(points)
    marks = rel.anchors.filter(F.contains("anchor", F.lit(anchor))).groupBy("file_id").agg(F.max(points).alias("p"))
    rows = files.join(defs, "file_id", "left").join(touched, "file_id", "left").join(marks, "file_id", "left")
    path, read = F.col("path"), F.col("n") > 0
    item = lambda points, reason: F.struct(F.lit(points).cast("bigint").alias("points") if isinstance(points, int) else points.cast("bigint").alias("points"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    one = lambda rule, points, reason: F.when(rule, F.array(item(points, reason))).otherwise(F.array().cast("array<struct<points:bigint,reason:string>>"))
    evidence = F.concat(
        one(F.col("defs").isNotNull(), 100, "definition"),
        F.array_repeat(item(80, "changed"), F.when(read, F.coalesce("times", F.lit(0))).otherwise(0)),
        one(read, F.least("n", F.lit(10)) * 6, F.concat(F.lit("refs "), "n")),
        one(read & F.contains(path, F.lit(core)), 50, "core package"),
        one(read & ~F.contains(path, F.lit(home)), -20, "translation"),
        one(F.col("p").isNotNull(), F.col("p"), "anchor"),
    )
    found = rows.select("path", evidence.alias("e")).filter(F.size("e") > 0)
    total = F.aggregate("e", F.lit(0).cast("bigint"), lambda acc, x: acc + x["points"])
    scored = found.select("path", total.alias("score"), F.array_join(F.transform("e", lambda x: x["reason"]), "; ").alias("reasons"))
    return scored.orderBy(F.desc("score"), F.desc("reasons"), "path").limit(limit)


@report("files", """WITH t AS (SELECT language AS tl, package AS tp, lines AS tn FROM files WHERE ord = 7)
SELECT path, CASE WHEN package = tp THEN 80 ELSE 0 END + CASE WHEN language = tl THEN 60 ELSE 0 END + CASE WHEN lines < 600 THEN 10 ELSE 0 END + least(lines, 12) * 4 AS score FROM files, t WHERE ord <> 7 ORDER BY score DESC, path LIMIT 20""")
def copy_donors(rel, target: int = 7, limit: int = 20):
    """Files most like a target, for copying from. The target is one row, joined by a constant key."""
    own = F.col("ord") == target
    target = rel.files.filter(own).select(F.lit(1).alias("one"), F.col("language").alias("tl"), F.col("package").alias("tp"))
    rows = rel.files.filter(~own).select(F.lit(1).alias("one"), "path", "language", "package", "lines").join(F.broadcast(target), "one")  # one row
    score = F.when(F.col("package") == F.col("tp"), 80).otherwise(0) + F.when(F.col("language") == F.col("tl"), 60).otherwise(0)
    score = score + F.when(F.col("lines") < 600, 10).otherwise(0) + F.least("lines", F.lit(12)) * 4
    return rows.select("path", score.alias("score")).orderBy(F.desc("score"), "path").limit(limit)


_INDEX = """index AS (SELECT anchor, file_id, line, domain, role, priority, false AS generated, ord FROM anchors UNION ALL
  SELECT 'file-'||file_id, file_id, 1, language, NULL, 'P2', true, ord FROM files WHERE file_id NOT IN (SELECT file_id FROM anchors)),
scored AS (SELECT *, CASE priority WHEN 'P0' THEN 100 WHEN 'P1' THEN 60 WHEN 'P2' THEN 25 WHEN 'P3' THEN 10 ELSE 5 END + CASE WHEN domain IS NOT NULL AND NOT generated THEN 10 ELSE 0 END - CASE WHEN generated THEN 5 ELSE 0 END AS score FROM index)"""


def anchor_index(rel) -> DataFrame:
    """Written anchors, and one generated for every file without any."""
    written = rel.anchors.select("anchor", "file_id", "line", "domain", "role", "priority", F.lit(False).alias("generated"), "ord")
    bare = rel.files.join(rel.anchors.select("file_id"), "file_id", "left_anti")
    made = bare.select(
        F.concat(F.lit("file-"), "file_id").alias("anchor"), "file_id", F.lit(1).cast("bigint").alias("line"), F.col("language").alias("domain"),
        F.lit(None).cast("string").alias("role"), F.lit("P2").alias("priority"), F.lit(True).alias("generated"), "ord",
    )
    points = F.lit(5)
    for p, n in PRIORITY_SCORES.items():
        points = F.when(F.col("priority") == p, n).otherwise(points)
    known = F.when(F.col("domain").isNotNull() & ~F.col("generated"), 10).otherwise(0)
    return written.unionByName(made).withColumn("score", points + known - F.when(F.col("generated"), 5).otherwise(0))


@report("files anchors", f"WITH {_INDEX} SELECT anchor, file_id, line, score, generated FROM scored")
def anchors_index(rel):
    return anchor_index(rel).select("anchor", "file_id", "line", "score", "generated")


@report("anchors", """SELECT 'missing domain' AS rule, 'warning' AS level, count(*) AS n FROM anchors WHERE domain IS NULL UNION ALL SELECT 'missing role', 'warning', count(*) FROM anchors WHERE role IS NULL
  UNION ALL SELECT 'missing priority', 'warning', count(*) FROM anchors WHERE priority IS NULL UNION ALL SELECT 'unknown domain', 'error', count(*) FROM anchors WHERE domain IS NOT NULL AND domain NOT IN ('click', 'view', 'purchase')
  UNION ALL SELECT 'duplicate anchor', 'error', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM anchors GROUP BY anchor HAVING count(*) > 1))""")
def anchor_diagnostics(rel):
    """Rule violations, counted: each anchor lists the rules it breaks, in one pass."""
    domain = F.col("domain")
    broken = F.array_compact(
        F.array(
            F.when(domain.isNull(), "missing domain"), F.when(F.col("role").isNull(), "missing role"), F.when(F.col("priority").isNull(), "missing priority"),
            F.when(domain.isNotNull() & ~domain.isin("click", "view", "purchase"), "unknown domain"), F.when(F.col("twice"), "duplicate anchor"),
        )
    )
    twice = rel.anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor", F.lit(True).alias("twice"))
    counts = rel.anchors.join(twice, "anchor", "left").select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    names = ["missing domain", "missing role", "missing priority", "unknown domain", "duplicate anchor"]
    rules = rel.spark.createDataFrame([(n, "error" if n[0] in "ud" else "warning") for n in names], "rule string, level string")
    return rules.join(counts, "rule", "left").na.fill(0, ["n"])


@report("files anchors", f"WITH {_INDEX} SELECT coalesce(priority, '-') AS priority, count(*) AS n, count(*) FILTER (WHERE generated) AS generated, count(*) FILTER (WHERE domain IS NULL) AS without_domain FROM scored GROUP BY ALL")
def anchor_coverage(rel):
    groups = anchor_index(rel).groupBy(F.coalesce("priority", F.lit("-")).alias("priority"))
    return groups.agg(F.count(F.lit(1)).alias("n"), F.count_if("generated").alias("generated"), F.count_if(F.col("domain").isNull()).alias("without_domain"))


#: (part of a path, check, whether it is required).
CHECKS = (("/src0/", "run the core tests", True), ("/de/", "check translations", False), ("/fr/", "check translations", False), ("/en/", "read the docs again", True), ("src1", "build the libraries", True))


@report("changed files", "SELECT DISTINCT c.check_name, c.required FROM changed JOIN files f USING (file_id) JOIN (VALUES " + ", ".join(f"('{p}', '{c}', {r})" for p, c, r in CHECKS) + ") c(part, check_name, required) ON contains(f.path, c.part)")
def verify_plan(rel):
    """Checks that the changed paths call for. The rules are few and fixed, and are tried in place."""
    met = F.array_compact(F.array(*[F.when(F.contains("path", F.lit(p)), F.struct(F.lit(c).alias("check_name"), F.lit(r).alias("required"))) for p, c, r in CHECKS]))
    rows = rel.changed.join(rel.files.select("file_id", "path"), "file_id").select(F.explode(met).alias("c"))
    return rows.select("c.check_name", "c.required").distinct()


@report("symbols files", """SELECT f.path, s.name, CASE WHEN contains(f.path, '/en/') THEN 'required' ELSE 'optional' END AS need FROM symbols s JOIN files f USING (file_id) WHERE s.name = 'red widget'""")
def verify_scope(rel):
    rows = rel.symbols.filter("name = 'red widget'").join(rel.files.select("file_id", "path"), "file_id")
    return rows.select("path", "name", F.when(F.contains("path", F.lit("/en/")), "required").otherwise("optional").alias("need"))


@report("files anchors", """SELECT f.path, count(*) AS anchors, max(a.line) AS last_line FROM files f JOIN anchors a USING (file_id) WHERE a.role = 'view' GROUP BY f.path ORDER BY anchors DESC, last_line DESC, f.path LIMIT 15""")
def append_plan(rel):
    """Where to append: the files with most anchors of a role, and the last line of one."""
    rows = rel.anchors.filter("role = 'view'").join(rel.files.select("file_id", "path"), "file_id")
    groups = rows.groupBy("path").agg(F.count(F.lit(1)).alias("anchors"), F.max("line").alias("last_line"))
    return groups.orderBy(F.desc("anchors"), F.desc("last_line"), "path").limit(15)


@report("anchors", "SELECT anchor, ord FROM anchors WHERE lower(priority) = 'p0' AND NOT (lower(role) = 'view' AND role IS NOT NULL) AND contains(lower(anchor), 'click')")
def anchors_filter(rel):
    from textloom.operators.navigation import tag_query

    fields = {"anchor": F.col("anchor"), "role": F.col("role"), "priority": F.col("priority")}
    return rel.anchors.filter(tag_query("priority:p0,!role:view", fields) & has(F.col("anchor"), "click")).select("anchor", "ord")
