"""What to read for a task: files ranked by definitions, mentions, anchors, changes and where they lie, with what to skip."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.names import APP, TOOL, feature_group
from textloom.functions.text import ascii_fold, ascii_lower, identifier, line_array
from textloom.operators.catalog import report
from textloom.operators.ranking import PRIORITY_SCORES

#: Points of a feature group and what they are called (fixed values).
GROUPS = (
    (("app/store",), 50, "store boundary"), (("app/selection",), 45, "selection"), (("main-window",), 35, "main-window"),
    (("feature/inspector", "properties"), 30, "inspector/properties"), (("startup",), 25, "startup"),
)
#: Words of a query that say nothing about a text (fixed values).
PLAIN = ("document", "yaml", "tree", "real", "viewer", "node")
#: Ends and parts of paths not worth reading, and of tests (fixed values).
LOW_ENDS = (".md", ".txt", ".css", ".scss", ".snap")
LOW_PARTS = ("/docs/", "package-lock.json", "/tests/fixtures/", "/tests/snapshots/")
TEST_PARTS = (".test.", ".spec.", "/tests/")
FIRST, SKIPPED = 5, 6
_ITEM = "array<struct<points: bigint, reason: string>>"


def tokens_of(query: str) -> list[str]:
    """The words of a query, three letters or more, each once."""
    return list(dict.fromkeys(w for w in re.findall(r"[a-z0-9]+", ascii_fold(query)) if len(w) > 2))


def is_low(path: Column) -> Column:
    out = path.startswith("docs/")
    for end in LOW_ENDS:
        out = out | path.endswith(end)
    for part in LOW_PARTS:
        out = out | F.contains(path, F.lit(part))
    return out


def is_test(path: Column) -> Column:
    out = F.lit(False)
    for part in TEST_PARTS:
        out = out | F.contains(path, F.lit(part))
    return out


def _items(*rules: tuple[Column, Column | int, Column | str]) -> Column:
    """The (points, reason) of the rules that hold, in order."""
    col = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    each = [F.when(rule, F.array(F.struct(col(p, "bigint").alias("points"), col(r, "string").alias("reason")))).otherwise(F.array().cast(_ITEM)) for rule, p, r in rules]
    return F.concat(*each)


def task_items(task: str, definition: Column, changed: Column, refs: Column, test: Column) -> Column:
    rules: dict[str, list] = {
        "trace": [(definition, 80, "task:trace-definition"), (refs > 0, F.least(refs, F.lit(8)) * 8, "task:trace-refs"), (test, -25, "task:trace-deprioritize-test")],
        "test": [(test, 80, "task:test")], "cleanup": [(changed, 60, "task:cleanup-changed")],
        "verify": [(changed, 100, "task:verify-changed"), (test, 35, "task:verify-test")],
    }
    for name in ("implement", "migrate", "refactor"):
        rules[name] = [(definition, 60, "task:implement-definition"), (changed, 50, "task:implement-changed")]
    return _items(*rules[task]) if task in rules else F.array().cast(_ITEM)


def anchor_text() -> Column:
    return ascii_lower(F.concat_ws(" ", "anchor", F.coalesce("domain", F.lit("")), F.coalesce("role", F.lit("")), F.coalesce("priority", F.lit(""))))


def reading_list(rel, query: str, task: str = "read", limit: int | None = None, app: str = APP, tool: str = TOOL) -> DataFrame:
    """rank, path, score, reasons (array), part of the files to read (``first`` five, ``second``) and of six to ``skip``.

    A word of a query of several words counts by itself, except in definitions, where it always does.
    Files of the tool are skipped if what is looked for is defined in the application. Mentions are counted in one
    pass over the texts; what is known of a file meets it in three joins. Rank: score, reasons, both descending, path.
    """
    tokens = tokens_of(query)
    several = len(query.split()) > 1
    in_texts, in_anchors = [t for t in tokens if several and t not in PLAIN], tokens if several else []
    same = (F.col("name") == query) | identifier(F.col("name")).isin([re.sub("[^a-z0-9]", "", t) for t in tokens])
    # one row for each name, so that a name of many symbols is said once and counted each time
    named = rel.symbols.filter(same).groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    other = F.col("name") != query
    by_name = F.array_sort(F.collect_list(F.when(other, F.struct("ord", (F.col("n") * 70).alias("points"), F.concat(F.lit("symbol-token:"), "name").alias("reason")))))
    defs = named.groupBy("file_id").agg(F.transform(by_name, lambda x: F.struct(x["points"].cast("bigint").alias("points"), x["reason"].alias("reason"))).alias("by_name"))
    in_app = not defs.join(rel.files.select("file_id", "path"), "file_id").filter(F.col("path").startswith(app)).isEmpty()
    touched = rel.changed.groupBy("file_id").agg(F.min("status").alias("status"))
    points = F.lit(0)
    for p, value in PRIORITY_SCORES.items():
        points = F.when(F.col("priority") == p, value).otherwise(points)
    by_query = F.contains(anchor_text(), F.lit(ascii_fold(query)))
    by_token = F.lit(False)
    for t in in_anchors:
        by_token = by_token | F.contains(anchor_text(), F.lit(t))
    exact = ascii_lower(F.col("anchor")) == ascii_fold(query)
    said = _items(
        (F.lit(True), points, F.concat(F.lit("anchor:"), "anchor")), (exact, 100, "exact-anchor"), (by_token, 80, "anchor-token"),
        (F.lit(True), 0, F.concat(F.lit("domain:"), F.coalesce("domain", F.lit("")))), (F.lit(True), 0, F.concat(F.lit("role:"), F.coalesce("role", F.lit("")))),
    )
    marks = rel.anchors.filter(by_query | by_token).groupBy("file_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", said.alias("said")))), lambda x: x["said"])).alias("marks"))
    holding = lambda needle: F.size(F.filter(line_array(ascii_lower("text")), lambda x: F.contains(x, F.lit(needle)))).cast("bigint")
    files = rel.files.select("file_id", "path", holding(ascii_fold(query)).alias("n"), *[holding(t).alias(f"t{k}") for k, t in enumerate(in_texts)])
    rows = files.join(defs, "file_id", "left").join(touched, "file_id", "left").join(marks, "file_id", "left")
    refs = F.col("n")
    for k in range(len(in_texts)):
        refs = refs + F.col(f"t{k}")
    path, definition, changed = F.col("path"), F.col("by_name").isNotNull(), F.col("status").isNotNull()
    test, group = is_test(path), feature_group(path, app)
    evidence = F.concat(
        F.when(refs > 0, F.concat(
            _items((definition, 100, "definition"), (changed, 80, "changed"), (changed, 0, F.concat(F.lit("git:"), "status")), (F.lit(True), F.least(refs, F.lit(10)) * 6, F.concat(F.lit("refs:"), refs.cast("string")))),
            _items(*[(group.isin(*names), p, what) for names, p, what in GROUPS], (test, -20, "test")), task_items(task, definition, changed, refs, test),
        )).otherwise(_items((definition, 100, "definition"))),
        F.coalesce("marks", F.array().cast(_ITEM)), F.coalesce("by_name", F.array().cast(_ITEM)),
        *[_items((F.col(f"t{k}") > 0, F.col(f"t{k}") * 12, f"text-token:{t}")) for k, t in enumerate(in_texts)],
    )
    low = is_low(path) | (path.startswith(tool) if in_app else F.lit(False))
    found = rows.select("path", low.alias("low"), evidence.alias("e"), refs.alias("refs"), F.col("marks").isNotNull().alias("marked")).filter(F.size("e") > 0)
    score = F.aggregate("e", F.lit(0).cast("bigint"), lambda acc, x: acc + x["points"])
    read = found.filter(~F.col("low")).select("path", score.alias("score"), F.transform("e", lambda x: x["reason"]).alias("reasons"))
    order = (F.desc("score"), F.desc("reasons"), F.col("path"))
    top = read.orderBy(*order).limit(limit) if limit is not None else read
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    listed = ranked.select("rank", "path", "score", "reasons", F.when(F.col("rank") <= FIRST, "first").otherwise("second").alias("part"))
    skipped = found.filter(F.col("low") & ((F.col("refs") > 0) | F.col("marked"))).select("path").orderBy("path").limit(SKIPPED)
    none = F.lit(None)
    return listed.unionByName(skipped.select(none.cast("int").alias("rank"), "path", none.cast("bigint").alias("score"), none.cast("array<string>").alias("reasons"), F.lit("skip").alias("part")))


class Placed:
    """Relations whose files lie in folders of an application, by their package and language."""

    def __init__(self, rel):
        self.symbols, self.changed, self.anchors = rel.symbols, rel.changed, rel.anchors
        k = F.substring("package", 4, 4).cast("int")
        folder = F.element_at(F.array(*map(F.lit, PLACES)), (k % len(PLACES) + 1).cast("int"))
        end = F.when(F.col("language") == "en", ".ts").when(F.col("language") == "de", ".test.ts").when(F.col("language") == "fr", ".rs").otherwise(".md")
        self.files = rel.files.withColumn("path", F.concat(folder, F.col("file_id"), end))


PLACES = (APP + "src/app/store/", APP + "src/app/selection/", APP + "src/main-window/", APP + "src/properties/", APP + "src/startup/", TOOL + "src/", "lib/")
_QUERY = ("error the", "trace", 60)
_TASK_SQL = """UNION ALL SELECT path, 8, 80, 'task:trace-definition' FROM r WHERE refs > 0 AND def UNION ALL SELECT path, 9, least(refs, 8) * 8, 'task:trace-refs' FROM r WHERE refs > 0 UNION ALL SELECT path, 10, -25, 'task:trace-deprioritize-test' FROM r WHERE refs > 0 AND test"""
_READING = f"""WITH k AS (SELECT *, list_extract({list(PLACES)}, (substr(package, 4, 4)::INT % {len(PLACES)} + 1)::INT) || file_id || CASE language WHEN 'en' THEN '.ts' WHEN 'de' THEN '.test.ts' WHEN 'fr' THEN '.rs' ELSE '.md' END AS spot FROM files),
c AS (SELECT file_id, count(*) FILTER (contains(lower(line), 'error the')) AS n, count(*) FILTER (contains(lower(line), 'error')) AS t0, count(*) FILTER (contains(lower(line), 'the')) AS t1 FROM lines GROUP BY file_id),
d AS (SELECT DISTINCT file_id FROM symbols WHERE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') IN ('error', 'the')),
u AS (SELECT file_id, min(status) AS status FROM changed GROUP BY file_id),
r AS (SELECT k.file_id, spot AS path, coalesce(n + t0 + t1, 0) AS refs, coalesce(t0, 0) AS t0, coalesce(t1, 0) AS t1, d.file_id IS NOT NULL AS def, status, contains(spot, '.test.') AS test, spot LIKE '%.md' OR (EXISTS (SELECT 1 FROM d JOIN k USING (file_id) WHERE starts_with(spot, '{APP}')) AND starts_with(spot, '{TOOL}')) AS low
  FROM k LEFT JOIN c USING (file_id) LEFT JOIN d USING (file_id) LEFT JOIN u USING (file_id)),
m AS (SELECT r.path, a.ord, a.anchor, coalesce(a.domain, '') AS domain, coalesce(a.role, '') AS role, CASE a.priority WHEN 'P0' THEN 100 WHEN 'P1' THEN 60 WHEN 'P2' THEN 25 WHEN 'P3' THEN 10 WHEN 'PX' THEN 5 ELSE 0 END AS p,
  lower(concat_ws(' ', a.anchor, coalesce(a.domain, ''), coalesce(a.role, ''), coalesce(a.priority, ''))) AS said FROM anchors a JOIN r USING (file_id)),
hit AS (SELECT * FROM m WHERE contains(said, 'error') OR contains(said, 'the')),
e AS (SELECT path, 1 AS a, 0 AS b, 0 AS s, 100 AS points, 'definition' AS reason FROM r WHERE def UNION ALL SELECT path, 2, 0, 0, 80, 'changed' FROM r WHERE refs > 0 AND status IS NOT NULL UNION ALL SELECT path, 3, 0, 0, 0, 'git:' || status FROM r WHERE refs > 0 AND status IS NOT NULL
  UNION ALL SELECT path, 4, 0, 0, least(refs, 10) * 6, 'refs:' || refs FROM r WHERE refs > 0
  UNION ALL SELECT path, 5, 0, 0, g.p, g.what FROM r JOIN (VALUES ('app/store', 50, 'store boundary'), ('app/selection', 45, 'selection'), ('main-window', 35, 'main-window'), ('properties', 30, 'inspector/properties'), ('startup', 25, 'startup')) g(part, p, what) ON contains(path, '/src/' || part) WHERE refs > 0
  UNION ALL SELECT path, 7, 0, 0, -20, 'test' FROM r WHERE refs > 0 AND test
  UNION ALL SELECT path, a, 0, 0, points, reason FROM (SELECT '' AS path, 0 AS a, 0 AS points, '' AS reason WHERE FALSE {_TASK_SQL})
  UNION ALL SELECT path, 20, ord, 0, p, 'anchor:' || anchor FROM hit UNION ALL SELECT path, 20, ord, 2, 80, 'anchor-token' FROM hit UNION ALL SELECT path, 20, ord, 3, 0, 'domain:' || domain FROM hit UNION ALL SELECT path, 20, ord, 4, 0, 'role:' || role FROM hit
  UNION ALL SELECT path, 40, 0, 0, t0 * 12, 'text-token:error' FROM r WHERE t0 > 0 UNION ALL SELECT path, 41, 0, 0, t1 * 12, 'text-token:the' FROM r WHERE t1 > 0),
t AS (SELECT path, sum(points)::BIGINT AS score, list(reason ORDER BY a, b, s) AS reasons FROM e WHERE path NOT IN (SELECT path FROM r WHERE low) GROUP BY path),
k2 AS (SELECT row_number() OVER (ORDER BY score DESC, reasons DESC, path)::INTEGER AS rank, * FROM t)
SELECT rank, path, score, array_to_string(reasons, '; ') AS reasons, CASE WHEN rank <= {FIRST} THEN 'first' ELSE 'second' END AS part FROM k2 WHERE rank <= 60
UNION ALL (SELECT NULL, path, NULL, NULL, 'skip' FROM r WHERE low AND (refs > 0 OR path IN (SELECT path FROM hit)) ORDER BY path LIMIT {SKIPPED})"""


@report("files lines symbols changed anchors", _READING)
def reading_order(rel):
    """A reading list for a query of two words and a task, over files placed in folders of an application."""
    query, task, limit = _QUERY
    return reading_list(Placed(rel), query, task, limit).withColumn("reasons", F.array_join("reasons", "; "))
