"""What a new file can be copied from, and what still refers to names that should go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.names import APP, feature_group, name_tokens, shared_prefix
from textloom.functions.text import ascii_lower, lines
from textloom.operators.catalog import report
from textloom.operators.graph import longest_prefix
from textloom.operators.imports import file_name, stem
from textloom.operators.reading import PLACES, Placed, is_test

#: Ends and parts of paths of documents (fixed values).
DOC_ENDS, DOC_PART, DOC_START = (".md", ".txt"), "/docs/", "docs/"
#: Lines below which a file is short enough to copy (a fixed value).
COPYABLE = 600


def donors(files: DataFrame, packages: DataFrame, target: str, task: str = "", limit: int | None = None, app: str = APP) -> DataFrame:
    """path, score, reasons (array) of the files most like ``target``, which need not exist, for a task in words.

    Documents are left out, and tests unless the task or the target is one; only files of the target's extension
    count. The same folder, package and feature group, a common beginning of names, shared words, the same last word and
    a copyable size earn points. Rank: score, then path.
    """
    at = F.lit(target)
    folder = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    extension = lambda p: F.regexp_extract(file_name(p), r"^.+\.([^.]*)$", 1)
    docs = F.col("path").startswith(DOC_START) | F.contains("path", F.lit(DOC_PART)) | F.col("path").endswith(DOC_ENDS[0]) | F.col("path").endswith(DOC_ENDS[1])
    kept = files.filter(~docs & (extension(F.col("path")) == extension(at)))
    if "test" not in task and ".test." not in target:
        kept = kept.filter(~is_test(F.col("path")))
    spark = files.sparkSession
    of_target = longest_prefix(spark.createDataFrame([(target,)], "path string"), packages).select("name").first()["name"]
    rows = kept.select("path", "lines").join(longest_prefix(kept.select("path").distinct(), packages).withColumnRenamed("name", "of"), "path", "left")
    own, theirs = stem(at), stem(F.col("path"))
    own_words, words = name_tokens(F.concat(own, F.lit(f" {task}"))), name_tokens(theirs)
    prefix = shared_prefix(own, theirs)
    overlap = F.size(F.filter(own_words, lambda w: F.array_contains(words, w)))
    last = lambda w: F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit(""))
    rules = [
        (folder(F.col("path")) == folder(at), F.lit(120), F.lit("same directory")), (F.col("of").eqNullSafe(F.lit(of_target).cast("string")), F.lit(80), F.lit("same package")),
        (feature_group(F.col("path"), app) == feature_group(at, app), F.lit(60), F.lit("same feature group")), (prefix > 0, F.least(prefix, F.lit(12)) * 4, F.concat(F.lit("shared prefix "), prefix.cast("string"))),
        (overlap > 0, F.least(overlap, F.lit(4)) * 20, F.concat(F.lit("token overlap "), overlap.cast("string"))), ((last(words) == last(name_tokens(own))) & (last(words) != ""), F.lit(40), F.lit("same suffix")),
        (F.col("lines") < COPYABLE, F.lit(10), F.lit("copyable size")),
    ]
    score = sum((F.when(rule, points).otherwise(0) for rule, points, _ in rules), F.lit(0)).cast("bigint")
    reasons = F.filter(F.array(*[F.when(rule, what) for rule, _, what in rules]), lambda x: x.isNotNull())
    found = rows.select("path", score.alias("score"), reasons.alias("reasons"))
    return found.orderBy(F.desc("score"), "path").limit(limit) if limit is not None else found


_TARGET, _TASK = PLACES[0] + "f7.ts", "review f 12"


@report("files", f"""WITH k AS (SELECT *, list_extract({list(PLACES)}, (substr(package, 4, 4)::INT % {len(PLACES)} + 1)::INT) AS folder FROM files WHERE language = 'en'),
s AS (SELECT folder || file_id || '.ts' AS path, lines, folder = '{PLACES[0]}' AS near, substr(file_id, 2) AS n, CASE WHEN file_id[2] = '7' THEN 2 ELSE 1 END AS p, 2 + (substr(file_id, 2) = '7')::INT + (substr(file_id, 2) = '12')::INT AS o FROM k)
SELECT path, (CASE WHEN near THEN 180 ELSE 0 END + 80 + p * 4 + o * 20 + CASE WHEN n = '7' THEN 40 ELSE 0 END + CASE WHEN lines < 600 THEN 10 ELSE 0 END)::BIGINT AS score,
  concat_ws('; ', CASE WHEN near THEN 'same directory' END, 'same package', CASE WHEN near THEN 'same feature group' END, 'shared prefix ' || p, 'token overlap ' || o, CASE WHEN n = '7' THEN 'same suffix' END, CASE WHEN lines < 600 THEN 'copyable size' END) AS reasons
FROM s ORDER BY score DESC, path LIMIT 200""")
def donor_ranking(rel):
    """Files like a file of the application's store, none of whose folders lie in a package."""
    found = donors(Placed(rel).files, rel.packages, _TARGET, _TASK, 200)
    return found.withColumn("reasons", F.array_join("reasons", "; "))


def stale_names(rel, patterns: tuple[str, ...], changed_only: bool = False) -> DataFrame:
    """pattern, defs, refs, in_changed, status: files that mention a name besides those that define it on a line that does.

    Case of A-Z does not count. A file with a definition whose own line mentions the name is no reference.
    All patterns are listed in one pass over the lines.
    """
    low = {p.lower(): p for p in patterns}
    held = lambda text: F.explode(F.filter(F.array(*map(F.lit, low)), lambda p: F.contains(ascii_lower(text), p)))
    names = rel.spark.createDataFrame(list(low.items()), "low string, pattern string")
    defs = rel.symbols.select("file_id", "line", held(F.col("name")).alias("low"))
    counts = defs.groupBy("low").agg(F.count(F.lit(1)).alias("defs"))
    found = lines(rel.files, "file_id").select("file_id", "line_no", held(F.col("line")).alias("low")).withColumnRenamed("line_no", "line")
    on_definition = found.join(defs, ["file_id", "line", "low"], "left_semi").select("file_id", "low").distinct()
    files = found.select("file_id", "low").distinct().join(on_definition, ["file_id", "low"], "left_anti")
    marked = files.join(rel.changed.select("file_id", F.lit(True).alias("changed")).distinct(), "file_id", "left")
    if changed_only:
        marked = marked.filter("changed")
    refs = marked.groupBy("low").agg(F.count(F.lit(1)).alias("refs"), F.count("changed").alias("in_changed"))
    n = names.join(counts, "low", "left").join(refs, "low", "left").na.fill(0)
    status = F.when((F.col("defs") == 0) & (F.col("refs") == 0), "clean").when(F.col("refs") == 0, "safe-delete candidate")
    status = status.when(F.col("refs") == F.col("in_changed"), "cleanup in progress").otherwise("migration incomplete")
    return n.select("pattern", "defs", "refs", "in_changed", status.alias("status"))


_NAMES = ("The", "ring", "green", "nowhere at all", "a")


@report("lines symbols changed", f"""WITH p AS (SELECT unnest({list(_NAMES)}) AS pattern), d AS (SELECT pattern, file_id, line FROM p JOIN symbols ON contains(lower(name), lower(pattern))),
m AS (SELECT DISTINCT pattern, file_id, line_no FROM p JOIN lines ON contains(lower(line), lower(pattern))),
r AS (SELECT DISTINCT pattern, file_id FROM m WHERE (pattern, file_id) NOT IN (SELECT (m.pattern, m.file_id) FROM m JOIN d ON d.pattern = m.pattern AND d.file_id = m.file_id AND d.line = m.line_no)),
n AS (SELECT pattern, (SELECT count(*) FROM d WHERE d.pattern = p.pattern) AS defs, (SELECT count(*) FROM r WHERE r.pattern = p.pattern) AS refs, (SELECT count(*) FROM r WHERE r.pattern = p.pattern AND file_id IN (SELECT file_id FROM changed)) AS in_changed FROM p)
SELECT *, CASE WHEN defs = 0 AND refs = 0 THEN 'clean' WHEN refs = 0 THEN 'safe-delete candidate' WHEN refs = in_changed THEN 'cleanup in progress' ELSE 'migration incomplete' END AS status FROM n""")
def stale_mentions(rel):
    return stale_names(rel, _NAMES)
