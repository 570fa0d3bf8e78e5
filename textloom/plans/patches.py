"""Unified diffs: parsed by windows over their lines, checked against files and applied.

A patch is rows of lines (patch_id, line_no, line). Files, hunks and line numbers are
running counts and carried values within a patch; a file's hunks are then folded over
its lines, each looked for at its hinted place (moved by what earlier hunks added) and,
if it is not there, at the first place where its old lines stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import line_array, lines
from textloom.operators.catalog import report
from textloom.operators.graph import nearest_preceding
from textloom.plans.ops import bind

HUNK = "@@"


def patch_lines(patches: DataFrame) -> DataFrame:
    """(patch_id, line_no, line) of patches (patch_id, text)."""
    return lines(patches, "patch_id")


def added_lines(rows: DataFrame) -> DataFrame:
    """Light parse: patch_id, old_path, new_path, line for every line that a patch adds."""
    line, order = F.col("line"), Window.partitionBy("patch_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    header = line.startswith("diff --git a/")
    at = line.startswith(HUNK)
    first = F.try_to_number(F.regexp_extract("line", r"\+(\d+)", 1), F.lit("9999999999")).cast("bigint")
    marked = rows.select(
        "patch_id", "line_no", "line", header.alias("header"), at.alias("at"),
        F.sum(header.cast("int")).over(before).alias("file"), F.sum((at & F.contains("line", F.lit("+"))).cast("int")).over(before).alias("hunk"),
    )
    in_file, in_hunk = Window.partitionBy("patch_id", "file"), Window.partitionBy("patch_id", "hunk")
    paths = F.split(F.substring("line", len("diff --git a/") + 1, 1 << 20), " b/")
    moves = ~F.col("header") & ~F.col("at") & ~line.startswith("-")
    placed = marked.withColumns(
        {
            "paths": F.max(F.when(F.col("header") & (F.size(paths) == 2), paths)).over(in_file),
            "base": F.max(F.when(F.col("at") & F.contains("line", F.lit("+")), F.coalesce(first, F.lit(0)))).over(in_hunk),
            "moved": F.sum(moves.cast("int")).over(in_hunk.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    added = placed.filter("file > 0 AND paths IS NOT NULL AND NOT header AND NOT at").filter(line.startswith("+") & ~line.startswith("+++"))
    return added.select("patch_id", F.col("paths")[0].alias("old_path"), F.col("paths")[1].alias("new_path"), (F.coalesce("base", F.lit(0)) + F.coalesce("moved", F.lit(0))).alias("line"))


def diff_path(value: Column) -> Column:
    """The path of a ``---`` or ``+++`` line; null for /dev/null."""
    path = F.regexp_extract(value, r"^(?:---|\+\+\+) (\S+)", 1)
    return F.when((path != "/dev/null") & (path != ""), F.replace(F.regexp_replace(path, "^[ab]/", ""), F.lit("\\"), F.lit("/")))


def parsed(rows: DataFrame) -> DataFrame:
    """Full parse: patch_id, file, old_path, new_path, hunks (old_start, old lines, new lines), error."""
    line, order = F.col("line"), Window.partitionBy("patch_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    starts, at, other = line.startswith("--- "), line.startswith("@@ "), line.startswith("diff --git ")
    state = F.when(at, 1).when(starts | other, 0)
    marked = rows.select(
        "patch_id", "line_no", "line", starts.alias("starts"), at.alias("at"),
        F.sum(starts.cast("int")).over(before).alias("file"), F.sum(at.cast("int")).over(before).alias("hunk"),
        F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(0)).alias("in_hunk"), F.lead("line").over(order).alias("following"),
    ).filter("file > 0")
    files = marked.filter("starts").select(
        "patch_id", "file", diff_path(line).alias("old_path"), F.when(F.col("following").startswith("+++ "), diff_path(F.col("following"))).alias("new_path")
    )
    # the line after "--- " is the header's other half; a line of spaces alone counts as context
    body = marked.filter("in_hunk = 1").filter(line != "\\ No newline at end of file")
    sign = F.when(line == "", " ").otherwise(F.substring("line", 1, 1))
    start = F.regexp_extract("line", r"^@@ -(\d+)", 1).cast("bigint")
    hunks = body.groupBy("patch_id", "file", "hunk").agg(
        F.max(F.when(F.col("at"), start)).alias("old_start"),
        F.sort_array(F.collect_list(F.when(~F.col("at"), F.struct("line_no", sign.alias("sign"), F.substring("line", 2, 1 << 24).alias("text"))))).alias("body"),
        F.max(F.when(~F.col("at") & ~sign.isin(" ", "+", "-"), True)).alias("odd"),
    )
    of = lambda *signs: F.transform(F.filter("body", lambda x: x["sign"].isin(*signs)), lambda x: x["text"])
    each = F.struct("hunk", "old_start", of(" ", "-").alias("old"), of(" ", "+").alias("new"))
    by_file = hunks.groupBy("patch_id", "file").agg(F.sort_array(F.collect_list(each)).alias("hunks"), F.max("odd").alias("odd"))
    out = files.join(by_file, ["patch_id", "file"], "left")
    error = F.when(F.col("old_path").isNull() & F.col("new_path").isNull(), "missing paths").when(F.col("hunks").isNull(), "no hunks").when(F.col("odd"), "unsupported line")
    return out.select("patch_id", "file", "old_path", "new_path", "hunks", error.alias("error"))


def split_lines(text: Column) -> Column:
    body = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n+\z", "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def with_hunks(text: Column, hunks: Column) -> Column:
    """struct(lines, error): the lines of a text after its hunks, or the first hunk that has no place."""
    start = F.struct(split_lines(text).alias("lines"), F.lit(0).cast("bigint").alias("offset"), F.lit(0).alias("nth"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, hunk: Column) -> Column:
        n, size = F.size(hunk["old"]), F.size(acc["lines"])
        hinted = F.greatest(hunk["old_start"] - 1 + acc["offset"], F.lit(0).cast("bigint"))
        stands = lambda i: F.slice(acc["lines"], i.cast("int") + 1, n) == hunk["old"]
        places = F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))
        first = F.array_position(F.transform(places, stands), True)
        at = F.when(n == 0, F.least(hinted, size)).when((hinted + n <= size) & stands(hinted), hinted).when((first > 0) & (n <= size), first - 1)

        def applied(at: Column) -> Column:
            new = F.concat(F.filter(acc["lines"], lambda x, i: i < at), hunk["new"], F.filter(acc["lines"], lambda x, i: i >= at + n))
            near = F.concat(F.lit("hunk "), (acc["nth"] + 1).cast("string"), F.lit(" context mismatch near line "), hunk["old_start"].cast("string"))
            stop = acc["error"].isNotNull() | at.isNull()
            return F.struct(
                F.when(stop, acc["lines"]).otherwise(new).alias("lines"), (acc["offset"] + F.size(hunk["new"]) - n).alias("offset"), (acc["nth"] + 1).alias("nth"),
                F.coalesce(acc["error"], F.when(at.isNull(), near)).alias("error"),
            )

        return bind(at, applied)

    return F.aggregate(hunks, start, step)


def apply_patches(patches: DataFrame, files: DataFrame) -> DataFrame:
    """patch_id, path, hunks, applies, status and text afterwards (null unless it applies) of every file of every patch.

    ``files``: path, text. A file that a patch creates need not be there; two patches
    of one file each see the file as it is.
    """
    found = parsed(patch_lines(patches)).withColumn("path", F.coalesce("new_path", "old_path"))
    rows = found.join(files.select("path", F.col("text").alias("own")), "path", "left")
    unsafe = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    early = F.coalesce(F.col("error"), F.when(unsafe, "unsafe path"), F.when(F.col("own").isNull() & F.col("old_path").isNotNull(), "target missing"))
    done = rows.select("patch_id", "path", F.coalesce(F.size("hunks"), F.lit(0)).cast("bigint").alias("hunks"), early.alias("early"), F.when(early.isNull(), with_hunks(F.col("own"), F.col("hunks"))).alias("end"))
    status = F.coalesce("early", "end.error", F.lit("dry-run ok"))
    text = F.when(F.size("end.lines") == 0, "").otherwise(F.concat(F.array_join("end.lines", "\n"), F.lit("\n")))
    return done.select("patch_id", "path", "hunks", (status == "dry-run ok").alias("applies"), status.alias("status"), F.when(status == "dry-run ok", text).alias("text"))


# the driver's tables: a patch for every file of four lines or more


def file_patches(rel) -> DataFrame:
    """Patches of one or two hunks; some hints are wrong, some contexts and targets do not exist, some have no hunk."""
    f = rel.files.select("ord", "path", line_array("text").alias("l")).filter(F.size("l") >= 4)
    every = lambda n: F.col("ord") % n == 0
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    path = F.when(every(7), F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    l2 = F.when(every(5), "@no such line@").otherwise(F.get("l", F.lit(1)))
    one = F.array(
        F.when(every(3), "@@ -40,2 +40,3 @@").otherwise("@@ -2,2 +2,3 @@"), cat(" ", l2), cat("-", F.get("l", F.lit(2))), cat("+new ", F.col("ord").cast("string")), F.lit("+more")
    )
    two = F.array(cat("@@ -", F.size("l").cast("string"), " +", (F.size("l") + 1).cast("string"), " @@"), cat("-", F.element_at("l", -1)), F.lit("+end"))
    none = F.array().cast("array<string>")
    head = F.array(cat("diff --git a/", path, " b/", path), F.lit("index 1..2"), cat("--- a/", path), cat("+++ b/", path))
    text = F.array_join(F.concat(head, F.when(every(11), none).otherwise(one), F.when(every(4) & ~every(11), two).otherwise(none)), "\n")
    return f.select(F.col("ord").alias("patch_id"), text.alias("text"))


_PATCHED = r"""f AS (SELECT ord AS patch_id, ord, CASE WHEN ord % 7 = 0 THEN path||'.gone' ELSE path END AS path, text, l, string_split(regexp_replace(replace(text, chr(13)||chr(10), chr(10)), '\n+\z', ''), chr(10)) AS own
  FROM (SELECT *, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace(text, '\n\z', ''), '\r?\n') END AS l FROM files) WHERE len(l) >= 4),
g AS (SELECT *, len(own) AS n, CASE WHEN ord % 3 = 0 THEN 40 ELSE 2 END AS hint FROM f),
h AS (SELECT *, CASE WHEN ord % 5 = 0 THEN NULL WHEN own[hint] = l[2] AND own[hint + 1] = l[3] THEN hint ELSE list_filter(range(1, n), lambda i: own[i] = l[2] AND own[i + 1] = l[3])[1] END AS pos FROM g),
k AS (SELECT *, list_concat(list_concat(own[1:pos], ['new '||ord, 'more']), own[pos + 2:]) AS one FROM h),
m AS (SELECT *, CASE WHEN one[len(l) + 1] = l[-1] THEN len(l) + 1 ELSE list_position(one, l[-1]) END AS tail_at FROM k),
p AS (SELECT *, CASE WHEN ord % 11 = 0 THEN 'no hunks' WHEN ord % 7 = 0 THEN 'target missing' WHEN pos IS NULL THEN 'hunk 1 context mismatch near line '||hint
  WHEN ord % 4 = 0 AND (tail_at IS NULL OR tail_at = 0) THEN 'hunk 2 context mismatch near line '||len(l) ELSE 'dry-run ok' END AS status FROM m)"""


@report("files", f"WITH {_PATCHED} SELECT patch_id, path, CASE WHEN ord % 11 = 0 THEN 0 WHEN ord % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS hunks, status = 'dry-run ok' AS applies, status FROM p")
def patch_check(rel):
    """Whether each file of each patch can be changed as the patch says."""
    return apply_patches(file_patches(rel), rel.files).drop("text")


@report("files", f"""WITH {_PATCHED} SELECT path, CASE WHEN ord % 4 = 0 THEN array_to_string(list_concat(list_concat(one[1:tail_at - 1], ['end']), one[tail_at + 1:]), chr(10)) || chr(10)
  ELSE array_to_string(one, chr(10)) || chr(10) END AS patched FROM p WHERE status = 'dry-run ok'""")
def patch_apply(rel):
    """The files that patches change, as they are afterwards."""
    return apply_patches(file_patches(rel), rel.files).filter("applies").select("path", F.col("text").alias("patched"))


@report("files", f"""WITH {_PATCHED}, a AS (SELECT patch_id, path, unnest([hint + 1, hint + 2]) AS line FROM p WHERE ord % 11 <> 0 UNION ALL SELECT patch_id, path, len(l) + 1 FROM p WHERE ord % 11 <> 0 AND ord % 4 = 0)
SELECT patch_id, path AS new_path, line::BIGINT AS line FROM a""")
def patch_added_lines(rel):
    return added_lines(patch_lines(file_patches(rel))).select("patch_id", "new_path", "line")


@report("files symbols", f"""WITH {_PATCHED}, a AS (SELECT path, unnest([hint + 1, hint + 2]) AS line_no FROM p WHERE ord % 11 <> 0 AND ord % 7 <> 0 UNION ALL SELECT path, len(l) + 1 FROM p WHERE ord % 11 <> 0 AND ord % 7 <> 0 AND ord % 4 = 0),
s AS (SELECT a.path, a.line_no, f.file_id FROM a JOIN files f USING (path)),
r AS (SELECT s.path, s.line_no, y.name, row_number() OVER (PARTITION BY s.path, s.line_no ORDER BY y.line <= s.line_no DESC, CASE WHEN y.line <= s.line_no THEN -y.line ELSE y.line END, CASE WHEN y.line <= s.line_no THEN -y.ord ELSE y.ord END) AS k
  FROM s JOIN symbols y ON y.file_id = s.file_id)
SELECT s.path, array_to_string(string_split(s.path, '/')[1:3], '/') AS area, s.line_no::BIGINT AS line_no, r.name AS symbol FROM s LEFT JOIN r ON r.path = s.path AND r.line_no = s.line_no AND k = 1""")
def patch_symbols(rel):
    """The area of every added line and the symbol that stands at or above it (the first one of the file, if none does)."""
    added = added_lines(patch_lines(file_patches(rel))).select(F.col("new_path").alias("path"), F.col("line").alias("line_no"))
    inside = added.join(rel.files.select("path", "file_id"), "path")
    near = nearest_preceding(inside.select("file_id", "line_no"), rel.symbols.select("file_id", "line", "name", "ord"))
    return inside.join(near.select("file_id", "line_no", "name").distinct(), ["file_id", "line_no"], "left").select("path", F.substring_index("path", "/", 3).alias("area"), "line_no", F.col("name").alias("symbol"))
