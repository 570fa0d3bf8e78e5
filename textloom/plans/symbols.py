"""Edits of symbols by name: ranges, replacements, insertions, and the plans that would make them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import line_array
from textloom.operators.catalog import report
from textloom.plans.edits import _sql_insert, _sql_lines
from textloom.plans.ops import KINDS, SYMBOL_KINDS, with_inserted, with_lines

#: What to run after files of a language change (fixed values of this library).
CHECKS = {"rs": "cargo check", "ts": "tsc --noEmit", "tsx": "tsc --noEmit", "md": "none", "txt": "none"}


def single(rel, name: str | None = None) -> DataFrame:
    """Symbols that have their name to themselves in their file, with their file's lines; of one name, if given."""
    s = rel.symbols if name is None else rel.symbols.filter(F.col("name") == name)
    alone = s.groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("same")).filter("same = 1")
    files = rel.files.select("file_id", "path", "hash", line_array("text").alias("l"))
    return s.join(alone.select("file_id", "name"), ["file_id", "name"]).join(files, "file_id")


_SINGLE = r"""single AS (SELECT s.*, f.path, f.hash, 'new ' || s.ord AS content, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace(text, '\n\z', ''), '\r?\n') END AS l
  FROM (SELECT *, count(*) OVER (PARTITION BY file_id, name) AS same FROM symbols) s JOIN files f USING (file_id) WHERE same = 1)"""


def _edited(rel, edit) -> DataFrame:
    rows = single(rel)
    return rows.select("ord", edit(F.col("l"), F.concat(F.lit("new "), F.col("ord"))).alias("edited"))


@report("symbols files", "SELECT s.ord, f.path, s.line, s.line_end, s.line_end - s.line + 1 AS n FROM symbols s JOIN files f USING (file_id) WHERE contains(s.name, 'ring')")
def range_for_symbol(rel, name: str = "ring"):
    """The lines of every symbol whose name holds a needle."""
    found = rel.symbols.filter(F.contains("name", F.lit(name))).join(rel.files.select("file_id", "path"), "file_id")
    return found.select("ord", "path", "line", "line_end", (F.col("line_end") - F.col("line") + 1).alias("n"))


@report("files symbols", f"WITH {_SINGLE} SELECT ord, {_sql_lines('line', 'line_end')} AS edited FROM single")
def replace_symbol(rel):
    return _edited(rel, lambda lines, new: with_lines(lines, F.col("line"), F.col("line_end"), new))


@report("files symbols", f"WITH {_SINGLE} SELECT ord, {_sql_lines('line', 'line_end', False)} AS edited FROM single")
def delete_symbol(rel):
    return _edited(rel, lambda lines, new: with_lines(lines, F.col("line"), F.col("line_end"), None))


@report("files symbols", f"WITH {_SINGLE} SELECT ord, {_sql_insert('(line_end + 1)')} AS edited FROM single")
def insert_after_symbol(rel):
    return _edited(rel, lambda lines, new: with_inserted(lines, F.col("line_end") + 1, new))


@report("files symbols", f"WITH {_SINGLE} SELECT ord, {_sql_lines('(body_open_line + 1)', '(body_close_line - 1)')} AS edited FROM single WHERE body_close_line > body_open_line")
def replace_method_body(rel):
    """Bodies between their braces; symbols without a body, or with one on a single line, are left out."""
    rows = single(rel).filter("body_close_line > body_open_line")
    return rows.select("ord", with_lines(F.col("l"), F.col("body_open_line") + 1, F.col("body_close_line") - 1, F.concat(F.lit("new "), F.col("ord"))).alias("edited"))


@report("files symbols", f"WITH {_SINGLE} SELECT ord AS op_id, {list(SYMBOL_KINDS)}[ord % {len(SYMBOL_KINDS)} + 1] AS kind, path, name AS symbol, CASE WHEN {list(SYMBOL_KINDS)}[ord % {len(SYMBOL_KINDS)} + 1] <> 'delete_symbol' THEN content END AS content, hash AS expected FROM single")
def compile_edit(rel):
    """Arguments of an edit (kind, symbol, text) as rows of a plan, with the hash that guards them."""
    kind = F.element_at(F.array(*map(F.lit, SYMBOL_KINDS)), (F.col("ord") % len(SYMBOL_KINDS) + 1).cast("int"))
    rows = single(rel).withColumn("kind", kind)
    content = F.when(F.col("kind") != "delete_symbol", F.concat(F.lit("new "), F.col("ord")))
    return rows.select(F.col("ord").alias("op_id"), "kind", "path", F.col("name").alias("symbol"), content.alias("content"), F.col("hash").alias("expected"))


@report("files symbols", "SELECT f.path, s.name AS symbol, 'replace_symbol' AS kind, f.hash AS expected, s.line, s.line_end FROM symbols s JOIN files f USING (file_id) WHERE lower(s.name) LIKE '%red%'")
def ops_skeleton(rel, query: str = "red"):
    """A plan's first draft: an operation for each symbol that a query finds."""
    found = rel.symbols.filter(F.contains(F.lower("name"), F.lit(query.lower()))).join(rel.files.select("file_id", "path", "hash"), "file_id")
    return found.select("path", F.col("name").alias("symbol"), F.lit("replace_symbol").alias("kind"), F.col("hash").alias("expected"), "line", "line_end")


@report("files", "SELECT command, count(*) AS files FROM (SELECT CASE string_split(path, '.')[-1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHECKS.items()) + f" ELSE 'none' END AS command FROM files WHERE ord % {len(KINDS)} > 3) GROUP BY command")
def ops_verify(rel):
    """What to run after a plan, by the files it touches."""
    end = F.substring_index("path", ".", -1)
    command = F.coalesce(*[F.when(end == k, F.lit(v)) for k, v in CHECKS.items()], F.lit("none"))
    return rel.files.filter(F.col("ord") % len(KINDS) > 3).groupBy(command.alias("command")).agg(F.count(F.lit(1)).alias("files"))
