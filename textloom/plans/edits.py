"""Edits as data: a plan over all files, checked, applied and summed up; splices of symbols and ranges.

``textloom.plans.ops`` has the operations; here they are bound to the relations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import line_array
from textloom.operators.catalog import report
from textloom.plans.ops import KINDS, LINK_KINDS, OK, RANGE_KINDS, SYMBOL_KINDS, apply_ops, check_ops
from textloom.session import cut


def splice(lines: Column, start: Column, stop: Column, new: Column) -> Column:
    """The lines with [start, stop] (from 1, inclusive; stop < start inserts) replaced by ``new``."""
    head = F.slice(lines, F.lit(1), start - 1)
    tail = F.filter(lines, lambda x, i: i >= F.greatest(stop, start - 1))
    return F.concat(head, new, tail)


def operations(rel) -> DataFrame:
    """A plan over the files: one operation for each document, of every kind in turn, some of them wrong."""
    names = rel.symbols.groupBy("file_id").agg(F.min_by("name", "ord").alias("name"))
    f = rel.files.join(names, "file_id", "left")
    ord_, path = F.col("ord"), F.col("path")
    every = lambda n, k=0: ord_ % n == k
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (ord_ % len(KINDS) + 1).cast("int"))
    made = F.concat(F.lit("new/n"), ord_, F.lit(".txt"))
    of = lambda *k: F.col("kind").isin(*k)
    first, third = (F.substring(F.get(line_array("text"), F.lit(i)), 1, 5) for i in (0, 2))
    rows = f.withColumn("kind", kind).withColumn("at", path)
    where = (
        F.when(of("create_file") & ~every(11), made)
        .when(of("copy_file") & every(3), F.concat(F.lit("new/n"), ord_ - 4, F.lit(".txt")))
        .when(of("delete_dir") & every(2), F.substring_index("at", "/", 4))
        .when(of("assert_symbol_absent", "assert_text_absent") & every(3), F.lit(None))
        .when(every(11), F.concat("at", F.lit(".missing")))
        .when(every(17), F.concat(F.lit("../"), "at"))
        .otherwise(F.col("at"))
    )
    name = F.when(every(19), "nosuch").otherwise(F.col("name"))
    return rows.select(
        ord_.alias("op_id"), "kind", where.alias("path"),
        F.when(of(*LINK_KINDS), F.when(every(5), F.col("at")).otherwise(F.concat("at", F.lit(".to")))).alias("target"),
        F.when(of("replace_field_access"), F.when(every(4), "nodot").otherwise(". ")).when(of("assert_text_absent"), F.when(every(2), "@nowhere@").otherwise("e")).otherwise(first).alias("find"),
        third.alias("until"), F.concat(F.lit("new "), ord_).alias("content"), F.lit(2).cast("bigint").alias("start"), (ord_ % 3 + 2).alias("stop"),
        F.when(of(*SYMBOL_KINDS, "delete_symbol_if_exists", "assert_symbol_absent"), name).alias("symbol"),
        F.when(of("replace_text") & every(4), F.col("name")).alias("scope"),
        F.when(every(5), "ffffffff").when(~every(5, 1), F.col("hash")).alias("expected"),
        F.when(of(*RANGE_KINDS) & every(7), "@nowhere@").alias("before"),
        F.when(of("replace_text", "replace_field_access") & every(3), F.lit(1)).alias("count"),
        (of("create_file") & every(2)).alias("overwrite"), F.lit(False).alias("recursive"), every(2).alias("strict"),
    )


_L = r"CASE WHEN own = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace(own, '\n\z', ''), '\r?\n') END"


def _sql_in(kinds) -> str:
    return "kind IN (" + ", ".join(f"'{k}'" for k in kinds) + ")"


_OPS = f"""plan_names AS (SELECT file_id, min_by(name, ord) AS name FROM symbols GROUP BY file_id),
plan_rows AS (SELECT f.*, n.name, {list(KINDS)}[ord % {len(KINDS)} + 1] AS kind, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace(text, '\\n\\z', ''), '\\r?\\n') END AS l
  FROM files f LEFT JOIN plan_names n USING (file_id)),
ops AS (SELECT ord AS op_id, kind, CASE WHEN kind = 'create_file' AND ord % 11 <> 0 THEN 'new/n'||ord||'.txt' WHEN kind = 'copy_file' AND ord % 3 = 0 THEN 'new/n'||(ord - 4)||'.txt'
    WHEN kind = 'delete_dir' AND ord % 2 = 0 THEN array_to_string(string_split(path, '/')[1:4], '/') WHEN kind IN ('assert_symbol_absent', 'assert_text_absent') AND ord % 3 = 0 THEN NULL
    WHEN ord % 11 = 0 THEN path||'.missing' WHEN ord % 17 = 0 THEN '../'||path ELSE path END AS path,
  CASE WHEN {_sql_in(LINK_KINDS)} THEN CASE WHEN ord % 5 = 0 THEN path ELSE path||'.to' END END AS target,
  CASE WHEN kind = 'replace_field_access' THEN CASE WHEN ord % 4 = 0 THEN 'nodot' ELSE '. ' END WHEN kind = 'assert_text_absent' THEN CASE WHEN ord % 2 = 0 THEN '@nowhere@' ELSE 'e' END ELSE substr(l[1], 1, 5) END AS find,
  substr(l[3], 1, 5) AS until, 'new '||ord AS content, 2 AS start, ord % 3 + 2 AS stop,
  CASE WHEN {_sql_in((*SYMBOL_KINDS, 'delete_symbol_if_exists', 'assert_symbol_absent'))} THEN CASE WHEN ord % 19 = 0 THEN 'nosuch' ELSE name END END AS symbol,
  CASE WHEN kind = 'replace_text' AND ord % 4 = 0 THEN name END AS scope, CASE WHEN ord % 5 = 0 THEN 'ffffffff' WHEN ord % 5 <> 1 THEN hash END AS expected,
  CASE WHEN {_sql_in(RANGE_KINDS)} AND ord % 7 = 0 THEN '@nowhere@' END AS before, CASE WHEN kind IN ('replace_text', 'replace_field_access') AND ord % 3 = 0 THEN 1 END AS n_want,
  kind = 'create_file' AND ord % 2 = 0 AS overwrite, ord % 2 = 0 AS strict FROM plan_rows)"""
_MADE = """events AS (SELECT op_id, path, kind IN ('create_file', 'replace_file') AS there FROM ops WHERE kind IN ('create_file', 'replace_file', 'delete_file', 'move_file', 'rename_file')
  UNION ALL SELECT op_id, target, true FROM ops WHERE target IS NOT NULL)"""
_STATE = _OPS + ", " + _MADE + f""", named AS (SELECT f.path, s.name, count(*) AS s_n, arg_min(struct_pack(a := s.line, b := s.line_end, o := s.body_open_line, c := s.body_close_line), s.line * 1000000 + s.line_end) AS s
  FROM symbols s JOIN files f USING (file_id) GROUP BY ALL),
st AS (SELECT o.*, f.text AS own, f.hash AS digest, t.path IS NOT NULL AS target_there, coalesce(m.s_n, 0) AS s_n, m.s.a AS s_line, m.s.b AS s_end, m.s.o AS s_open, m.s.c AS s_close,
    coalesce((SELECT arg_max(e.there, e.op_id) FROM events e WHERE e.path = o.path AND e.op_id < o.op_id), false) AS virtual,
    o.kind IN ('create_dir', 'delete_dir') AND EXISTS (SELECT 1 FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS folder FROM files, range(1, 8) t(k) WHERE k < len(string_split(path, '/'))) x WHERE x.folder = o.path) AS is_folder,
    CASE WHEN o.path IS NOT NULL THEN 0 WHEN kind = 'assert_symbol_absent' THEN (SELECT count(*) FROM symbols y WHERE y.name = o.symbol)
      WHEN kind = 'assert_text_absent' THEN CASE o.find WHEN 'e' THEN (SELECT sum(length(z.text) - length(replace(z.text, 'e', ''))) FROM files z) ELSE (SELECT sum((length(z.text) - length(replace(z.text, '@nowhere@', ''))) // 9) FROM files z) END ELSE 0 END AS found
  FROM ops o LEFT JOIN files f ON f.path = o.path LEFT JOIN files t ON t.path = o.target LEFT JOIN named m ON m.path = o.path AND m.name = coalesce(o.scope, o.symbol)),
lined AS (SELECT *, {_L} AS l, string_split(own, chr(10)) AS raw, CASE WHEN contains(own, find) THEN find WHEN contains(own, replace(find, chr(10), chr(13)||chr(10))) THEN replace(find, chr(10), chr(13)||chr(10)) END AS hit FROM st),
parts AS (SELECT *, CASE WHEN scope IS NULL THEN '' ELSE array_to_string(raw[1:s_line - 1], chr(10)) || CASE WHEN s_line = 1 OR s_line > len(raw) THEN '' ELSE chr(10) END END AS p_head,
  CASE WHEN scope IS NULL THEN own ELSE array_to_string(raw[s_line:s_end], chr(10)) || CASE WHEN s_end >= len(raw) THEN '' ELSE chr(10) END END AS p_in,
  CASE WHEN scope IS NULL THEN '' ELSE array_to_string(raw[s_end + 1:], chr(10)) END AS p_tail,
  list_filter(range(1, len(l) + 1), lambda i: contains(l[i], find))[1] AS a1 FROM lined),
ready AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: i > a1 AND contains(l[i], until))[1] AS a2,
  CASE WHEN length(hit) > 0 THEN (length(CASE WHEN kind = 'replace_text' THEN p_in ELSE own END) - length(replace(CASE WHEN kind = 'replace_text' THEN p_in ELSE own END, hit, ''))) // length(hit) END AS n,
  coalesce((length(own) - length(replace(own, find, ''))) // length(find), 0) AS n_field FROM parts)"""
_NEEDS = ("append_to_file", "delete_file", *RANGE_KINDS, "replace_between_anchors", *SYMBOL_KINDS, "delete_symbol_if_exists", "insert_before_text", "insert_after_text", "replace_text", "insert_before_anchor", "insert_after_anchor")
_HASHED = ("replace_file", "append_to_file", "delete_file", *LINK_KINDS, *RANGE_KINDS, "replace_between_anchors", *SYMBOL_KINDS, "delete_symbol_if_exists")
_VERDICT = f"""CASE WHEN path = '' OR starts_with(path, '/') OR regexp_matches(path, '(^|/)[.][.](/|$)') OR regexp_matches(target, '(^|/)[.][.](/|$)') THEN 'unsafe path'
  WHEN {_sql_in((*RANGE_KINDS, *SYMBOL_KINDS))} AND strict AND expected IS NULL AND before IS NULL THEN 'no guard'
  WHEN kind = 'create_file' AND own IS NOT NULL AND NOT overwrite THEN 'file exists'
  WHEN kind = 'replace_file' AND own IS NULL AND expected IS NOT NULL THEN 'missing file' WHEN {_sql_in(_NEEDS)} AND own IS NULL THEN 'missing file'
  WHEN kind IN ('assert_symbol_absent', 'assert_text_absent', 'replace_field_access') AND path IS NOT NULL AND own IS NULL THEN 'missing file'
  WHEN {_sql_in(LINK_KINDS)} AND own IS NULL AND (expected IS NOT NULL OR NOT virtual) THEN 'missing file'
  WHEN {_sql_in(_HASHED)} AND own IS NOT NULL AND expected <> digest THEN 'hash differs' WHEN {_sql_in(LINK_KINDS)} AND target_there THEN 'target exists'
  WHEN kind IN ('create_dir', 'delete_dir') AND own IS NOT NULL THEN 'not a folder' WHEN kind = 'delete_dir' AND NOT is_folder THEN 'missing folder' WHEN kind = 'delete_dir' THEN 'folder not empty'
  WHEN kind IN ('insert_before_text', 'insert_after_text', 'replace_text') AND hit IS NULL THEN 'text not found' WHEN kind = 'replace_text' AND scope IS NOT NULL AND s_n = 0 THEN 'symbol not found'
  WHEN kind = 'replace_text' AND n_want <> n THEN 'count differs' WHEN kind = 'replace_text' AND n = 0 THEN 'text not found'
  WHEN kind IN ('insert_before_text', 'insert_after_text', 'replace_text') AND strict AND n_want IS NULL AND n > 1 THEN 'text ambiguous'
  WHEN kind = 'replace_field_access' AND NOT contains(find, '.') THEN 'no dotted name' WHEN kind = 'replace_field_access' AND n_want <> n_field THEN 'count differs'
  WHEN kind = 'replace_field_access' AND n_want IS NULL AND n_field = 0 THEN 'text not found' WHEN kind = 'replace_field_access' AND n_want IS NULL AND strict AND n_field > 1 THEN 'text ambiguous'
  WHEN {_sql_in(RANGE_KINDS)} AND stop > len(l) THEN 'range outside file' WHEN {_sql_in(RANGE_KINDS)} AND before IS NOT NULL AND NOT contains(array_to_string(l[1:start - 1], chr(10)), before) THEN 'context not found'
  WHEN kind IN ('insert_before_anchor', 'insert_after_anchor') AND NOT contains(own, find) THEN 'anchor not found' WHEN kind = 'replace_between_anchors' AND (a1 IS NULL OR a2 IS NULL) THEN 'anchor not found'
  WHEN {_sql_in(SYMBOL_KINDS)} AND s_n = 0 THEN 'symbol not found' WHEN {_sql_in((*SYMBOL_KINDS, 'delete_symbol_if_exists'))} AND s_n > 1 THEN 'symbol ambiguous'
  WHEN kind = 'replace_method_body' AND s_open IS NULL THEN 'no body' WHEN kind = 'replace_method_body' AND s_close <= s_open THEN 'bad range'
  WHEN kind = 'assert_symbol_absent' AND CASE WHEN path IS NULL THEN found > 0 ELSE contains(own, symbol) END THEN 'symbol found'
  WHEN kind = 'assert_text_absent' AND CASE WHEN path IS NULL THEN found > 0 ELSE contains(own, find) END THEN 'text found' ELSE 'ok' END"""


def _sql_text(lines: str) -> str:
    return f"(CASE WHEN len({lines}) = 0 THEN '' ELSE array_to_string({lines}, chr(10)) || chr(10) END)"


def _sql_lines(start: str, stop: str, new: bool = True) -> str:
    """The text with lines replaced by the content, or without them."""
    place = f"CASE WHEN {start} <= len(l) THEN [content] ELSE [] END" if new else "[]::VARCHAR[]"
    return _sql_text(f"list_concat(list_concat(l[1:{start} - 1], {place}), l[greatest({start}, {stop} + 1):])")


def _sql_insert(line: str) -> str:
    return _sql_text(f"list_concat(list_concat(l[1:{line} - 1], [content]), l[{line}:])")


def _sql_first(text: str, find: str, new: str) -> str:
    return f"(CASE WHEN strpos({text}, {find}) = 0 THEN {text} ELSE substr({text}, 1, strpos({text}, {find}) - 1) || {new} || substr({text}, strpos({text}, {find}) + length({find})) END)"


_EDITED = f"""CASE kind WHEN 'create_file' THEN content WHEN 'replace_file' THEN content WHEN 'append_to_file' THEN own || CASE WHEN own LIKE '%' || chr(10) THEN '' ELSE chr(10) END || content || chr(10)
  WHEN 'insert_before_text' THEN {_sql_first('own', 'hit', "content || chr(10) || hit")} WHEN 'insert_after_text' THEN {_sql_first('own', 'hit', "hit || chr(10) || content || chr(10)")}
  WHEN 'replace_text' THEN p_head || CASE WHEN n_want IS NULL THEN {_sql_first('p_in', 'hit', 'content')} ELSE replace(p_in, hit, content) END || p_tail
  WHEN 'replace_field_access' THEN CASE WHEN n_want IS NULL THEN {_sql_first('own', 'find', 'content')} ELSE replace(own, find, content) END
  WHEN 'replace_range' THEN {_sql_lines('start', 'stop')} WHEN 'delete_range' THEN {_sql_lines('start', 'stop', False)}
  WHEN 'insert_before_anchor' THEN {_sql_first('own', 'find', "content || chr(10) || find")} WHEN 'insert_after_anchor' THEN {_sql_first('own', 'find', "find || chr(10) || content")}
  WHEN 'replace_between_anchors' THEN CASE WHEN a2 > a1 + 1 THEN {_sql_lines('(a1 + 1)', '(a2 - 1)')} ELSE {_sql_insert('a2')} END
  WHEN 'replace_symbol' THEN {_sql_lines('s_line', 's_end')} WHEN 'delete_symbol' THEN {_sql_lines('s_line', 's_end', False)}
  WHEN 'delete_symbol_if_exists' THEN CASE WHEN s_n > 0 THEN {_sql_lines('s_line', 's_end', False)} ELSE own END
  WHEN 'insert_before_symbol' THEN {_sql_insert('s_line')} WHEN 'insert_after_symbol' THEN {_sql_insert('(s_end + 1)')} WHEN 'replace_method_body' THEN {_sql_lines('(s_open + 1)', '(s_close - 1)')}
  WHEN 'copy_file' THEN coalesce(own, 'new '||(op_id - 4)) END"""


@report("files symbols", f"WITH {_OPS} SELECT kind, count(*) AS n FROM ops GROUP BY kind")
def ops_preview(rel):
    return operations(rel).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@report("files symbols changed", f"WITH {_STATE} SELECT op_id, kind, path, {_VERDICT} AS verdict FROM ready")
def ops_check(rel):
    """A verdict on every operation; the first rule it breaks."""
    return check_ops(operations(rel), rel.files, rel.symbols, rel.changed)


@report("files symbols changed", f"""WITH {_STATE}, good AS (SELECT * FROM ready WHERE {_VERDICT} = 'ok' AND kind NOT IN ('create_dir', 'delete_dir', 'assert_symbol_absent', 'assert_text_absent')),
after AS (SELECT path, {_EDITED} AS text FROM good UNION SELECT target, coalesce(own, 'new '||(op_id - 4)) FROM good WHERE target IS NOT NULL)
SELECT path, text, NULL::VARCHAR AS failed FROM after""")
def ops_apply(rel):
    """Every path that the operations without a fault touch, with its text afterwards."""
    ops = cut(operations(rel))
    good = check_ops(ops, rel.files, rel.symbols, rel.changed).filter(F.col("verdict") == OK).select("op_id")
    return apply_ops(ops.join(good, "op_id"), rel.files, rel.symbols, rel.changed)


@report("files symbols", f"WITH {_OPS} SELECT array_to_string(string_split(path, '/')[1:4], '/') AS area, count(*) AS n, count(DISTINCT kind) AS kinds FROM ops GROUP BY area")
def ops_split(rel):
    area = F.substring_index("path", "/", 4)
    return operations(rel).groupBy(area.alias("area")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("kinds"))


@report("files symbols", f"WITH {_OPS} SELECT array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(DISTINCT path) AS paths FROM ops")
def ops_summary(rel):
    return operations(rel).agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.countDistinct("path").alias("paths"))


@report("files", """SELECT path, array_to_string(list_concat(list_concat(a[1:1], ['new '||ord]), a[4:]), chr(10)) AS edited FROM (SELECT path, ord, string_split_regex(regexp_replace(text, '\\n\\z', ''), '\\r?\\n') AS a FROM files WHERE text <> '') WHERE len(a) >= 3""")
def replace_range(rel):
    a = rel.files.filter("text <> ''").select("path", "ord", line_array("text").alias("a")).filter(F.size("a") >= 3)
    new = F.array(F.concat(F.lit("new "), "ord"))
    return a.select("path", F.array_join(splice(F.col("a"), F.lit(2), F.lit(3), new), "\n").alias("edited"))


@report("files symbols", """SELECT s.ord, array_to_string(list_concat(list_concat(a[1:line - 1], ['// '||name]), a[line:]), chr(10)) AS edited FROM (SELECT file_id, string_split_regex(regexp_replace(text, '\\n\\z', ''), '\\r?\\n') AS a FROM files WHERE text <> '') JOIN symbols s USING (file_id) WHERE s.line <= len(a) AND s.line >= 1 AND s.kind = 'fn'""")
def insert_before_symbol(rel):
    a = rel.files.filter("text <> ''").select("file_id", line_array("text").alias("a"))
    rows = rel.symbols.filter("kind = 'fn' AND line >= 1").join(a, "file_id").filter(F.col("line") <= F.size("a"))
    start = F.col("line").cast("int")
    return rows.select("ord", F.array_join(splice(F.col("a"), start, start - 1, F.array(F.concat(F.lit("// "), "name"))), "\n").alias("edited"))


FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(values: list[bytes]) -> list[str]:
    """The first eight hex digits of the 64-bit FNV-1a hash (fixed constants) of each value, a byte of all at a time."""
    length = np.array([len(v) for v in values], np.int64)
    width = int(length.max(initial=0))
    raw = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width).astype(np.uint64)
    h = np.full(len(values), FNV_START, np.uint64)
    for j in range(width):
        h = np.where(j < length, (h ^ raw[:, j]) * np.uint64(FNV_PRIME), h)
    return [f"{x:016x}"[:8] for x in h.tolist()]


@report("files", f"""SELECT path, substr(lpad(lower(to_hex(list_reduce(list_prepend({FNV_START}::UHUGEINT, list_transform(regexp_extract_all(hex(encode(path)), '..'), lambda x: ('0x' || x)::UHUGEINT)),
  lambda h, b: (xor(h, b) * {FNV_PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)), 16, '0'), 1, 8) AS hash FROM files""")
def fnv_hash(rel):
    """Short hashes of paths; 64-bit products overflow SQL integers, so Arrow batches go through numpy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "hash": fnv1a([p.encode() for p in b["path"]])})

    return rel.files.select("path").mapInPandas(run, "path string, hash string")


@report("files symbols", f"WITH {_OPS} SELECT op_id, path, count(*) OVER (PARTITION BY path ORDER BY op_id) AS nth_of_path FROM ops")
def ops_sequence(rel):
    """The place of each operation among those of its path: later ones see the files of earlier ones."""
    return operations(rel).select("op_id", "path", F.count(F.lit(1)).over(Window.partitionBy("path").orderBy("op_id")).alias("nth_of_path"))
