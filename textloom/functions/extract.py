"""What source text declares: exports, imports, commands, handlers, registry ids, fields. Rows from lines, by patterns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import line_array, lines

#: How an export begins, the characters its name ends at, and its kind (fixed values).
EXPORTS = (
    ("export function ", "[(:=<{]", "named"), ("export const ", "[=:; ]", "named"), ("export type ", "[<=: ]", "named"),
    ("export interface ", "[< ]", "named"), ("export default ", "[ (]", "default"),
)
TS_FROM = r"""^\s*(?:import|export)\s+.*?\s+from\s+["']([^"']+)["']"""
TS_BARE = r"""^\s*import\s+["']([^"']+)["']"""
RUST_USE = r"^\s*use\s+([^;\n]+);"
RUST_MOD = r"^\s*(?:pub\s+)?mod\s+([A-Za-z0-9_]+)"
ATTRIBUTE, FUNCTION = "#[tauri::command]", r"\bfn\s+([A-Za-z0-9_]+)"
PANEL = r"""propertyPanel\(\s*["']([A-Za-z0-9_.-]+)["']"""
PROPERTY = r"""(?:id|kind|type)\s*:\s*["']([A-Za-z0-9_.-]+)["']"""
COMPONENT = r"""id:\s*["']([A-Za-z0-9_.-]+)["']"""
FIELD = r"^\s*([A-Za-z0-9_]+)\??\s*:"


def exports(files: DataFrame, *keep: str) -> DataFrame:
    """Kept columns, line_no, name, kind of every export."""
    bare = F.trim("line")
    found = [F.when(bare.startswith(head), F.struct(F.trim(F.get(F.split(F.substring(bare, len(head) + 1, 1 << 20), cut), F.lit(0))).alias("name"), F.lit(kind).alias("kind"))) for head, cut, kind in EXPORTS]
    found.append(F.when(bare.startswith("pub use "), F.struct(F.lit("pub use").alias("name"), F.lit("reexport").alias("kind"))))
    rows = lines(files, *keep).select(*keep, "line_no", F.coalesce(*found).alias("e")).filter("e IS NOT NULL")
    return rows.select(*keep, "line_no", "e.name", "e.kind")


def imports(files: DataFrame, *keep: str) -> DataFrame:
    """Kept columns, line_no, specifier, kind (module, use, mod) of every import."""
    got = lambda pattern, kind: F.when(F.col("line").rlike(pattern), F.struct(F.trim(F.regexp_extract("line", pattern, 1)).alias("specifier"), F.lit(kind).alias("kind")))
    rows = lines(files, *keep).select(*keep, "line_no", F.coalesce(got(TS_FROM, "module"), got(TS_BARE, "module"), got(RUST_USE, "use"), got(RUST_MOD, "mod")).alias("i"))
    return rows.filter("i IS NOT NULL").select(*keep, "line_no", "i.specifier", "i.kind")


def import_block(files: DataFrame, *keep: str) -> DataFrame:
    """The lines of the block of imports that a file begins with, blank ones left out."""
    bare = F.trim("line")
    inside = (bare == "") | bare.startswith("import ") | bare.startswith("use ") | bare.startswith("mod ") | bare.startswith("pub mod ")
    before = Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines(files, *keep).withColumn("all", F.bool_and(inside).over(before)).filter(F.col("all") & (bare != "")).drop("all")


def commands(files: DataFrame, *keep: str) -> DataFrame:
    """Functions that stand below a command attribute: the first after each."""
    before = Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark, name = F.contains("line", F.lit(ATTRIBUTE)), F.nullif(F.regexp_extract("line", FUNCTION, 1), F.lit(""))
    rows = lines(files, *keep).select(*keep, "line_no", mark.alias("mark"), F.when(~mark, name).alias("name"))
    rows = rows.withColumn("part", F.sum(F.col("mark").cast("int")).over(before)).filter("part > 0 AND name IS NOT NULL")
    return rows.groupBy(*keep, "part").agg(F.min_by("name", "line_no").alias("name"), F.min("line_no").alias("line_no")).drop("part")


def handlers(text: Column) -> Column:
    """The names that a handler list registers, without their modules."""
    inner = F.regexp_extract(text, r"generate_handler!\[([^\]]*)\]", 1)
    names = F.transform(F.split(inner, ","), lambda x: F.substring_index(F.regexp_replace(x, r"^\s+|\s+$", ""), "::", -1))
    return F.filter(names, lambda x: x != "")


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def depth(line: Column) -> Column:
    """Braces that a line opens, less those it closes."""
    return F.length(F.regexp_replace(line, r"[^{]", "")) - F.length(F.regexp_replace(line, r"[^}]", ""))


def component_ids(files: DataFrame, *keep: str) -> DataFrame:
    """Ids of the components listed at the top level: braces are counted from the line that opens the list to that which ends it."""
    line, order = F.col("line"), Window.partitionBy(*keep).orderBy("line_no")
    until, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.contains(line, F.lit("builtinEditorComponents")) | F.contains(line, F.lit("EDITOR_COMPONENTS"))
    rows = lines(files, *keep).withColumn("inside", F.bool_or(opens).over(until)).filter("inside")
    rows = rows.withColumns({"at": F.coalesce(F.sum(depth(line)).over(before), F.lit(0)), "after": F.sum(depth(line)).over(until)})
    ends = (F.col("after") <= 0) & F.contains(line, F.lit("];"))
    rows = rows.withColumn("over", F.coalesce(F.bool_or(ends).over(before), F.lit(False))).filter("NOT over")
    bare = F.ltrim("line")
    listed = ((F.col("at") == 1) & bare.startswith("id:")) | ((F.col("at") == 0) & bare.startswith("{ id:"))
    return rows.filter(listed).select(*keep, "line_no", F.regexp_extract("line", COMPONENT, 1).alias("id")).filter("id <> ''")


def type_fields(text: Column, name: str) -> Column:
    """Fields of an interface or type, nested bodies included, up to the brace that closes it."""
    start = F.when(F.contains(text, F.lit(f"interface {name}")), F.instr(text, F.lit(f"interface {name}"))).otherwise(F.instr(text, F.lit(f"type {name}")))
    rest = F.when(start > 0, F.substr(text, start))
    rest = F.substr(rest, F.nullif(F.instr(rest, F.lit("{")), F.lit(0)))
    # braces after each character of a brace: the part before the one that closes the first
    parts = F.split(rest, r"(?<=[{}])")
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("body"), F.lit(False).alias("over"))

    def step(acc: Column, part: Column) -> Column:
        now = acc["depth"] + depth(part)
        over = acc["over"] | (now == 0)
        text_ = F.regexp_replace(part, r"\}$", "")
        body = F.when(acc["over"], acc["body"]).when(acc["depth"] == 0, "").otherwise(F.concat(acc["body"], F.when(over, text_).otherwise(part)))
        return F.struct(now.alias("depth"), body.alias("body"), over.alias("over"))

    body = F.aggregate(parts, zero, step)["body"]
    fields = F.transform(line_array(body), lambda x: F.regexp_extract(x, FIELD, 1))
    return F.coalesce(F.filter(fields, lambda x: x != ""), F.array().cast("array<string>"))
