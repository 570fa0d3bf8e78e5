"""Reports on what source text declares, over a page of code laid out for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import extract as X
from textloom.operators.catalog import report

#: Lines of the page; {n} is the document's number, {m} that of the one before it.
PAGE = (
    "import {{ a }} from './m{m}'", "import './side{n}'", "", "use crate::store{m}::Item;", "pub mod part{n};", "export function build{n}(x) {{", "}}", "export const TOP{n} = 1;",
    "export type Kind{n}<T> = T;", "export interface Shape{n} {{", "  first: string;", "  nested?: {{ inner{n}: number }};", "  last{n}?: number;", "}}", "export default main{n}", "pub use self::inner;",
    "#[tauri::command]", "// note", "pub async fn run_{n}(x: u32) {{", "}}", "fn plain_{n}() {{}}", "#[tauri::command] pub fn skipped() {{}}", "fn after_{n}() {{}}",
    "generate_handler![commands::run_{n}, run_{m} ,", " other::late]", "propertyPanel('panel-{m}', x)", "const one = {{ kind: \"k.{n}\", type : 'T' }};", "const builtinEditorComponents = [",
    "  {{ id: 'c{n}', y: 1 }},", "  {{", "    id: \"d{n}\",", "    tools: [{{ id: 'nested' }}],", "  }},", "];", "  id: 'late',",
)


def pages(rel) -> DataFrame:
    """ord, text: the page of each document, every seventh without its imports and every fifth without its last lines."""
    n = F.col("doc_id").cast("string")
    m = F.greatest(F.col("doc_id") - 1, F.lit(0)).cast("string")
    text = "\n".join(PAGE).replace("{{", "{").replace("}}", "}")
    whole = F.replace(F.replace(F.lit(text), F.lit("{n}"), n), F.lit("{m}"), m)
    whole = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace(whole, r"^(?:.*\n){2}", "// head\n")).otherwise(whole)
    whole = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace(whole, r"(?s)\nconst builtin.*$", "")).otherwise(whole)
    return rel.read("documents").select(F.col("doc_id").alias("ord"), whole.alias("text"))


_TEXT = "\n".join(PAGE).replace("{{", "{").replace("}}", "}").replace("'", "''")
_PAGES = f"""pages_of AS (SELECT doc_id AS ord, replace(replace('{_TEXT}', '{{n}}', doc_id::VARCHAR), '{{m}}', greatest(doc_id - 1, 0)::VARCHAR) AS t FROM documents),
cut_of AS (SELECT ord, CASE WHEN ord % 7 = 0 THEN '// head' || chr(10) || array_to_string(string_split(t, chr(10))[3:], chr(10)) ELSE t END AS t FROM pages_of),
code AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN array_to_string(string_split(t, chr(10))[1:len(string_split(t, chr(10))) - 8], chr(10)) ELSE t END AS text FROM cut_of),
code_lines AS (SELECT ord, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM code)"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


@report("", f"""WITH {_PAGES} SELECT ord, line_no, name, kind FROM (SELECT ord, line_no, CASE {" ".join(f"WHEN starts_with(trim(line), '{h}') THEN trim(string_split_regex(substr(trim(line), {len(h) + 1}), '{c}')[1])" for h, c, _ in X.EXPORTS)} WHEN starts_with(trim(line), 'pub use ') THEN 'pub use' END AS name,
  CASE WHEN starts_with(trim(line), 'pub use ') THEN 'reexport' WHEN starts_with(trim(line), 'export default ') THEN 'default' ELSE 'named' END AS kind FROM code_lines) WHERE name IS NOT NULL""")
def exports(rel):
    return X.exports(pages(rel), "ord")


@report("", f"""WITH {_PAGES} SELECT ord, line_no, trim(CASE kind WHEN 'a' THEN regexp_extract(line, '{_quoted(X.TS_FROM)}', 1) WHEN 'b' THEN regexp_extract(line, '{_quoted(X.TS_BARE)}', 1) WHEN 'use' THEN regexp_extract(line, '{X.RUST_USE}', 1) ELSE regexp_extract(line, '{X.RUST_MOD}', 1) END) AS specifier,
  CASE WHEN kind IN ('a', 'b') THEN 'module' ELSE kind END AS kind FROM (SELECT *, CASE WHEN regexp_matches(line, '{_quoted(X.TS_FROM)}') THEN 'a' WHEN regexp_matches(line, '{_quoted(X.TS_BARE)}') THEN 'b' WHEN regexp_matches(line, '{X.RUST_USE}') THEN 'use' WHEN regexp_matches(line, '{X.RUST_MOD}') THEN 'mod' END AS kind FROM code_lines) WHERE kind IS NOT NULL""")
def source_imports(rel):
    return X.imports(pages(rel), "ord")


@report("", f"""WITH {_PAGES} SELECT ord, line_no, line FROM (SELECT *, bool_and(trim(line) = '' OR regexp_matches(trim(line), '^(import|use|mod|pub mod) ')) OVER (PARTITION BY ord ORDER BY line_no) AS inside FROM code_lines) WHERE inside AND trim(line) <> ''""")
def import_blocks(rel):
    return X.import_block(pages(rel), "ord")


_COMMANDS = f"""marked_of AS (SELECT *, contains(line, '{X.ATTRIBUTE}') AS mark, sum(contains(line, '{X.ATTRIBUTE}')::INT) OVER (PARTITION BY ord ORDER BY line_no) AS part FROM code_lines),
commands_of AS (SELECT ord, arg_min(regexp_extract(line, '\\bfn\\s+([A-Za-z0-9_]+)', 1), line_no) AS name, min(line_no) AS line_no FROM marked_of WHERE part > 0 AND NOT mark AND regexp_matches(line, '\\bfn\\s+[A-Za-z0-9_]+') GROUP BY ord, part)"""
_HANDLERS = """handlers_of AS (SELECT ord, unnest(list_filter(list_transform(string_split(regexp_extract(text, 'generate_handler!\\[([^\\]]*)\\]', 1), ','), lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^.*::', '')), lambda x: x <> '')) AS name FROM code)"""


@report("", f"WITH {_PAGES}, {_COMMANDS} SELECT ord, name, line_no FROM commands_of")
def command_functions(rel):
    return X.commands(pages(rel), "ord")


@report("", f"""WITH {_PAGES}, {_COMMANDS}, {_HANDLERS} SELECT name, 'not registered' AS side FROM commands_of WHERE name NOT IN (SELECT name FROM handlers_of)
  UNION ALL SELECT DISTINCT name, 'not defined' FROM handlers_of WHERE name NOT IN (SELECT name FROM commands_of)""")
def unmatched_commands(rel):
    """Commands that no handler list registers, and registered names that no file defines."""
    code = pages(rel)
    defined, listed = X.commands(code, "ord").select("name"), code.select(F.explode(X.handlers(F.col("text"))).alias("name"))
    return defined.join(listed, "name", "left_anti").withColumn("side", F.lit("not registered")).unionByName(
        listed.distinct().join(defined, "name", "left_anti").withColumn("side", F.lit("not defined"))
    )


@report("", f"""WITH {_PAGES} SELECT ord, 'panel' AS kind, unnest(regexp_extract_all(text, '{_quoted(X.PANEL)}', 1)) AS id FROM code UNION ALL SELECT ord, 'property', unnest(regexp_extract_all(text, '{_quoted(X.PROPERTY)}', 1)) FROM code""")
def registry_properties(rel):
    code = pages(rel)
    each = lambda kind, pattern: code.select("ord", F.lit(kind).alias("kind"), F.explode(X.all_of(F.col("text"), pattern)).alias("id"))
    return each("panel", X.PANEL).unionByName(each("property", X.PROPERTY))


@report("", f"WITH {_PAGES} SELECT ord, unnest(CASE WHEN ord % 5 = 0 THEN []::VARCHAR[] ELSE ['c' || ord, 'd' || ord] END) AS id FROM code")
def component_ids(rel):
    """The ids of top-level components only: neither nested ones nor those after the list."""
    return X.component_ids(pages(rel), "ord").select("ord", "id")


@report("", f"WITH {_PAGES} SELECT ord, CASE WHEN ord = 3 THEN 'first,nested,last3' WHEN ord BETWEEN 30 AND 39 OR ord BETWEEN 300 AND 399 OR ord BETWEEN 3000 AND 3999 OR ord BETWEEN 30000 AND 39999 THEN 'first,nested,last' || ord ELSE '' END AS fields FROM code")
def type_fields(rel):
    """Fields of the types whose names begin with one given name."""
    return pages(rel).select("ord", F.array_join(X.type_fields(F.col("text"), "Shape3"), ",").alias("fields"))
