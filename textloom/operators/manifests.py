"""Manifests and logs: sectioned keys, fields by name, raw files that nothing names, entries of a Markdown log.

The driver's tables hold none, so each document stands for a plugin manifest, an asset
manifest and a section of a log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.names import lexical
from textloom.functions.text import lines
from textloom.functions.trees import field_counts, nodes
from textloom.functions.trees import field_values as tree_values
from textloom.operators.catalog import report
from textloom.session import cut

#: Section and key of the lists that a plugin manifest may have (fixed values).
PLUGIN_LISTS = (
    ("capabilities", "provides"), ("capabilities", "requires"), ("slots", "implements"), ("slots", "requires"), ("targets", "reads"), ("targets", "writes"),
    ("targets", "contributes"), ("contributions", "emits"), ("contributions", "consumes"), ("diagnostics", "channels"),
)
TOKENS = r"(?i)tokens:\s*(?:used\s*)?~?([0-9]+)|tokens(?: used)?:\s*~?([0-9]+)"


def entries(files: DataFrame, *keep: str) -> DataFrame:
    """Kept columns, section, key, values of ``key = value`` lines; a key belongs to the last section above it.

    A value in brackets is a list; quotes around an item are dropped, empty items are none.
    """
    line = F.trim("line")
    rows = lines(files, *keep).filter((line != "") & ~line.startswith("#"))
    section = F.when(line.startswith("[") & line.endswith("]"), F.regexp_replace(line, r"^\[+|\]+$", ""))
    above = F.last(section, ignorenulls=True).over(Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*keep, "line_no", line.alias("line"), F.coalesce(above, F.lit("")).alias("section"), section.isNotNull().alias("header"))
    at = F.instr("line", F.lit("="))
    value = F.trim(F.substr(F.col("line"), at + 1))
    items = F.transform(F.split(F.regexp_replace(value, r"^\[+|\]+$", ""), ","), lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', ""))
    found = rows.filter(~F.col("header") & (at > 0))
    return found.select(*keep, "section", F.trim(F.substr(F.col("line"), F.lit(1), at - 1)).alias("key"), F.filter(items, lambda x: x != "").alias("values"))


def field_values(files: DataFrame, fields: tuple[str, ...], *keep: str) -> DataFrame:
    """Kept columns, field, value of every line ``field: value``, in YAML or JSON, whatever its depth or list."""
    line = F.regexp_replace(F.trim("line"), r"^(-\s+)+", "")
    value = lambda f: F.regexp_replace(F.regexp_extract(line, f"^[\"']?{f}[\"']?\\s*:\\s*(.+?)\\s*,?$", 1), "^[\"']+|[\"']+$", "")
    each = F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields])
    rows = lines(files, *keep).select(*keep, F.explode(each).alias("x"))
    return rows.select(*keep, "x.field", "x.value").filter("value <> ''")


def is_asset_path(value: Column) -> Column:
    return F.contains(value, F.lit("/")) | value.rlike(r"\.(png|jpg|json|yaml|yml)$")


#: Keys that name files of assets, and those that are counted (fixed values).
ASSET_FIELDS = ("path", "source", "image", "scene", "spritesheet", "font")
COUNTED_FIELDS = ("spritesheet", "font", "scene")


def asset_counts(manifests: DataFrame) -> DataFrame:
    """field, n: how often each kind of asset is an entry of the manifests (path, text)."""
    return field_counts(nodes(manifests), COUNTED_FIELDS).groupBy("field").agg(F.sum("n").alias("n"))


def asset_check(manifests: DataFrame, raw: DataFrame) -> DataFrame:
    """finding, value: sources that do not exist, ids in several manifests, raw files that none names.

    manifests: path, text (YAML or JSON); raw: path. A source is looked for beside its manifest; it
    may stand anywhere below a key of ``ASSET_FIELDS``, an id anywhere below ``id``.
    """
    tree = cut(nodes(manifests))
    sources = tree_values(tree, ASSET_FIELDS).filter(is_asset_path(F.col("value")))
    named = sources.select(lexical(F.concat(F.regexp_replace("path", r"[^/]*$", ""), "value")).alias("value"))
    missing = named.distinct().join(raw.select(F.col("path").alias("value")), "value", "left_anti")
    twice = tree_values(tree, ("id",)).groupBy("value").agg(F.countDistinct("path").alias("n")).filter("n > 1")
    unused = raw.select(F.col("path").alias("value")).join(named, "value", "left_anti")
    mark = lambda df, what: df.select(F.lit(what).alias("finding"), "value")
    return mark(missing, "missing source").unionByName(mark(twice, "duplicate id")).unionByName(mark(unused, "unused raw"))


def log_entries(logs: DataFrame) -> DataFrame:
    """log_id, nth, task, tokens of the sections of Markdown logs (log_id, text)."""
    parts = logs.select("log_id", F.posexplode(F.split("text", "\n### ")).alias("nth", "section"))
    bare = F.regexp_replace("section", r"^\s+|\s+\z", "")
    parts = parts.select("log_id", "nth", bare.alias("section")).filter("section <> ''")
    found = F.coalesce(F.nullif(F.regexp_extract("section", TOKENS, 1), F.lit("")), F.nullif(F.regexp_extract("section", TOKENS, 2), F.lit("")), F.lit("0"))
    task = F.trim(F.regexp_replace(F.substring_index("section", "\n", 1), "^#+|#+$", ""))
    return parts.select("log_id", F.col("nth").cast("bigint").alias("nth"), task.alias("task"), found.cast("bigint").alias("tokens"))


# the driver's tables


def plugin_files(rel) -> DataFrame:
    n = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit('# plugin\nid = "p'), n, F.lit('"\nkind = "app"\n\n[capabilities]\nprovides = ["cap'), n, F.lit('", "shared"]\nrequires = ["cap'), (F.col("doc_id") + 1).cast("string"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('", "none'), n)).otherwise(""), F.lit('"]\n[ slots ]\n[targets]\nreads = []\n writes=["t'), (F.col("doc_id") % 7).cast("string"), F.lit('"]\n'),
    )
    return rel.read("documents").select(F.col("doc_id").alias("ord"), text.alias("text"))


_PLUGINS = """plug AS (SELECT doc_id AS ord, 'p' || doc_id AS id, list_concat(['cap' || (doc_id + 1)], CASE WHEN doc_id % 3 = 0 THEN ['none' || doc_id] ELSE [] END) AS requires, ['cap' || doc_id, 'shared'] AS provides, ['t' || (doc_id % 7)] AS writes FROM documents)"""


@report("", f"""WITH {_PLUGINS} SELECT ord, section, key, array_to_string(v, ',') AS items FROM (SELECT ord, '' AS section, 'id' AS key, [id] AS v FROM plug UNION ALL SELECT ord, '', 'kind', ['app'] FROM plug
  UNION ALL SELECT ord, 'capabilities', 'provides', provides FROM plug UNION ALL SELECT ord, 'capabilities', 'requires', requires FROM plug UNION ALL SELECT ord, 'targets', 'reads', [] FROM plug UNION ALL SELECT ord, 'targets', 'writes', writes FROM plug)""")
def plugin_manifests(rel):
    """The keys of every manifest with their sections and lists."""
    return entries(plugin_files(rel), "ord").select("ord", "section", "key", F.array_join("values", ",").alias("items"))


@report("", f"""WITH {_PLUGINS}, r AS (SELECT ord, unnest(requires) AS name FROM plug) SELECT ord, name FROM r WHERE name NOT IN (SELECT unnest(provides) FROM plug)""")
def plugins_missing(rel):
    """Capabilities that a plugin requires and none provides."""
    found = entries(plugin_files(rel), "ord").filter("section = 'capabilities'").select("ord", "key", F.explode("values").alias("name"))
    return found.filter("key = 'requires'").select("ord", "name").join(found.filter("key = 'provides'").select("name"), "name", "left_anti").select("ord", "name")


def asset_files(rel) -> tuple[DataFrame, DataFrame]:
    """Manifests that each name two raw files, and the raw files: those of even numbers, and one that none names."""
    k = F.col("doc_id")
    n = k.cast("string")
    text = F.concat(
        F.lit("id: "), F.when(k % 10 == 0, "hero").otherwise(F.concat(F.lit('"a'), n, F.lit('"'))), F.lit("\nparts:\n  - source: ../raw/r"), n, F.lit(".png\n    image: './own"), n, F.lit(".jpg'\n  - path: plain\n"),
    )
    d = rel.read("documents")
    manifests = d.select(F.concat(F.lit("assets/m"), n, F.lit(".yml")).alias("path"), text.alias("text"))
    raw = d.select(F.when(k % 2 == 0, F.concat(F.lit("raw/r"), n, F.lit(".png"))).otherwise(F.concat(F.lit("raw/x"), n, F.lit(".png"))).alias("path"))
    return manifests, raw


@report("", """SELECT 'missing source' AS finding, 'raw/r' || doc_id || '.png' AS value FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 'missing source', 'assets/own' || doc_id || '.jpg' FROM documents
  UNION ALL SELECT 'duplicate id', 'hero' FROM documents WHERE doc_id % 10 = 0 GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'unused raw', 'raw/x' || doc_id || '.png' FROM documents WHERE doc_id % 2 = 1""")
def asset_file_check(rel):
    return asset_check(*asset_files(rel))


@report("", """SELECT conv_id, turn + 1 AS nth, 'Task ' || turn AS task, CASE turn % 3 WHEN 0 THEN length(text) WHEN 1 THEN length(text) + 1 ELSE 0 END::BIGINT AS tokens FROM conversations WHERE text IS NOT NULL""")
def operations_entries(rel):
    """The sections of the log of each conversation, with the tokens they say they took."""
    turn, n = F.col("turn").cast("string"), F.length("text")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Tokens: used ~"), n)).when(F.col("turn") % 3 == 1, F.concat(F.lit("tokens used: "), n + 1)).otherwise("no count")
    section = F.concat(F.lit("Task "), turn, F.lit(" ##\n\n- "), said, F.lit("\n"))
    kept = rel.read("conversations").filter("text IS NOT NULL")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", section.alias("s")))), lambda x: x["s"]), "\n### ")
    logs = kept.groupBy(F.col("conv_id").alias("log_id")).agg(F.concat(F.lit("# Log\n### "), body).alias("text"))
    return log_entries(logs).filter("task <> 'Log'").select(F.col("log_id").alias("conv_id"), "nth", "task", "tokens")


def conversation_trees(rel) -> DataFrame:
    """conv_id, text: every conversation as a tree of its turns, as JSON (of even numbers) or YAML."""
    rows = rel.read("conversations").filter("conv_id IS NOT NULL")
    size = F.length("text")
    item = F.concat(F.lit("  - role: '"), "role", F.lit("'\n    body: {chars: "), size, F.lit(", turn: "), "turn", F.lit("}\n"))
    of = lambda x: F.array_sort(F.collect_list(F.struct("turn", x.alias("x"))))
    turns = F.transform(of(F.struct("role", F.struct(size.alias("chars"), "turn").alias("body"))), lambda t: t["x"])
    as_json = F.to_json(F.struct(F.struct(F.col("conv_id").alias("number"), turns.alias("turns")).alias("conversation")))
    as_yaml = F.concat(F.lit("# a conversation\nconversation:\n  number: "), F.col("conv_id").cast("string"), F.lit("\n  turns:\n"), F.array_join(F.transform(of(item), lambda t: t["x"]), ""))
    return rows.groupBy("conv_id").agg(F.when(F.col("conv_id") % 2 == 0, as_json).otherwise(as_yaml).alias("text"))


@report("", """SELECT conv_id, 'role' AS field, role AS value, count(*) AS n FROM conversations GROUP BY ALL UNION ALL SELECT conv_id, 'number', conv_id::VARCHAR, 1 FROM conversations GROUP BY conv_id
  UNION ALL SELECT conv_id, 'body', v, count(*) FROM (SELECT conv_id, unnest([length(text)::VARCHAR, turn::VARCHAR]) AS v FROM conversations) GROUP BY ALL
  UNION ALL SELECT conv_id, 'chars', length(text)::VARCHAR, count(*) FROM conversations GROUP BY ALL""")
def tree_fields(rel):
    """What stands below four keys of each conversation's tree, at any depth."""
    found = tree_values(nodes(conversation_trees(rel), "conv_id"), ("role", "number", "body", "chars"))
    return found.groupBy("conv_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
