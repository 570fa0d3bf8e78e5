"""Reports on names and paths: groups, domains, roles, tokens, likeness, modules.

The driver's tables have no paths of source code, so ``paths`` lays one out for each
document: folders of every kind in turn, and a name made of its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import names as N
from textloom.operators.catalog import report

FOLDERS = [d for d, _, _ in N.DOMAINS] + [f"crates/apps/web/{p}" for p, _ in N.FEATURES if p.endswith("/")] + ["crates/engine/core/", "lib/tests/", "a/docs/", "x/gen/", ""]
ENDS = (".rs", ".ts", ".tsx", ".test.ts", "_test.rs", ".css", ".md", "/Cargo.toml", "/package.json", "scene.yml", ".rhai", "mod.toml", "-schema.json", "dto.ts", ".generated.ts", ".png", "", ".txt", "/index.ts")
COMMAND_NAMES = ("open_window", "open_mod", "load_session", "read_tree", "read_project_file", "validate_all", "list_assets", "cut_tile", "show_preview", "drop_cache", "set_theme", "ping", "registry_descriptor")
QUERIES = (".button", "ui/scene/main", "a-b.c", "run_command", "plain", "invoke it", "a.b")
SPECIFIERS = ("./near", "../up", "../../far.ts", "./", "react", ".././x/./y", "../d{}")


def _pick(values, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def paths(rel) -> DataFrame:
    """ord, path, command, query, specifier, name."""
    d = rel.read("documents").select(F.col("doc_id").alias("ord"))
    n = F.col("ord")
    path = F.concat(_pick(FOLDERS, n), F.lit("d"), (n / 3).cast("bigint"), _pick(ENDS, (n / 2).cast("bigint")))
    name = F.concat(_pick(("read", "loadAll", "HTTPServer", "x_y", "Item2Name"), n), F.lit("Of"), n, _pick(("Store", "view", "UI", "_tail"), (n / 7).cast("bigint")))
    return d.select("ord", path.alias("path"), _pick(COMMAND_NAMES, n).alias("command"), _pick(QUERIES, n).alias("query"), F.replace(_pick(SPECIFIERS, n), F.lit("{}"), n.cast("string")).alias("specifier"), name.alias("name"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_pick(values, n: str) -> str:
    return f"{_sql_list(values)}[({n}) % {len(values)} + 1]"


_PATHS = f"""paths AS (SELECT doc_id AS ord, {_sql_pick(FOLDERS, 'doc_id')} || 'd' || (doc_id // 3) || {_sql_pick(ENDS, 'doc_id // 2')} AS path, {_sql_pick(COMMAND_NAMES, 'doc_id')} AS command, {_sql_pick(QUERIES, 'doc_id')} AS query,
  replace({_sql_pick(SPECIFIERS, 'doc_id')}, '{{}}', doc_id::VARCHAR) AS specifier, {_sql_pick(('read', 'loadAll', 'HTTPServer', 'x_y', 'Item2Name'), 'doc_id')} || 'Of' || doc_id || {_sql_pick(('Store', 'view', 'UI', '_tail'), 'doc_id // 7')} AS name FROM documents)"""
_GROUP = "CASE WHEN starts_with(path, 'crates/') AND len(string_split(path, '/')) >= 3 THEN array_to_string(string_split(path, '/')[1:CASE WHEN string_split(path, '/')[2] IN ('apps', 'tools') THEN 3 ELSE 2 END], '/') ELSE string_split(path, '/')[1] END"


def _sql_case(rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for rule, name in rules) + f" ELSE {otherwise} END"


@report("", f"""WITH {_PATHS} SELECT ord, path, {_GROUP} AS grouped, {_sql_case([(f"contains(path, '{p}')", g) for p, g in N.FEATURES], f"CASE WHEN starts_with(path, '{N.APP}src/') THEN string_split(substr(path, {len(N.APP) + 5}), '/')[1] ELSE {_GROUP} END")} AS feature FROM paths""")
def path_groups(rel):
    """The package-like group of each path and its feature group, by the first of the ordered rules."""
    path = F.col("path")
    return paths(rel).select("ord", "path", N.group_path(path).alias("grouped"), N.feature_group(path).alias("feature"))


@report("", f"""WITH {_PATHS} SELECT ord, {_sql_case([(f"starts_with(path, '{p}')", d) for p, d, _ in N.DOMAINS] + [("path LIKE '%.md'", "docs")], "'index'")} AS domain, {_sql_case([(f"starts_with(path, '{p}')", x) for p, _, x in N.DOMAINS] + [("path LIKE '%.md'", "docs")], "'tool'")} AS layer,
  {_sql_case([(f"ends_with(path, '{e}')", r) for e, r in N.ROLES], "'file'")} AS role FROM paths""")
def path_domains(rel):
    domain, layer = N.domain_and_layer(F.col("path"))
    return paths(rel).select("ord", domain.alias("domain"), layer.alias("layer"), N.role_of(F.col("path")).alias("role"))


@report("", f"""WITH {_PATHS}, n AS (SELECT ord, lower(string_split(path, '/')[-1]) AS name FROM paths)
SELECT ord, CASE WHEN name = 'cargo.toml' THEN 'cargo' WHEN name = 'package.json' THEN 'package' WHEN regexp_extract(name, '[^.][.]([^.]+)$', 1) = '' THEN 'txt' ELSE regexp_extract(name, '[^.][.]([^.]+)$', 1) END AS language FROM n""")
def path_languages(rel):
    return paths(rel).select("ord", N.language_of(F.col("path")).alias("language"))


@report("", f"""WITH {_PATHS} SELECT ord, array_to_string(list_filter([{', '.join("CASE WHEN " + " OR ".join([f"contains(path, '{p}')" for p in parts] + [f"ends_with(path, '{e}')" for e in ends]) + f" THEN '{c}' END" for c, parts, ends in N.CLASSES)}], lambda x: x IS NOT NULL), ',') AS classes FROM paths""")
def path_classes(rel):
    return paths(rel).select("ord", F.array_join(N.classes_of(F.col("path")), ",").alias("classes"))


_COMMAND = _sql_case([(" OR ".join([f"contains(command, '{p}')" for p in parts] + [f"command = '{n}'" for n in N.SESSION_NAMES if g == "session"]), g) for g, parts in N.COMMANDS], "'shared'")


@report("", f"WITH {_PATHS} SELECT command, {_COMMAND} AS command_group, 'commands/' || {_COMMAND} || '.rs' AS target, count(*) AS n FROM paths GROUP BY ALL")
def command_map(rel):
    """Commands with the group that their names stand for and the file that group belongs in."""
    rows = paths(rel).groupBy("command").agg(F.count(F.lit(1)).alias("n")).withColumn("command_group", N.command_group(F.col("command")))
    return rows.select("command", "command_group", N.command_target(F.col("command_group")).alias("target"), "n")


@report("", f"""WITH {_PATHS} SELECT query, CASE WHEN starts_with(query, '.') THEN 'css-class' WHEN contains(query, '/') AND contains(query, 'scene') THEN 'scene-path' WHEN contains(query, '.') AND contains(query, '-') THEN 'id-like-string'
  WHEN ends_with(query, '_command') OR contains(query, 'invoke') THEN 'command' ELSE 'symbol-or-text' END AS kind, count(*) AS n FROM paths GROUP BY ALL""")
def trace_kinds(rel):
    return paths(rel).groupBy("query", N.trace_kind(F.col("query")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_TOKENS = "name"
for _p in ("([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])", "([A-Z])([A-Z][a-z])"):
    _TOKENS = f"regexp_replace({_TOKENS}, '{_p}', '\\1 \\2', 'g')"
_TOKENS = f"list_filter(string_split_regex(lower({_TOKENS}), '[^a-z0-9]+'), lambda x: x <> '')"


@report("", f"WITH {_PATHS} SELECT ord, name, array_to_string({_TOKENS}, ' ') AS tokens, {_TOKENS}[-1] AS suffix, (SELECT count(*) FROM range(1, 13) t(k) WHERE substr(name, 1, k) = substr('loadAllOf12', 1, k) AND k <= length(name) AND k <= 11) AS prefix FROM paths")
def name_parts(rel):
    """The tokens of each name, its suffix, and how far it begins like another name."""
    tokens = N.name_tokens(F.col("name"))
    return paths(rel).select("ord", "name", F.array_join(tokens, " ").alias("tokens"), F.element_at(tokens, -1).alias("suffix"), N.shared_prefix(F.col("name"), F.lit("loadAllOf12")).alias("prefix"))


def symbol_scores(rel, query: str = "loadAll-Of 12view", limit: int = 40) -> DataFrame:
    """The names most like a query: score, then name and number."""
    rows = paths(rel).select("ord", "name", N.symbol_score(F.col("name"), query).cast("bigint").alias("score")).filter("score > 0")
    return rows.orderBy(F.desc("score"), "name", "ord").limit(limit)


@report("", f"""WITH {_PATHS}, b AS (SELECT ord, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS bare FROM paths)
SELECT ord, name, CASE WHEN bare = 'loadallof12view' THEN 900 ELSE CASE WHEN starts_with(bare, 'loadallof12view') OR starts_with('loadallof12view', bare) THEN 50 ELSE 0 END
  + (SELECT count(*) FROM range(1, 18) t(k) WHERE starts_with(lower(name), substr('loadall-of 12view', 1, k))) + least(length(regexp_replace(bare, '[^loadf12view]', '', 'g')), 20)
  + 10 * len(list_intersect(list_distinct(string_split_regex(lower(name), '[^a-z0-9]+')), ['loadall', 'of', '12view'])) END::BIGINT AS score FROM b ORDER BY score DESC, name, ord LIMIT 40""")
def resolve_fuzzy(rel):
    return symbol_scores(rel)


_LEX = "array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({p}, '/'), lambda x: [x])), lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END), '/')"


@report("", f"""WITH {_PATHS}, b AS (SELECT ord, specifier, path, {_LEX.format(p="regexp_replace(path, '[^/]*$', '') || specifier")} AS base FROM paths WHERE starts_with(specifier, '.')),
c AS (SELECT ord, specifier, path, unnest([base, regexp_replace(base, '[.][^./]*$', '') || '.ts', regexp_replace(base, '[.][^./]*$', '') || '.tsx', base || '/index.ts', base || '/index.tsx']) AS candidate, unnest(range(0, 5)) AS preference FROM b),
k AS (SELECT DISTINCT path FROM paths), h AS (SELECT ord, arg_min(candidate, preference) AS target FROM c JOIN k ON k.path = c.candidate GROUP BY ord)
SELECT p.ord, p.specifier, h.target FROM paths p LEFT JOIN h USING (ord)""")
def module_resolution(rel):
    """The file that each relative specifier means: the first of its candidates that exists."""
    rows = paths(rel)
    tries = rows.select("ord", F.posexplode(N.module_candidates(F.col("path"), F.col("specifier"))).alias("preference", "candidate"))
    known = rows.select(F.col("path").alias("candidate")).distinct()
    hit = tries.join(known, "candidate").groupBy("ord").agg(F.min_by("candidate", "preference").alias("target"))
    return rows.select("ord", "specifier").join(hit, "ord", "left")


@report("", f"""WITH {_PATHS}, b AS (SELECT ord, path, string_split('crates/apps/editor/src/api/d7.ts', '/')[1:5] AS folder, CASE WHEN string_split(path, '/')[-1] IN ('index.ts', 'index.tsx') THEN string_split(path, '/')[1:len(string_split(path, '/')) - 1] ELSE string_split(path, '/') END AS parts FROM paths),
k AS (SELECT *, (SELECT count(*) FROM range(1, 6) t(i) WHERE folder[1:i] = parts[1:i] AND i <= len(parts)) AS k FROM b),
m AS (SELECT ord, path, 5 - k AS up, parts[k + 1:] AS down, regexp_replace(regexp_replace(repeat('../', 5 - k) || array_to_string(parts[k + 1:], '/'), '/+$', ''), '([.]tsx?)+$', '') AS bare FROM k)
SELECT ord, path, CASE WHEN up = 0 AND len(down) = 0 THEN './' WHEN len(down) > 0 THEN CASE WHEN starts_with(bare, '.') THEN bare ELSE './' || bare END END AS module FROM m""")
def relative_modules(rel):
    """How one file names every other one."""
    return paths(rel).select("ord", "path", N.relative_module(F.lit("crates/apps/editor/src/api/d7.ts"), F.col("path")).alias("module"))
