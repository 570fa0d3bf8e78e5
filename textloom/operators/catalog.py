"""Registry of the reports: each is a function of the relations, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from textloom.sources.relations import Relations

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

_LINES = r"CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace(text, '\n\z', ''), '\r?\n') END"
#: The relations as SQL views over the driver's tables; a query names those it needs.
VIEWS = {
    "files": f"""SELECT 'f'||doc_id AS file_id, doc_id AS ord, 'crates/apps/'||source||'/src/'||lang||'/d'||doc_id||'.txt' AS path,
        lang AS language, source AS package, len({_LINES})::BIGINT AS lines, strlen(text)::BIGINT AS size,
        substr(sha256(text), 1, 8) AS hash, text FROM documents""",
    "lines": f"""SELECT file_id, ord, path, language, package, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no
        FROM (SELECT *, {_LINES} AS a FROM files)""",
    "packages": """SELECT DISTINCT source AS name, CASE WHEN length(source) > 4 THEN 'library' ELSE 'app' END AS kind,
        'crates/apps/'||source AS prefix FROM documents""",
    "changed": """SELECT 'f'||doc_id AS file_id, CASE WHEN toxic = 1 THEN 'D' WHEN quality = 0 THEN 'A' ELSE 'M' END AS status FROM labels""",
    "symbols": """SELECT p_name AS name, CASE p_partkey % 4 WHEN 0 THEN 'component' WHEN 1 THEN 'fn' WHEN 2 THEN 'method' ELSE 'type' END AS kind,
        p_brand AS owner, CASE p_size % 3 WHEN 0 THEN 'pub' WHEN 1 THEN 'export' ELSE 'private' END AS visibility,
        'f'||(p_partkey % (SELECT count(*) FROM documents)) AS file_id, p_size::BIGINT AS line, p_size::BIGINT + p_partkey % 10 AS line_end,
        p_partkey % 10 + 1 AS line_count, CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT END AS body_open_line,
        p_size::BIGINT + p_partkey % 10 AS body_close_line, p_partkey AS ord FROM part""",
    "occurrences": """SELECT value, CASE WHEN regexp_matches(value, '^[A-Z]+$') THEN 'constant' ELSE 'license' END AS kind, file_id, ord, line_no, line AS context
        FROM (SELECT *, unnest(regexp_extract_all(line, '[A-Z][A-Z]+|Licensed|License')) AS value FROM lines)""",
    "anchors": """SELECT event_type||'-'||user_id AS anchor, CASE WHEN user_id % 7 <> 0 THEN event_type END AS domain,
        CASE user_id % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'store' WHEN 2 THEN 'view' WHEN 3 THEN 'helper' END AS role,
        CASE WHEN value < 20 THEN 'P0' WHEN value < 40 THEN 'P1' WHEN value < 60 THEN 'P2' WHEN value < 80 THEN 'P3' WHEN value < 100 THEN 'PX' END AS priority,
        'f'||(user_id % (SELECT count(*) FROM documents)) AS file_id, event_id % 300 AS line, event_id AS ord FROM events""",
    "dependencies": """SELECT DISTINCT 'f'||l_suppkey AS source, 'f'||l_partkey AS target,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'imports' ELSE 'uses' END AS kind FROM lineitem""",
    "imports": """SELECT page_id, url, unnest(a) AS specifier, unnest(range(0, len(a)))::INT AS ord
        FROM (SELECT *, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages)""",
}
_NEEDS = {"lines": ["files"], "occurrences": ["files", "lines"]}


def with_views(views: str, sql: str) -> str:
    names: list[str] = []
    for v in views.split():
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    return (f"WITH {head}{',' if sql.lstrip().upper().startswith('WITH') else ''} " + (sql.lstrip()[4:] if sql.lstrip().upper().startswith("WITH") else sql)) if head else sql


def report(views: str = "", sql: str | None = None):
    """Register a function of ``Relations`` as the query of its name."""

    def add(fn: Callable[[Relations], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Relations(spark, sf_dir))
        if sql is not None:
            SQL[fn.__name__] = with_views(views, sql)
        return fn

    return add


def load() -> None:
    """Import every module that registers reports."""
    from textloom.operators import catalogs, classify, donors, graph, imports, manifests, navigation, quality, ranking, reading, sources, suggest  # noqa: F401
    from textloom.plans import edits, patches, raw, symbols  # noqa: F401
    from textloom.sources import snapshots  # noqa: F401
    from textloom.streaming import debounce, upkeep  # noqa: F401
