"""Symbols that a name may have meant, by how close names are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.names import shared_prefix
from textloom.functions.text import ascii_fold, ascii_lower, identifier
from textloom.operators.catalog import report

#: Scores of the name itself, the name without case and signs, and an owner with its name (fixed values).
EXACT, NORMAL, OWNED = 1000, 900, 850


def symbol_tokens(name: Column) -> Column:
    """The words of a name in lower case: cut at ``_ - :`` and spaces, and at capitals after small letters or digits."""
    bare = F.regexp_replace(name, "[^A-Za-z0-9_ :-]", "")
    return F.filter(F.split(ascii_lower(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2")), "[_ :-]+"), lambda x: x != "")


def in_order(text: Column, query: str) -> Column:
    """How many characters of ``text``, from the left, are found in ``query`` one after the other."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(acc: Column, char: Column) -> Column:
        found = F.call_function("locate", char, F.lit(query), acc["at"] + 1)
        return F.when((found > 0) & (acc["at"] < len(query)), F.struct(found.alias("at"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)["n"]


def closeness(name: Column, query: str) -> Column:
    """0 to 100: 100 alike without case and signs, 80 and more if one holds the other, else by shared words or characters in order."""
    bare, wanted = identifier(name), re.sub("[^a-z0-9]", "", ascii_fold(query))
    if not wanted:
        return F.lit(0)
    div = lambda a, b: F.call_function("div", a, b)
    n = F.length(bare)
    longer, shorter = F.greatest(n, F.lit(len(wanted))), F.least(n, F.lit(len(wanted)))
    tokens = symbol_tokens(name)
    own = symbol_tokens(F.lit(query))
    shared = F.size(F.filter(tokens, lambda t: F.array_contains(own, t)))
    by_word = F.when(shared > 0, 30 + div(shared * 70, F.greatest(F.size(tokens), F.size(own)))).otherwise(0)
    by_char = div(in_order(bare, wanted) * 70 + shared_prefix(bare, F.lit(wanted)) * 30, longer)
    holds = F.contains(bare, F.lit(wanted)) | F.contains(F.lit(wanted), bare)
    return F.when(bare == "", 0).when(bare == wanted, 100).when(holds, 80 + div(shorter * 20, longer)).otherwise(F.greatest(by_word, by_char)).cast("bigint")


def match(symbols: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """``symbols`` (name, owner, ...) with score and how (exact, normal, owned, fuzzy), those with a score, the best first.

    A query ``Owner::name`` or ``Owner.name`` meets a symbol of that owner, without case. Ties: by name without case, then ord.
    """
    parts = re.split(r"::|\.", ascii_fold(query))
    owned = F.lit(False)
    if len(parts) > 1:
        owned = (ascii_lower("owner") == "::".join(parts[:-1])) & (ascii_lower("name") == parts[-1])
    how = F.when(F.col("name") == query, "exact").when((identifier(F.col("name")) == re.sub("[^a-z0-9]", "", ascii_fold(query))) & (identifier(F.col("name")) != ""), "normal").when(F.coalesce(owned, F.lit(False)), "owned").otherwise("fuzzy")
    rows = symbols.withColumn("how", how)
    score = F.when(F.col("how") == "exact", EXACT).when(F.col("how") == "normal", NORMAL).when(F.col("how") == "owned", OWNED).otherwise(closeness(F.col("name"), query)).cast("bigint")
    found = rows.withColumn("score", score).filter("score > 0")
    return found.orderBy(F.desc("score"), ascii_lower("name"), "ord").limit(limit) if limit is not None else found


_QUERY = "greenRing 7"
_WANTED = "greenring7"


@report("symbols", f"""WITH b AS (SELECT ord, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS bare, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_ :-]', '', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[_ :-]+'), lambda x: x <> '') AS t FROM symbols),
k AS (SELECT *, len(list_filter(t, lambda x: x IN ('green', 'ring', '7'))) AS shared, greatest(length(bare), {len(_WANTED)}) AS longer, least(length(bare), {len(_WANTED)}) AS shorter,
  (SELECT count(*) FROM range(1, {len(_WANTED) + 1}) p(i) WHERE i <= length(bare) AND substr(bare, 1, i) = substr('{_WANTED}', 1, i)) AS prefix,
  list_reduce(list_prepend([0, 0], list_transform(string_split(bare, ''), lambda c: [ascii(c), 0])), lambda a, x: CASE WHEN a[1] < {len(_WANTED)} AND strpos(substr('{_WANTED}', a[1] + 1), chr(x[1])) > 0 THEN [(a[1] + strpos(substr('{_WANTED}', a[1] + 1), chr(x[1])))::INTEGER, a[2] + 1] ELSE a END)[2] AS seq FROM b)
SELECT ord, name, score, CASE WHEN score = 900 THEN 'normal' ELSE 'fuzzy' END AS how FROM (SELECT *, CASE WHEN bare = '{_WANTED}' THEN 900 WHEN contains(bare, '{_WANTED}') OR contains('{_WANTED}', bare) THEN 80 + shorter * 20 // longer
  ELSE greatest(CASE WHEN shared > 0 THEN 30 + shared * 70 // greatest(len(t), 3) ELSE 0 END, (seq * 70 + prefix * 30) // longer) END::BIGINT AS score FROM k WHERE bare <> '') WHERE score > 0 ORDER BY score DESC, lower(name), ord LIMIT 100""")
def suggested_symbols(rel):
    return match(rel.symbols, _QUERY, 100).select("ord", "name", "score", "how")
