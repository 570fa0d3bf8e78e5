"""YAML and JSON texts as rows: every entry of a mapping and every scalar, with the keys above it.

Spark deals the texts out and joins, groups and counts the rows; in a task a text is walked once. Of YAML,
block mappings and sequences, flow collections on one line, quotes, block scalars and comments are read;
anchors and tags stay text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = re.compile(r"""("[^"]*"|'[^']*'|[^\s:#{\[\-"'][^:]*?|-[^\s:][^:]*?)\s*:(?:\s+(.*))?$""")
_FLOW = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'[^']*'|[{}\[\],]|:(?=\s|$|[{\["'])|(?:[^{}\[\],:]|:(?!\s|$))+)""")


def _bare(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _flow(text: str, keys: list[str]) -> Iterator[tuple[list[str], str | None, bool]]:
    """Rows of a flow collection; what is open is on a stack, so nesting has no limit."""
    tokens = _FLOW.findall(text)
    open_: list[tuple[str, list[str]]] = []
    above = keys
    for k, token in enumerate(tokens):
        token = token.strip()
        follows = tokens[k + 1] if k + 1 < len(tokens) else ""
        if token in ("{", "["):
            open_.append((token, above))
        elif token in ("}", "]"):
            above = open_.pop()[1] if open_ else keys
        elif token == ",":
            above = open_[-1][1] if open_ else keys
        elif token and token != ":":
            if follows == ":":
                above = [*above, _bare(token)]
                yield above, None, True
            else:
                yield above, _bare(token), False


def _json(value, keys: list[str]) -> Iterator[tuple[list[str], str | None, bool]]:
    waiting = [(value, keys)]
    while waiting:
        value, keys = waiting.pop()
        if isinstance(value, dict):
            for key, inner in value.items():
                yield [*keys, key], None, True
                waiting.append((inner, [*keys, key]))
        elif isinstance(value, list):
            waiting += [(x, keys) for x in value]
        elif value is not None:
            yield keys, value if isinstance(value, str) else json.dumps(value), False


def _yaml(text: str) -> Iterator[tuple[list[str], str | None, bool]]:
    open_: list[tuple[int, list[str]]] = []  # where a key stands, and the keys down to it
    block: tuple[int, list[str], list[str]] | None = None  # a block scalar: where its key stands, keys, lines
    for line in [*text.split("\n"), None]:
        at = 0 if line is None else len(line) - len(line.lstrip(" "))
        if block is not None:
            if line is not None and (not line.strip() or at > block[0]):
                block[2].append(line.strip())
                continue
            yield block[1], "\n".join(block[2]).strip(), False
            block = None
        body = "" if line is None else re.sub(r"(^|\s)#.*$", "", line).strip() if "#" in line and not re.search(r"[\"'].*#.*[\"']", line) else line.strip()
        if not body or body in ("---", "..."):
            continue
        dash = False
        while True:  # "- - key: value" stands as deep as its key
            item = body == "-" or body.startswith("- ")
            # a sequence may begin right below its key; anything else there ends the key
            while open_ and (open_[-1][0] > at or (open_[-1][0] == at and not item) or (dash and open_[-1][0] >= at)):
                open_.pop()
            if not item:
                break
            rest = body[1:].lstrip()
            at, body, dash = at + len(body) - len(rest), rest, True
            if not body:
                break
        keys = open_[-1][1] if open_ else []
        if not body:
            continue
        found = None if body[0] in "{[" else _KEY.match(body)
        value = body
        if found:
            keys, value = [*keys, _bare(found[1])], (found[2] or "").strip()
            yield keys, None, True
            open_.append((at, keys))
        if value[:1] in "|>" and value:
            block = (at, keys, [])
        elif value[:1] in ("{", "["):
            yield from _flow(value, keys)
        elif value and value not in ("null", "~"):
            yield keys, _bare(value), False


def rows_of(text: str) -> Iterator[tuple[list[str], str | None, bool]]:
    """(keys from the top, value or None, whether it is an entry of a mapping) of a text."""
    if text.lstrip()[:1] in ("{", "["):
        try:
            yield from _json(json.loads(text), [])
            return
        except ValueError:
            pass
    yield from _yaml(text)


def nodes(files: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """id, keys, value, entry: the entries (value null) and scalars (entry false) of every text. Null and empty texts have none."""
    kind = files.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, values, entries = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for above, value, entry in rows_of(text or ""):
                    at.append(k)
                    keys.append(above)
                    values.append(value)
                    entries.append(entry)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.list_(pa.string())), pa.array(values, pa.string()), pa.array(entries, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "keys", "value", "entry"])

    found = files.select(F.col(id_col), F.col(text_col)).mapInArrow(walk, f"id {kind}, keys array<string>, value string, entry boolean")
    return found.withColumnRenamed("id", id_col)


def field_values(found: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The columns of ``nodes`` with field, value: every scalar below a key of ``fields``, once for each such key above it."""
    names = F.array(*map(F.lit, fields))
    wanted = F.filter("keys", lambda k: F.array_contains(names, k))
    return found.filter("value IS NOT NULL").withColumn("field", F.explode(wanted)).drop("entry", "keys")


def field_counts(found: DataFrame, fields: tuple[str, ...], id_col: str = "path") -> DataFrame:
    """id, field, n: entries whose own key is one of ``fields``."""
    last = F.element_at("keys", -1)
    return found.filter(F.col("entry") & last.isin(*fields)).groupBy(id_col, last.alias("field")).agg(F.count(F.lit(1)).alias("n"))
