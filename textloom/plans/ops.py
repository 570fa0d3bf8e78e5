"""Edit plans: rows of operations, checked against files and applied in order.

An operation is a row of ``PLAN`` columns. ``check_ops`` gives each the first rule
it breaks, from the files as they are and from what earlier operations of the plan
will have made or removed. ``apply_ops`` folds the operations of each group of paths
(paths that copies, moves and operations on folders link) over the texts of the group,
inside the JVM: an edit is an expression over the lines of a text, and a group is one
row. Files under a deleted folder that no other operation names are counted, not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.substrings import holders
from textloom.functions.text import bind, line_array
from textloom.plans.groups import linked
from textloom.session import cut

#: Columns of a plan. ``until``: the second anchor; ``count``: matches expected.
PLAN = {
    "op_id": "bigint", "kind": "string", "path": "string", "target": "string", "find": "string", "until": "string",
    "content": "string", "start": "bigint", "stop": "bigint", "symbol": "string", "scope": "string", "expected": "string",
    "before": "string", "after": "string", "count": "bigint", "overwrite": "boolean", "recursive": "boolean", "strict": "boolean",
}
#: The kinds of operation (fixed values), by what they work on.
FILE_KINDS = ("create_file", "replace_file", "append_to_file", "delete_file")
LINK_KINDS = ("copy_file", "move_file", "rename_file")
FOLDER_KINDS = ("create_dir", "delete_dir")
TEXT_KINDS = ("insert_before_text", "insert_after_text", "replace_text", "replace_field_access")
RANGE_KINDS = ("replace_range", "delete_range")
ANCHOR_KINDS = ("insert_before_anchor", "insert_after_anchor", "replace_between_anchors")
SYMBOL_KINDS = ("replace_symbol", "delete_symbol", "insert_before_symbol", "insert_after_symbol", "replace_method_body")
ASSERTIONS = ("assert_symbol_absent", "assert_text_absent")
ABSENCE_KINDS = ("delete_symbol_if_exists", *ASSERTIONS)
KINDS = (*FILE_KINDS, *LINK_KINDS, *FOLDER_KINDS, *TEXT_KINDS, *RANGE_KINDS, *ANCHOR_KINDS, *SYMBOL_KINDS, *ABSENCE_KINDS)
OK = "ok"


def required_fields() -> dict[str, list[str]]:
    """The plan columns that each kind of operation needs."""
    out = {}
    for kind in KINDS:
        fields = [] if kind in ("assert_symbol_absent", "assert_text_absent", "replace_field_access") else ["path"]
        fields += ["target"] * (kind in LINK_KINDS) + ["find"] * (kind in (*TEXT_KINDS, *ANCHOR_KINDS, "assert_text_absent")) + ["until"] * (kind == "replace_between_anchors")
        fields += ["start", "stop"] * (kind in RANGE_KINDS) + ["symbol"] * (kind in (*SYMBOL_KINDS, "delete_symbol_if_exists", "assert_symbol_absent"))
        quiet = ("delete_file", *LINK_KINDS, *FOLDER_KINDS, "delete_range", "delete_symbol", *ABSENCE_KINDS)
        out[kind] = fields + ["content"] * (kind not in quiet)
    return out


def plan(df: DataFrame) -> DataFrame:
    """``df`` with all columns of a plan: those it lacks are null, flags false."""
    have = set(df.columns)
    flag = lambda c, t: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    return df.select(*[(flag(c, t) if t == "boolean" else F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in PLAN.items()])


# texts


def lines_text(lines: Column) -> Column:
    """Lines as a text that ends with a line feed; no line, no text."""
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def bare(content: Column) -> Column:
    return F.regexp_replace(content, r"\s+\z", "")


def with_lines(lines: Column, start: Column, stop: Column, new: Column | None) -> Column:
    """A text of ``lines`` with [start, stop] (from 1) replaced by ``new``; unchanged beyond its end, left out if null."""
    empty = F.array().cast("array<string>")
    place = empty if new is None else F.when(start <= F.size(lines), F.array(bare(new))).otherwise(empty)
    return lines_text(F.concat(F.filter(lines, lambda x, i: i + 1 < start), place, F.filter(lines, lambda x, i: (i + 1 >= start) & (i + 1 > stop))))


def with_inserted(lines: Column, line: Column, content: Column) -> Column:
    """A text of ``lines`` with ``content`` as a line before line ``line``, or at the end if that lies beyond it."""
    return lines_text(F.concat(F.filter(lines, lambda x, i: i + 1 < line), F.array(bare(content)), F.filter(lines, lambda x, i: i + 1 >= line)))


def replace_first(text: Column, find: Column, new: Column) -> Column:
    at = F.instr(text, find)
    return F.when(at == 0, text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(find))))


def matches(text: Column, find: Column) -> Column:
    return F.when(F.length(find) > 0, (F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.length(find)).cast("bigint")


def located(text: Column, find: Column) -> Column:
    """``find`` as the text has it, with CRLF in place of LF if need be; null if it has neither."""
    crlf = F.replace(find, F.lit("\n"), F.lit("\r\n"))
    return F.when(F.contains(text, find), find).when(F.contains(text, crlf), crlf)


def scoped(raw: Column, start: Column, stop: Column) -> tuple[Column, Column, Column]:
    """The text before, in and after lines [start, stop] of ``raw``; all of it in the middle if they are null."""
    n, start, stop = F.size(raw), F.coalesce(start, F.lit(1)), F.when(start.isNull(), F.size(raw)).otherwise(stop)
    part = lambda keep, last: bind(F.filter(raw, keep), lambda a: F.when(F.size(a) == 0, "").otherwise(F.concat(F.array_join(a, "\n"), F.when(last, "").otherwise("\n"))))
    return (
        part(lambda x, i: i + 1 < start, start > n),
        part(lambda x, i: (i + 1 >= start) & (i + 1 <= stop), stop >= n),
        part(lambda x, i: i + 1 > stop, F.lit(True)),
    )


def between(lines: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """The line of the first anchor and that of the second one after it; null where there is none."""
    place = lambda keep: F.nullif(F.array_position(F.transform(lines, keep), True), F.lit(0))
    at = place(lambda x: F.contains(x, first))
    return at, bind(at, lambda k: place(lambda x, i: (i + 1 > k) & F.contains(x, second)))


def seen(op, text: Column) -> Column:
    """What the rules and edits of an operation look at in a text: its lines, where things are found, its scope.

    Each part is worked out for the kinds that use it, and is null for the others.
    """
    of = lambda kinds, value: F.when(op["kind"].isin(*kinds), value)
    by_line = (*RANGE_KINDS, *SYMBOL_KINDS, "delete_symbol_if_exists", "replace_between_anchors")
    scoped_kind = (op["kind"] == "replace_text") & op["scope"].isNotNull()
    head, scope, tail = scoped(F.split(text, "\n", -1), F.when(scoped_kind, op["s_line"]), op["s_end"])
    first, second = between(line_array(text), op["find"], op["until"])
    anchored = op["kind"] == "replace_between_anchors"
    return F.struct(
        text.alias("text"), of(by_line, line_array(text)).alias("lines"), of(("insert_before_text", "insert_after_text", "replace_text"), located(text, op["find"])).alias("find"),
        F.when(scoped_kind, head).otherwise("").alias("head"), F.when(scoped_kind, scope).otherwise(text).alias("scope"), F.when(scoped_kind, tail).otherwise("").alias("tail"),
        F.when(anchored, first).alias("first"), F.when(anchored, second).alias("second"),
    )


# rules


def _unsafe(path: Column) -> Column:
    return path.isNotNull() & ((path == "") | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"))


def verdict(op, t, target_exists: Column, folder: Column, found: Column, virtual: Column | None = None) -> Column:
    """The first rule that an operation breaks, or ``ok``.

    op: a struct of plan columns with s_n, s_line, s_end, s_open, s_close (how many
    symbols of the file have its name, and the first one's lines). t: ``seen`` of the
    path's text, which is null if it does not exist. folder: whether files lie under
    the path. found: matches in the files the operation is about when it names none.
    virtual: whether earlier operations leave the path in place; null if they do not
    touch it.
    """
    text, lines, find = t["text"], t["lines"], t["find"]
    kind, exists = op["kind"], text.isNotNull()
    of = lambda *k: kind.isin(*k)
    wrong_hash = exists & (op["expected"] != F.substring(F.sha2(text, 256), 1, 8))
    n = matches(F.when(of("replace_text"), t["scope"]).otherwise(text), find)
    first, second = t["first"], t["second"]
    n_field = F.coalesce(F.when(op["path"].isNull(), found).otherwise(matches(text, op["find"])), F.lit(0))
    guard = op["expected"].isNull() & F.when(of(*RANGE_KINDS), op["before"].isNull() & op["after"].isNull()).otherwise(True)
    missing_source = ~exists & (op["expected"].isNotNull() | ~F.coalesce(virtual if virtual is not None else F.lit(False), F.lit(False)))
    side = lambda keep: F.array_join(F.filter(lines, keep), "\n")
    needs = ("append_to_file", "delete_file", *RANGE_KINDS, "replace_between_anchors", *SYMBOL_KINDS, "delete_symbol_if_exists", "insert_before_text", "insert_after_text", "replace_text", "insert_before_anchor", "insert_after_anchor")
    hashed = ("replace_file", "append_to_file", "delete_file", *LINK_KINDS, *RANGE_KINDS, "replace_between_anchors", *SYMBOL_KINDS, "delete_symbol_if_exists")
    rules = [
        (~of(*KINDS), "unknown kind"),
        (_unsafe(op["path"]) | _unsafe(op["target"]), "unsafe path"),
        (of(*RANGE_KINDS, *SYMBOL_KINDS) & op["strict"] & guard, "no guard"),
        (of("create_file") & exists & ~op["overwrite"], "file exists"),
        (of("replace_file") & ~exists & op["expected"].isNotNull(), "missing file"),
        (of(*needs) & ~exists, "missing file"),
        (of("assert_symbol_absent", "assert_text_absent", "replace_field_access") & op["path"].isNotNull() & ~exists, "missing file"),
        (of(*LINK_KINDS) & missing_source, "missing file"),
        (of(*hashed) & wrong_hash, "hash differs"),
        (of(*LINK_KINDS) & target_exists & ~op["overwrite"], "target exists"),
        (of(*FOLDER_KINDS) & exists, "not a folder"),
        (of("delete_dir") & ~folder, "missing folder"),
        (of("delete_dir") & ~op["recursive"], "folder not empty"),
        (of("insert_before_text", "insert_after_text", "replace_text") & find.isNull(), "text not found"),
        (of("replace_text") & op["scope"].isNotNull() & (op["s_n"] == 0), "symbol not found"),
        (of("replace_text") & (op["count"] == 0), "bad count"),
        (of("replace_text") & (op["count"] != n), "count differs"),
        (of("replace_text") & (n == 0), "text not found"),
        (of("insert_before_text", "insert_after_text", "replace_text") & op["strict"] & op["count"].isNull() & (n > 1), "text ambiguous"),
        (of("replace_field_access") & ~F.contains(op["find"], F.lit(".")), "no dotted name"),
        (of("replace_field_access") & (op["count"] != n_field), "count differs"),
        (of("replace_field_access") & op["count"].isNull() & (n_field == 0), "text not found"),
        (of("replace_field_access") & op["count"].isNull() & op["strict"] & (n_field > 1), "text ambiguous"),
        (of(*RANGE_KINDS) & ((op["start"] < 1) | (op["stop"] < op["start"])), "bad range"),
        (of(*RANGE_KINDS) & (op["stop"] > F.size(lines)), "range outside file"),
        (of(*RANGE_KINDS) & ~F.contains(side(lambda x, i: i + 1 < op["start"]), op["before"]), "context not found"),
        (of(*RANGE_KINDS) & ~F.contains(side(lambda x, i: i + 1 > op["stop"]), op["after"]), "context not found"),
        (of("insert_before_anchor", "insert_after_anchor") & ~F.contains(text, op["find"]), "anchor not found"),
        (of("replace_between_anchors") & (first.isNull() | second.isNull()), "anchor not found"),
        (of(*SYMBOL_KINDS) & (op["s_n"] == 0), "symbol not found"),
        (of(*SYMBOL_KINDS, "delete_symbol_if_exists") & (op["s_n"] > 1), "symbol ambiguous"),
        (of("replace_method_body") & (op["s_open"].isNull() | op["s_close"].isNull()), "no body"),
        (of("replace_method_body") & (op["s_close"] <= op["s_open"]), "bad range"),
        (of("assert_symbol_absent") & F.when(op["path"].isNull(), found > 0).otherwise(F.contains(text, op["symbol"])), "symbol found"),
        (of("assert_text_absent") & F.when(op["path"].isNull(), found > 0).otherwise(F.contains(text, op["find"])), "text found"),
    ]
    return F.coalesce(*[F.when(rule, F.lit(name)) for rule, name in rules], F.lit(OK))


def edited(op, t) -> Column:
    """The text of an operation's path after it (of a file that stays in place)."""
    text, lines, find, new = t["text"], t["lines"], t["find"], op["content"]
    several = lambda body, f: F.when(op["count"].isNotNull(), F.replace(body, f, new)).otherwise(replace_first(body, f, new))
    first, second = t["first"], t["second"]
    effects = {
        "create_file": new,
        "replace_file": new,
        "append_to_file": F.concat(text, F.when(text.endswith("\n"), "").otherwise("\n"), bare(new), F.lit("\n")),
        "insert_before_text": replace_first(text, find, F.concat(bare(new), F.lit("\n"), find)),
        "insert_after_text": replace_first(text, find, F.concat(find, F.when(find.endswith("\n"), "").otherwise("\n"), bare(new), F.lit("\n"))),
        "replace_text": F.concat(t["head"], several(t["scope"], find), t["tail"]),
        "replace_field_access": several(text, op["find"]),
        "replace_range": with_lines(lines, op["start"], op["stop"], new),
        "delete_range": with_lines(lines, op["start"], op["stop"], None),
        "insert_before_anchor": replace_first(text, op["find"], F.concat(new, F.lit("\n"), op["find"])),
        "insert_after_anchor": replace_first(text, op["find"], F.concat(op["find"], F.lit("\n"), new)),
        "replace_between_anchors": F.when(second > first + 1, with_lines(lines, first + 1, second - 1, new)).otherwise(with_inserted(lines, second, new)),
        "replace_symbol": with_lines(lines, op["s_line"], op["s_end"], new),
        "delete_symbol": with_lines(lines, op["s_line"], op["s_end"], None),
        "delete_symbol_if_exists": F.when(op["s_n"] > 0, with_lines(lines, op["s_line"], op["s_end"], None)).otherwise(text),
        "insert_before_symbol": with_inserted(lines, op["s_line"], new),
        "insert_after_symbol": with_inserted(lines, op["s_end"] + 1, new),
        "replace_method_body": with_lines(lines, op["s_open"] + 1, op["s_close"] - 1, new),
    }
    return reduce(lambda out, x: F.when(op["kind"] == x[0], x[1]).otherwise(out), effects.items(), text)


# plans over files

_SYMBOL = ("s_n", "s_line", "s_end", "s_open", "s_close")


def with_symbols(ops: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``ops`` with how many symbols of its file have the name it gives, and the lines of the first of them."""
    first = F.min(F.struct("line", "line_end", "body_open_line", "body_close_line"))
    named = symbols.join(files.select("file_id", "path"), "file_id").groupBy("path", F.col("name").alias("wanted")).agg(F.count(F.lit(1)).alias("s_n"), first.alias("s"))
    named = named.select("path", "wanted", "s_n", F.col("s.line").alias("s_line"), F.col("s.line_end").alias("s_end"), F.col("s.body_open_line").alias("s_open"), F.col("s.body_close_line").alias("s_close"))
    return ops.withColumn("wanted", F.coalesce("scope", "symbol")).join(named, ["path", "wanted"], "left").drop("wanted").na.fill(0, ["s_n"])


def folders(path: Column) -> Column:
    """Every folder that a path lies in."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def searched(ops: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """ops (find, scope, ...) joined with file_id, path, text of the files of their scope that contain what they look for.

    All needles are searched in one pass over the texts; only files that hold one meet the operations.
    """
    held = holders(files, ops.select(F.col("find").alias("needle"))).withColumnRenamed("needle", "find")
    marked = held.join(changed.select("file_id", F.lit(True).alias("is_changed")).distinct(), "file_id", "left")
    scope = F.coalesce("scope", F.lit("all"))
    met = ops.join(marked, "find").filter((scope == "all") | ((scope == "changed") & F.col("is_changed"))).drop("is_changed")
    return met.join(files.select("file_id", "path", "text"), "file_id")


def found_anywhere(ops: DataFrame, files: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(op_id, found): matches of operations that name no file, in all files or (scope ``changed``) in the changed ones."""
    names = ops.filter(F.col("path").isNull() & (F.col("kind") == "assert_symbol_absent")).select("op_id", "symbol")
    same = names.join(symbols.select(F.col("name").alias("symbol")), "symbol").groupBy("op_id").agg(F.count(F.lit(1)).alias("found"))
    wide = ops.filter(F.col("path").isNull() & F.col("kind").isin("replace_field_access", "assert_text_absent")).select("op_id", "find", "scope")
    if wide.isEmpty():
        return same
    # each text is searched once for a needle and scope, however many operations ask for them
    asked = wide.select("find", F.coalesce("scope", F.lit("all")).alias("scope")).distinct()
    counts = searched(asked, files, changed).groupBy("find", "scope").agg(F.sum(matches(F.col("text"), F.col("find"))).alias("found"))
    texts = wide.withColumn("scope", F.coalesce("scope", F.lit("all"))).join(counts, ["find", "scope"]).select("op_id", "found")
    return texts.unionByName(same)


def check_ops(ops: DataFrame, files: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """op_id, kind, path, verdict of every operation."""
    ops = cut(with_symbols(plan(ops), files, symbols))
    made = F.when(F.col("kind").isin("create_file", "replace_file"), True).when(F.col("kind").isin("delete_file", "move_file", "rename_file"), False)
    events = ops.select("op_id", "path", made.alias("there")).unionByName(ops.filter(F.col("kind").isin(*LINK_KINDS)).select("op_id", F.col("target").alias("path"), F.lit(True).alias("there")))
    events = events.filter("there IS NOT NULL AND path IS NOT NULL").select("op_id", "path", "there", F.lit(False).alias("asks"))
    asks = ops.filter(F.col("kind").isin(*LINK_KINDS)).select("op_id", "path", F.lit(None).cast("boolean").alias("there"), F.lit(True).alias("asks"))
    earlier = Window.partitionBy("path").orderBy("op_id", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    virtual = events.unionByName(asks).withColumn("virtual", F.last("there", ignorenulls=True).over(earlier)).filter("asks").select("op_id", "virtual")
    at = files.select(F.col("path"), F.col("text").alias("own"))
    targets = files.select(F.col("path").alias("target"), F.lit(True).alias("target_there"))
    dirs = files.select(F.explode(folders(F.col("path"))).alias("path")).distinct().withColumn("is_folder", F.lit(True))
    # the texts come last, so that no other join carries them
    rows = ops.join(targets, "target", "left").join(virtual, "op_id", "left").join(found_anywhere(ops, files, symbols, changed), "op_id", "left")
    rows = rows.join(dirs.join(ops.filter(F.col("kind").isin(*FOLDER_KINDS)).select("path").distinct(), "path"), "path", "left")
    rows = rows.join(at, "path", "left")
    rows = cut(rows)  # the rules are a large expression, planned once over what was joined
    op = {c: F.col(c) for c in (*PLAN, *_SYMBOL)}
    flags = F.coalesce("target_there", F.lit(False)), F.coalesce("is_folder", F.lit(False)), F.coalesce("found", F.lit(0)), F.col("virtual")
    said = bind(seen(op, F.col("own")), lambda t: verdict(op, t, *flags))
    return rows.select("op_id", "kind", "path", said.alias("verdict"))


WIDE_KINDS = ("replace_field_access", "assert_symbol_absent", "assert_text_absent")
#: What a failed operation stops: the group of paths that its own is linked to, nothing but itself, or all operations after it.
ON_ERROR = ("group", "skip", "stop")


def wide(ops: DataFrame, files: DataFrame, symbols: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations on each file, failures) of the operations that name no file.

    They are judged by all files as they were before the plan. A count that holds for all
    files together becomes each file's own.
    """
    unnamed = ops.filter(F.col("path").isNull() & F.col("kind").isin(*WIDE_KINDS))
    found = unnamed.join(found_anywhere(ops, files, symbols, changed), "op_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    none = F.lit(None)
    symbol_columns = {"s_n": F.lit(0), **{c: none.cast("bigint") for c in _SYMBOL[1:]}}
    op = {c: F.col(c) if c in PLAN else symbol_columns[c] for c in (*PLAN, *_SYMBOL)}
    text = F.lit(None).cast("string")
    judged = cut(found.withColumn("rule", bind(seen(op, text), lambda t: verdict(op, t, F.lit(False), F.lit(False), F.col("found")))))
    failures = judged.filter(F.col("rule") != OK).select("op_id", F.concat_ws(" ", F.col("op_id").cast("string"), "kind", "rule").alias("failed"))
    spread = judged.filter((F.col("rule") == OK) & (F.col("kind") == "replace_field_access")).drop("path", "found", "rule")
    if spread.isEmpty():
        return spread.withColumn("path", F.lit(None).cast("string")).transform(plan), failures
    each = searched(spread, files, changed)
    own_count = F.when(F.col("count").isNotNull(), matches(F.col("text"), F.col("find")))
    return plan(each.withColumn("count", own_count).drop("text", "scope", "file_id")), failures


def apply_ops(ops: DataFrame, files: DataFrame, symbols: DataFrame, changed: DataFrame, on_error: str = "group") -> DataFrame:
    """path, text, failed of every path that the plan touches, after its operations in order of op_id.

    text is null where the file is gone (or never was). An operation that breaks a rule, an
    assertion too, changes nothing; ``failed`` names it and the rule, for every path of its group.
    ``on_error``: ``group``, the group stays as it was and only its first failure is named;
    ``skip``, the operations after it run, and all failures are named; ``stop``, no operation of
    the plan after the first failure runs. A failed operation that names no file has a row without a path.
    A folder, or a file that is only asserted about, has a row only to name a failure. ``delete_dir`` takes files that the plan itself made.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error is one of {ON_ERROR}")
    ops = cut(plan(ops))
    each, failures = wide(ops, files, symbols, changed)
    todo = cut(with_symbols(ops.filter("path IS NOT NULL").unionByName(each), files, symbols))
    failures = cut(failures)
    if on_error == "stop":
        folded = fold(todo, files, skip=True)
        first = folded.select(F.explode("failures").alias("f")).select("f.op_id").unionByName(failures.select("op_id")).agg(F.min("op_id")).first()[0]
        if first is not None:
            named = folded.select("failures").unionByName(failures.select(F.array(F.struct("op_id", F.col("failed").alias("what"))).alias("failures")))
            what = named.select(F.explode("failures").alias("f")).filter(F.col("f.op_id") == first).agg(F.min("f.what")).first()[0]
            done = result(fold(todo.filter(F.col("op_id") < first), files, skip=True), files)
            return done.unionByName(files.sparkSession.createDataFrame([(None, None, what)], "path string, text string, failed string"))
    out = result(fold(todo, files, skip=on_error != "group"), files)
    return out.unionByName(failures.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text"), "failed"))


def fold(ops: DataFrame, files: DataFrame, skip: bool) -> DataFrame:
    """paths, texts, end (texts, removed folders), failures of each group of linked paths.

    ops: operations that name a path, with ``with_symbols``. A folder is in a map of
    texts as its path with a slash.
    """
    folder_ops = ops.filter(F.col("kind").isin(*FOLDER_KINDS))
    touched = ops.select("path").unionByName(ops.filter("target IS NOT NULL").select(F.col("target").alias("path"))).distinct()
    under = touched.select("path", F.explode(folders(F.col("path"))).alias("folder"))
    links = ops.filter("target IS NOT NULL").select(F.col("path").alias("a"), F.col("target").alias("b"))
    links = links.unionByName(under.join(folder_ops.select(F.col("path").alias("folder")).distinct(), "folder").filter("path <> folder").select(F.col("path").alias("a"), F.col("folder").alias("b")))
    names = linked(links)
    touched = touched.join(names, "path", "left").select("path", F.coalesce("group", "path").alias("group"))
    state = touched.join(files.select("path", "text"), "path", "left").groupBy("group").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("path", "text")))).alias("texts"), F.collect_list("path").alias("paths")
    )
    others = untouched(folder_ops.select("path"), files, ops).groupBy("folder").agg(F.count(F.lit(1)).alias("others"))
    rows = ops.join(others.withColumnRenamed("folder", "path"), "path", "left").na.fill(0, ["others"])
    columns = [*PLAN, *_SYMBOL, "others"]
    todo = rows.join(names, "path", "left").groupBy(F.coalesce("group", "path").alias("group")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("ops"))

    def put(texts: Column, path: Column, text: Column) -> Column:
        others = F.map_filter(texts, lambda k, v: k != path)
        return F.when(text.isNull(), others).otherwise(F.map_concat(others, F.create_map(path, text)))

    def left_under(acc: Column, op: Column) -> Column:
        """Files under an operation's folder that no other operation names, less those of folders removed before."""
        above = F.exists(F.map_keys(acc["removed"]), lambda k: (op["path"] == k) | F.startswith(op["path"], F.concat(k, F.lit("/"))))
        within = F.aggregate(F.map_entries(acc["removed"]), F.lit(0).cast("bigint"), lambda n, e: n + F.when(F.startswith(e["key"], F.concat(op["path"], F.lit("/"))), e["value"]).otherwise(0))
        return F.when(above, F.lit(0).cast("bigint")).otherwise(op["others"] - within)

    def step(acc: Column, op: Column) -> Column:
        none = F.lit(None).cast("string")
        there = F.map_contains_key(acc["texts"], F.coalesce(op["target"], F.lit("")))
        gone = op["kind"].isin("delete_file", "move_file", "rename_file")
        inside = F.filter(F.map_keys(acc["texts"]), lambda k: F.startswith(k, F.concat(op["path"], F.lit("/"))))
        is_folder = op["kind"].isin(*FOLDER_KINDS)
        # files under a folder, and whether it is there at all
        held = F.when(is_folder, left_under(acc, op) + F.size(F.filter(inside, lambda k: ~k.endswith("/")))).otherwise(0)
        stands = F.when(is_folder, (held > 0) | (F.size(inside) > 0)).otherwise(False)

        def judge(t: Column) -> Column:
            rule = verdict(op, t, there, stands, F.lit(0))
            rule = F.when((op["kind"] == "delete_dir") & (rule == "folder not empty") & (held == 0), OK).otherwise(rule)
            return F.struct(rule.alias("rule"), F.when(gone, none).otherwise(edited(op, t)).alias("text"), t["text"].alias("own"))

        def turned(x: Column) -> Column:
            after = put(acc["texts"], op["path"], x["text"])
            after = F.when(op["kind"].isin(*LINK_KINDS), put(after, F.coalesce(op["target"], F.lit("")), x["own"])).otherwise(after)
            after = F.when(op["kind"] == "create_dir", put(acc["texts"], F.concat(op["path"], F.lit("/")), F.lit(""))).otherwise(after)
            without = F.map_filter(acc["texts"], lambda k, v: ~F.startswith(k, F.concat(op["path"], F.lit("/"))))
            after = F.when(op["kind"] == "delete_dir", without).otherwise(after)
            kept = F.map_filter(acc["removed"], lambda k, v: ~F.startswith(k, F.concat(op["path"], F.lit("/"))) & (k != op["path"]))
            removed = F.when(op["kind"] == "delete_dir", F.map_concat(kept, F.create_map(op["path"], op["others"]))).otherwise(acc["removed"])
            still = x["rule"] != OK if skip else (F.size(acc["failures"]) > 0) | (x["rule"] != OK)
            wrong = F.array(F.struct(op["op_id"].alias("op_id"), F.concat_ws(" ", op["op_id"].cast("string"), op["kind"], x["rule"]).alias("what")))
            noted = x["rule"] != OK if skip else (F.size(acc["failures"]) == 0) & (x["rule"] != OK)
            return F.struct(
                F.when(still, acc["texts"]).otherwise(after).alias("texts"), F.when(still, acc["removed"]).otherwise(removed).alias("removed"),
                F.when(noted, F.concat(acc["failures"], wrong)).otherwise(acc["failures"]).alias("failures"),
            )

        return bind(bind(seen(op, F.try_element_at(acc["texts"], op["path"])), judge), turned)

    start = F.struct(
        F.col("texts"), F.create_map().cast("map<string, bigint>").alias("removed"), F.array().cast("array<struct<op_id: bigint, what: string>>").alias("failures"),
    )
    ready = cut(state.join(todo, "group"))
    changes = F.filter("ops", lambda o: ~o["kind"].isin(*FOLDER_KINDS, *ASSERTIONS))
    changing = F.flatten(F.transform(changes, lambda o: F.array_compact(F.array(o["path"], o["target"]))))
    named = F.transform(F.filter("ops", lambda o: o["kind"].isin(*FOLDER_KINDS)), lambda o: o["path"])
    done = ready.select("paths", "texts", changing.alias("changing"), named.alias("folders"), F.aggregate("ops", start, step).alias("end"))
    stays = F.lit(False) if skip else F.size("end.failures") > 0
    return cut(done.select(
        "paths", "changing", "folders", "texts", F.when(stays, F.col("texts")).otherwise(F.col("end.texts")).alias("final"),
        F.when(stays, F.create_map().cast("map<string, bigint>")).otherwise(F.col("end.removed")).alias("removed"), F.col("end.failures").alias("failures"),
    ))


def untouched(folder_paths: DataFrame, files: DataFrame, ops: DataFrame) -> DataFrame:
    """(path, folder): files under the folders that no operation names itself."""
    named = ops.select("path").unionByName(ops.filter("target IS NOT NULL").select(F.col("target").alias("path"))).distinct()
    inside = files.select("path", F.explode(folders(F.col("path"))).alias("folder")).join(folder_paths.select(F.col("path").alias("folder")).distinct(), "folder")
    return inside.filter("path <> folder").join(named, "path", "left_anti").select("path", "folder")


def result(folded: DataFrame, files: DataFrame) -> DataFrame:
    """path, text, failed of what ``fold`` gives."""
    failed = F.when(F.size("failures") > 0, F.array_join(F.transform("failures", lambda f: f["what"]), "; "))
    rows = folded.select(F.explode("paths").alias("path"), "final", "changing", "folders", "removed", failed.alias("failed"))
    deleted = F.exists(F.map_keys("removed"), lambda k: F.startswith(F.col("path"), F.concat(k, F.lit("/"))))
    deleted = deleted & ~F.array_contains("folders", F.col("path"))
    own = rows.filter(F.array_contains("changing", F.col("path")) | deleted | F.col("failed").isNotNull())
    own = own.select("path", F.try_element_at("final", F.col("path")).alias("text"), "failed")
    removed = folded.select(F.explode(F.map_keys("removed")).alias("path"))
    names = folded.select(F.explode("paths").alias("path"), F.lit(None).cast("string").alias("target"))
    gone = untouched(removed, files, names).select("path").distinct()
    return own.unionByName(gone.select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("failed")))
