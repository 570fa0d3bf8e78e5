"""Edit plans and patches on small files: every kind of operation, its rules and its effect."""

import pytest

from textloom.plans.groups import linked
from textloom.plans import ops, patches

LIB = "one\nfn start() {\n  body\n}\nlast\n"
FILES = [("f1", "a/lib.rs", LIB), ("f2", "a/crlf.rs", "x\r\ny\r\nz"), ("f3", "b/use.ts", "a.b and a.b\nmark A\nold\nmark B\n"), ("f4", "b/deep/x.ts", "a.b"), ("f5", "c.txt", "")]
SYMBOLS = [("start", "f1", 2, 4, 2, 4), ("twin", "f3", 1, 1, None, None), ("twin", "f3", 2, 2, None, None)]
COLUMNS = "op_id bigint, kind string, path string, target string, find string, until string, content string, start bigint, stop bigint, symbol string, scope string, expected string, before string, after string, count bigint, overwrite boolean, recursive boolean, strict boolean"
NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


@pytest.fixture(scope="module")
def world(spark):
    files = spark.createDataFrame(FILES, "file_id string, path string, text string")
    symbols = spark.createDataFrame(SYMBOLS, "name string, file_id string, line bigint, line_end bigint, body_open_line bigint, body_close_line bigint")
    return files, symbols, spark.createDataFrame([("f4", "M")], "file_id string, status string")


def plan(spark, *rows):
    return spark.createDataFrame([tuple(({"op_id": k} | r).get(c) for c in NAMES) for k, r in enumerate(rows, 1)], COLUMNS)


def op(kind, path=None, **more):
    return {"kind": kind, "path": path, **more}


EFFECTS = [
    (op("create_file", "n/new.txt", content="hello"), {"n/new.txt": "hello"}),
    (op("replace_file", "a/lib.rs", content="hello"), {"a/lib.rs": "hello"}),
    (op("append_to_file", "a/crlf.rs", content="more \n\n"), {"a/crlf.rs": "x\r\ny\r\nz\nmore\n"}),
    (op("delete_file", "a/lib.rs"), {"a/lib.rs": None}),
    (op("copy_file", "a/lib.rs", target="a/two.rs"), {"a/lib.rs": LIB, "a/two.rs": LIB}),
    (op("move_file", "a/lib.rs", target="a/two.rs"), {"a/lib.rs": None, "a/two.rs": LIB}),
    (op("rename_file", "a/lib.rs", target="a/two.rs"), {"a/lib.rs": None, "a/two.rs": LIB}),
    (op("create_dir", "new"), {}),
    (op("delete_dir", "b", recursive=True), {"b/use.ts": None, "b/deep/x.ts": None}),
    (op("insert_before_text", "a/lib.rs", find="last", content="new\n"), {"a/lib.rs": LIB.replace("last", "new\nlast")}),
    (op("insert_after_text", "a/lib.rs", find="one", content="new"), {"a/lib.rs": LIB.replace("one", "one\nnew\n")}),
    (op("replace_text", "a/crlf.rs", find="x\ny", content="w"), {"a/crlf.rs": "w\r\nz"}),
    (op("replace_text", "b/use.ts", find="a.b", content="c", count=2), {"b/use.ts": "c and c\nmark A\nold\nmark B\n"}),
    (op("replace_text", "a/lib.rs", find="n", content="N", scope="start"), {"a/lib.rs": LIB.replace("fn", "fN")}),
    (op("replace_field_access", None, find="a.b", content="c.d", scope="changed"), {"b/deep/x.ts": "c.d"}),
    (op("replace_field_access", None, find="a.b", content="c.d"), {"b/deep/x.ts": "c.d", "b/use.ts": "c.d and a.b\nmark A\nold\nmark B\n"}),
    (op("replace_range", "a/lib.rs", start=2, stop=4, content="new\n"), {"a/lib.rs": "one\nnew\nlast\n"}),
    (op("delete_range", "a/lib.rs", start=2, stop=4), {"a/lib.rs": "one\nlast\n"}),
    (op("insert_before_anchor", "b/use.ts", find="mark A", content="new"), {"b/use.ts": "a.b and a.b\nnew\nmark A\nold\nmark B\n"}),
    (op("insert_after_anchor", "b/use.ts", find="mark A", content="new"), {"b/use.ts": "a.b and a.b\nmark A\nnew\nold\nmark B\n"}),
    (op("replace_between_anchors", "b/use.ts", find="mark A", until="mark B", content="new"), {"b/use.ts": "a.b and a.b\nmark A\nnew\nmark B\n"}),
    (op("replace_between_anchors", "b/use.ts", find="a.b", until="mark A", content="new"), {"b/use.ts": "a.b and a.b\nnew\nmark A\nold\nmark B\n"}),
    (op("replace_symbol", "a/lib.rs", symbol="start", content="new"), {"a/lib.rs": "one\nnew\nlast\n"}),
    (op("delete_symbol", "a/lib.rs", symbol="start"), {"a/lib.rs": "one\nlast\n"}),
    (op("insert_before_symbol", "a/lib.rs", symbol="start", content="new"), {"a/lib.rs": LIB.replace("fn", "new\nfn")}),
    (op("insert_after_symbol", "a/lib.rs", symbol="start", content="new"), {"a/lib.rs": LIB.replace("last", "new\nlast")}),
    (op("replace_method_body", "a/lib.rs", symbol="start", content="  new"), {"a/lib.rs": LIB.replace("body", "new")}),
    (op("delete_symbol_if_exists", "a/lib.rs", symbol="start"), {"a/lib.rs": "one\nlast\n"}),
    (op("delete_symbol_if_exists", "a/lib.rs", symbol="other"), {"a/lib.rs": LIB}),
    (op("assert_symbol_absent", None, symbol="other"), {}),
    (op("assert_text_absent", None, find="@@"), {}),
]


def test_every_kind_has_an_effect_here():
    assert {x["kind"] for x, _ in EFFECTS} == set(ops.KINDS) == set(ops.required_fields()) and len(ops.KINDS) == 26


def test_effects(spark, world):
    found = ops.check_ops(plan(spark, *[x for x, _ in EFFECTS]), *world).collect()
    assert {r.op_id: r.verdict for r in found} == {k: ops.OK for k in range(1, len(EFFECTS) + 1)}
    # each operation that names a file works in a copy of the files of its own
    files = [(f"{k}:{i}", f"{k}/{p}", t) for k in range(len(EFFECTS)) for i, p, t in FILES]
    symbols = [(n, f"{k}:{i}", *rest) for k in range(len(EFFECTS)) for n, i, *rest in SYMBOLS]
    moved = [x | {c: f"{k}/{x[c]}" for c in ("path", "target") if x.get(c)} for k, (x, _) in enumerate(EFFECTS) if x["path"]]
    many = spark.createDataFrame(files, "file_id string, path string, text string"), spark.createDataFrame(symbols, world[1].schema), world[2]
    got = {r.path: r.text for r in ops.apply_ops(plan(spark, *moved), *many).collect()}
    assert got == {f"{k}/{p}": t for k, (x, want) in enumerate(EFFECTS) if x["path"] for p, t in want.items()}
    for x, want in [e for e in EFFECTS if e[0]["kind"] == "replace_field_access"]:
        assert {r.path: r.text for r in ops.apply_ops(plan(spark, x), *world).collect()} == want


def test_rules(spark, world):
    wrong = [
        (op("shuffle", "a/lib.rs"), "unknown kind"),
        (op("delete_file", "../x"), "unsafe path"),
        (op("copy_file", "a/lib.rs", target="/etc/x"), "unsafe path"),
        (op("replace_range", "a/lib.rs", start=1, stop=1, content="", strict=True), "no guard"),
        (op("create_file", "a/lib.rs", content=""), "file exists"),
        (op("replace_file", "no", content="", expected="00"), "missing file"),
        (op("delete_file", "no"), "missing file"),
        (op("delete_file", "a/lib.rs", expected="00000000"), "hash differs"),
        (op("move_file", "a/lib.rs", target="c.txt"), "target exists"),
        (op("create_dir", "c.txt"), "not a folder"),
        (op("delete_dir", "none"), "missing folder"),
        (op("delete_dir", "a"), "folder not empty"),
        (op("insert_after_text", "a/lib.rs", find="zzz", content=""), "text not found"),
        (op("insert_before_text", "b/use.ts", find="a.b", content="", strict=True), "text ambiguous"),
        (op("replace_text", "b/use.ts", find="a.b", content="", count=3), "count differs"),
        (op("replace_field_access", None, find="ab", content=""), "no dotted name"),
        (op("replace_field_access", None, find="a.b", content="", count=2), "count differs"),
        (op("replace_range", "a/lib.rs", start=0, stop=1, content=""), "bad range"),
        (op("delete_range", "a/lib.rs", start=5, stop=6), "range outside file"),
        (op("delete_range", "a/lib.rs", start=2, stop=2, after="one"), "context not found"),
        (op("insert_after_anchor", "a/lib.rs", find="zzz", content=""), "anchor not found"),
        (op("replace_between_anchors", "b/use.ts", find="mark B", until="mark A", content=""), "anchor not found"),
        (op("replace_symbol", "a/lib.rs", symbol="zzz", content=""), "symbol not found"),
        (op("delete_symbol", "b/use.ts", symbol="twin"), "symbol ambiguous"),
        (op("assert_symbol_absent", None, symbol="start"), "symbol found"),
        (op("assert_text_absent", None, find="mark A"), "text found"),
        (op("assert_text_absent", None, find="mark A", scope="changed"), ops.OK),
    ]
    found = {r.op_id: r.verdict for r in ops.check_ops(plan(spark, *[x for x, _ in wrong]), *world).collect()}
    assert found == {k: want for k, (_, want) in enumerate(wrong, 1)}


def test_operations_see_those_before_them(spark, world):
    rows = [
        op("create_file", "n/a.txt", content="a\n"), op("append_to_file", "n/a.txt", content="b"), op("move_file", "n/a.txt", target="n/b.txt"),
        op("append_to_file", "n/b.txt", content="c"), op("copy_file", "n/a.txt", target="n/c.txt"), op("delete_file", "a/lib.rs"), op("append_to_file", "a/lib.rs", content="x"),
    ]
    said = {r.op_id: r.verdict for r in ops.check_ops(plan(spark, *rows), *world).collect()}
    assert said[3] == ops.OK and said[5] == "missing file"  # moved away before
    got = {r.path: (r.text, r.failed) for r in ops.apply_ops(plan(spark, *rows[:4]), *world).collect()}
    assert got == {"n/a.txt": (None, None), "n/b.txt": ("a\nb\nc\n", None)}
    got = {r.path: (r.text, r.failed) for r in ops.apply_ops(plan(spark, *rows), *world).collect()}
    # a group with a failure stays as it was
    assert got["a/lib.rs"] == (LIB, "7 append_to_file missing file") and got["n/b.txt"] == (None, "5 copy_file missing file")


def test_folders_and_assertions_in_order(spark, world):
    """Folder rules hold, folders take what the plan made, assertions count, and a failure stops what it should."""
    applied = lambda rows, **how: {r.path: (r.text, r.failed) for r in ops.apply_ops(plan(spark, *rows), *world, **how).collect()}
    kept = applied([op("delete_dir", "a")])
    assert kept == {"a": (None, "1 delete_dir folder not empty")}
    inside = {p for _, p, _ in FILES if p.startswith("b/")}
    made = applied([op("create_file", "b/new.ts", content="n\n"), op("delete_dir", "b", recursive=True)])
    assert made == {p: (None, None) for p in {*inside, "b/new.ts"}}
    nested = applied([op("create_file", "b/x/new.ts", content="n\n"), op("delete_dir", "b/x", recursive=True), op("delete_dir", "b", recursive=True), op("create_file", "b/again.ts", content="2\n")])
    assert nested == {**{p: (None, None) for p in {*inside, "b/x/new.ts"}}, "b/again.ts": ("2\n", None)}
    assert applied([op("create_dir", "fresh"), op("delete_dir", "fresh")]) == {}
    assert applied([op("delete_dir", "none", recursive=True)]) == {"none": (None, "1 delete_dir missing folder")}
    guarded = [op("assert_text_absent", "a/lib.rs", find="fn"), op("delete_file", "a/lib.rs"), op("append_to_file", "c.txt", content="end")]
    whole = {p: t for _, p, t in FILES}
    said = "1 assert_text_absent text found"
    assert applied(guarded)["a/lib.rs"] == (LIB, said) and applied(guarded)["c.txt"] == (whole["c.txt"].rstrip("\n") + "\nend\n", None)
    assert applied(guarded, on_error="skip")["a/lib.rs"] == (None, said)
    assert applied(guarded, on_error="stop") == {None: (None, said)}
    late = [op("append_to_file", "c.txt", content="end"), *guarded[:2]]
    assert applied(late, on_error="stop") == {"c.txt": (whole["c.txt"].rstrip("\n") + "\nend\n", None), None: (None, "2 assert_text_absent text found")}
    with pytest.raises(ValueError):
        ops.apply_ops(plan(spark, *late), *world, on_error="go on")


def test_a_count_over_all_files(spark, world):
    n = sum(t.count("a.b") for _, _, t in FILES)
    holding = {p: t for _, p, t in FILES if "a.b" in t}
    got = {r.path: (r.text, r.failed) for r in ops.apply_ops(plan(spark, op("replace_field_access", None, find="a.b", content="a.c", count=n)), *world).collect()}
    assert got == {p: (t.replace("a.b", "a.c"), None) for p, t in holding.items()} and n > 1
    got = [(r.path, r.failed) for r in ops.apply_ops(plan(spark, op("replace_field_access", None, find="a.b", content="a.c", count=n + 1)), *world).collect()]
    assert got == [(None, "1 replace_field_access count differs")]
    got = [(r.path, r.failed) for r in ops.apply_ops(plan(spark, op("assert_text_absent", None, find="mark A")), *world).collect()]
    assert got == [(None, "1 assert_text_absent text found")]


def test_a_long_chain_of_links_is_one_group(spark):
    rows = [(f"p{k:03}", f"p{k + 1:03}") for k in range(200)] + [("q1", "q2")]
    got = {r.path: r.group for r in linked(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert len(got) == 203 and {g for p, g in got.items() if p[0] == "p"} == {"p000"} and got["q2"] == "q1"
    assert linked(spark.createDataFrame([], "a string, b string")).count() == 0


DIFF = """diff --git a/src/store.ts b/src/store.ts
index 1..2 100644
--- a/src/store.ts
+++ b/src/store.ts
@@ -1,2 +1,3 @@
 one
+two
 three
@@ -9 +10,2 @@ fn x
-nine
+NINE
+ten
\\ No newline at end of file
diff --git a/old.ts b/new.ts
--- /dev/null
+++ b/new.ts
@@ -0,0 +1 @@
+fresh
"""


def test_light_and_full_diffs(spark):
    rows = patches.patch_lines(spark.createDataFrame([("p", DIFF)], "patch_id string, text string"))
    got = sorted((r.old_path, r.new_path, r.line) for r in patches.added_lines(rows).collect())
    assert got == [("old.ts", "new.ts", 1), ("src/store.ts", "src/store.ts", 2), ("src/store.ts", "src/store.ts", 10), ("src/store.ts", "src/store.ts", 11)]
    full = sorted(patches.parsed(rows).collect(), key=lambda r: r.file)
    assert [(r.old_path, r.new_path, r.error) for r in full] == [("src/store.ts", "src/store.ts", None), (None, "new.ts", None)]
    assert [(h.old_start, h.old, h.new) for h in full[0].hunks] == [(1, ["one", "three"], ["one", "two", "three"]), (9, ["nine"], ["NINE", "ten"])]


def test_patches_apply_or_say_why(spark):
    head = "--- a/x.ts\n+++ b/x.ts\n"
    texts = {
        1: DIFF, 2: head, 3: head + "@@ -1 +1 @@\n-gone\n+new", 4: "--- a/../x\n+++ b/../x\n@@ -1 +1 @@\n-a\n+b", 5: head + "@@ -1 +1 @@\n*odd", 6: "--- a/no\n+++ b/no\n@@ -1 +1 @@\n-a\n+b",
    }
    files = spark.createDataFrame([("src/store.ts", "one\r\nthree\r\nnine\r\n"), ("x.ts", "here\n")], "path string, text string")
    got = {(r.patch_id, r.path): (r.status, r.text) for r in patches.apply_patches(spark.createDataFrame(list(texts.items()), "patch_id bigint, text string"), files).collect()}
    assert got == {
        (1, "src/store.ts"): ("dry-run ok", "one\ntwo\nthree\nNINE\nten\n"), (1, "new.ts"): ("dry-run ok", "fresh\n"), (2, "x.ts"): ("no hunks", None),
        (3, "x.ts"): ("hunk 1 context mismatch near line 1", None), (4, "../x"): ("unsafe path", None), (5, "x.ts"): ("unsupported line", None), (6, "no"): ("target missing", None),
    }
