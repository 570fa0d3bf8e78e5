"""Substring search, orphan files and import checks: brute force, and the facts of small repositories."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import names as N
from textloom.functions import substrings as S
from textloom.operators import imports as I
from textloom.sources.scan import bound, porcelain, scan


def write(root, files):
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


@pytest.mark.parametrize("piece", [S.PIECE, 16])
def test_holders_match_brute_force(spark, piece):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abé/.ß日") for _ in range(n))
    texts = [(i, text(rng.randrange(300))) for i in range(60)] + [(100, None), (101, ""), (102, "x" * 5000 + "needle" + "y" * 5000)]
    needles = {text(rng.randrange(1, 9)) for _ in range(300)} | {"needle", "x" * 40, "日", "never here"}
    frame = spark.createDataFrame([(n,) for n in needles] + [("",), (None,), ("needle",)], "needle string").repartition(3)
    found = S.holders(spark.createDataFrame(texts, "file_id bigint, text string").repartition(3), frame, piece_size=piece)
    got = sorted((r.file_id, r.needle) for r in found.collect())
    assert got == sorted((i, n) for i, t in texts for n in needles if t and n in t) and len(got) > 1000
    assert S.holders(spark.createDataFrame(texts, "file_id bigint, text string"), frame.limit(0)).count() == 0


def test_containing_matches_brute_force(spark):
    rng = random.Random(6)
    name = lambda n: "".join(rng.choice("abc/") for _ in range(n))
    names, needles = [(name(rng.randrange(12)), i) for i in range(200)], sorted({name(k) for k in (1, 2, 3, 4, 6) for _ in range(20)} | {"zzz", "aaz"})
    got = S.containing(spark.createDataFrame([(n,) for n in needles] + [("",)], "needle string"), spark.createDataFrame(names, "name string, ord bigint")).collect()
    assert sorted((r.needle, r.ord) for r in got) == sorted((n, i) for n in needles for t, i in names if n in t)


def test_orphans_of_a_repository(spark, tmp_path):
    files = {
        "src/features/assets/AssetTreePanel.tsx": "import { x } from './AssetBrowserPanel';\nconst a = 1;\n",
        "src/features/assets/AssetBrowserPanel.tsx": "import { y } from './AssetTreePanel';\n",
        "src/features/assets/AssetRegistryTree.tsx": "export { Thing } from './thing';\n",
        "src/features/lonely.ts": "".join(f"line {i};\n" for i in range(9)),
        "src/features/tests/lone.ts": "alone\n",
        "src/index.ts": "alone too\n",
        "src/other.ts": "AssetRegistry is not named whole\n",
    }
    write(tmp_path, files)
    rel = bound(spark, str(tmp_path))
    none = spark.createDataFrame([], "source string, target string, kind string")
    got = {r.path.rsplit("/", 1)[1]: (r.refs, r.status) for r in I.orphans(rel.files, none, "src/features").collect()}
    assert got == {"AssetTreePanel.tsx": (1, "referenced"), "AssetBrowserPanel.tsx": (1, "referenced"), "AssetRegistryTree.tsx": (0, "forwarding"), "lonely.ts": (0, "orphan")}
    with_imports = {r.path.rsplit("/", 1)[1]: r.refs for r in I.orphans(rel.files, rel.dependencies, "src/features").collect()}
    assert with_imports["AssetTreePanel.tsx"] == 2
    every = {r.path for r in I.orphans(rel.files, none).collect()}
    assert len(every) == 5 and not any(p.endswith(("index.ts", "lone.ts")) for p in every)


def test_stems_and_names(spark):
    rows = spark.createDataFrame([("a/b.c/d.spec.ts",), (".gitignore",), ("a/Makefile",), ("x/.env.local",)], "path string")
    got = [tuple(r) for r in rows.select(I.file_name(F.col("path")), I.stem(F.col("path"))).collect()]
    assert got == [("d.spec.ts", "d.spec"), (".gitignore", ".gitignore"), ("Makefile", "Makefile"), (".env.local", ".env")]


def test_imports_of_a_repository(spark, tmp_path):
    write(tmp_path, {
        "src/app/MainEditorWindow.tsx": 'import { Panels } from "./workspacePanels";\nimport { Next } from "./SelectionPanel";\nimport React from "react";\nimport { deep } from "../../lib/deep";\n',
        "src/features/SelectionPanel.tsx": "export const SelectionPanel = () => null;\n",
        "src/features/unchanged.ts": 'import { gone } from "./nowhere";\n',
        "lib/deep.ts": "export const deep = 1;\n",
    })
    status = porcelain(spark.createDataFrame([(" M src/app/MainEditorWindow.tsx",), (" D src/app/workspacePanels.tsx",)], "line string"))
    rel = bound(spark, str(tmp_path), status)
    rows = rel.imports.select(F.col("url").alias("path"), F.col("ord").alias("line"), "specifier")
    got = {(r.specifier, r.line): r for r in I.check_imports(rows, rel.files, status, changed_only=True).collect()}
    assert {k: (r.finding, r.candidate, r.reach) for k, r in got.items()} == {
        ("./workspacePanels", 1): ("stale", None, "flat"),
        ("./SelectionPanel", 2): ("broken", "src/features/SelectionPanel.tsx", "flat"),
        ("../../lib/deep", 4): ("found", None, "deep"),
    }
    assert got["./workspacePanels", 1].target == "src/app/workspacePanels.tsx" and got["../../lib/deep", 4].target == "lib/deep.ts"
    everything = I.check_imports(rows, rel.files, status).collect()
    assert len(everything) == 4 and {r.finding for r in everything if r.specifier == "./nowhere"} == {"broken"}


def test_a_deleted_file_is_met_by_whole_folders_only(spark):
    tries = spark.createDataFrame([(1, "app/b.ts"), (2, "b.ts"), (3, "x/app/b.ts"), (4, "pp/b.ts")], "key bigint, candidate string")
    deleted = spark.createDataFrame([("src/app/b.ts",), ("z/src/app/b.ts",)], "path string")
    got = {r.key: r.deleted for r in I.deleted_targets(tries, deleted).collect()}
    assert got == {1: "src/app/b.ts", 2: "src/app/b.ts"}


def test_a_repository_below_an_ignored_name(spark, tmp_path):
    root = tmp_path / "build" / "target" / "repo"
    write(root, {"a.rs": "fn a() {}\n", "src/build.rs": "fn b() {}\n", "build/c.rs": "fn c() {}\n", "x/node_modules/d.ts": "let d;\n"})
    assert {r.path.rsplit("/", 1)[1] for r in scan(spark, str(root)).collect()} == {"a.rs", "build.rs"}
    assert {r.path for r in bound(spark, f"file://{root}/").files.collect()} == {"a.rs", "src/build.rs"}


def test_status_keeps_both_letters(spark):
    lines = ["?? new.txt", "MM both.txt", "AM added.txt", " M tree.txt", "M  index.txt", "R  old.txt -> new name.txt", 'D  "spaced \\ name"']
    got = [(r.status, r.path, r.original) for r in porcelain(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got[:5] == [("??", "new.txt", None), ("MM", "both.txt", None), ("AM", "added.txt", None), ("M", "tree.txt", None), ("M", "index.txt", None)]
    assert got[5] == ("R", "new name.txt", "old.txt") and got[6][0] == "D"


def test_a_module_is_named_in_one_pass_and_sought_once(spark):
    pairs = spark.createDataFrame([("a/b/x.ts", "a/c/y.ts"), ("a/x.ts", "a/y/index.ts"), ("a/b/x.ts", "a/b"), ("x", "y.tsx.ts"), ("a/index.ts", "a/index.ts")], "path string, to string")
    named = pairs.select(N.relative_module(F.col("path"), F.col("to")).alias("specifier"))
    assert [r.specifier for r in named.collect()] == ["../c/y", "./y", "./", "./y", "./"]
    # a value that many others need is no copy of its expression for each of them
    assert named._jdf.queryExecution().optimizedPlan().toString().count("zip_with") == 1
    imports = spark.createDataFrame([("a/x.ts", 1, "./y"), ("a/z.ts", 2, "./y"), ("b/x.ts", 3, "../a/y"), ("b/x.ts", 4, "./gone"), ("b/x.ts", 5, "./none"), ("b/x.ts", 5, "./none"), ("b/x.ts", 6, "out"), (None, 7, "./y")], "path string, line int, specifier string")
    files = spark.createDataFrame([("a/y.ts", 0), ("a/none.tsx", 1)], "path string, ord int")
    status = spark.createDataFrame([("D", "b/gone.ts")], "status string, path string")
    got = sorted((r.line, r.finding, r.target, r.candidate) for r in I.check_imports(imports, files, status).collect())
    assert got == [(1, "found", "a/y.ts", None), (2, "found", "a/y.ts", None), (3, "found", "a/y.ts", None), (4, "stale", "b/gone.ts", None)] + 2 * [(5, "broken", None, "a/none.tsx")] + [(7, "broken", None, "a/y.ts")]


def test_what_passes_in_vain_does_not_grow_with_the_needles(spark):
    rng = random.Random(8)
    texts = spark.createDataFrame([(i, "".join(rng.choice("0123456789") for _ in range(2000))) for i in range(40)], "file_id bigint, text string").repartition(4)
    for n in (20_000, 200_000):
        needles = spark.range(n).select(F.format_string("%012d", F.col("id") * 4_999_999).alias("needle"))
        assert S._passed(texts, needles, S.slots_for(n), "file_id", "text", S.PIECE).count() < 40
    some = spark.createDataFrame([(t.text[k : k + 9],) for k, t in enumerate(texts.collect())], "needle string").unionByName(spark.range(3000).select(F.format_string("x%04d", "id").alias("needle")))
    found = lambda **by: sorted(map(tuple, S.holders(texts, some, **by).collect()))
    assert found(most=1 << 15) == found() and len(found()) == 40  # in two passes
