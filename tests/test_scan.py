"""Scanning a small repository."""

from textloom.sources import scan as S

FILES = {
    "a/lib.rs": "use crate::store;\npub fn start() {\n}\nfn stop() {}\nstruct Inner;\n",
    "a/Cargo.toml": '[package]\nname = "a"\n\n[dependencies]\nserde = "1"\n',
    "b/app.tsx": "import { x } from './x';\nexport function App() {}\nclass View {}\n",
    "b/empty.md": "",
}


def write(root, files):
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_scan(spark, tmp_path):
    write(tmp_path, FILES)
    files = S.scan(spark, str(tmp_path))
    got = {r.path.split("/", 1)[1][-8:]: r for r in files.collect()}
    assert {r.language: r.lines for r in got.values()} == {"rust": 5, "toml": 5, "tsx": 3}
    symbols = {(r.name, r.kind, r.visibility, r.line) for r in S.symbols(files).collect()}
    assert symbols == {("start", "fn", "pub", 2), ("stop", "fn", "private", 4), ("Inner", "type", "private", 5), ("App", "fn", "pub", 2), ("View", "type", "private", 3)}
    assert {r.specifier for r in S.imports(files).collect()} == {"crate::store", "./x"}
    assert {(r.section, r.key, r.value) for r in S.manifest_entries(files).collect()} == {("package", "name", "a"), ("dependencies", "serde", "1")}
    assert S.scan(spark, str(tmp_path), max_file_size=60).count() == 1


def test_scan_passes_over_what_is_no_text(spark, tmp_path):
    write(tmp_path, FILES | {"node_modules/x/a.ts": "export const X = 1;\n", "a/ünïcode.md": "straße\n"})
    (tmp_path / "a/logo.png").write_bytes(b"\x89PNG\r\n\x1a\n\xff\xfe\x00")
    got = {r.path.rsplit("/", 1)[-1] for r in S.scan(spark, str(tmp_path)).collect()}
    assert len(got) == 4 and not {"logo.png", "a.ts"} & got


def test_save_only_what_changed(spark, tmp_path):
    write(tmp_path / "src", FILES)
    files = S.scan(spark, str(tmp_path / "src")).drop("modified")
    out = str(tmp_path / "out")
    assert S.save(files, out) and not S.save(files, out)
    snapshot = S.latest(spark, out)
    assert not S.stale(files, snapshot)
    write(tmp_path / "src", {"a/lib.rs": "fn other() {}\n"})
    again = S.scan(spark, str(tmp_path / "src")).drop("modified")
    assert S.stale(again, snapshot) and S.save(again, out) and not S.stale(again, S.latest(spark, out))


def test_load_or_scan(spark, tmp_path):
    write(tmp_path / "src", FILES)
    out = str(tmp_path / "out")
    first = S.load_or_scan(spark, str(tmp_path / "src"), out)
    assert first.count() == 3 and S.newest(spark, out).version == 0
    assert S.load_or_scan(spark, str(tmp_path / "src"), out).count() == 3 and S.newest(spark, out).version == 0
    write(tmp_path / "src", {"c/new.rs": "fn new() {}\n"})
    assert S.load_or_scan(spark, str(tmp_path / "src"), out).count() == 4 and S.newest(spark, out).version == 1


def test_porcelain(spark):
    text = ' M src/a.rs\n?? new.ts\nR  old.ts -> "b dir/new.ts"\n\nD  gone.rs'
    got = {(r.status, r.path, r.original) for r in S.porcelain(spark.createDataFrame([(x,) for x in text.split("\n")], "line string")).collect()}
    assert got == {("M", "src/a.rs", None), ("??", "new.ts", None), ("R", "b dir/new.ts", "old.ts"), ("D", "gone.rs", None)}


REPO = {
    "crates/apps/web/src/app/store/main.ts": "import { x } from '../near';\nimport './side';\nexport function startThe(x) {\n  if (x) {\n    the();\n  }\n}\nexport interface Open { a: string }\n",
    "crates/apps/web/src/app/near.ts": "export const near = 1; // the near one\n",
    "crates/apps/web/src/app/store/side/index.ts": "// TODO the side\n",
    "crates/engine/core/lib.rs": "pub struct Unit;\npub fn run()\n{\n    nested { }\n}\n",
}


def test_reports_run_on_a_scan(spark, tmp_path):
    """The same reports as on the driver's tables."""
    from textloom.operators import graph, navigation, quality, ranking

    write(tmp_path, REPO)
    status = spark.createDataFrame([("M", "crates/apps/web/src/app/near.ts")], "status string, path string")
    rel = S.bound(spark, str(tmp_path), status)
    assert {r.path for r in rel.files.collect()} == set(REPO)
    found = {r.path.rsplit("/", 1)[-1]: (r.matches, r.first_lines) for r in navigation.find(rel, "the").collect()}
    assert found == {"main.ts": (2, "3,5"), "near.ts": (1, "1"), "index.ts": (1, "1")}
    symbols = {(r.name, r.line, r.line_end, r.body_open_line, r.body_close_line) for r in rel.symbols.collect()}
    assert symbols == {("startThe", 3, 7, 3, 7), ("Open", 8, 8, 8, 8), ("Unit", 1, 1, None, None), ("run", 2, 5, 3, 5)}
    ids = {r.path.rsplit("/", 1)[-1]: r.file_id for r in rel.files.collect()}
    edges = {(r.source, r.target) for r in rel.dependencies.collect()}
    assert edges == {(ids["main.ts"], ids["near.ts"]), (ids["main.ts"], ids["index.ts"])}
    assert {(r.way, r.file_id) for r in graph.neighbors_edges(rel, ids["near.ts"]).collect()} == {("in", ids["main.ts"])}
    assert {r.path.rsplit("/", 1)[-1] for r in graph.orphan_degree(rel, "crates/").collect()} == {"main.ts", "lib.rs"}
    ranked = ranking.open_set(rel, "the", "startThe", "nothing", "/store/", "/app/").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.score) for r in ranked] == [("main.ts", 100 + 6 + 50), ("near.ts", 80 + 6), ("index.ts", 6 + 50)]
    assert {r.package: r.exact for r in quality.rename_counts(rel, "the").collect()} == {"crates/apps/web": 3}
