"""Snapshots by level: what is reused, what is written again, and what makes one stale."""

import os

import pytest

from textloom.operators.navigation import find
from textloom.sources import snapshots as S

FILES = {"src/a.rs": "pub fn start() {\n}\n", "src/b.ts": "import { x } from './c';\n// TODO later\n", "src/c.ts": "export const x = 1;\n"}


def write(root, files, at=None):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
        if at:
            os.utime(root / name, (at, at))


def test_levels_and_reuse(spark, tmp_path):
    root, path = tmp_path / "repo", str(tmp_path / "map")
    write(root, FILES, 1_700_000_000)
    load = lambda **how: S.load_or_scan(spark, str(root), path, **how)
    saved, source = load(level=0)
    assert source == "scan" and saved.files.count() == 3 and saved.envelope.level == 0
    with pytest.raises(AttributeError, match="symbols"):
        saved.symbols  # noqa: B018
    assert load(level=0)[1] == "snapshot"
    files_before = saved.envelope.versions["files"]
    saved, source = load(level=2)  # a higher level is worked out once; the files are not written again
    assert source == "scan" and saved.envelope.versions["files"] == files_before
    assert {r.name for r in saved.symbols.collect()} == {"start"} and saved.dependencies.count() == 1
    assert load(level=1)[1] == load(level=2)[1] == "snapshot" and load(level=2, no_cache=True)[1] == "scan"
    assert S.load_or_scan(spark, str(root) + "/", path)[1] == "snapshot"
    assert not S.usable(S.read_envelope(spark, path), str(tmp_path), 0)
    with pytest.raises(ValueError):
        S.write_snapshot(saved, path, str(root), 3)


def test_what_makes_a_snapshot_stale(spark, tmp_path):
    root, path = tmp_path / "target" / "repo", str(tmp_path / "map")
    write(root, FILES, 1_700_000_000)
    (root / "logo.png").write_bytes(b"\x89PNG\xff\xfe")
    load = lambda: S.load_or_scan(spark, str(root), path)[1]
    assert [load(), load()] == ["scan", "snapshot"]
    S.mark_dirty(spark, path)
    assert S.is_dirty(spark, path) and [load(), load()] == ["scan", "snapshot"]
    write(root, {"src/a.rs": "fn other() {}\n"})  # newer
    assert [load(), load()] == ["scan", "snapshot"]
    (root / "src/c.ts").unlink()
    assert [load(), load()] == ["scan", "snapshot"]
    write(root, {"src/new.ts": "let n;\n"}, 4_000_000_000)
    assert load() == "scan"
    write(root, {"node_modules/x.ts": "let x;\n"}, 4_000_000_000)
    assert load() == "snapshot"
    write(root, {".git/index": "x"}, 4_000_000_000)
    assert load() == "scan"


def test_reports_run_on_a_snapshot(spark, tmp_path):
    write(tmp_path / "repo", FILES)
    saved, _ = S.load_or_scan(spark, str(tmp_path / "repo"), str(tmp_path / "map"), level=2)
    assert find(saved, needle="later").count() >= 1
