"""Donors of a small map, and names that should go."""

from textloom.operators.donors import donors, stale_names
from textloom.sources.scan import bound

MAP = [("src/startup/StartupDialog.tsx", 120), ("src/startup/ModsPanel.tsx", 80), ("src/startup/ModsPanel.css", 20), ("src/main-window/MainEditorWindow.tsx", 700), ("src/startup/ModsPanel.test.tsx", 9), ("docs/x.tsx", 5), ("Makefile", 3)]


def test_donors_of_a_panel(spark):
    files = spark.createDataFrame(MAP, "path string, lines bigint")
    packages = spark.createDataFrame([], "prefix string, name string")
    got = [tuple(r) for r in donors(files, packages, "src/startup/NewPanel.tsx", "panel", 4).collect()]
    assert got[0] == ("src/startup/ModsPanel.tsx", 120 + 80 + 60 + 40 + 40 + 10, ["same directory", "same package", "same feature group", "token overlap 2", "same suffix", "copyable size"])
    assert [(p, s) for p, s, _ in got[1:]] == [("src/startup/StartupDialog.tsx", 270), ("src/main-window/MainEditorWindow.tsx", 80)]
    with_tests = {r.path for r in donors(files, packages, "src/startup/NewPanel.tsx", "write a test").collect()}
    assert "src/startup/ModsPanel.test.tsx" in with_tests and "docs/x.tsx" not in with_tests
    some = spark.createDataFrame([("src/startup", "startup")], "prefix string, name string")
    assert {r.path.rsplit("/", 1)[1]: "same package" in r.reasons for r in donors(files, some, "src/startup/a.tsx").collect()} == {"StartupDialog.tsx": True, "ModsPanel.tsx": True, "MainEditorWindow.tsx": False}
    assert [r.path for r in donors(files, packages, "Other").collect()] == ["Makefile"]


def test_a_definition_is_no_reference_to_itself(spark, tmp_path):
    for name, text in {
        "a.rs": "pub fn old_name() {}\n// old_name again\n", "b.rs": "fn other() { OLD_NAME(); }\n", "c.rs": "fn lonely() {}\n", "d.rs": "calls gone_name\n",
    }.items():
        (tmp_path / name).write_text(text)
    status = spark.createDataFrame([("M", "d.rs")], "status string, path string")
    rel = bound(spark, str(tmp_path), status)
    got = {r.pattern: (r.defs, r.refs, r.in_changed, r.status) for r in stale_names(rel, ("old_name", "lonely", "gone_name", "never")).collect()}
    assert got == {"old_name": (1, 1, 0, "migration incomplete"), "lonely": (1, 0, 0, "safe-delete candidate"), "gone_name": (0, 1, 1, "cleanup in progress"), "never": (0, 0, 0, "clean")}
    assert {r.pattern: r.refs for r in stale_names(rel, ("old_name", "gone_name"), changed_only=True).collect()} == {"old_name": 0, "gone_name": 1}
