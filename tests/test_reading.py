"""Reading lists: the facts of a small repository, tasks, words of a query and what is skipped."""

import pytest

from textloom.functions.names import APP, TOOL
from textloom.operators.reading import reading_list, tokens_of
from textloom.sources.scan import bound

FILES = {
    APP + "src/app/selectionTypes.ts": "export type EditorSelectionRef = string;\n",
    APP + "src/app/store/editorState.ts": "const value: EditorSelectionRef = 'x';\n",
    APP + "src/app/store/editorState.test.ts": "editorselectionref again\neditorselectionref\n",
    TOOL + "src/own.rs": "// EditorSelectionRef\n",
    "README.md": "EditorSelectionRef docs\n",
    "lib/tests/snapshots/x.ts": "EditorSelectionRef\n",
}


@pytest.fixture
def small(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    status = spark.createDataFrame([("M", APP + "src/app/store/editorState.ts")], "status string, path string")
    return bound(spark, str(tmp_path)), bound(spark, str(tmp_path), status)


def listed(rows):
    return [(r.path.removeprefix(APP + "src/app/"), r.score, r.reasons) for r in sorted(rows.filter("part <> 'skip'").collect(), key=lambda r: r["rank"])]


def test_a_definition_and_its_mention(small):
    rel, changed = small
    rows = reading_list(rel, "EditorSelectionRef", "migrate")
    assert listed(rows) == [
        ("selectionTypes.ts", 211, ["definition", "refs:1", "selection", "task:implement-definition"]),
        ("store/editorState.ts", 56, ["refs:1", "store boundary"]),
        ("store/editorState.test.ts", 42, ["refs:2", "store boundary", "test"]),
    ]
    assert [r.path for r in rows.filter("part = 'skip'").orderBy("path").collect()] == ["README.md", TOOL + "src/own.rs", "lib/tests/snapshots/x.ts"]
    assert listed(reading_list(changed, "EditorSelectionRef", "verify"))[0] == ("store/editorState.ts", 236, ["changed", "git:M", "refs:1", "store boundary", "task:verify-changed"])
    assert listed(reading_list(rel, "EditorSelectionRef", "test"))[1][1:] == (122, ["refs:2", "store boundary", "test", "task:test"])
    assert listed(reading_list(rel, "EditorSelectionRef", "trace"))[0][1] == 211 - 60 + 80 + 8
    assert len(listed(reading_list(rel, "EditorSelectionRef", limit=1))) == 1


def test_words_of_a_query(small):
    rel, _ = small
    assert tokens_of("The Editor-state of the tree") == ["the", "editor", "state", "tree"]
    rows = {p: (s, r) for p, s, r in listed(reading_list(rel, "value viewer"))}
    # the word counts as a mention and by itself; "viewer" says nothing about texts
    assert rows["store/editorState.ts"][0] == 6 + 50 + 12 and "text-token:value" in rows["store/editorState.ts"][1] and len(rows) == 1
    assert listed(reading_list(rel, "nothing like it")) == []
