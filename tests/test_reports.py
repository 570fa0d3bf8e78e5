"""Every report against its SQL in DuckDB, and laws that SQL does not state."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import catalog
from textloom.operators.graph import longest_prefix, nearest_preceding
from textloom.operators.quality import log_errors
from textloom.operators.ranking import ranked
from textloom.plans.edits import fnv1a, splice
from textloom.plans.patches import with_hunks
from textloom.sources.relations import Relations
from textloom.streaming.upkeep import delta, snapshots, upkeep_stream

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
catalog.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents labels events pages part lineitem conversations".split():
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: "null" if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_report_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_longest_prefix_ends_at_a_folder(spark):
    paths = spark.createDataFrame([("a/src1/x",), ("a/src10/x",), ("b/y",)], "path string")
    prefixes = spark.createDataFrame([("a", "root"), ("a/src1", "one")], "prefix string, name string")
    got = {r.path: r.name for r in longest_prefix(paths, prefixes).collect()}
    assert got == {"a/src1/x": "one", "a/src10/x": "root", "b/y": None}


def test_nearest_preceding_falls_back_to_the_first(spark):
    lines = spark.createDataFrame([("f", 1), ("f", 5), ("f", 9), ("g", 1)], "file_id string, line_no bigint")
    marks = spark.createDataFrame([("f", 3, "a", 1), ("f", 5, "b", 2), ("f", 5, "c", 3)], "file_id string, line bigint, name string, ord bigint")
    got = {(r.file_id, r.line_no): r.name for r in nearest_preceding(lines, marks).collect()}
    assert got == {("f", 1): "a", ("f", 5): "c", ("f", 9): "c"}


def test_top_k_is_a_prefix_of_the_full_order(spark):
    data = [(f"p{i % 7}", i % 3, i * 10 % 40, f"r{i % 2}") for i in range(30)]
    evidence = spark.createDataFrame(data, "path string, ord int, points bigint, reason string")
    everything = ranked(evidence, 100).collect()
    assert ranked(evidence, 3).collect() == everything[:3] and len(everything) == 7


def test_splice():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    a = spark.createDataFrame([(list("abcdef"),)], "a array<string>")
    run = lambda i, j, new: a.select(splice(F.col("a"), F.lit(i), F.lit(j), F.array(*map(F.lit, new))).alias("x")).first().x
    assert run(3, 4, ["X"]) == list("abXef") and run(1, 0, ["X"]) == list("Xabcdef") and run(7, 6, ["X"]) == list("abcdefX")


def test_hunks(spark):
    row = [("a\nb\nc\na\nb\nd\n",)]
    hunk = "struct<hunk:bigint,old_start:bigint,old:array<string>,new:array<string>>"

    def run(*hunks):
        df = spark.createDataFrame([(*row[0], [(k, *h) for k, h in enumerate(hunks)])], f"text string, hunks array<{hunk}>")
        end = df.select(with_hunks(F.col("text"), F.col("hunks")).alias("e")).first().e
        return end.error or "".join(end.lines)

    assert run((4, ["a", "b"], ["a", "x"])) == "abcaxd"
    assert run((3, ["a", "b"], ["a", "x"])) == "axcabd"
    assert run((1, ["z"], [])) == "hunk 1 context mismatch near line 1"
    # the second hunk is hinted two lines further down, by what the first one added
    assert run((1, ["a"], ["a", "x", "y"]), (4, ["a", "b"], ["a", "z"])) == "axybcazd"
    assert run((1, [], ["n"])) == "nabcabd" and run((99, [], ["n"])) == "abcabdn"


def test_fnv():
    assert fnv1a([b"", b"a"]) == ["cbf29ce4", "af63dc4c"] and fnv1a([]) == []


def test_build_log_places_follow_their_error(spark):
    text = [
        "a.tsx(1,2): error TS2305: no export", "error[E0603]: private", "  note", "  --> src/one.rs:1:2", "b\\c.ts(3,4): error TS2339: no property", "  --> src\\two.rs:3:4",
        "error[E0432]: unresolved", "error[E1234]: odd", "error TS2304: nothing",
    ]
    log = spark.createDataFrame([("l", k, x) for k, x in enumerate(text)], "log_id string, n bigint, line string")
    got = sorted(((r.n, r.file, r.kind, r.message) for r in log_errors(log).collect()), key=lambda r: r[0])
    assert got == [
        (0, "a.tsx", "missing export/import", "no export"), (1, "src/two.rs", "visibility", "private"), (4, "b/c.ts", "missing property", "no property"),
        (6, None, "unresolved import", "unresolved"), (7, None, "other", "odd"), (8, None, "missing name/import", "nothing"),
    ]


def test_delta_replays_to_the_new_snapshot(spark):
    before, after = snapshots(Relations(spark, SF))
    old, new = ({r.path: r.hash for r in df.collect()} for df in (before, after))
    for r in delta(before, after).collect():
        if r.op == "del":
            old.pop(r.path)
        else:
            old[r.path] = new[r.path]
    assert old == new


def test_stream_of_changes_equals_a_rebuild(spark, tmp_path):
    before, after = snapshots(Relations(spark, SF))
    before.write.parquet(str(tmp_path / "known/0"))
    delta(before, after).select("path").write.parquet(str(tmp_path / "changes"))
    stream = spark.readStream.schema("path string").parquet(str(tmp_path / "changes"))
    upkeep_stream(spark, stream, str(tmp_path / "known"), lambda touched: after.join(touched, "path", "left_semi"))
    got = {r.path: r.hash for r in spark.read.parquet(str(tmp_path / "known/1")).collect()}
    assert got == {r.path: r.hash for r in after.collect()}


def test_stream_counts_are_finished_hours(spark):
    got = {(r.started, r.event_type): r.n for r in catalog.QUERIES["events_stream"](spark, SF).collect()}
    want = {(r.started, r.event_type): r.n for r in catalog.QUERIES["events_tumbling"](spark, SF).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 10


def test_patches_change_what_they_name(spark):
    """A hunk takes one line out and puts two in; a second one replaces a line."""
    rel = Relations(spark, SF)
    files = {r.path: (r.ord, r.text) for r in rel.files.select("path", "ord", "text").collect()}
    done = catalog.QUERIES["patch_apply"](spark, SF).collect()
    assert done
    for r in done:
        ord_, text = files[r.path]
        before, after = text.rstrip("\n").split("\n"), r.patched.rstrip("\n").split("\n")
        assert len(after) == len(before) + 1 and f"new {ord_}" in after and (ord_ % 4 != 0 or "end" in after)


def test_paths_hash(spark):
    rows = catalog.QUERIES["fnv_hash"](spark, SF).collect()
    assert [r.hash for r in rows] == fnv1a([r.path.encode() for r in rows])


def test_dependencies_have_a_task_for_so_many_rows(spark, monkeypatch):
    from textloom.sources import relations

    whole = Relations(spark, SF).dependencies.collect()
    monkeypatch.setattr(relations, "EDGES_OF_A_TASK", 500)
    d = Relations(spark, SF).dependencies
    assert d.rdd.getNumPartitions() == spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500
    assert sorted(d.collect()) == sorted(whole)


def test_fields_of_types_of_documents_of_any_number(spark, tmp_path):
    from textloom.operators.sources import type_fields

    spark.createDataFrame([(i,) for i in (39_999, 40_000, 300_001, 3_000_001)], "doc_id bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.ord: r.fields for r in type_fields(Relations(spark, str(tmp_path))).collect()}
    assert got == {39_999: "first,nested,last39999", 40_000: "", 300_001: "first,nested,last300001", 3_000_001: "first,nested,last3000001"}
