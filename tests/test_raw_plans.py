"""Plans written as blocks: their operations, and what makes them unusable."""

import duckdb

from textloom.operators import catalog
from textloom.plans import ops, raw
from textloom.sources.relations import Relations

PLANS = {
    1: "ACTION: REPLACE SYMBOL\nFILE: src/lib.rs\nSYMBOL: run\nCONTENT:\nfn run() {}\nEND\n",
    2: "ACTION: replace_text\nFILE: src/lib.rs\nWITHIN_SYMBOL: run\nEXPECTED_MATCHES: 1\nFIND:\nfont_size: 14.0,\nREPLACE:\nfont_size: theme.font.output_size,\nEND\n",
    3: "ACTION: CREATE FILE\nFILE: src/lib.rs\nCONTENT:\nmod api;\n",
    4: "# nothing but remarks\n\n",
    5: "FILE: first.rs\naction: delete range\nstart_line: 2\nEND_LINE: 4\nACTION: INSERT\nFILE: b.rs\nFIND: here\ncontent:\nlower: key is text here\n  # so is this\n\nEND\nEND\nACTION: ASSERT TEXT ABSENT\nFILE: c.rs\nFIND: x: y\nCHANGED_ONLY: true",
    6: "ACTION: REPLACE FIELD ACCESS\nFILE: a\nFIND: a.b\nCONTENT:\na.c\nEND\nACTION: modify enum\nFILE: e.rs\nFIND:\nA,\n  B,\n\nREPLACE:\nC,\nEND\n",
    7: "ACTION: DANCE\nFILE: a\nEND\nACTION: DELETE RANGE\nFILE: a\nSTART_LINE: two\nEND_LINE: 3\nEND\nno key here\nCOLOR: red\nACTION: REPLACE SYMBOL\nFILE: a\nCONTENT:\nx\nEND\nACTION: CREATE FILE\nCHANGED_ONLY: maybe",
    8: "",
}


def test_blocks_and_errors(spark):
    found, errors = raw.parsed(spark.createDataFrame(list(PLANS.items()), "plan_id bigint, text string").repartition(3))
    got = {(r.plan_id, r.block): r for r in found.collect()}
    assert sorted(got) == [(1, 1), (2, 1), (5, 1), (5, 2), (5, 3), (6, 1), (6, 2)]
    one, two = got[1, 1], got[2, 1]
    assert (one.kind, one.path, one.symbol, one.content) == ("replace_symbol", "src/lib.rs", "run", "fn run() {}\n")
    assert (two.kind, two.find, two.content, two.scope, two["count"]) == ("replace_text", "font_size: 14.0,", "font_size: theme.font.output_size,", "run", 1)
    assert (got[5, 1].kind, got[5, 1].path, got[5, 1].start, got[5, 1].stop) == ("delete_range", "first.rs", 2, 4)
    assert (got[5, 2].kind, got[5, 2].find, got[5, 2].content) == ("insert_before_text", "here", "lower: key is text here\n  # so is this\n\n")
    assert (got[5, 3].kind, got[5, 3].find, got[5, 3].scope) == ("assert_text_absent", "x: y", "changed")
    assert (got[6, 1].content, got[6, 2].kind, got[6, 2].find, got[6, 2].content) == ("a.c\n", "replace_text", "A,\n  B,", "C,")
    said = {(r.plan_id, r.line_no, r.error) for r in errors.collect()}
    assert said == {
        (3, 3, "CONTENT is missing END"), (4, 0, "no ACTION"), (8, 0, "no ACTION"), (7, 1, "unsupported action DANCE"), (7, 6, "no number"), (7, 9, "no KEY: value"),
        (7, 10, "unknown field COLOR"), (7, 11, "missing SYMBOL"), (7, 16, "missing FILE"), (7, 17, "no true or false"),
    }


def test_a_plan_is_applied(spark):
    text = "ACTION: CREATE FILE\nFILE: n.rs\nCONTENT:\nmod api;\nEND\nACTION: REPLACE RANGE\nFILE: n.rs\nSTART_LINE: 1\nEND_LINE: 1\nCONTENT:\nmod other;\nEND\nACTION: REPLACE TEXT\nFILE: n.rs\nFIND: gone\nREPLACE: x\n"
    found, _ = raw.parsed(spark.createDataFrame([(4, text)], "plan_id bigint, text string"))
    files = spark.createDataFrame([("f", "m.rs", "x\n")], "file_id string, path string, text string")
    symbols = spark.createDataFrame([], "name string, file_id string, line bigint, line_end bigint, body_open_line bigint, body_close_line bigint")
    changed = spark.createDataFrame([], "file_id string, status string")
    got = [tuple(r) for r in ops.apply_ops(raw.operations(found), files, symbols, changed, on_error="skip").collect()]
    assert got == [("n.rs", "mod other;\n", "4000003 replace_text text not found")]


def test_the_lines_of_plans_are_sorted_once(spark):
    plans = spark.createDataFrame([(1, "ACTION: create_file\nFILE: a\nCONTENT:\nx\nEND\n"), (2, "ACTION: create_file\nFILE: b\nodd\n")], "plan_id bigint, text string")
    ops, errors = raw.parsed(plans)
    for frame in (ops, errors):
        assert "Window" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert [r.path for r in ops.collect()] == ["a"] and [(r.plan_id, r.line_no, r.error) for r in errors.collect()] == [(2, 3, "no KEY: value")]


def test_blank_lines_and_tabs_are_values(spark):
    text = "ACTION: replace_text\nFILE:\ta\tb.rs \nFIND:\n\nREPLACE:\n  \nEND\nACTION: replace_text\nFILE: c.rs\nFIND: x\nREPLACE:\nEND\n"
    found, errors = raw.parsed(spark.createDataFrame([(1, text)], "plan_id bigint, text string"))
    assert sorted((r.block, r.path, r.find, r.content) for r in found.collect()) == [(1, "a\tb.rs", "", ""), (2, "c.rs", "x", None)] and errors.isEmpty()


def test_plans_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    texts = ["", "\nsecond\n", " \t\nb", "END\nb", " END\nb", "NOTE: a\nb", "  lead\nb", "trail \nb", "a\r\nb\r\nc", "a\r\r\nb\r\r\n", "\r\n\r\n", "---: a\nb", "FIND:\nREPLACE", "form\f\nb\f"]
    docs = spark.createDataFrame([(i, t, "en", "s\t1") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = raw.ops_raw_preview(Relations(spark, str(tmp_path))).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalog.SQL["ops_raw_preview"]).fetchall()
    assert len(got) == 3 * len(texts) and sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
