"""Logs: files, folders of parts, and both; numbers of lines; fields of any type; what one command writes and another reads."""

import json

import pytest
from pyspark.sql import functions as F

from tremolo import cli, schemas
from tremolo.sources import judges, logs, readers, sinks

LINE = {"pair_id": "p", "task_type": "factuality", "model": "m", "run": 1, "normalized_a": "YES", "normalized_b": "NO", "error": None}


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    texts = [("" if k % 7 == 0 else "{bad" if k % 10 == 1 else json.dumps({"pair_id": f"p{k}"})) for k in range(1, 1001)]
    write(tmp_path / "a.jsonl", *texts)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "800")
    try:
        assert logs.lines(spark, str(tmp_path)).select("block").distinct().count() > 10
        log = logs.read(spark, str(tmp_path), schemas.JUDGMENT)
        got = {r.line: r.pair_id for r in log.rows.collect()}
        bad = {r.line for r in log.malformed.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {k: f"p{k}" for k in range(1, 1001) if texts[k - 1].startswith('{"')}
    assert bad == {k for k in range(1, 1001) if texts[k - 1] == "{bad"}
    log.close()


def test_splits_beyond_the_bound_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "FEW_SPLITS", 0)
    write(tmp_path / "a.jsonl", LINE, "", "{bad", LINE)
    log = logs.read(spark, str(tmp_path), schemas.JUDGMENT)
    assert sorted(r.line for r in log.rows.collect()) == [1, 4]
    assert [r.line for r in log.malformed.collect()] == [3]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_endings_of_lines(spark, tmp_path, ending):
    (tmp_path / "x y+%.jsonl").write_bytes(ending.join(['{"pair_id": "p"}', "  ", '\t{"pair_id": "q"} ']).encode())
    rows, bad = readers.jsonl_in_order(spark, str(tmp_path), schemas.JUDGMENT)
    assert sorted((r.pair_id, r.file, r.line) for r in rows.collect()) == [("p", "x y+%.jsonl", 1), ("q", "x y+%.jsonl", 3)]
    assert bad.count() == 0


def test_a_field_of_another_type_is_null_and_the_record_stays(spark, tmp_path):
    lines = [
        LINE | {"run": "x"}, LINE | {"run": "3"}, LINE | {"flipped": "maybe"}, LINE | {"normalized_a": 5, "error": {"code": [1]}}, LINE | {"run": 1.5}, LINE | {"pair_id": None}, "[]", "5", "null", '"text"',
        json.dumps(LINE) + " more", json.dumps(LINE) + json.dumps(LINE), "{'pair_id': 'p'}", "[" + json.dumps(LINE) + "]", '{"pair_id": "p", "pair_id": "last"}', "{}", '{"pair_id": "p",}',
    ]
    write(tmp_path / "a.jsonl", *lines)
    log = logs.read(spark, str(tmp_path), schemas.JUDGMENT)
    rows = {r.line: r for r in log.rows.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 15, 16]
    assert [rows[k].run for k in (1, 2, 5)] == [None, 3, None]
    assert (rows[1].pair_id, rows[1].normalized_b) == ("p", "NO")
    assert (rows[3].flipped, rows[4].normalized_a, rows[4].error) == (None, "5", '{"code":[1]}')
    assert (rows[6].pair_id, rows[15].pair_id, rows[16].pair_id) == (None, "last", None)
    assert sorted(r.line for r in log.malformed.collect()) == [7, 8, 9, 10, 11, 12, 13, 14, 17]
    assert logs.records(spark, str(tmp_path), schemas.JUDGMENT).count() == 8


def test_a_mistyped_run_stays_in_the_metrics(spark, tmp_path):
    write(tmp_path / "raw" / "m.jsonl", *[LINE | {"pair_id": f"p{k}", "run": "x" if k < 3 else 1} for k in range(10)])
    assert cli.summarize(spark, str(tmp_path / "raw"), str(tmp_path / "s.json"))["m"]["factuality"]["n_pairs"] == 10


def test_parts_of_a_log_stand_in_order(spark, tmp_path):
    write(tmp_path / "a.jsonl", LINE | {"pair_id": "file"})
    write(tmp_path / "a.jsonl.parts" / "0002" / "part-0.json", LINE | {"pair_id": "third"}, "{bad")
    write(tmp_path / "a.jsonl.parts" / "0001" / "part-0.json", LINE | {"pair_id": "second"}, "")
    write(tmp_path / "b.jsonl" / "part-1.json", LINE | {"pair_id": "two"})
    write(tmp_path / "b.jsonl" / "part-0.json", LINE | {"pair_id": "one"})
    write(tmp_path / "b.jsonl" / "_temporary" / "part-0.json", LINE | {"pair_id": "unfinished"})
    write(tmp_path / "other.txt", LINE)
    log = logs.read(spark, str(tmp_path), schemas.JUDGMENT)
    assert [(r.file, r.line, r.pair_id) for r in log.rows.orderBy("file", "line").collect()] == [("a.jsonl", 1, "file"), ("a.jsonl", 2, "second"), ("a.jsonl", 4, "third"), ("b.jsonl", 1, "one"), ("b.jsonl", 2, "two")]
    assert [tuple(r) for r in log.malformed.collect()] == [("a.jsonl", 5, "{bad")]


def test_no_log_is_an_empty_table(spark, tmp_path):
    log = logs.read(spark, str(tmp_path), schemas.JUDGMENT)
    assert (log.rows.count(), log.malformed.count()) == (0, 0)
    assert logs.records(spark, str(tmp_path / "none.jsonl"), schemas.JUDGMENT).count() == 0


def test_appends_to_a_plain_file_stand_beside_it(spark, tmp_path):
    write(tmp_path / "a.jsonl", LINE | {"pair_id": "old"})
    before = (tmp_path / "a.jsonl").read_text()
    for k in range(3):
        sinks.append_jsonl(spark.createDataFrame([(f"new{k}",)], "pair_id string"), str(tmp_path / "a.jsonl"))
    assert (tmp_path / "a.jsonl").read_text() == before
    log = logs.read(spark, str(tmp_path), schemas.JUDGMENT)
    assert [(r.line, r.pair_id) for r in log.rows.orderBy("line").collect()] == [(1, "old"), (2, "new0"), (3, "new1"), (4, "new2")]


def test_a_batch_that_is_written_again_replaces_itself(spark, tmp_path):
    for name in ("x", "y"):
        sinks.append_jsonl(spark.createDataFrame([(name,)], "pair_id string"), str(tmp_path / "a.jsonl"), "0001")
    assert [r.pair_id for r in logs.records(spark, str(tmp_path / "a.jsonl"), schemas.JUDGMENT).collect()] == ["y"]


def judge():
    return lambda prompt: "yes" if sum(prompt.encode()) % 3 else "no"


@pytest.mark.parametrize("published", [False, True])
def test_summarize_reads_what_evaluate_writes(spark, tmp_path, published):
    pairs = [{"pair_id": f"p{k}", "task_type": "factuality", "prompt_a": f"a{k}", "prompt_b": f"b{k}"} for k in range(30)]
    write(tmp_path / "factuality.jsonl", *pairs)
    out = tmp_path / "out"
    if published:  # a plain-file log, as all published ones are, with half of the work
        write(out / "gpt-4o_factuality.jsonl", *[LINE | {"pair_id": f"p{k}", "model": "gpt-4o", "run": 1, "normalized_b": "YES"} for k in range(15)])
    cli.evaluate(spark, ["gpt-4o"], ["factuality"], 2, str(tmp_path), str(out), make=lambda name: judge, wait=0, paced=False, batch_rows=20)
    rows = [r.asDict() for r in logs.read(spark, str(out), schemas.JUDGMENT).rows.orderBy("line").collect()]
    assert len({(r["pair_id"], r["run"]) for r in rows}) == len(rows) == 60
    assert sum(r["timestamp"] is None for r in rows) == (15 if published else 0)
    for exact in (True, False):
        got = cli.summarize(spark, str(out), str(tmp_path / "s.json"), exact)
        write(tmp_path / f"plain{exact}" / "gpt-4o_factuality.jsonl", *[{k: v for k, v in r.items() if k not in ("file", "line")} for r in rows])
        assert got == cli.summarize(spark, str(tmp_path / f"plain{exact}"), str(tmp_path / "t.json"), exact)
        assert got["gpt-4o"]["factuality"]["n_pairs"] == 60
    assert cli.evaluate(spark, ["gpt-4o"], ["factuality"], 2, str(tmp_path), str(out), make=lambda name: dead, wait=0, paced=False) == 0


def dead():
    raise AssertionError("nothing is left to ask")


def test_a_log_named_by_judge_and_task_may_be_a_folder(spark, tmp_path):
    sinks.append_jsonl(spark.createDataFrame([("p", "m", "coherence")], "pair_id string, model string, task_type string"), str(tmp_path / "m_coherence.jsonl"))
    for read in (readers.judgments_by_file, readers.judgments):
        assert read(spark, str(tmp_path), schemas.JUDGMENT, "m", "coherence").count() == 1
        assert read(spark, str(tmp_path), schemas.JUDGMENT, "m", "relevance").count() == 0
    assert judges.spec("gpt-4o").pause == 0.5
    assert logs.lines(spark, str(tmp_path)).where(F.col("text") != "").count() == 1
