"""Sources, sinks and streams."""

import json
import tarfile

import pytest
from pyspark.sql import functions as F

from mnemo.operators import memory
from mnemo.plans import report
from mnemo.sources import files
from mnemo.streaming import memory_stream


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": "é"}\nbroken\n', encoding="utf-8")
    assert files.json_lines(spark, str(p), "id int, t string", drop_bad=True).count() == 2
    assert [(r.line, r.text) for r in files.bad_lines(spark, str(p)).collect()] == [(4, "broken")]
    with pytest.raises(Exception):
        files.json_lines(spark, str(p), "id int, t string").collect()


def test_scenario_documents(spark, tmp_path):
    from mnemo.operators.perimeter import flatten_sessions

    (tmp_path / "scenario_01.json").write_text(json.dumps({"scenario_id": "S", "sessions": [{"session_id": "S1", "order": 1, "messages": [{"message_id": "m1", "order": 1, "role": "user", "content": "hi"}, {"message_id": "m2", "order": 2, "role": "assistant", "content": "yo"}]}]}, indent=2))
    schema = "scenario_id string, sessions array<struct<session_id string, order int, messages array<struct<message_id string, order int, role string, content string>>>>"
    got = flatten_sessions(files.json_documents(spark, str(tmp_path / "scenario_*.json"), schema)).collect()
    assert [(r.message_id, r.session_order) for r in got] == [("m1", 1)]


def test_tar_round_trip(spark, tmp_path):
    p = str(tmp_path / "a.tar.gz")
    members = [("root/x/2.json", b'{"a": 2}'), ("root/x/1.json", b'{"a": 1}'), ("root/y/3.json", b"{}")]
    assert files.write_tar_gz(members, p) == files.write_tar_gz(members[::-1], p)
    with tarfile.open(p) as t:
        assert t.getnames() == sorted(n for n, _ in members)
    assert sorted((r.member, r.content) for r in files.tar_members(spark, p, "x/").collect()) == [("x/1.json", '{"a": 1}'), ("x/2.json", '{"a": 2}')]


def test_csv_dump_and_pins(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.csv_table(spark, str(tmp_path / "c"), "k int, v string").collect()))[0] == (1, "a,b")
    a = files.dump_json_lines([{"b": 1, "a": "é"}], str(tmp_path / "f.jsonl"))
    found = {r.path.split("/")[-1]: r.sha256 for r in files.fingerprints(spark, str(tmp_path / "f.jsonl")).collect()}
    assert found == {"f.jsonl": a} and (tmp_path / "f.jsonl").read_text() == '{"a": "é", "b": 1}\n'
    files.append(df, str(tmp_path / "log"))
    files.append(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_overlay(spark):
    base = spark.createDataFrame([("q1", "t1", None), ("q2", "t2", "k")], "q string, text string, kind string")
    got = {r.q: (r.text, r.kind, r.note) for r in files.overlay(base, spark.createDataFrame([("q1", "z", "n")], "q string, kind string, note string"), "q").collect()}
    assert got == {"q1": ("t1", "z", "n"), "q2": ("t2", "k", None)}
    with pytest.raises(Exception, match="unknown key"):
        files.overlay(base, spark.createDataFrame([("q9", "z")], "q string, kind string"), "q").collect()


def test_answers_and_replay(spark):
    req = spark.createDataFrame([("c1", "p1"), ("c2", "p2")], "cell_id string, prompt string")
    got = {r.cell_id: (r.status, r.content) for r in files.answers(req, files.replay({"p1": "yes"})).collect()}
    assert got == {"c1": ("ok", "yes"), "c2": ("error", None)}


def test_fold_stream_equals_batch(spark, tmp_path):
    schema = "scenario string, op_order long, op_id string, claim_key string, kind string, target string, value string"
    ops = [("s", 1, "o1", "k", "ADD", None, "a"), ("s", 2, "o2", "k", "UPDATE", "s-M001", "b"), ("s", 3, "o3", "k", "DELETE", "s-M001", None), ("s", 4, "o4", "k", "DELETE", "s-M002", None), ("s", 5, "o5", "j", "NOOP", None, None)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (ops[:2], ops[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = memory_stream.fold_stream(spark.readStream.schema(schema).parquet(src))
        memory_stream.write_log(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    want = memory.fold_operations(spark.createDataFrame(ops, schema))
    key = lambda df: sorted((r.op_id, r.applied, r.rejection, r.entry_id, r.supersedes) for r in df.collect())
    assert key(spark.read.parquet(out)) == sorted(key(want)) or sorted(map(str, key(spark.read.parquet(out)))) == sorted(map(str, key(want)))


def test_sessions_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT 1 AS user_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m) AS ts, 2L AS tokens FROM VALUES (0), (10), (100) t(m)").write.parquet(src)
    q = memory_stream.sessions(spark.readStream.schema("user_id int, ts timestamp, tokens long").parquet(src)).writeStream.format("memory").queryName("sess").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n_turns for r in spark.table("sess").collect()) == [1, 2]


def test_report(spark):
    text = report.markdown("Rates", spark.createDataFrame([("a", 0.5), ("b", None)], "m string, r double"), ["m"])
    assert "| a | 0.5 |" in text and "| b | n/d |" in text and report.rate_line(0, 0) == "n/d"


def test_event_stream_log(spark):
    from mnemo.functions.parse import event_stream

    log = '{"type":"system","model":"m1"}\nnoise\n{"type":"result","result":"42","is_error":false}\n'
    r = spark.createDataFrame([(log,), ("",)], "l string").select(event_stream(F.col("l")).alias("x")).collect()
    assert (r[0].x.answer, r[0].x.models, r[0].x.error) == ("42", "m1", None) and r[1].x.error == "no result"
