"""Guards that raise, places in orders, and operators that no query shows on their own."""

import hashlib
import json
import math
import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemo.functions import parse, text
from mnemo.operators import evaluate, graph, items, memory, naming, perimeter, positions, quality, resample, validate
from mnemo.plans import catalog
from mnemo.sources import files
from mnemo.streaming import memory_stream


def raises(df, what):
    with pytest.raises(Exception, match=what):
        df.collect()


def test_numbered_rows_and_order_statistics(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.choice([1.0, 2.5, None, rng.random() * 100])) for k in range(700)] + [(1000, "one", 5.0), (1001, "none", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.id: r.pos for r in positions.numbered(df, ["g", "id"]).collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert positions.numbered(df.limit(0), ["id"]).count() == 0
    places, median = positions.middle()
    x = positions.order_statistics(df, ["g"], "v", places | {"p95": F.floor(0.95 * (F.col("n") - 1))}).withColumn("median", median)
    want = {}
    for g in ("a", "b", "one"):
        v = sorted(r[2] for r in rows if r[1] == g and r[2] is not None)
        want[g] = (len(v), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, v[math.floor(0.95 * (len(v) - 1))])
    assert {r.g: (r.n, r["median"], r.p95) for r in x.collect()} == want


def test_twister_draws_are_those_of_one_stream(spark):
    c = spark.createDataFrame([(f"c{k}", k, 1.0, 2.0, 1.0, 3.0) for k in range(7)], "cluster string, slot long, num_a double, den_a double, num_b double, den_b double")
    rng = random.Random(20260922)
    want = sorted((r, rng.randrange(7)) for r in range(50) for _ in range(7))
    assert sorted(map(tuple, resample.twister_draws(c, 50, 20260922).collect())) == want


def test_exhausted_strata_blocks_and_hash_collisions_raise(spark):
    pool = spark.createDataFrame([("s", k, k % 3, f"{k:03d}") for k in range(7)], "stratum string, item long, unlike long, rank_key string")
    raises(resample.greedy_strata(pool, "stratum", "item", "unlike", 3, 3), "has no block")
    assert resample.greedy_strata(pool, "stratum", "item", "unlike", 3, 3, strict=False).count() == 6
    rows = spark.range(7)
    with pytest.raises(ValueError, match="left over"):
        resample.blocks_of(rows, ["id"])
    got = [tuple(r) for r in resample.blocks_of(rows.where("id < 6"), ["id"]).orderBy("id").collect()]
    assert got == [(k, k // 3 + 1, k % 3) for k in range(6)]
    cells = spark.createDataFrame([("h", 1, "x"), ("h", 2, "x"), ("g", 3, "y")], "sha string, cell long, text string")
    assert {r.cell: r.kind for r in resample.reuse_plan(cells, ["sha"], [], "cell", "text").collect()} == {1: "call", 2: "reuse", 3: "call"}
    with pytest.raises(Exception, match="two contents"):
        resample.reuse_plan(cells.union(spark.createDataFrame([("h", 4, "z")], cells.schema)), ["sha"], [], "cell", "text").collect()
    turns = spark.createDataFrame([("e", "a", 1), ("e", "b", 1)], "episode string, activity string, turn int")
    order = spark.createDataFrame([("b", 1, 1), ("a", 1, 2)], "activity string, turn int, position int")
    assert {r.activity: r.message_order for r in resample.interleave(turns, order, ["activity", "turn"]).collect()} == {"b": 1, "a": 2}


def test_guards(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    raises(validate.all_present(a, b, ["k"]), "no partner")
    assert validate.all_present(a.where("k = 1"), b, ["k"]).count() == 1
    q = spark.createDataFrame([("q1",), ("q9",)], "question string")
    raises(q.select(validate.group_of(F.col("question"), {"g": ("q1",)})), "no group")
    assert q.where("question = 'q1'").select(validate.group_of(F.col("question"), {"g": ("q1", "q2")}).alias("g")).first().g == "g"
    with pytest.raises(PermissionError, match="expected_answer"):
        validate.without_oracle(spark.createDataFrame([("x",)], "expected_answer string"))
    assert validate.without_oracle(q) is q
    raises(spark.range(1).select(items.budget_required(F.lit("GER"), F.lit(None))), "needs a budget")
    assert spark.range(1).select(items.budget_required(F.lit("T"), F.lit(None)).alias("b")).first().b is None
    rows = spark.createDataFrame([("s", f"q{k}", m) for k in range(3) for m in "TU"], "scenario string, question string, mode string")
    assert [tuple(r) for r in validate.chosen(rows, ["U"], ["q0", "q2"], 1).collect()] == [("s", "q0", "U")]


def test_perimeters_cells_and_graph_parts(spark):
    m = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 2)], "session string, activity string, k int")
    assert [r.k for r in perimeter.accessible(m, spark.createDataFrame([("s2",)], "session string"), ["session"]).collect()] == [2]
    asked = m.withColumn("asked", F.lit("a"))
    assert [r.k for r in perimeter.by_activity(asked, F.lit("separated"), F.col("activity"), F.col("asked")).collect()] == [1]
    assert perimeter.by_activity(asked, F.lit("shared"), F.col("activity"), F.col("asked")).count() == 2
    cells = evaluate.expected_cells(spark.createDataFrame([(1,), (2,)], "cell int"), spark.createDataFrame([(1, "ok")], "cell int, status string"), ["cell"])
    assert {r.cell: r.status for r in cells.collect()} == {1: "ok", 2: "missing"}
    ranked = spark.createDataFrame([(1, 1, "i1", "The Server fails", ["f1"]), (1, 2, "i2", "other", ["f2"])], "k int, rank int, item_id string, text string, source_fact_ids array<string>")
    nodes = spark.createDataFrame([(1, "N1", 1, ["server"], ["f9"]), (1, "N2", 2, ["zzz"], ["f2"]), (1, "N3", 3, ["nope"], ["f8"]), (1, "N4", 0, ["fails"], ["f7"])], "k int, node_id string, node_order int, aliases array<string>, source_fact_ids array<string>")
    assert [(r.node_id, r.pos) for r in naming.seed_nodes(ranked, nodes, ["k"], 2).orderBy("pos").collect()] == [("N4", 1), ("N1", 2)]
    n, e = graph.normalise(spark.createDataFrame([("A", ["f"]), ("B", [])], "node_id string, source_fact_ids array<string>"), spark.createDataFrame([(1, "A", "B", ["f"]), (2, "A", "C", ["f"]), (3, "A", "B", [])], "order int, subject string, object string, source_fact_ids array<string>"))
    assert {r.node_id: r.provenance_valid for r in n.collect()} == {"A": True, "B": False}
    assert {r.edge_id: r.provenance_valid for r in e.collect()} == {"E001": True, "E002": False, "E003": False}
    why = [spark.range(1).select(graph.unselected_reason(F.lit(a), F.lit(b), F.lit(c)).alias("w")).first().w for a, b, c in ((True, True, True), (False, True, False), (True, False, False), (True, True, False))]
    assert why == [None, "state not readable", "off topic", "outside the budget"]
    facts = spark.createDataFrame([("f1", "e", "alpha"), ("f2", "e", "beta"), ("f3", "e", "gamma")], "fact_id string, episode string, value string")
    said = spark.createDataFrame([("e", "alpha beta"), ("e", "beta")], "episode string, content string")
    assert {(r.key, r.detail) for r in quality.unique_value(said, facts).collect()} == {("f2", "2"), ("f3", "0")}


def test_foreign_targets_equal_a_fold_of_the_whole_log(spark, data):
    """Rejections of the fold by key, looked up, against one scenario after the other with all keys."""
    from mnemo.plans import memory_graph as plan

    got = {(r.scenario, r.op_order): (r.applied, r.rejection) for r in plan.memory_foreign_targets(spark, data).collect()}
    ops = sorted(plan._ops(spark, data).collect(), key=lambda r: (r.scenario, r.op_order))
    want, scenario = {}, None
    for r in ops:
        if r.scenario != scenario:
            scenario, entries, newest = r.scenario, {}, None
        op = r.asDict()
        if r.op_order % 7 == 0 and r.kind in ("UPDATE", "DELETE"):
            op["target"] = newest
        out = memory.apply(op, entries)
        want[r.scenario, r.op_order] = (out["applied"], out["rejection"])
        newest = f"{r.scenario}-M{r.op_order:03d}" if r.kind in ("ADD", "UPDATE") else newest
    assert got == want and {"target of another key", "target not active"} <= {v[1] for v in want.values()}


def test_fingerprints_are_digests_of_the_state(spark, data):
    from mnemo.plans import memory_graph as plan

    got = {(r.scenario, r.op_order): r for r in catalog.queries()["memory_fingerprints"](spark, data).collect()}
    digest = lambda e: hashlib.sha256(json.dumps(e, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    users = sorted({r[0] for r in got})[:12]
    for user in users:
        entries = {}
        for op in sorted((r.asDict() for r in plan._ops(spark, data).where(F.col("scenario") == user).collect()), key=lambda r: r["op_order"]):
            before = digest(list(entries.values()))
            memory.apply(op, entries)
            r = got[user, op["op_order"]]
            assert (r.before, r.after, r.active) == (before, digest(list(entries.values())), sum(e["status"] == "attivo" for e in entries.values()))


def test_values_by_their_definition(spark, data):
    """usable_values and value_normalisation of whole documents, recomputed."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    good = lambda v: v is not None and v != "" and v.strip() == v and unicodedata.normalize("NFC", v) == v and all(unicodedata.category(c) not in ("Cc", "Zl", "Zp") for c in v)
    usable = catalog.queries()["usable_values"](spark, data).collect()
    lines = {(i, k): v for i, t in docs.items() for k, v in enumerate(t.split("\n") if t is not None else [None])}
    assert {(r.doc_id, r.line): r.usable for r in usable} == {k: good(v) for k, v in lines.items()}
    plain = lambda v: hashlib.md5(unicodedata.normalize("NFC", f" {v}\t").strip().casefold().encode()).hexdigest()
    norm = catalog.queries()["value_normalisation"](spark, data).collect()
    assert {r.doc_id: r.md5 for r in norm} == {i: None if t is None else plain(t) for i, t in docs.items()}


def test_parsers_of_streams_and_graphs(spark):
    log = "\n".join(['{"type": "system", "model": "m1"}', "", '{"type": "result", "result": "done", "is_error": false, "model": "m2"}'])
    got = spark.createDataFrame([(log,), ('{"type": "system"}',), ('{"type": "result", "result": "bad", "is_error": true}',)], "t string").select(parse.event_stream(F.col("t")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("done", "m1,m2", None), (None, "", "no result"), (None, "", "bad")]
    assert parse.embedded_graph('text {"nodes": [], "edges": []} text') == {"nodes": [], "edges": []} and parse.embedded_graph('{"nodes": 1}') is None
    assert spark.range(1).select(text.normalised_value(F.lit(" E\u0301 ")).alias("v")).first().v == "\u00e9"


def test_sinks_logs_and_streams(spark, tmp_path):
    files.write_json_lines(spark.createDataFrame([(2, "b"), (1, "a")], "z int, a string"), str(tmp_path / "out"))
    assert sorted(spark.read.text(str(tmp_path / "out")).toPandas()["value"]) == ['{"a":"a","z":1}', '{"a":"b","z":2}']
    files.dump_json({"b": 1, "a": ["\u00e9"]}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text(encoding="utf-8") == '{\n  "a": [\n    "\u00e9"\n  ],\n  "b": 1\n}\n'
    log = files.DurableLog(str(tmp_path / "log.jsonl"))
    assert log.finished() == set()
    for row in ({"cell_id": "a", "status": "error"}, {"cell_id": "a", "status": "ok", "content": "x"}, {"cell_id": "b", "status": "ok", "content": "y"}, {"cell_id": "b", "status": "error"}):
        log.add(row)
    assert log.finished() == {"a"}
    model = files.replay_in_order(["one", "two"])
    assert [model("p"), model("p")] == ["one", "two"]
    with pytest.raises(IndexError):
        model("p")
    pd.DataFrame({"cell_id": ["a", "a", "b"], "status": ["ok", "ok", "error"], "ts": pd.to_datetime(["2024-01-01"] * 3)}).to_parquet(tmp_path / "in.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema("cell_id string, status string, ts timestamp").parquet(str(tmp_path / "in.parque*"))
    memory_stream.write_log(memory_stream.finished_cells(stream), str(tmp_path / "done"), str(tmp_path / "ck")).awaitTermination()
    assert [r.cell_id for r in spark.read.parquet(str(tmp_path / "done")).collect()] == ["a"]


def test_a_set_batch_size_is_kept(spark):
    from mnemo import session

    was = spark.conf.get(session.ARROW_ROWS)
    spark.conf.set(session.ARROW_ROWS, 10_000)
    session.ready(spark)
    assert spark.conf.get(session.ARROW_ROWS) == "10000"
    spark.conf.set(session.ARROW_ROWS, was)
