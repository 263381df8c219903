"""Operators against small loops that state their meaning."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemo.functions import parse
from mnemo.functions.text import count_tokens, normalised_value, plain_spaces, ratio
from mnemo.operators import budget, evaluate, graph, intake, memory, metrics, perimeter, quality, ranking, resample


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def test_budget_tokens(spark):
    texts = ["SC02-S1-U1", "Perché no? 3,5 è", "", None, "a\tb  c_d"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", count_tokens(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]", t or "")) for t in texts] and got[0] == 5


def test_ratio_without_denominator_is_null(spark):
    r = spark.range(1).select(ratio(F.lit(0), F.lit(0)).alias("a"), ratio(F.lit(1), F.lit(3)).alias("b")).first()
    assert r.a is None and r.b == 0.333333


def loop_scores(query, docs):
    tok = lambda t: re.findall("[a-z0-9_-]+", t.lower())
    n, df = len(docs), {}
    for t in docs.values():
        for w in set(tok(t)):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}

    def vec(t):
        v = {}
        for w in tok(t):
            if w in idf:
                v[w] = v.get(w, 0) + idf[w]
        m = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / m for w, x in v.items()} if m else {}

    q = vec(query)
    return {k: sum(x * vec(t).get(w, 0) for w, x in q.items()) for k, t in docs.items()}


def test_cosine_scores(spark):
    docs = {1: "the cat sat", 2: "a dog", 3: "", 4: "Cat and DOG and cat", 5: "perché"}
    q = spark.createDataFrame([("q", "the cat perché")], "c string, text string")
    d = spark.createDataFrame([("q", k, t) for k, t in docs.items()], "c string, k int, text string")
    got = {r["k"]: r["score"] for r in rows(ranking.cosine_scores(q, d, ["c"], ["k"]))}
    want = loop_scores("the cat perché", docs)
    assert set(got) == set(docs) and all(abs(got[k] - want[k]) < 1e-12 for k in docs)
    top = rows(ranking.top_k(ranking.rank_exact(ranking.cosine_scores(q, d, ["c"], ["k"]), ["c"], [F.col("k")]), 4), "rank")
    assert len(top) == 4 and [r["k"] for r in top][-1] in (2, 3)  # rows without shared terms stay in


def loop_prefix(items, limit):
    out, total = [], 0
    for rank, score, tokens in items:
        if score <= 0:
            break
        if limit is None or total + tokens <= limit:
            out.append(rank)
            total += tokens
            continue
        if not out:
            out.append(rank)
        break
    return out


def loop_tiers(items, limit):
    quota = {"recent": limit // 2, "archive": limit - limit // 2}
    ok = [i for i in items if i[1] > 0]
    chosen, used = {}, 0
    for level in ("recent", "archive"):
        spent = 0
        for rank, _, tokens, lv in ok:
            if lv != level:
                continue
            if spent + tokens > quota[level]:
                break
            chosen[rank] = 1
            spent += tokens
        used += spent
    for rank, _, tokens, _ in ok:
        if rank in chosen:
            continue
        if used + tokens > limit:
            break
        chosen[rank] = 2
        used += tokens
    return chosen


def test_budget_rules(spark):
    rng = random.Random(5)
    data = []
    for k in range(150):
        n = rng.randint(1, 9)
        scores = sorted((rng.choice([0.0, 0.1, 0.5, 0.9]) for _ in range(n)), reverse=True)
        data += [(k, r + 1, s, rng.randint(1, 60), rng.choice(["recent", "archive"])) for r, s in enumerate(scores)]
    df = spark.createDataFrame(data, "k int, rank int, score double, tokens int, level string").cache()
    for limit in (50, None):
        got = rows(budget.prefix_within_budget(df, ["k"], F.lit(limit).cast("int")).where("selected"), "k", "rank")
        want = [(k, r) for k in range(150) for r in loop_prefix([x[1:4] for x in data if x[0] == k], limit)]
        assert [(g["k"], g["rank"]) for g in got] == want
    got = rows(budget.two_phase(df, ["k"], F.lit(50)).where("selected"), "k", "rank")
    want = sorted((k, r, p) for k in range(150) for r, p in loop_tiers([x[1:5] for x in data if x[0] == k], 50).items())
    assert [(g["k"], g["rank"], g["phase"]) for g in got] == want
    checked = budget.two_phase(df, ["k"], F.lit(50)).withColumn("item_id", F.col("rank"))
    assert quality.tier_properties(checked, ["k"], 50).count() == 0


def test_scope_and_phase(spark):
    df = spark.createDataFrame([("Che cosa è cambiato?", 1), ("NON È PIÙ così", 2), ("Dove siamo", 3)], "t string, s int")
    assert [r.x for r in df.orderBy("s").select(perimeter.scope(F.col("t")).alias("x")).collect()] == ["history", "history", "current"]
    with pytest.raises(Exception, match="no phase"):
        df.select(perimeter.phase(F.col("s"), {"a": (1, 2)})).collect()
    with pytest.raises(Exception, match="before an entry"):
        df.select(perimeter.session_reached(F.lit(1), F.col("s"), ["t"])[0]).collect()


def test_fold_by_key_equals_fold_by_scenario(spark):
    rng = random.Random(3)
    ops, ids = [], {}
    for s in ("A", "B"):
        for k in range(1, 121):
            kind = rng.choice(["ADD", "UPDATE", "DELETE", "NOOP", "MOVE"])
            key = rng.choice("xyz")
            target = rng.choice([None, *ids.get((s, key), []), *ids.get((s, "x"), [])]) if rng.random() < 0.9 else "nowhere"
            ops.append((s, k, f"{s}-OP{k:03d}", key, kind, target, f"v{k}"))
            ids.setdefault((s, key), []).append(f"{s}-M{k:03d}")
    df = spark.createDataFrame(ops, "scenario string, op_order long, op_id string, claim_key string, kind string, target string, value string")
    by_key = {r["op_id"]: r for r in rows(memory.fold_operations(df))}
    whole = {r["op_id"]: r for r in rows(memory.fold_with_fingerprints(df))}
    assert len(by_key) == 240 and any(not r["applied"] for r in by_key.values())
    for k, r in by_key.items():
        assert (r["applied"], r["entry_id"], r["supersedes"]) == (whole[k]["applied"], whole[k]["entry_id"], whole[k]["supersedes"])
        assert (whole[k]["before"] == whole[k]["after"]) == (not r["applied"] or r["kind"] == "NOOP")


def test_shortest_paths(spark):
    rng = random.Random(11)
    edges = [(f"E{k:02d}", f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}") for k in range(14)]
    anchors = [f"n{k}" for k in range(0, 10, 2)]
    adj = {}
    for e, a, b in edges:
        adj.setdefault(a, []).append((e, b))
        adj.setdefault(b, []).append((e, a))
    want = {}
    for i, a in enumerate(anchors):
        level = {a: []}
        seen = {a}
        for _ in range(3):
            nxt = {}
            for node, path in sorted(level.items(), key=lambda x: x[1]):
                for e, b in sorted(adj.get(node, [])):
                    if b not in seen and (b not in nxt or path + [e] < nxt[b]):
                        nxt[b] = path + [e]
            seen |= set(nxt)
            level = nxt
            for b, p in nxt.items():
                if b in anchors and a < b:
                    want[a, b] = ",".join(p)
    df = graph.shortest_paths(spark.createDataFrame(edges, "edge_id string, subject string, object string"), spark.createDataFrame([(a,) for a in anchors], "node string"))
    assert {(r["source"], r["target"]): r["edge_ids"] for r in rows(df)} == want


def test_mentions_are_token_runs(spark):
    df = spark.createDataFrame([("the North-Sea port is open", "north-sea port"), ("northern seaport", "north"), ("a", "")], "t string, n string")
    assert [r.x for r in df.select(graph.mentioned(F.col("t"), F.col("n")).alias("x")).collect()] == [True, False, False]


@pytest.mark.parametrize("text, error", [(None, "no_text"), (" ", "empty_text"), ('{"value":1} x', "not_json"), ("[]", "not_json_object"), ("{}", "missing_value_key"), ('{"value":"a","b":1}', "extra_keys:b"), ('{"value":3}', "value_type:int"), ('{"value":null}', None), (' {"value":"x"}\n', None)])
def test_one_value(spark, text, error):
    assert parse.one_value(text)["error"] == error
    r = spark.createDataFrame([(text,)], "t string").select(parse.parse_one_value("t").alias("p")).first().p
    assert r.error == error and r.ok == (error is None)


def test_other_parsers():
    assert parse.many_values('{"values":["a",1]}')["error"] == "values_not_list_of_strings"
    assert parse.many_values('{"values":["a"]}')["values"] == ["a"]
    assert parse.status_answer('{"status":"maybe","answer":""}', ("yes",))["error"] == "status_not_allowed:'maybe'"
    assert parse.status_answer('{"status":"yes"}', ("yes",))["error"] == "missing_keys:answer"
    assert parse.embedded_array("```json\n[1, 2]\n```") == [1, 2] and parse.embedded_array("none") is None
    assert parse.embedded_graph('x {"nodes": [], "edges": []} y') and parse.embedded_graph('{"nodes": []}') is None


def test_value_cells(spark):
    c = spark.createDataFrame(
        [("1", "e", "a", "ok", '{"value":" Réd "}', "réd", "is réd", True, True), ("2", "e", "a", "ok", '{"value":"blue"}', "red", "x", True, True), ("3", "e", "a", "missing", None, "red", "x", True, True), ("4", "e", "a", "ok", '{"value":null}', "red", "x", True, True), ("5", "e", "a", "ok", "?", "red", "x", True, True), ("6", "e", "a", "ok", '{"value":"q"}', "red", "x", False, None)],
        "cell_id string, episode string, activity string, status string, content string, expected string, context string, reachable boolean, success boolean",
    )
    f = spark.createDataFrame([("e", "b", "colour", "BLUE"), ("e", "a", "colour", "red")], "episode string, activity string, field string, value string")
    got = rows(evaluate.value_cells(c, f), "cell_id")
    assert [r["cause"] for r in got] == [None, "generation", "missing_response", "generation", "format", "evidence_unreachable"]
    assert got[0]["exact_match"] and got[0]["supported"] and got[1]["confused_with"] == ["b.colour"] and got[3]["null_despite_evidence"]


def test_set_cells(spark):
    c = spark.createDataFrame(
        [("1", "sufficient", "ok", '{"values":["A","b"]}', "h", "h", ["a", "b"], []), ("2", "sufficient", "ok", '{"values":["c"]}', "h", "h", ["a"], ["c"]), ("3", "insufficient", "ok", '{"values":[]}', "h", "h", [], []), ("4", "insufficient", "ok", "x", "h", "h", [], []), ("5", "sufficient", "ok", '{"values":["a"]}', "h", "old", ["a"], [])],
        "cell_id string, condition string, status string, content string, prompt_sha string, answered_sha string, expected array<string>, detectable array<string>",
    )
    got = rows(evaluate.set_cells(c), "cell_id")
    assert [r["exact_match"] for r in got] == [True, False, None, None, False]
    assert [r["correct_abstention"] for r in got] == [None, None, True, False, None]
    assert got[1]["intrusion"] is True and got[0]["intrusion"] is None and got[4]["status"] == "stale_prompt" and (got[1]["tp"], got[1]["fp"], got[1]["fn"]) == (0, 1, 1)


def test_bootstrap_interval(spark):
    c = spark.createDataFrame([(0, 1.0, 2.0, 0.0, 2.0), (1, 2.0, 2.0, 1.0, 2.0), (2, 0.0, 0.0, 1.0, 1.0)], "slot int, num_a double, den_a double, num_b double, den_b double")
    draws = resample.twister_draws(c, 300, 7)
    rng = random.Random(7)
    data, each = [r for r in c.collect()], []
    for _ in range(300):
        s = [data[rng.randrange(3)] for _ in range(3)]
        da, db = sum(r.den_a for r in s), sum(r.den_b for r in s)
        if da and db:
            each.append(round(100 * (sum(r.num_a for r in s) / da - sum(r.num_b for r in s) / db), 6))
    each.sort()
    r = resample.paired_effect(c, draws).first()
    n = len(each) - 1
    assert (r.low, r.high, r.reps) == (each[math.floor(0.025 * n)], each[math.floor(0.975 * n)], len(each))


def test_sequential_dedupe(spark):
    rng = random.Random(2)
    data = [(f"{rng.random():.12f}", k, f"p{rng.randint(0, 25)}", rng.choice(["", *(f"s{j}" for j in range(20))])) for k in range(300)]
    got = {r["item"]: r["decision"] for r in rows(resample.sequential_dedupe(spark.createDataFrame(data, "o string, i long, p string, s string"), "o", "p", "s", "i"))}
    ps, ss, want = set(), set(), {}
    for _, i, p, s in sorted(data):
        want[i] = "repeated_profile" if p in ps else "repeated_summary" if s and s in ss else "selected"
        if want[i] == "selected":
            ps.add(p)
            ss.add(s)
    assert got == want


def test_greedy_strata(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), k, f"u{rng.randint(0, 4)}", f"{rng.random():.9f}") for k in range(80)]
    got = [(r["stratum"], r["block"], r["position"], r["item"]) for r in rows(resample.greedy_strata(spark.createDataFrame(data, "g string, i long, u string, rank_key string"), "g", "i", "u", 3, 6), "stratum", "block", "position")]
    want = []
    for g in "ab":
        pool, used = sorted((x for x in data if x[0] == g), key=lambda x: (x[3], x[1])), set()
        for block in range(1, 7):
            chosen, seen = [], set()
            for _, i, u, _ in pool:
                if len(chosen) < 3 and i not in used and u not in seen:
                    chosen.append(i)
                    seen.add(u)
                    used.add(i)
            if len(chosen) < 3:
                break
            want += [(g, block, p, i) for p, i in enumerate(chosen, 1)]
    assert got == want


def test_violations_are_reported(spark):
    good = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 2)], "g int, o int, ref int")
    bad = good.union(spark.createDataFrame([(2, 1, 9), (2, 4, None)], "g int, o int, ref int"))
    ref = spark.createDataFrame([(1,), (2,)], "id int")
    for df, n in ((good, 0), (bad, 1)):
        assert quality.duplicates(df, ["g", "o"]).count() == n
        assert quality.missing_reference(df, ["g", "o"], ref, [("ref", "id")]).count() == n
    assert quality.order_gaps(good, ["g"], "o").count() == 0 and quality.order_gaps(bad, ["g"], "o").count() == 2
    assert [r["code"] for r in rows(quality.field_rules(bad, ["g", "o"], {"E-REF": F.col("ref") < 5, "E-O": F.col("o") < 3}), "code")] == ["E-O", "E-REF", "E-REF"]
    assert quality.mismatch(good, good, ["g", "o"], "ref").count() == 0


def test_normalisation(spark):
    r = spark.createDataFrame([(" ÉTÀ\n",)], "t string").select(normalised_value("t").alias("a"), plain_spaces(F.lit(" A \t b\n")).alias("b")).first()
    assert r.a == "étà" and r.b == "a b"


def test_flags_and_fragments(spark):
    df = spark.createDataFrame([("Old plan, see X-9", "plan", ["old"])], "a string, c string, o array<string>")
    f = evaluate.flags(F.col("a"), F.col("c"), F.col("o"), "[A-Z]-[0-9]")
    r = df.select(f["obsolete_used"].alias("o"), f["unsupported_tokens"].alias("u")).first()
    assert r.o == ["old"] and r.u == ["X-9"]
    r = spark.range(1).select(metrics.fragments(F.array(F.lit("Web"), F.lit("other")), F.array(F.lit("Web - App"))).alias("x")).first()
    assert r.x == ["Web"]


def test_facts_keep_and_mark_what_they_cannot_support(spark):
    schema = "scenario string, order long, text string, kind string, source_message_ids array<string>, allowed_message_ids array<string>"
    raw = spark.createDataFrame([("A", 1, " a b ", "Fact", ["m1 "], ["m1"]), ("A", 2, None, "odd", ["m1", "m9"], ["m1"]), ("A", 3, "x", None, None, ["m1"]), ("A", 4, "x", "fact", ["m1"], None)], schema)
    got = rows(intake.facts(raw, ("fact",)), "order")
    assert [(r["fact_id"], r["kind_valid"], r["provenance_problem"], r["tokens"]) for r in got] == [
        ("A-F001", True, None, 2), ("A-F002", False, "foreign messages: m9", 0), ("A-F003", False, "no source message", 1), ("A-F004", True, "foreign messages: m1", 1)]
    assert intake.facts(raw.limit(0), ("fact",)).count() == 0


def test_registered_proposals_without_fact_change_nothing(spark):
    known = spark.createDataFrame([("A", "s", "F1", ["m1"], ["m1"]), ("A", "t", "F2", ["m2"], ["m1"])], "scenario string, session string, fact_id string, source_message_ids array<string>, allowed_message_ids array<string>")
    p = spark.createDataFrame([("A", "s", 1, "F1", "k", "ADD", "v", None), ("A", "s", 2, "F2", "k", "UPDATE", "w", "A-M001"), ("A", "t", 3, "F2", "k", "UPDATE", "w", "A-M001")], "scenario string, session string, op_order long, fact_id string, claim_key string, kind string, value string, target string")
    ops = intake.register(p, known)
    assert [(r["op_id"], r["has_fact"], r["provenance_problem"]) for r in rows(ops, "op_order")] == [("A-OP001", True, None), ("A-OP002", False, "fact of another session"), ("A-OP003", True, "foreign messages: m2")]
    done = rows(intake.fold_registered(ops), "op_order")
    assert [(r["applied"], r["rejection"], r["entry_id"]) for r in done] == [(True, None, "A-M001"), (False, "provenance: fact of another session", None), (True, None, "A-M003")]


def test_known_lists_are_whole_or_empty(spark):
    lists = [["b", " a", "b"], ["a", "Unknown"], ["a", "U - Other"], ["x - unknown"], [None, "a"], [], None]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<string>").select("k", intake.known_list(F.col("v")).alias("v"))
    assert [r["v"] for r in rows(got, "k")] == [["a", "b"], [], [], [], [], [], []]


def test_relation_without_sources_is_absent(spark):
    kind = "q int, {} string, source_message_ids array<string>"
    relations = spark.createDataFrame([(1, "r", ["a", "b", "a"]), (1, "s", []), (1, "t", None), (2, "r", ["a"])], kind.format("relation_id"))
    items = spark.createDataFrame([(1, "i", ["b", "a", "c"]), (1, "j", ["a"]), (1, "h", ["a", "b"])], kind.format("item_id"))
    assert [tuple(r.values()) for r in rows(graph.relation_trace(relations, items, ["q"]), "q", "relation_id")] == [(1, "r", "h,i", True), (1, "s", "", False), (1, "t", "", False), (2, "r", "", False)]


def test_causes_and_approval(spark):
    cases = spark.createDataFrame([("a", "unreachable", [], ["x"]), ("b", "unreachable", ["x"], []), ("c", "not_retrieved", ["x"], None), ("d", "generation", [], []), ("e", "generation", None, ["x"])], "case_id string, cause string, unreachable_ids array<string>, not_retrieved_ids array<string>")
    assert [r["key"] for r in rows(quality.unsupported_causes(cases), "key")] == ["a", "c", "e"]
    files = spark.createDataFrame([("p", bytearray(b"x"))], "path string, content binary")
    good = files.select("path", F.sha2("content", 256).alias("sha256"))
    quality.approved(files, good)
    for bad in (good.limit(0), good.withColumn("sha256", F.lit("0"))):
        with pytest.raises(PermissionError):
            quality.approved(files, bad)


def test_sequential_dedupe_reads_whole_texts(spark, tmp_path):
    from mnemo.plans import selection

    rows = [(k, "same opening " * 20 + end, f"l{k}", "s", 300) for k, end in enumerate(("one", "two", "TWO "))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.decision for r in selection.sequential_dedupe(spark, str(tmp_path)).collect())
    assert got == ["repeated_summary", "selected", "selected"]


def test_values_are_whole_texts(spark, tmp_path):
    import hashlib
    import unicodedata

    from mnemo.plans import evaluation, selection

    texts = ["a" * 50 + "E\u0301 One", "a" * 50 + "\u00c9 one", "good\nbad\x01\ne\u0301\nfine", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.md5 for r in evaluation.value_normalisation(spark, str(tmp_path)).collect()}
    assert got == {k: t and hashlib.md5(unicodedata.normalize("NFC", t).strip().casefold().encode()).hexdigest() for k, t in enumerate(texts)}
    used = {(r.doc_id, r.line): r.usable for r in selection.usable_values(spark, str(tmp_path)).collect()}
    assert used == {(0, 0): False, (1, 0): True, (2, 0): True, (2, 1): False, (2, 2): False, (2, 3): True, (3, 0): False}
