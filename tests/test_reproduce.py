"""Fingerprints, splits, pairs, oracles and retrievals on small fixtures with planted faults and nulls."""

import random
from collections import Counter

from pyspark.sql import functions as F

from mnemo.operators import reproduce


def found(df):
    return sorted((r.code, r.key, r.detail) for r in df.collect())


def test_differences_of_multisets(spark):
    rng = random.Random(3)
    rows = [(k % 40, None if k % 7 == 0 else k % 5, rng.choice(["a", "b", None]), [k % 3]) for k in range(200)]
    schema = "id int, x int, t string, l array<int>"
    a = spark.createDataFrame(rows, schema)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert found(reproduce.differences(spark.createDataFrame(shuffled, schema).repartition(5), a, ["id"])) == []
    by_id = {k: [r for r in rows if r[0] == k] for k in range(40)}
    saved = [r for r in rows if r[0] != 3]  # missing
    saved += [(77, 1, "z", [1])]  # unexpected
    saved += [by_id[5][0]]  # repeated
    saved[saved.index(by_id[9][0])] = (9, 999, "q", None)  # changed
    one = next(r for r in saved if r[0] == 11 and r[1] is not None and r[2] is not None)
    saved[saved.index(one)] = (11, None, one[2], one[3])  # a value became null
    want = [("E-REPRODUCE", "11", "changed"), ("E-REPRODUCE", "3", "missing"), ("E-REPRODUCE", "5", "repeated"), ("E-REPRODUCE", "77", "unexpected"), ("E-REPRODUCE", "9", "changed")]
    assert found(reproduce.differences(spark.createDataFrame(saved, schema), a, ["id"])) == want
    assert found(reproduce.differences(a.limit(0), a.limit(0), ["id"])) == []


def test_nulls_of_other_columns_are_told_apart(spark):
    a, b = (spark.createDataFrame([r], "id int, x int, y int") for r in ((None, None, 1), (None, 1, None)))
    assert found(reproduce.differences(a, b, ["id"])) == [("E-REPRODUCE", "null", "changed")]
    p, q = (x.first() for x in (reproduce.fingerprints(a, ["x", "y"]), reproduce.fingerprints(b, ["x", "y"])))
    assert p.n == q.n == 1 and p.a != q.a and p.b != q.b


def test_fingerprints_merge(spark):
    df = spark.range(1000).selectExpr("id % 10 AS g", "id AS x")
    whole, parts = reproduce.fingerprints(df, ["x"]).first(), reproduce.fingerprints(df.repartition(7), ["x"], [F.col("g")]).collect()
    assert (whole.n, whole.a, whole.b) == (sum(r.n for r in parts), sum(r.a for r in parts), sum(r.b for r in parts))


def test_splits_pairs_and_audit(spark):
    rows = spark.createDataFrame([("dev", "e1", "q1"), ("eval", "e2", "q2"), ("eval", "e1", None), ("dev", None, None)], "split string, e string, q string")
    assert found(reproduce.disjoint(rows, "split", ["e", "q"])) == [("E-SPLIT", "e|e1", "dev,eval")]
    pairs = spark.createDataFrame([(1, "a", "ctx", 5, None), (1, "b", "other", 5, None), (2, "a", "x", 5, 1), (2, "b", "y", 6, None)], "k int, c string, context string, n int, m int")
    assert found(reproduce.paired(pairs, ["k"], "c", ["context"])) == [("E-PAIR-FIELD", "2", "m,n")]
    assert reproduce.paired(pairs.select("k", "c", "context"), ["k"], "c", ["context"]).count() == 0
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    excluded = spark.createDataFrame([(2, "short"), (3, "odd"), (4, "short")], "id int, criterion string")
    got = found(reproduce.audit(ids(1, 2, 3, 4, 5), ids(1, 4, 9, 9), excluded, "id", ["short"]))
    assert got == [("E-AUDIT-BOTH", "4", ""), ("E-AUDIT-DUP", "9", ""), ("E-AUDIT-MISSING", "5", ""), ("E-AUDIT-UNKNOWN", "9", ""), ("E-CRITERION", "3", "odd")]


def test_values_inside_texts_by_loops(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abAé ") for _ in range(n))
    texts = [(s, f"m{s}{k}", rng.choice([text(30), text(5), "", None])) for s in range(6) for k in range(8)]
    values = [(s, f"v{s}{k}", rng.choice([text(2), text(3), text(1), "", None, "zz"])) for s in range(7) for k in range(9)]
    want = Counter((s, v, m) for s, v, x in values for t, m, c in texts if s == t and x and c and x in c)
    for limit in (1000, 3):
        got = reproduce.value_places(spark.createDataFrame(texts, "s int, m string, content string"), spark.createDataFrame(values, "s int, value_id string, value string"), ["s"], "m", limit)
        assert Counter(map(tuple, got.collect())) == want and len(want) > 40


def test_oracle_and_retrieval(spark):
    messages = spark.createDataFrame([("m1", 1, "a", "the port is 8080 today"), ("m2", 1, "a", "ask again"), ("m3", 1, "b", "port 8080 and 9090"), ("m4", 1, "b", "again 9090")], "message_id string, episode int, activity string, content string")
    questions = spark.createDataFrame([("q1", "Which port?"), ("q2", "Is it 9090?"), ("q3", "?"), ("q5", "?")], "question_id string, text string")
    answers = spark.createDataFrame([("q1", 1, "a", "8080", "m1"), ("q2", 1, "b", "9090", "m3"), ("q3", 1, "a", "again ", "m3"), ("q3", 1, "a", "8080", "m2"), ("q4", 1, "a", "8080", "m1")], "question_id string, episode int, activity string, value string, evidence_id string")
    got = found(reproduce.oracle(questions, answers.where("question_id <> 'q3'"), messages))
    assert got == [("E-ORACLE-ROWS", "q3", "0"), ("E-ORACLE-ROWS", "q4", "1"), ("E-ORACLE-ROWS", "q5", "0"), ("E-QUESTION-LEAK", "q2", "9090"), ("E-UNIQUE", "q2", "2")]
    got = found(reproduce.oracle(questions, answers, messages))
    assert ("E-ORACLE-ROWS", "q3", "2") in got and ("E-EVIDENCE", "q3", "m3") in got and ("E-TRIM", "q3", "") in got
    may = spark.createDataFrame([("a", m) for m in "xyz"] + [("b", "x"), ("c", "x"), ("d", "x"), ("d", "y")], "k string, message_id string")
    rows = spark.createDataFrame([("a", 1, "x", 3.0), ("a", 2, "y", 3.0), ("b", 1, "z", 1.0), ("d", 1, "x", 1.0), ("d", 2, "y", 2.0)], "k string, rank int, message_id string, score double")
    assert found(reproduce.retrieval(rows, may, ["k"], 2)) == [("E-ACCESS", "b|z", ""), ("E-SCORE-ORDER", "d", ""), ("E-TOP-K", "c", "")]


def test_prompt_leaks(spark):
    rows = spark.createDataFrame([(1, "see HTTPS://x and GHSA-2345-6789-cfgh"), (2, "clean"), (3, None), (4, "on OSV.dev, cve-2020-1234")], "k int, p string")
    assert found(reproduce.prompt_leaks(rows, ["k"], "p")) == [("E-PROMPT", "1", "ghsa_id"), ("E-PROMPT", "1", "https://"), ("E-PROMPT", "4", "cve_id"), ("E-PROMPT", "4", "osv.dev")]


def test_perimeter_scores_equal_scores_within_each(spark):
    from mnemo.operators import ranking

    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(["ab", "b", "cd", "e-f", "Ab", "zz"]) for _ in range(n)) + rng.choice(["", " !", " only%d" % rng.randrange(9)])
    docs = spark.createDataFrame([(k, s, rng.choice([text(5), text(1), "", "!"])) for k in range(6) for s in range(7)], "k int, s int, text string")
    queries = spark.createDataFrame([(k, text(4)) for k in range(5)], "k int, text string")  # one corpus is not asked
    members = {"all": F.lit(True), "late": F.col("s") >= 5, "middle": F.col("s").between(2, 4), "none": F.lit(False), "odd": F.col("s") % 2 == 1}
    got = ranking.perimeter_scores(queries, docs, ["k"], ["s"], members)
    want = None
    for n, c in members.items():
        own = ranking.cosine_scores(queries, docs.where(c), ["k"], ["s"]).select("k", "s", F.lit(n).alias("perimeter"), "score")
        want = own if want is None else want.union(own)
    rows = lambda df: sorted((r.k, r.s, r.perimeter, round(r.score, 9)) for r in df.collect())
    assert rows(got) == rows(want) and any(r.score > 0.5 for r in got.collect())
