"""Names in texts and provenance against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import shuffled
from mnemo.operators import graph, naming

NODE = "k int, node_id string, node_order int, aliases array<string>, label string, source_fact_ids array<string>"


def tokens(t):
    return re.findall("[a-z0-9_-]+", t.lower())


def stands(words, name):
    n = tokens(name)
    return bool(n) and any(words[i : i + len(n)] == n for i in range(len(words)))


def loop_mentioned(text, nodes):
    out = []
    for i, o, aliases, label in nodes:
        for name in [i, *(aliases or []), label]:
            if name and stands(tokens(text), name):
                out.append((i, o, name))
                break
    return out


def loop_seeds(items, nodes, most):
    found = []
    for rank, item, text, facts in items:
        for i, o, aliases, _, own in nodes:
            if i in [f[0] for f in found]:
                continue
            if any(n and n.lower() in text.lower() for n in [i, *(aliases or [])]) or set(facts) & set(own):
                found.append((i, item))
    return found[:most]


@pytest.fixture(scope="module")
def world():
    rng = random.Random(6)
    word = lambda: rng.choice(["ab", "Ab", "b", "ba", "c-d", "c", "é", "x1", "AB"])
    phrase = lambda n: " ".join(word() for _ in range(n))
    nodes, items, questions = [], [], []
    for k in range(12):
        for o in range(8):
            label = rng.choice([None, "", phrase(2), "!"])
            nodes.append((k, f"{word()}{o}" if o % 2 else phrase(rng.randint(1, 2)) + "." * o, o, rng.choice([None, [], [phrase(3), phrase(1)], [phrase(2), None, ""]]), label, [f"f{rng.randrange(9)}" for _ in range(rng.randint(0, 2))]))
        for r in range(5):
            items.append((k, r + 1, f"i{r}", rng.choice(["", phrase(9), phrase(3) + ", " + phrase(2)]), [f"f{rng.randrange(40)}"]))
        questions += [(k, f"q{j}", t) for j, t in enumerate([phrase(12), phrase(4) + "?" + phrase(3), ""])]
    return nodes, items, questions


@pytest.mark.parametrize("limit", [200_000, 7, 1])
def test_matching_equals_loops(spark, world, limit):
    """One automaton, and shards of a few names each."""
    nodes, items, questions = world
    n = spark.createDataFrame(nodes, NODE)
    got = naming.mentioned_nodes(spark.createDataFrame(questions, "k int, question_id string, text string"), n, ["k"], limit=limit)
    want = [(k, q, *m) for k, q, text in questions for m in loop_mentioned(text, [x[1:5] for x in nodes if x[0] == k])]
    assert sorted((r.k, r.question_id, r.node_id, r.node_order, r.matched_name) for r in got.collect()) == sorted(want) and len(want) > 30
    seeds = naming.seed_nodes(spark.createDataFrame(items, "k int, rank int, item_id string, text string, source_fact_ids array<string>"), n, ["k"], 3, limit)
    got = {}
    for r in sorted(seeds.collect(), key=lambda r: r.pos):
        got.setdefault(r.k, []).append((r.node_id, r.from_item))
    assert got == {k: s for k in range(12) if (s := loop_seeds([x[1:] for x in items if x[0] == k], [x[1:] for x in nodes if x[0] == k], 3))}


def test_no_names_and_no_texts(spark, world):
    nodes, items, questions = world
    n, q = spark.createDataFrame(nodes, NODE), spark.createDataFrame(questions, "k int, question_id string, text string")
    assert naming.mentioned_nodes(q, n.limit(0), ["k"]).count() == 0 == naming.mentioned_nodes(q.limit(0), n, ["k"]).count()
    assert naming.mentioned_nodes(q, n.limit(0), ["k"], limit=0 + 1).count() == 0


def loop_provenance(cited, facts, allowed):
    messages, problems = [], []
    for f in cited or []:
        if f not in facts:
            problems.append(f"unknown fact: {f}")
            continue
        for m in facts[f]:
            if m not in allowed:
                problems.append(f"message not allowed: {m}")
            elif m not in messages:
                messages.append(m)
    return messages, problems + ([] if cited else ["no source fact"])


def test_provenance_equals_loops(spark):
    rng = random.Random(9)
    states = ("attivo", "superato")
    for_spark = {"nodes": [], "edges": [], "facts": [], "allowed": []}
    want = []
    for k in range(10):
        facts = {f"f{i}": [f"m{rng.randrange(7)}" for _ in range(rng.randint(0, 3))] for i in range(5)}
        allowed = {f"m{i}" for i in range(5)}
        for_spark["facts"] += [(k, f, 1, v) for f, v in facts.items()] + [(k, "f0", 0, ["m6"])]  # the last of equal ids counts
        for_spark["allowed"] += [(k, m) for m in allowed]
        cite = lambda: rng.choice([None, [], [f"f{rng.randrange(7)}" for _ in range(rng.randint(1, 3))]])
        nodes = [(k, o, f" n{o} ", cite()) for o in range(4)]
        edges = [(k, o, f"n{rng.randrange(5)}", rng.choice([None, f" n{rng.randrange(6)}"]), rng.choice([None, " Superato", "x"]), cite()) for o in range(1, 6)]
        for_spark["nodes"] += nodes
        for_spark["edges"] += edges
        for _, o, i, c in nodes:
            m, p = loop_provenance(c, facts, allowed)
            want.append((k, "node", i.strip(), m, not p, "; ".join(p) or None))
        for _, o, s, t, state, c in edges:
            m, p = loop_provenance(c, facts, allowed)
            for end, v in (("subject", s), ("object", (t or "").strip())):
                p += [] if v in {f"n{i}" for i in range(4)} else [f"{end} is not a declared node: {v}"]
            st = (state or "attivo").strip().lower()
            want.append((k, "edge", f"E{o:03d} {st} {st in states}", m, not p, "; ".join(p) or None))
    ids = "array<string>"
    df = lambda n, s: spark.createDataFrame(for_spark[n], s)
    n, e = naming.normalised_graph(df("nodes", f"k int, node_order int, node_id string, source_fact_ids {ids}"), df("edges", f"k int, order int, subject string, object string, state string, source_fact_ids {ids}"), df("facts", f"k int, fact_id string, fact_order int, source_message_ids {ids}"), df("allowed", "k int, message_id string"), ["k"], states, "attivo")
    got = [(r.k, "node", r.node_id, r.source_message_ids, r.provenance_valid, r.provenance_problem) for r in n.collect()]
    got += [(r.k, "edge", f"{r.edge_id} {r.state} {r.state_valid}", r.source_message_ids, r.provenance_valid, r.provenance_problem) for r in e.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_paths_equal_breadth_first_search(spark):
    rng = random.Random(4)
    edges = [(f"e{k:03d}", f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for k in range(45)]
    anchors = [f"n{k}" for k in range(0, 25, 4)]

    def bfs(a, b):
        front, seen = [(a, [])], {a}
        for _ in range(3):
            nxt = []
            for at, ids in front:
                for e, x, y in sorted(edges):
                    for s, t in {(x, y), (y, x)}:
                        if s == at and t not in seen:
                            seen.add(t)
                            nxt.append((t, [*ids, e]))
            front = nxt
            for t, ids in front:
                if t == b:
                    return ",".join(ids)
        return None

    got = {(r.source, r.target): r.edge_ids for r in graph.shortest_paths(spark.createDataFrame(edges, "edge_id string, subject string, object string"), spark.createDataFrame([(a,) for a in anchors], "node string")).collect()}
    assert got == {(a, b): p for a in anchors for b in anchors if a < b and (p := bfs(a, b))}


def test_annotation_template_equals_loops(spark):
    from mnemo.operators import template

    rng = random.Random(7)
    ids = lambda n: [f"m{rng.randrange(6)}" for _ in range(n)]
    cells = [(s, q, m) for s in "st" for q in ("q1", "q2", "q3", "q4") for m in "FG"]
    facts = [(s, q, f"f{k}", rng.choice([None, [], ids(1), ids(3)])) for s in "st" for q in ("q1", "q2") for k in range(3)]
    memory = [(s, m, f"m{k}") for s in "st" for m in "FG" for k in range(6) if rng.random() < 0.6]
    context = [(*c, x) for c in cells for x in sorted(set(ids(6)))]
    declared = [(s, f"r{k}", rng.choice([[], ids(1), ids(2)])) for s in "st" for k in range(3)]
    required = [(s, q, f"r{k}") for s in "st" for q in ("q1", "q3") for k in range(4) if rng.random() < 0.7]
    selected = [(*c, f"i{k}", rng.choice(["edge", "entry"]), ids(3)) for c in cells for k in range(4)]
    chains = [("s", "q1", ["r0", "r1"]), ("s", "q3", ["r1"]), ("t", "q1", []), ("t", "q3", ["r2"])]
    df = lambda rows, more: spark.createDataFrame(rows, more)
    cell, arr = "scenario string, question string, mode string", "source_message_ids array<string>"
    got = template.annotation_template(
        df(cells, cell), df(facts, f"scenario string, question string, fact_key string, {arr}"), df(memory, "scenario string, mode string, message_id string"), df(context, f"{cell}, message_id string"),
        df(required, "scenario string, question string, relation_id string"), df(declared, f"scenario string, relation_id string, {arr}"), df(selected, f"{cell}, item_id string, unit string, {arr}"), df(chains, "scenario string, question string, chain array<string>"),
    )
    want = []
    for s, q, m in cells:
        has, seen = {x for a, b, x in memory if (a, b) == (s, m)}, {x for *c, x in context if c == [s, q, m]}
        fs = [(k, v or []) for a, b, k, v in facts if (a, b) == (s, q)]
        rs, known = [r for a, b, r in required if (a, b) == (s, q)], {r: v for a, r, v in declared if a == s}
        present = {r for r in rs if known.get(r) and any(set(known[r]) <= set(v) for *c, _, _, v in selected if c == [s, q, m])}
        missing, gone = sorted(k for k, v in fs if not set(v) <= seen), sorted(set(rs) - present)
        chain = next((c for a, b, c in chains if (a, b) == (s, q)), [])
        want.append((s, q, m, len(fs), sum(set(v) <= has for _, v in fs), ",".join(missing), len(rs), ",".join(gone), all(r not in gone for r in chain) if chain else None, False if missing or gone else None))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {w[-1] for w in want} == {False, None}
    rows = template.relation_rows(df(cells, cell), df(required, "scenario string, question string, relation_id string"), df(declared, f"scenario string, relation_id string, {arr}"), df(selected, f"{cell}, item_id string, unit string, {arr}"))
    assert {r.problem for r in rows.collect() if r.relation_id == "r3"} == {"relation not declared"} and not [r for r in rows.collect() if r.relation_id != "r3" and r.problem]


def test_evidence_ranks(spark):
    from mnemo.operators import template

    a = "array<string>"
    rows = spark.createDataFrame([("q1", "x", ["m1", "m2"], ["m2", "m1"], ["m2"], ["x"]), ("q2", "x", ["m1"], ["m1"], ["m1"], ["y"]), ("q3", "x", [], [], [], [])], f"question string, activity string, accessible {a}, ranked {a}, retrieved {a}, retrieved_activities {a}")
    oracle = spark.createDataFrame([("q1", "m1"), ("q2", "m9"), ("q3", "m1")], "question string, evidence_id string")
    got = {r.question: tuple(r)[1:] for r in template.evidence_ranks(rows, oracle).collect()}
    assert got == {"q1": (True, False, 2, 0, 0.0), "q2": (False, False, None, 1, 1.0), "q3": (False, False, None, 0, None)}


def test_numbers_within_groups_and_clashing_names(spark):
    from mnemo.operators import positions

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), k, "mine") for k in range(120)]
    df = spark.createDataFrame(rows, "g string, v int, k int, __p string").withColumnRenamed("__p", "_p").withColumn("__k", F.lit("mine"))
    got = positions.numbered_within(df, "g", ["v", "k"])
    assert got.columns == ["g", "v", "k", "_p", "__k", "pos"]
    want = {}
    for g in ("a", "b", None):
        want |= {r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1)}
    assert {r.k: r.pos for r in got.collect()} == want


@pytest.mark.parametrize("limit", [200_000, 30, 1])
def test_mentions_copy_no_text_for_its_words(spark, limit):
    """Long texts, of which each word begins a name: a text is not moved once a word."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(1500)]
    texts = [(k, " ".join(rng.sample(words, 1200)) + (". The end" if k % 3 else "")) for k in range(12)] + [(12, ""), (13, None), (12, "the END the end")]
    names = [" ".join(rng.sample(words, n)) for n in (1, 1, 2, 2)] + ["the end", "The End", "the end", "end the", "!", None]
    names += [" ".join(tokens(texts[k][1])[7 : 7 + n]) for k in range(5) for n in (2, 3)]
    if limit == 30:
        names += words
    before = shuffled(spark)
    got = graph.mentions(spark.createDataFrame(texts, "k int, text string"), ["k"], spark.createDataFrame([(n,) for n in names], "name string"), limit).collect()
    if limit != 1:
        assert shuffled(spark) - before < (0.5 if limit > len(names) else 10)
    assert sorted((r.k, r.name) for r in got) == sorted((k, n) for k, t in texts for n in names if t and n and stands(tokens(t), n))
