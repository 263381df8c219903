"""Table functions in SQL text and optional paths, against loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemo.functions import parse
from mnemo.functions.tables import register
from mnemo.operators import budget, paths


def test_within_budget_equals_windows(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice("xy"), r, rng.choice([0.0, 0.5, 1.0]) if r > 3 else 1.0, rng.randint(1, 40)) for g in range(8) for r in range(1, 9)]
    df = spark.createDataFrame(rows, "g int, note string, rank int, score double, tokens long")
    register(spark)
    for limit in (30, 90, None):
        got = spark.sql(f"SELECT * FROM within_budget(TABLE(SELECT * FROM {{t}}), key => 'g', budget => {'NULL' if limit is None else limit})", t=df)
        want = budget.prefix_within_budget(df, ["g"], F.lit(limit).cast("long"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM within_budget(TABLE(SELECT g FROM {t}), key => 'g', budget => 1)", t=df)
    with pytest.raises(Exception, match="no kind"):
        spark.sql("SELECT * FROM parse_answer('other', 'x')")


def test_parsers_in_sql(spark):
    texts = ['{"value": "a"}', "x", None, '{"values": ["a"]}', '{"status": "answered", "answer": "b"}', 'so: [1, {"b": 2, "a": 1}] end', '{"value": 1}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    register(spark)
    rows = lambda kind: {r.k: tuple(r)[2:] for r in spark.sql(f"SELECT * FROM {{t}} s, LATERAL parse_answer('{kind}', s.t)", t=df).collect()}
    for kind, f in (("one", parse.one_value), ("many", parse.many_values), ("status", lambda t: parse.status_answer(t, ("answered", "abstained")))):
        assert rows(kind) == {k: tuple(f(t).values()) for k, t in enumerate(texts)}
    assert rows("array")[5] == (['1', '{"a": 1, "b": 2}'],) and rows("array")[1] == (None,)


def loop_path(text, steps, kinds):
    try:
        v = json.loads(text)
    except (TypeError, ValueError):
        return None
    for s in steps:
        if isinstance(s, int):
            v = v[s] if isinstance(v, list) and s < len(v) else None
        else:
            v = v.get(s) if isinstance(v, dict) else None
    return v if isinstance(v, kinds) and not (isinstance(v, bool) and bool not in kinds) else None


def test_optional_paths_equal_loops(spark):
    records = [None, "", "{", "null", "[]", "1", '"a"', '{"a": null}', '{"a": 1}', '{"a": {"b": []}}', '{"a": {"b": [{"c": "x"}, {"c": 2}]}}', '{"a": {"b": [{"c": 1.5, "d": true}, 3]}}', '{"a": {"b": {"c": "no array"}}}', '{"a": {"b": [[1]]}}']
    df = spark.createDataFrame([(k, r, "mine") for k, r in enumerate(records)], "k int, record string, __record string")
    want = {"s": ("$.a.b[0].c", "string", ["a", "b", 0, "c"], (str,)), "l": ("$.a", "long", ["a"], (int,)), "d": ("$.a.b[0].c", "double", ["a", "b", 0, "c"], (int, float)), "t": ("$.a.b[0].d", "boolean", ["a", "b", 0, "d"], (bool,)), "n": ("$.a.b[1].c", "long", ["a", "b", 1, "c"], (int,))}
    got = paths.at_paths(df, "record", {n: w[:2] for n, w in want.items()})
    assert got.columns == ["k", "record", "__record", *want]
    for r in got.collect():
        for n, (_, _, steps, kinds) in want.items():
            assert r[n] == loop_path(r.record, steps, kinds), (r.record, n)
    found = paths.elements(df.drop("__record"), "record", "$.a.b", {"c": ("$.c", "string"), "me": ("$", "long")})
    assert sorted((r.k, r.place, r.c, r.me) for r in found.collect() if r.c or r.me) == [(10, 0, "x", None), (11, 1, None, 3)] and found.count() == 5
