"""Periodic runs, exact top-k search and Elkan clustering against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.llm import elkan, periodic_runs, queries, topk_search

VECTORS = "vec_id long, embedding array<double>, label int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- periodic runs ------------------------------------------------------------


def loop_runs(w, least=24, times=3):
    """All runs, by comparing each word with the one q further on, for each q."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def loop_collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def loop_planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]


def loop_digest(doc_id, text):
    w = loop_planted(doc_id, words(text))
    runs = loop_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *(best or (None,) * 3), milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(loop_collapsed(w, runs))))


def test_runs_of_random_words():
    rng, found = random.Random(5), 0
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 5, 60])) for _ in range(rng.randint(0, 140))]
        for _ in range(rng.randint(0, 4)):
            if len(w) > 5:
                a, p = rng.randrange(len(w)), rng.randint(1, 14)
                for i in range(a, min(len(w), a + rng.randint(1, 90))):
                    w[i] = w[a + (i - a) % p]
        least, times = rng.choice([(24, 3), (24, 3), (6, 2), (4, 3), (1, 2)])
        got = periodic_runs.find_runs(w, least, times)
        assert got == loop_runs(w, least, times)
        assert periodic_runs.collapsed(w, got) == loop_collapsed(w, got)
        found += len(got)
    assert found > 1000


def test_runs_of_long_texts_take_no_quadratic_time():
    w = [0, 1, 2] * 40_000
    assert periodic_runs.find_runs(w) == [(0, 120_000, 3)]
    assert periodic_runs.find_runs(list(range(60_000)) * 3) == [(0, 180_000, 60_000)]


def test_hash_collisions_only_cost_time(monkeypatch):
    monkeypatch.setattr(periodic_runs, "window_hashes", lambda ids, width: np.zeros(len(ids) - width + 1, np.uint64))
    rng = random.Random(2)
    w = [rng.randrange(50) for _ in range(300)] + [1, 2, 3] * 20
    assert periodic_runs.find_runs(w) == loop_runs(w)


def test_query_of_runs(spark, data):
    got = queries.queries()["op11_periodic_runs"](spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = [loop_digest(r.doc_id, r.text) for r in docs]
    assert Counter(map(tuple, got.collect())) == Counter(want) and sum(w[1] for w in want) > 5
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_rows_of_runs(spark):
    long_text = " ".join(["a b c"] * 30_000)
    rows = [(1, "x y " * 20, "mine"), (1, "x y " * 20, "mine"), (2, None, None), (None, "k " * 30, "n"), (3, "", None), (4, " \t\x0b\n", None), (5, long_text, None), (6, "é\x1fü " * 40, None), (7, "one two", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("__whole", F.lit(1)).withColumn("odd.name", F.lit(2))
    got = periodic_runs.periodic_runs(df)
    assert got.columns == ["doc_id", "text", "__whole", "odd.name", "runs", "collapsed"]
    back = Counter((r.doc_id, r.text, tuple(map(tuple, r.runs)), r.collapsed) for r in got.collect())
    want = Counter((i, t, tuple(loop_runs(words(t)) if t != long_text else [(0, 90_000, 3)]), " ".join(loop_collapsed(words(t), loop_runs(words(t))) if t != long_text else "abc")) for i, t, _ in rows)
    assert back == want and back[(2, None, (), "")] == 1 and back[(1, "x y " * 20, ((0, 40, 2),), "x y")] == 2
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0 == periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(df.limit(0)))).count()
    planted = {r.doc_id: r.text for r in periodic_runs.planted(spark.range(400).selectExpr("id AS doc_id", "array_join(transform(sequence(0, id % 90), x -> concat('w', x)), ' ') AS text")).collect()}
    assert all(words(t) == loop_planted(i, [f"w{k}" for k in range(i % 90 + 1)]) for i, t in planted.items())
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, min_times=1)


def test_strongest_run_ties(spark):
    df = spark.createDataFrame([(1, [(5, 30, 10), (2, 6, 2), (9, 9, 3)]), (2, [(4, 7, 2), (1, 10, 3)]), (3, [])], "id long, runs " + periodic_runs.RUNS)
    got = {r.id: r.b and tuple(r.b) for r in df.select("id", periodic_runs.strongest(F.col("runs")).alias("b")).collect()}
    assert got == {1: (2, 6, 2), 2: (4, 7, 2), 3: None}


# --- exact top-k search -------------------------------------------------------


def loop_top(rows, k, scale=64, every=20):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i is not None and i % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for j, v in ok if j != i and len(v) == len(q)]
            out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def make(rng, n, size, kinds=4, spread=0.2):
    centres = rng.standard_normal((kinds, size))
    return [(k, (centres[k % kinds] + spread * rng.standard_normal(size)).tolist(), 0) for k in range(n)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for size in (1, 3, 33, 64):
        x, y = (rng.integers(-200, 200, (50, size)) for _ in range(2))
        dots = x @ y.T
        for parts in (p for p in topk_search.SEGMENTS if p < size):
            bound = topk_search.statistics(x.astype(float), parts) @ topk_search.statistics(y.astype(float), parts).T
            assert (bound + 1e-6 >= dots).all()


@pytest.mark.parametrize("tile", [(1 << 20, 8192, 4096), (64, 3, 20)])
def test_top_k_of_odd_rows(spark, tile, monkeypatch):
    for name, value in zip(("TILE_ROWS", "TILE_QUERIES", "BLOCK"), tile):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(4)
    rows = make(rng, 300, 64) + [(400 + k, [0.5] * 64, 1) for k in range(60)]  # ties in plenty
    rows += [(500, None, 1), (520, [float("nan")] * 64, 1), (521, [None] + [0.1] * 63, 1), (522, [float("inf")] + [0.0] * 63, 1), (540, [1.0, 2.0], 1), (541, [3.0, 1.0], 1), (560, [], 1), (561, [], 1)]
    rows += [(None, [9.0] * 64, 1), (None, [9.0] * 64, None), (20, rows[20][1], 0), (33, rows[33][1], 0), (580, [1e5] * 64, 0), (-40, [-0.01] * 64, 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("number", F.lit("mine")).withColumn("least", F.lit("mine"))
    got = topk_search.top_k(df, F.col("id") % 20 == 0, k=7, seeds=50)
    assert Counter(map(tuple, got.collect())) == Counter(loop_top(rows, 7))
    assert topk_search.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert topk_search.top_k(df.where("vec_id = 540"), F.col("id") % 20 == 0).count() == 0


def test_top_k_leaves_huge_vectors_out(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0], 0), (1, [1e300, 0.0], 0), (2, [2.0, 1.0], 0), (20, [1e9, 1e9], 0)], VECTORS)
    assert [tuple(r) for r in topk_search.top_k(df, F.col("id") % 20 == 0).collect()] == [(0, 1, 2, 64 * 64 * 3)]


def test_search_prunes_and_keeps_all():
    """On clustered vectors few pairs survive the bounds, and none is lost."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 64)) * 20
    x = np.floor(centres[np.arange(2000) % 40] + rng.standard_normal((2000, 64))).astype(np.int64)
    side = topk_search.Side(np.arange(2000), x)
    dots = (x @ x.T).astype(np.int64)
    np.fill_diagonal(dots, np.iinfo(np.int64).min + 1)
    least = np.sort(dots, axis=1)[:, -20]
    i, j = topk_search.survivors(side, side, least.astype(float))
    assert len(i) < 0.2 * dots.size and (dots >= least[:, None]).sum() == (dots[i, j] >= least[i]).sum()
    i, j, score = topk_search.search(side, side, np.full(2000, np.iinfo(np.int64).min), 20)
    want = [(a, b, dots[a, b]) for a in range(0, 2000, 97) for b in sorted(range(2000), key=lambda b: (-dots[a, b], b))[:20]]
    assert set(want) <= set(zip(i.tolist(), j.tolist(), score.tolist())) and len(i) == 40_000


# --- Elkan clustering ---------------------------------------------------------


def loop_clusters(rows, k=8, rounds=10, size=64, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    x = np.array([v for _, v in kept], object)
    c = np.array([v for _, v in order[:k]], object)

    def near():
        d = np.array([[((p - q) ** 2).sum() for q in c] for p in x], object)
        a = np.array([min(range(len(c)), key=lambda j: (row[j], j)) for row in d])
        return a, [row[j] for row, j in zip(d, a)]

    for _ in range(rounds):
        a, _ = near()
        for j in range(len(c)):
            if (a == j).any():
                c[j] = [int(s) // int((a == j).sum()) for s in x[a == j].sum(axis=0)]
    a, d = near()
    per = [sum(e for e, b in zip(d, a) if b == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, map(int, row))).encode()).hexdigest() for row in c]
    return [(i, int(b), int(e), int(per[b]), int(sum(per)), sha[b]) for (i, _), b, e in zip(kept, a, d)]


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = make(rng, 150, 64, kinds=5, spread=0.6) + [(200 + k, [0.25 * (k % 3)] * 64, None) for k in range(30)]
    rows += [(300, None, 1), (301, [1.0] * 63, 1), (302, [1.0] * 65, 1), (303, [float("nan")] * 64, 1), (304, [None] * 64, 1), (305, [float("-inf")] * 64, 1), (None, [0.1] * 64, 1), (7, rows[7][1], 0), (7, [0.3] * 64, 0), (306, [1e4] * 64, 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("mine")).withColumn("distance", F.lit(0))
    got = elkan.summary(*elkan.clustered(df))
    assert Counter(map(tuple, got.collect())) == Counter(loop_clusters(rows))
    for some in (rows[:3], rows[150:180], []):  # fewer vectors than centroids; ties and empty clusters; nothing
        part = spark.createDataFrame(some, VECTORS)
        assert Counter(map(tuple, elkan.summary(*elkan.clustered(part)).collect())) == Counter(loop_clusters(some))


def test_bounds_skip_distances_and_keep_ties():
    rng = np.random.default_rng(8)
    x = rng.integers(-30, 30, (12, 64))[rng.integers(0, 12, 3000)] + rng.integers(-1, 2, (3000, 64))
    c = x[:9].copy()
    c[8] = c[3]  # equal centroids: the smaller number wins
    state, shift, taken = elkan.Bounds.unknown(len(x), len(c)), np.zeros(len(c)), []
    for r in range(8):
        state.move(shift)
        before = state.taken
        state.assign(x, c)
        taken.append(state.taken - before)
        d = np.array([elkan.squares(x, y) for y in c])
        assert (state.cluster == d.argmin(axis=0)).all()  # argmin takes the first of equals
        assert (state.upper**2 >= d.min(axis=0)).all() and (state.lower.T**2 <= d + 1e-9).all()
        new = np.array([x[state.cluster == j].sum(axis=0) // max(1, (state.cluster == j).sum()) if (state.cluster == j).any() else c[j] for j in range(len(c))])
        shift, c = elkan.root_up(elkan.squares(new, c)), new
    assert taken[-1] < 0.3 * d.size


def test_rounds_leave_no_tables(spark, data):
    import os

    assert queries.queries()["op13_elkan_clusters"](spark, data).count() == 500
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [d for d, _, _ in os.walk(top) if "elkan-" in d]


# --- near-duplicate vectors: memory of a large bucket ---------------------------


def test_sketches_of_a_large_slice_take_bounded_memory():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys, resource
sys.path.insert(0, {root!r})
import numpy as np
from mnemo.llm import embedding_dedup as e
rng = np.random.default_rng(1)
a = rng.integers(0, 1 << 63, (25_000, 2)).astype(np.uint64)
a[-1], a[12] = a[7], a[24_000]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
within, across = e.partnered(a, None, 20), e.partnered(a[:12_500], a[12_500:], 20)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, *np.flatnonzero(within), "-", *np.flatnonzero(across))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert out[1:] == ["7", "12", "24000", "24999", "-", "7", "12", "24000", "24999"] and int(out[0]) < 150
