"""The draws of the mix: each document's probability, each source's total, ties and sources in many cells."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mnemo.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def unit(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:13], 16) / 2**52


def test_documents_are_drawn_with_their_fraction(spark):
    """One document a source, or seven: of thousands of sources the share with a further copy is the fraction."""
    for per in (1, 7):
        sizes = spark.range(3000 * per).select(F.col("id").alias("doc_id"), F.format_string("s%05d", F.col("id") % 3000).alias("source"), (F.lit(5) + F.col("id") % 4).alias("size"))
        got = mixing.cell_table(sizes.withColumn("class", mixing.size_class(F.col("size"))))
        rows = mixing.with_cells(sizes.withColumn("class", mixing.size_class(F.col("size"))), got.withColumnsRenamed({"source": "s", "class": "c"}), {"source": "s", "class": "c"}, "doc_id")
        x = rows.select((F.col("target") / F.col("source_size") - F.col("whole")).alias("part"), (mixing.draw(F.col("doc_id")) <= F.coalesce("most", F.lit(-1.0))).cast("int").alias("more")).where("part > 0.001")
        for r in x.groupBy(F.round("part", 1).alias("p")).agg(F.count("*").alias("n"), F.avg("part").alias("want"), F.avg("more").alias("got"), F.sum("more").alias("k")).collect():
            assert abs(r.got - r.want) < 4 * math.sqrt(0.25 / r.n * (1 if per == 1 else 2)), (per, r)


def test_draws_equal_a_loop(spark):
    rows = [(k, " ".join("w" * (1 + k * k % 37 if k % 10 else 300)), "abcd"[min(3, k % 9)]) for k in range(700)]
    rows += [(3, rows[3][1], rows[3][2])] * 20 + [(None, "a b c", "b")] * 15  # ids that repeat
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan(df).collect()
    by_source, cells = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        n = len(t.split())
        bits = f"{n:b}".ljust(3, "0")
        by_source[s] += n
        cells[s, len(f"{n:b}") * 4 + int(bits[1:3], 2)].append(unit(f"mix:{'null' if i is None else i}"))
    target = {r.source: r.target for r in got}
    most = {}
    for s in by_source:
        part, upto, u = target[s] / by_source[s] % 1, 0, unit(f"cells:{s}")
        for c in sorted((c for t, c in cells if t == s), reverse=True):
            n = len(cells[s, c])
            k = math.floor((upto + n) * part + u) - math.floor(upto * part + u)
            upto += n
            most[s, c] = sorted(cells[s, c])[k - 1] if k else -1
    want = Counter()
    for i, t, s in rows:
        n = len(t.split())
        c = len(f"{n:b}") * 4 + int(f"{n:b}".ljust(3, "0")[1:3], 2)
        want[i, n, s, math.floor(target[s] / by_source[s]) + (unit(f"mix:{'null' if i is None else i}") <= most[s, c])] += 1
    assert Counter((r.doc_id, r.size, r.source, r.copies) for r in got) == want
    emitted = Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert emitted == Counter({i: m for i in {i for i, *_ in want} if (m := sum(k[3] * v for k, v in want.items() if k[0] == i))})


@pytest.mark.parametrize("limit", [100_000, 1])
def test_totals_come_near_targets(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)  # 1: cells are joined in salted slices
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pow(F.lit(1.7), F.col("id") % 13) + F.col("id") % 11).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("s%d", F.col("id") % 17)).alias("source"))
    got = mixing.plan(df).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.03 for r in got), got
