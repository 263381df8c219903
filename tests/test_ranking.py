"""Best documents of large corpora against loops."""

import math
import random
import re
from collections import Counter

import pytest
from conftest import shuffled
from pyspark.sql import functions as F

from mnemo.operators import ranking

DOCS, ASKS = "lang string, doc_id long, text string", "item_id long, lang string, text string"


def tokens(t):
    return re.findall("[a-z0-9_-]+", (t or "").lower())


def loop(asks, docs, k):
    """Rows of one document count as one text; a document without an id counts in frequencies only."""
    out = []
    for item, lang, text in asks:
        rows = [d for d in docs if d[0] is not None and d[0] == lang]
        tf = {}
        for _, i, t in rows:
            tf.setdefault(i, Counter()).update(tokens(t))
        df = Counter(w for c in tf.values() for w in c)
        idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
        q = {w: n * idf[w] for w, n in Counter(tokens(text)).items() if w in idf}
        length = math.sqrt(sum(x * x for x in q.values()))
        scored = []
        for i, c in tf.items():
            if i is not None and set(c) & set(q):
                norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
                scored.append((-round(sum(c[w] * idf[w] * q[w] for w in q if w in c) / norm / length, 12), i))
        out += [(item, i, round(-s, 6), r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("limit", [300_000, 60, 12, 1])
def test_best_documents_equal_loops(spark, limit):
    """All terms broadcast, the frequent and asked ones, the frequent ones alone, and next to none."""
    rng = random.Random(5)
    word = lambda: f"W{int(rng.paretovariate(0.7))}"
    phrase = lambda n: " ".join(word() for _ in range(n))
    docs = [(rng.choice(["en", "fr", None]), rng.choice([k, k, k, 3, None]), rng.choice([phrase(8), phrase(30), phrase(3) + "; " + phrase(2), "", None])) for k in range(150)]
    docs += [("en", 900, "w1 w2 only-here w1"), ("en", 901, "w1 w2 only-here w1"), ("fr", 902, "w1 w2")]
    asks = [(k, rng.choice(["en", "fr", "de"]), phrase(6)) for k in range(12)] + [(90, "en", "only-here W1"), (91, "en", ""), (92, "fr", None), (93, "fr", "nowhere")]
    got = ranking.top_scores(spark.createDataFrame(asks, ASKS), spark.createDataFrame(docs, DOCS), "item_id", "lang", "doc_id", 4, limit)
    want = loop(asks, docs, 4)
    assert sorted((r.item_id, r.doc_id, r.score, r["rank"]) for r in got.collect()) == want and len(want) > 30


def test_terms_of_documents_are_not_moved(spark):
    """120,000 terms of documents, of which queries ask for few."""
    base = spark.range(400).select(F.lit("en").alias("lang"), F.col("id").alias("doc_id"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda k: F.concat(F.lit("word"), F.pmod(F.hash("doc_id", k), F.lit(3000)).cast("string"))), " ")
    asks = spark.createDataFrame([(1, "en", "word1 word2 word3"), (2, "en", "word4")], ASKS)
    before = shuffled(spark)
    assert ranking.top_scores(asks, base.select("lang", "doc_id", text.alias("text")), "item_id", "lang", "doc_id", 5).count() == 10
    assert shuffled(spark) - before < 0.5
