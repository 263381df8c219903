"""TF-IDF ranking within perimeters, by joins on terms.

A corpus is the set of documents that one query may read; document frequencies, and so scores, are those of that
corpus.  Every step is keyed by corpus, and documents meet queries through shared terms only.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rank_tokens
from ..session import cut

#: Most frequent terms, and most terms or weights of queries, that are broadcast.
TERMS = 300_000


def term_counts(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return rows.select(*keys, F.explode(rank_tokens(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").cast("double").alias("tf"))


def cosine_scores(queries: DataFrame, docs: DataFrame, corpus: list[str], doc_key: list[str]) -> DataFrame:
    """(corpus, doc_key, score) for each document of ``docs``; 0 where nothing is shared.

    queries: corpus columns and text, one row each; docs: corpus columns, doc_key columns, text.  idf is
    ln((1 + N) / (1 + df)) + 1 with N documents in the corpus, empty ones included; vectors have unit length and the
    query keeps only terms of the corpus."""
    tf = term_counts(docs, corpus + doc_key)
    n = docs.groupBy(*corpus).agg(F.count("*").alias("n"))
    idf = tf.groupBy(*corpus, "term").agg(F.count("*").alias("df")).join(n, corpus)
    idf = idf.select(*corpus, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    dw = tf.join(idf, [*corpus, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norms = dw.groupBy(*corpus, *doc_key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    qw = term_counts(queries, corpus).join(idf, [*corpus, "term"]).select(*corpus, "term", (F.col("tf") * F.col("idf")).alias("qw"))
    qnorm = qw.groupBy(*corpus).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = dw.join(qw, [*corpus, "term"]).groupBy(*corpus, *doc_key).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = dots.join(norms, corpus + doc_key).join(qnorm, corpus).select(*corpus, *doc_key, (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))
    return docs.select(*corpus, *doc_key).join(scored, corpus + doc_key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def few(table: DataFrame, limit: int) -> DataFrame:
    """``table`` as a broadcast if it has ``limit`` rows at most."""
    return F.broadcast(table) if table.count() <= limit else table


def weighed(known: pa.Table, loose: bool, batches):
    """For documents (corpus, doc, words) the squares of their ``known`` terms' weights (corpus, term, idf, number) summed, numbers
    and counts of those with a number, and the other terms with counts.  Only rows that a query may meet."""
    own: dict = {}
    for corpus, *term in zip(*[c.to_pylist() for c in known.columns]):
        own.setdefault(corpus, {})[term[0]] = term[1:]
    for batch in batches:
        rows, squares, out = [], [], ([], [], [], [])
        for e, (corpus, words) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            terms, total, lists = own.get(corpus, {}), 0.0, ([], [], [], [])
            for term, tf in Counter((words or "").split()).items():
                if (hit := terms.get(term)) is None:
                    lists[2].append(term)
                    lists[3].append(tf)
                    continue
                total += (tf * hit[0]) ** 2
                if hit[1] >= 0:
                    lists[0].append(hit[1])
                    lists[1].append(tf)
            if lists[0] or loose and lists[2]:
                rows.append(e)
                squares.append(total)
                for to, x in zip(out, lists):
                    to.append(x)
        at, kinds = pa.array(np.asarray(rows, np.int64)), (pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[:2]], pa.array(squares, pa.float64()), *[pa.array(x, pa.list_(k)) for x, k in zip(out, kinds)]], names=[*batch.schema.names[:2], "_squares", "_nos", "_tfs", "_rest", "_times"])


def top_scores(queries: DataFrame, docs: DataFrame, query: str, corpus: str, doc: str, k: int, limit: int = TERMS) -> DataFrame:
    """(query, doc, score, rank): each query's ``k`` best documents of its corpus that share a term with it, ranked by
    ``rank_exact``.  queries: query, corpus, text; docs: corpus, doc, text; rows of one document count as one text.

    A document's terms are counted where it is and never moved: the most frequent terms' weights, and those that queries ask for,
    are broadcast (``limit`` of each at most), and only terms beyond are joined as rows.  What moves on is a row a document with
    its norm and the terms that are asked for; its scores are made, and cut to each query's best, where this row is."""
    key = [corpus, doc]
    docs = docs.select(*key, "text").where(F.col(corpus).isNotNull())
    size = cut(docs.groupBy(corpus).agg(F.count("*").alias("n")))
    words = lambda x: x.select(*key, F.explode(F.array_distinct(rank_tokens(F.col("text")))).alias("term"))
    again = cut(docs.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(corpus).alias("_corpus"), F.col(doc).alias("_doc")))
    one, held = docs, words(docs)
    if again.count():
        parted = lambda how: docs.join(few(again, limit), (F.col(corpus) == F.col("_corpus")) & F.col(doc).eqNullSafe(F.col("_doc")), how)
        held = words(parted("left_anti")).union(words(parted("left_semi")).distinct())
        one = parted("left_anti").union(parted("left_semi").where(F.col(doc).isNotNull()).groupBy(*key).agg(F.array_join(F.collect_list("text"), "\n").alias("text")))
    asks = cut(term_counts(queries.where(F.col(query).isNotNull()), [query, corpus]))
    asked = cut(asks.select(corpus, "term").distinct().withColumn("_no", F.monotonically_increasing_id()))
    all_asked = asked.count() <= limit
    terms = held.groupBy(corpus, "term").agg(F.count("*").alias("df")).join(few(size, limit), corpus).join(few(asked, limit), [corpus, "term"], "left")
    terms = cut(terms.select(corpus, "term", F.length(F.bin("df")).alias("_bits"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "_no"))
    total, bits, n = 0, 64, {r["_bits"]: r["n"] for r in terms.groupBy("_bits").agg(F.count("*").alias("n")).collect()}
    while bits and total + n.get(bits, 0) <= limit:
        total, bits = total + n.get(bits, 0), bits - 1
    is_known = (F.col("_bits") > bits) | (F.col("_no").isNotNull() & F.lit(all_asked))
    known = terms.where(is_known).select(corpus, "term", "idf", F.coalesce("_no", F.lit(-1))).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kinds = {"_squares": "double", "_nos": "array<bigint>", "_tfs": "array<bigint>", "_rest": "array<string>", "_times": "array<bigint>"}
    schema = docs.select(*key, *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).schema
    loose = not all_asked
    rows = one.where(F.col(doc).isNotNull()).select(*key, F.array_join(rank_tokens(F.col("text")), " ").alias("_words")).mapInArrow(lambda x: weighed(shared.value, loose, x), schema)
    zipped = F.arrays_zip(F.col("_nos").alias("_no"), F.col("_tfs").alias("_tf"))
    if sum(n.values()) == known.num_rows:
        units = rows.select(*key, "_squares", zipped.alias("_met")).repartition(*key)
    else:
        rows = cut(rows)
        rest = rows.select(*key, F.explode(F.arrays_zip("_rest", "_times")).alias("_x")).select(*key, F.col("_x._rest").alias("term"), F.col("_x._times").alias("_tf"))
        rest = rest.join(terms.where(~is_known).select(corpus, "term", "idf", "_no"), [corpus, "term"])
        more = [F.sum((F.col("_tf") * F.col("idf")) ** 2).alias("_more")] + ([F.collect_list(F.when(F.col("_no").isNotNull(), F.struct("_no", "_tf"))).alias("_far")] if loose else [])
        units = rows.select(*key, "_squares", zipped.alias("_met")).repartition(*key).join(rest.groupBy(*key).agg(*more), key, "left")
        units = units.withColumn("_squares", F.col("_squares") + F.coalesce("_more", F.lit(0.0)))
        if loose:
            units = units.withColumn("_met", F.concat("_met", F.coalesce("_far", F.array().cast(units.schema["_met"].dataType))))
    units = units.select(*key, F.sqrt("_squares").alias("_norm"), F.explode("_met").alias("_x")).select(*key, "_norm", "_x._no", "_x._tf")
    weights = asks.join(terms.where("_no IS NOT NULL").select(corpus, "term", "idf", "_no"), [corpus, "term"]).withColumn("_q", F.col("tf") * F.col("idf"))
    lengths = weights.groupBy(query).agg(F.sqrt(F.sum(F.col("_q") * F.col("_q"))).alias("_length"))
    weights = cut(weights.join(lengths, query).select("_no", query, (F.col("idf") * F.col("_q") / F.col("_length")).alias("_weight")))
    scores = units.join(few(weights, limit), "_no").groupBy(*key, query).agg(F.sum(F.col("_tf") / F.col("_norm") * F.col("_weight")).alias("score"))
    return top_k(rank_exact(scores.select(query, doc, "score"), [query], [F.col(doc)]), k)


def rank_exact(scored: DataFrame, corpus: list[str], ties: list[Column]) -> DataFrame:
    """Rank by the score before rounding (equal up to 12 digits, which sums in any order keep), then round it."""
    w = Window.partitionBy(*corpus).orderBy(F.round("score", 12).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).withColumn("score", F.round("score", 6))


def rank_rounded(scored: DataFrame, corpus: list[str], ties: list[Column]) -> DataFrame:
    """Round the score to 6 digits first, then rank."""
    w = Window.partitionBy(*corpus).orderBy(F.desc("score"), *ties)
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w))


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    """The first k of each ranking; rows without any shared term stay in."""
    return ranked.where(F.col("rank") <= k)


def perimeter_scores(queries: DataFrame, docs: DataFrame, corpus: list[str], doc_key: list[str], members: dict[str, Column]) -> DataFrame:
    """(corpus, doc_key, perimeter, score) for each document and perimeter that holds it: the scores of ``cosine_scores`` within
    each perimeter, from one pass over the documents' terms.

    members: {perimeter: condition on columns of ``docs``}, such as bounds of the session order; they may overlap in any way.
    Document frequencies of all perimeters are conditional counts of one aggregation by term, weights and norms conditional
    sums of one by document, so a document is not copied for each perimeter that it is in."""
    flag, own = {n: f"_in{i}" for i, n in enumerate(members)}, {n: i for i, n in enumerate(members)}
    d = docs.select(*corpus, *doc_key, "text", *[F.coalesce(c, F.lit(False)).alias(flag[n]) for n, c in members.items()])
    size = d.groupBy(*corpus).agg(*[F.count_if(flag[n]).alias(f"_n{i}") for n, i in own.items()])
    tf = term_counts(d, [*corpus, *doc_key, *flag.values()])
    idf = tf.groupBy(*corpus, "term").agg(*[F.count_if(flag[n]).alias(f"_df{i}") for n, i in own.items()]).join(size, corpus)
    # a word that no document of a perimeter has is no word of it
    rate = lambda i: F.when(F.col(f"_df{i}") > 0, F.log((1 + F.col(f"_n{i}")) / (1 + F.col(f"_df{i}"))) + 1).alias(f"_idf{i}")
    idf = idf.select(*corpus, "term", *[rate(i) for i in own.values()])
    asked = term_counts(queries, corpus).withColumnRenamed("tf", "_q").join(idf, [*corpus, "term"])
    length = asked.groupBy(*corpus).agg(*[F.sqrt(F.sum((F.col("_q") * F.col(f"_idf{i}")) ** 2)).alias(f"_len{i}") for i in own.values()])
    met = tf.join(idf, [*corpus, "term"]).join(asked.select(*corpus, "term", "_q"), [*corpus, "term"], "left")
    sums = []
    for i in own.values():
        w = F.col("tf") * F.col(f"_idf{i}")
        sums += [F.sum(w * F.col("_q") * F.col(f"_idf{i}")).alias(f"_dot{i}"), F.sqrt(F.sum(w * w)).alias(f"_norm{i}")]
    by_doc = met.groupBy(*corpus, *doc_key).agg(*sums)
    x = d.drop("text").join(by_doc, [*corpus, *doc_key], "left").join(length, corpus, "left")
    score = lambda i: F.coalesce(F.try_divide(F.col(f"_dot{i}"), F.col(f"_norm{i}") * F.col(f"_len{i}")), F.lit(0.0))
    each = F.explode(F.array_compact(F.array(*[F.when(F.col(flag[n]), F.struct(F.lit(n).alias("perimeter"), score(i).alias("score"))) for n, i in own.items()])))
    return x.select(*corpus, *doc_key, each.alias("_s")).select(*corpus, *doc_key, "_s.perimeter", "_s.score")
