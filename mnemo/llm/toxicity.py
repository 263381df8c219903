"""Toxicity from the nearest labelled examples.

A bounded sample of labelled documents is indexed: unit vectors (1 + ln tf, smoothed idf, and more weight the better a
word tells the classes apart by chi-square) over all words of the sample.  The index is inverted and block-max: rare
words have posting lists, common words a maximum for each block of BLOCK examples.  Blocks whose bound stays below the
k-th cosine are not opened; in the others single-precision sums, then exact cosines, decide, so the neighbours are
those of an exhaustive search.  Votes are weighted by similarity, and a logistic fit turns them into probabilities; the
neighbours are returned as evidence.  The fit is to votes out of fold: a fold's examples are scored by an index of the
others, whose words' weights know nothing of the fold's labels.

Near copies within a class (Jaccard similarity of their sets of word shingles 4/5 or more) are one example: else a much
copied text's own words would look like signs of its label.

Size: at most ``per_class`` examples of each class, so the broadcast index has the size of their texts.
Everything else is one pass over the documents, without a shuffle.

Rows: a null text is read as empty.  A text without indexed words has no neighbours and gets the calibrated score of
that case.  Null labels and ids are not learned from; of repeated label rows the largest counts; of repeated documents
the one of the least text is learned from; each row is scored, texts of any length whole.  Without any example the score
is 0.  Equal cosines are ordered by example id.  An empty table gives an empty result.  Other columns pass through; in
``score`` a result replaces an input column of its name.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, column, cut, held_out, slices, unit_hash

LETTERS = re.compile(r"[^\W\d_]+")
BLOCK = 64
NEIGHBOURS = 15
PER_CLASS = 4000
FLOOR = 0.05
CHI2 = 25.0
MARGIN = 1e-4
BATCH = 128
PRIOR = 0.5
FOLDS = 4

EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())]))


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def shingles(ws: list[str], size: int = 3) -> np.ndarray:
    """Sorted hashes of a text's different word shingles."""
    parts = {" ".join(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))}
    return np.sort(np.array([xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) for p in parts], np.uint64).view(np.int64))


def without_near_copies(marks: list[np.ndarray]) -> list[int]:
    """Places of the texts, in order, whose shingle sets have a Jaccard similarity under 4/5 to those of all kept before.

    Sets this similar share one of their rarest fifth of shingles, so only those are looked up, and each pair found is
    verified."""
    flat = np.concatenate(marks or [np.zeros(0, np.int64)])
    order = np.argsort(flat, kind="stable")
    group = np.cumsum(np.diff(flat[order], prepend=flat[order[:1]]) != 0, dtype=np.int32)
    count = np.bincount(group)
    rarity = np.empty(len(count), np.int32)
    rarity[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.int32)
    once = int((count == 1).sum())
    flat = np.empty(len(order), np.int32)
    flat[order] = rarity[group]
    del order, group, count, rarity
    ends = np.cumsum([len(m) for m in marks])
    for a, b in zip(np.r_[0, ends[:-1]], ends):
        flat[a:b].sort()
    sets = np.split(flat, ends[:-1]) if marks else []
    few = lambda x: x[: len(x) - (4 * len(x) + 4) // 5 + 1]
    rare = [r[r >= once] for r in map(few, sets)]  # the others are in one text only
    mark = np.concatenate(rare) if rare else np.zeros(0, np.int32)
    text = np.repeat(np.arange(len(rare), dtype=np.int32), [len(r) for r in rare])
    order = np.argsort(mark, kind="stable")
    mark, text = mark[order], text[order]
    kept = np.zeros(len(sets), bool)
    for e, x in enumerate(sets):
        spans = zip(np.searchsorted(mark, rare[e], "left"), np.searchsorted(mark, rare[e], "right"))
        met = np.unique(np.concatenate([text[a:b] for a, b in spans] or [np.zeros(0, np.int32)]))
        for o in met[(met < e) & kept[met]]:
            y = sets[o]
            if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 5 * both >= 4 * (len(x) + len(y) - both):
                break
        else:
            kept[e] = True
    return np.flatnonzero(kept).tolist()


class BlockMaxIndex:
    """Unit vectors of examples over all their words.  A word's weight is its idf times FLOOR + x / (x + CHI2), where x
    is its chi-square with the label: telling words count most, and all words count.

    Words of many examples have their weights by block, and the blocks' maxima; the others have posting lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, counts: Iterable[dict[str, int]], block: int = BLOCK):
        self.block, n, labels = block, len(ids), labels.astype(float)
        self.closed = [0, 0]  # blocks that were not opened, of all
        known: dict[str, int] = {}
        term, tf, size = array("i"), array("i"), array("q", [0])
        for c in counts:
            term.extend([known.setdefault(t, len(known)) for t in c])
            tf.extend(c.values())
            size.append(len(term))
        names = list(known)
        del known  # what is not needed goes at once
        term, tf, at = np.array(term), np.array(tf), np.repeat(np.arange(n, dtype=np.int32), np.diff(np.array(size)))
        df = np.bincount(term, minlength=len(names))
        with_1 = np.bincount(term, labels[at], minlength=len(names))
        # term numbers: words of many examples first
        order = sorted(range(len(names)), key=lambda k: (-df[k], names[k]))
        number = np.empty(len(names), np.int32)
        number[order] = np.arange(len(names), dtype=np.int32)
        term, df, with_1 = number[term], df[order], with_1[order]
        self.terms = {names[k]: e for e, k in enumerate(order)}
        self.idf = (np.log((1 + n) / (1 + df)) + 1) * (FLOOR + telling(df, with_1, n, labels.sum()))
        self.heads = int((df > n / 16).sum())
        weight = (1 + np.log(tf)) * self.idf[term]
        del names, order, number
        weight /= np.sqrt(np.bincount(at, weight * weight, minlength=n))[at]
        # examples of one kind, by the common word that weighs most in them, make blocks with low maxima for others
        kind = np.full(n, self.heads)
        by_weight = np.flatnonzero(term < self.heads)
        by_weight = by_weight[np.lexsort((-term[by_weight], weight[by_weight]))]
        kind[at[by_weight]] = term[by_weight]
        place = np.empty(n, np.int64)
        place[np.lexsort((ids, kind))] = np.arange(n)
        self.ids, self.labels = np.empty_like(ids), np.empty_like(labels)
        self.ids[place], self.labels[place] = ids, labels
        at = place[at].astype(np.int32)
        order = np.argsort(at.astype(np.int64) * len(self.terms) + term)
        self.term, self.tf = term[order], tf[order].astype(np.int32)
        self.starts = np.searchsorted(at[order], np.arange(n + 1))
        del order, term, weight, tf, at
        self.derive()

    def __getstate__(self) -> dict:
        """What is sent to workers: words, counts and idf; they derive weights and lists."""
        kept = ("block", "heads", "closed", "ids", "labels", "idf", "term", "tf", "starts")
        return {k: getattr(self, k) for k in kept} | {"words": "\n".join(self.terms)}

    def __setstate__(self, state: dict) -> None:
        words = state.pop("words")
        self.__dict__.update(state)
        self.terms = dict(zip(words.split("\n"), range(len(self.idf))))
        self.derive()

    def derive(self) -> None:
        """Weights, posting lists of rare words, and block-wise weights and maxima of common words."""
        n = len(self.ids)
        at = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))
        weight = (1 + np.log(self.tf)) * self.idf[self.term]
        weight /= np.sqrt(np.bincount(at, weight * weight, minlength=n))[at]
        self.weight = weight
        self.dense = np.zeros(len(self.idf))  # the query at hand
        head = self.term < self.heads
        self.first = np.arange(0, n, self.block)
        self.head = np.zeros((len(self.first), self.heads, self.block), np.float32)
        self.head[at[head] // self.block, self.term[head], at[head] % self.block] = weight[head]
        self.head_max = np.ascontiguousarray(self.head.max(axis=2).T)
        tail = np.flatnonzero(~head)[np.argsort(self.term[~head], kind="stable")]
        self.at, self.part = at[tail], weight[tail].astype(np.float32)
        self.edges = np.searchsorted(self.term[tail], np.arange(self.heads, len(self.idf) + 1))

    def counts(self, e: int) -> dict[int, int]:
        """An example's words, by number, and their counts."""
        a, b = self.starts[e], self.starts[e + 1]
        return dict(zip(self.term[a:b].tolist(), self.tf[a:b].tolist()))

    def vectors(self, first: int = 0, last: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The examples' own vectors."""
        some = self.starts[first : len(self.ids) + 1 if last is None else last + 1]
        return [(self.term[a:b].astype(np.int64), self.weight[a:b]) for a, b in zip(some[:-1], some[1:])]

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.fromiter(map(self.terms.get, counts, repeat(-1)), np.int64, len(counts))
        order = np.argsort(t)[np.count_nonzero(t < 0) :]
        t = t[order]
        w = (1 + np.log(np.fromiter(counts.values(), float, len(counts))[order])) * self.idf[t]
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def rare_parts(self, queries: list[tuple[np.ndarray, np.ndarray]], out: np.ndarray) -> np.ndarray:
        """Adds the parts of the queries' cosines that words with posting lists have, to single precision."""
        for row, (t, w) in zip(out, queries):
            h = np.searchsorted(t, self.heads)
            a = self.edges[t[h:] - self.heads]
            size = self.edges[t[h:] - self.heads + 1] - a
            take = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            row += np.bincount(self.at[take], self.part[take] * np.repeat(w[h:], size), minlength=len(self.ids))
        return out

    def cosines(self, t: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact cosines of a query and some examples."""
        self.dense[t] = w
        size = self.starts[at + 1] - self.starts[at]
        take = np.repeat(self.starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out = np.bincount(np.repeat(np.arange(len(at)), size), self.dense[self.term[take]] * self.weight[take], minlength=len(at))
        self.dense[t] = 0
        return out

    def opened(self, sums: np.ndarray, q: np.ndarray, which: np.ndarray) -> None:
        """Adds the common words' part to the sums of the (query, block) pairs in ``which``, a block at a time."""
        for block in np.flatnonzero(which.any(axis=0)):
            rows, first = np.flatnonzero(which[:, block]), self.first[block]
            size = min(self.block, len(self.ids) - first)
            sums[rows, first : first + size] += (q[rows] @ self.head[block])[:, :size]

    def nearest_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: Iterable[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of largest positive cosine (ties: smaller id first), leaving one out if wanted.

        A block's bound is the largest part that rare words have in it, plus the product with its maxima of common
        words.  The block of the largest bound is opened first; its k-th cosine is one that the others' bounds must
        reach, or they stay closed.  Sums are in single precision; examples within MARGIN of the k-th get exact cosines."""
        q = np.zeros((len(queries), self.heads), np.float32)
        for row, (t, w) in zip(q, queries):
            h = np.searchsorted(t, self.heads)
            row[t[:h]] = w[:h]
        sums = self.rare_parts(queries, np.zeros((len(queries), len(self.ids)), np.float32))
        bounds = np.maximum.reduceat(sums, self.first, axis=1) + q @ self.head_max
        every, skip = np.arange(len(queries)), np.arange(len(queries)) if without is not None else np.zeros(0, np.int64)
        out = list(without) if without is not None else []
        best = np.zeros(bounds.shape, bool)
        best[every, bounds.argmax(axis=1)] = True
        self.opened(sums, q, best)
        sums[skip, out] = -1
        full = self.block * bounds.argmax(axis=1)
        k_th = lambda row: np.partition(row, -k)[-k] if len(row) >= k else -1.0
        least = np.array([k_th(row[f : f + self.block]) for row, f in zip(sums, full)])
        more = (bounds >= least[:, None] - MARGIN) & (bounds >= MARGIN) & ~best
        self.opened(sums, q, more)
        sums[skip, out] = -1
        self.closed = [self.closed[0] + int((~(more | best)).sum()), self.closed[1] + more.size]
        open_, found = np.repeat(more | best, np.diff(np.r_[self.first, len(self.ids)]), axis=1), []
        for row, o, (t, w), lower in zip(sums, open_, queries, least):
            at = np.flatnonzero(o & (row > max(0, lower - 2 * MARGIN)))
            at = at[row[at] > k_th(row[at]) - 2 * MARGIN] if len(at) > k else at
            s = self.cosines(t, w, at)
            rank = np.lexsort((self.ids[at], -s.round(12)))[:k]
            rank = rank[s[rank] > 0]
            found.append((at[rank], s[rank]))
        return found

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_all([(t, w)], k)[0]


def telling(df: np.ndarray, with_1: np.ndarray, n: int, n1: float) -> np.ndarray:
    """x / (x + CHI2) of each word's chi-square x with the label."""
    sides = df * (n - df) * n1 * (n - n1)
    x = n * (with_1 * (n - n1) - (df - with_1) * n1) ** 2 / np.where(sides > 0, sides, np.inf)
    return x / (x + CHI2)


class Model:
    """Scores from an index: weighted votes, then a logistic calibration on three features of them."""

    def __init__(self, index: BlockMaxIndex | None, rate: float, class_weights: tuple[float, float] = (1.0, 1.0), k: int = NEIGHBOURS):
        self.index, self.rate, self.k = index, min(max(rate, 1e-4), 1 - 1e-4), k
        self.class_weights = class_weights
        self.beta = np.zeros(4)
        if index is not None:
            x, y = self.out_of_fold(), index.labels
            self.beta = logistic(x, y, np.where(y > 0, class_weights[1], class_weights[0]))

    def out_of_fold(self) -> np.ndarray:
        """Features of the examples, each by an index of the other folds' examples."""
        whole, out = self.index, np.zeros((len(self.index.ids), 4))
        fold = np.array([zlib.crc32(str(i).encode()) // 5 % FOLDS for i in whole.ids.tolist()])
        for f in range(FOLDS):
            inside, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(own):
                continue
            if not len(inside):
                out[own] = self.features(np.zeros(0), np.zeros(0))
                continue
            others = BlockMaxIndex(whole.ids[inside], whole.labels[inside], (whole.counts(e) for e in inside), whole.block)
            for s in range(0, len(own), BATCH):
                some = own[s : s + BATCH]
                found = others.nearest_all([others.vector(whole.counts(e)) for e in some], self.k)
                out[some] = [self.features(others.labels[at], cosines) for at, cosines in found]
        return out

    def features(self, y: np.ndarray, cosines: np.ndarray) -> list[float]:
        """Log odds of the neighbours' smoothed vote, the best cosine, and whether there is a neighbour at all."""
        if not len(y):
            return [1.0, math.log(self.rate / (1 - self.rate)), 0.0, 0.0]
        w = cosines**2 * np.where(y > 0, self.class_weights[1], self.class_weights[0]) / max(self.class_weights)
        vote = ((w * y).sum() + PRIOR * self.rate) / (w.sum() + PRIOR)
        return [1.0, math.log(vote / (1 - vote)), cosines[0], 1.0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        if self.index is None:
            return [(0.0, np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        out = []
        for start in range(0, len(texts), BATCH):
            queries = [self.index.vector(Counter(words(t))) for t in texts[start : start + BATCH]]
            for at, cosines in self.index.nearest_all(queries, self.k):
                z = float(np.dot(self.beta, self.features(self.index.labels[at], cosines)))
                out.append((1 / (1 + math.exp(-min(max(z, -30), 30))), at, cosines))
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the first column is the intercept."""
    beta, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + keep, x.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sampled_labels(labels: DataFrame, label_col: str, per_class: int, salt: str) -> tuple[DataFrame | None, dict[int, float]]:
    """At most ``per_class`` (doc_id, y) of each class 0 and 1, the first by a hash of the id, none of them held out;
    and the number of labelled rows of each class."""
    y = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    parts = [y.where(F.col("y") == c).orderBy(unit_hash(salt, F.col("doc_id")), "doc_id").limit(per_class) for c in n]
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.union(p)
    return out, n


class Packed:
    """A fitted model as bytes; its attributes load it.  A driver that only passes it on never does."""

    def __init__(self, raw: bytes):
        self.raw, self._model = raw, None

    def __getstate__(self) -> dict:
        return {"raw": self.raw, "_model": None}

    def load(self) -> Model:
        if self._model is None:
            self._model = pickle.loads(self.raw)
        return self._model

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.load(), name)


def learned(rows: pa.Table, totals: dict[int, int]) -> Model:
    """The model of sampled documents (doc_id, y, terms, ns, marks; ids differ); totals: labelled rows of each class."""
    rows, ys = rows.sort_by("doc_id"), {}
    for y in (0, 1):
        own = rows.filter(pc.equal(rows.column("y"), y)).select(["doc_id", "marks"])
        ids = own.column("doc_id").to_pylist()
        ys |= {ids[k]: y for k in without_near_copies([m.values.to_numpy() for m in own.column("marks")])}
    n1 = sum(ys.values())
    n0 = len(ys) - n1
    if not n0 or not n1:
        return Model(None, 0.0)
    rows = rows.select(["doc_id", "terms", "ns"])
    rows = rows.filter(pc.is_in(rows.column("doc_id"), pa.array(list(ys), pa.int64())))
    counts = (dict(zip(t.as_py(), n.as_py())) for t, n in zip(rows.column("terms"), rows.column("ns")))
    ids = sorted(ys)
    index = BlockMaxIndex(np.array(ids, np.int64), np.array([ys[i] for i in ids]), counts)
    # an example weighs as many labelled rows as it stands for
    return Model(index, totals[1] / (totals[0] + totals[1]), (totals[0] / n0, totals[1] / n1))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS) -> Packed:
    """The model of a bounded sample of the labelled rows that are not held out.  One task learns it, of ``per_class``
    documents a class at most; the driver sees its bytes."""
    none = Packed(pickle.dumps(Model(None, 0.0)))
    chosen, totals = sampled_labels(labels, label_col, per_class, "toxicity")
    if chosen is None or len(totals) < 2:
        return none
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def terms(batches):
        for batch in slices(batches, "text"):
            found = [(w, Counter(w)) for w in map(words, column(batch, "text"))]
            marks = pa.array([shingles(w) for w, _ in found], pa.list_(pa.int64()))
            more = {"terms": pa.array([list(c) for _, c in found], pa.list_(pa.string())), "ns": pa.array([list(c.values()) for _, c in found], pa.list_(pa.int32())), "marks": marks}
            yield appended(batch.select(["doc_id", "y"]), more)

    def learn(batches):
        if some := list(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learned(pa.Table.from_batches(some), totals))], pa.binary())], ["model"])

    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    read = cut(rows.mapInArrow(terms, "doc_id long, y int, terms array<string>, ns array<int>, marks array<long>"))
    made = read.coalesce(1).mapInArrow(learn, "model binary").collect()
    return Packed(bytes(made[0]["model"])) if made else none


def score(docs: DataFrame, model: Model | Packed, text_col: str = "text", keep_text: bool = True, prefix: str = "") -> DataFrame:
    """``docs`` with columns score, predicted and evidence (named with ``prefix``); a result replaces an input column
    of its name."""
    results = [T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "predicted", T.IntegerType()), T.StructField(prefix + "evidence", EVIDENCE)]
    taken = {f.name.lower() for f in results}
    kept = [c for c in docs.columns if c.lower() not in taken and (keep_text or c != text_col)]
    read = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text_col])])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def run(batches):
        m = shared.value
        m = m.load() if isinstance(m, Packed) else m
        for batch in slices(batches, text_col):
            found = m.scores(column(batch, text_col))
            p = np.array([f[0] for f in found])
            why = [[{"doc_id": int(m.index.ids[e]), "cosine": float(c)} for e, c in zip(at[:5], cos[:5])] for _, at, cos in found]
            yield appended(batch.select(kept), {results[0].name: pa.array(p), results[1].name: pa.array((p >= 0.5).astype(np.int32)), results[2].name: pa.array(why, kind)})

    return read.mapInArrow(run, T.StructType([f for f in read.schema if f.name in kept] + results))


def filtered(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    prefix = "tox_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    scored = score(docs, fit(docs, labels, text_col, id_col), text_col, prefix=prefix)
    return scored.where(F.col(prefix + "predicted") == 0).select(*[f"`{c}`" for c in docs.columns])
