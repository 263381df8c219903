"""Language identification as inference of a mixture.

Each language has a model of letter trigrams (with word ends), learned from a bounded sample of labelled documents; a
word's likelihood in a language is the product of its trigrams'.  A document is a mixture of languages: expectation-
maximisation (EM) over its words estimates the proportions of all languages.  Then the sets of its k largest languages,
k = 1, 2 ..., are fitted again, and the set with the best likelihood less PENALTY * ln(words + 1) a further language is
selected; its largest language is predicted.  No set fits better than all languages together, so the search ends, exactly,
where even their likelihood would not pay for one more.

EM runs on whole Arrow batches of documents at once; each document stops on its own, when no share moves by TOLERANCE in a
round (or after ROUNDS), so its result doesn't hang on the others of its batch.

Size: about ``per_language`` sampled documents for each language (an expected number, by a hash threshold).  A number
for each language, and the trigram counts of the sample, reach the driver and are broadcast; every count of the sample
is kept.

Rows: null texts and texts without letters are ``und`` with score 0.  Null languages are not learned from; without any
language all rows are ``und``.  Repeated rows get equal results; ties go to the language that sorts first.  Texts are
read whole; an empty table gives an empty result; other columns pass through, but for those named like a result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, column, held_out, slices, unit_hash

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
PER_LANGUAGE = 600
SMOOTH = 0.1
PENALTY = 4.0
TOLERANCE = 1e-5
ROUNDS = 1000
#: Words whose likelihoods a worker remembers; the memory is emptied when full.
REMEMBERED = 200_000


def trigrams(word: str) -> list[str]:
    x = f"^{word}$"
    return [x[k : k + 3] for k in range(len(x) - 2)]


class LanguageModel:
    """Log likelihoods of words from trigram counts per language."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.languages = sorted({lang for lang, _ in counts})
        grams = sorted({g for _, g in counts})
        self.row = {g: k for k, g in enumerate(grams)}
        table = np.full((len(grams) + 1, max(1, len(self.languages))), SMOOTH)  # the last row: unseen trigrams
        column_of = {lang: k for k, lang in enumerate(self.languages)}
        for (lang, g), n in counts.items():
            table[self.row[g], column_of[lang]] += n
        self.table = np.log(table / table.sum(axis=0))
        self.seen: dict[str, int] = {}
        self.matrix = np.zeros((0, max(1, len(self.languages))))

    def rows(self, words: list[str]) -> np.ndarray:
        """Log likelihoods (words x languages)."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.matrix = {}, self.matrix[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.seen]
        if new:
            base, last, row = len(self.seen), len(self.row), self.row
            parts = [[row.get(g, last) for g in trigrams(w)] for w in new]
            flat = self.table[np.array([k for p in parts for k in p])]
            sums = np.add.reduceat(flat, np.cumsum([0] + [len(p) for p in parts[:-1]]))
            if base + len(new) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros((max(len(new), len(self.matrix)), sums.shape[1]))])
            self.matrix[base : base + len(new)] = sums
            self.seen.update(zip(new, range(base, base + len(new))))
        return self.matrix[[self.seen[w] for w in words]]


def mixture(like: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) and log likelihoods, by EM from equal proportions of the allowed languages.
    like: log likelihoods of each document's distinct words, which are seen n times; starts: first word of each."""
    top = np.where(allowed[doc], like, -np.inf).max(axis=1, keepdims=True)
    p = np.exp(np.minimum(like - top, 0.0)) * allowed[doc]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    live = np.arange(len(starts))  # documents that still move, and their words
    q, m, d, at, now = p, n, doc, starts, share.copy()
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(rounds):
        r = q * now[d]
        r *= (m / r.sum(axis=1))[:, None]
        new = np.add.reduceat(r, at, axis=0) / total
        moving = np.abs(new - now).max(axis=1) >= TOLERANCE
        now = new
        share[live] = now
        if not moving.any():
            break
        if not moving.all():
            words = moving[d]
            live, now, total, q, m = live[moving], now[moving], total[moving], q[words], m[words]
            sizes = np.diff(np.r_[at, len(d)])[moving]
            d, at = np.repeat(np.arange(len(live)), sizes), np.cumsum(sizes) - sizes
    fit = np.log((p * share[doc]).sum(axis=1)) + top[:, 0]
    return share, np.add.reduceat(fit * n, starts)


def infer(model: LanguageModel, texts: list[str | None], penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """(predicted language, its proportion, selected set with proportions) of each text."""
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    counts = [Counter(LETTERS.findall((t or "").lower())) for t in texts]
    # LETTERS lets number characters such as fractions into words; a text of those alone has no letter
    which = [k for k, c in enumerate(counts) if any(any(map(str.isalpha, w)) for w in c)] if model.languages else []
    if not which:
        return out
    words = [w for k in which for w in counts[k]]
    n = np.array([x for k in which for x in counts[k].values()], float)
    sizes = np.array([len(counts[k]) for k in which])
    like, m = model.rows(words), len(model.languages)

    def fitted(some: np.ndarray, allowed: np.ndarray):
        rows = np.concatenate([np.arange(e - s, e) for s, e in zip(sizes[some], np.cumsum(sizes)[some])])
        return mixture(like[rows], n[rows], np.repeat(np.arange(len(some)), sizes[some]), np.cumsum(sizes[some]) - sizes[some], allowed)

    some = np.arange(len(which))
    share, every = fitted(some, np.ones((len(which), m)))
    order = np.argsort(-share.round(9), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    cost = penalty * np.log(np.add.reduceat(n, np.cumsum(sizes) - sizes) + 1)
    final, value = np.zeros_like(share), np.full(len(which), -np.inf)
    for k in range(1, m + 1):
        some = some[every[some] - (k - 1) * cost[some] > value[some]]
        if not len(some):
            break
        s, fit = fitted(some, (place[some] < k).astype(float))
        worth = fit - (k - 1) * cost[some]
        up = worth > value[some]
        value[some[up]], final[some[up]] = worth[up], s[up]
    for k, row in zip(which, final):
        chosen = sorted(((float(x), lang) for x, lang in zip(row, model.languages) if x > 0), key=lambda c: (-round(c[0], 9), c[1]))
        out[k] = (chosen[0][1], min(1.0, chosen[0][0]), [(lang, x) for x, lang in chosen])
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Trigram counts of about ``per_language`` documents of each language, none of them held out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    n = {r["lang"]: r["count"] for r in rows.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    if not n:
        return LanguageModel({})
    rate = F.create_map(*[x for lang, c in n.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / c)))])
    rows = rows.where(unit_hash("language", F.col(id_col)) < F.element_at(rate, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def grams(batches):
        for batch in slices(batches, "text"):
            found: Counter = Counter()
            for lang, text in zip(column(batch, "lang"), column(batch, "text")):
                for w, k in Counter(LETTERS.findall(text.lower())).items():
                    for g in trigrams(w):
                        found[lang, g] += k
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    counts = rows.mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return LanguageModel({(r["lang"], r["gram"]): r["n"] for r in counts.orderBy(F.desc("n"), "lang", "gram").toArrow().to_pylist()})


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and languages (the selected set with proportions); one pass, no shuffle."""
    mix = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    results = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", mix)]
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in results} and (keep_text or c != text_col)]
    read = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text_col])])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        m = shared.value
        for batch in slices(batches, text_col, 1 << 20):
            found = infer(m, column(batch, text_col))
            more = {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())}
            yield appended(batch.select(kept), more | {"languages": pa.array([[{"lang": a, "share": b} for a, b in f[2]] for f in found], kind)})

    return read.mapInArrow(run, T.StructType([f for f in read.schema if f.name in kept] + results))
