"""Quality of documents by hierarchical empirical Bayes.

A logistic classifier on shape features (learned from a bounded sample of labelled documents) gives each document's
own evidence.  Hosts and paths below them pool their documents' probabilities: a host's mean is shrunk toward the
global mean, a path's toward its host's, with prior strengths estimated from the spread between groups (method of
moments), so sparse sites stay near their parents.  A document's final log odds are its own plus the difference that
its path makes, with the document itself left out of its sites' sums.

Sites are summed by grouped aggregation with a map-side part; the tables of sites are joined back to light rows
(id, site, probability), never to texts, and a site of many rows stays spread over tasks.

Rows: a null text is read as empty; texts of any length are read whole.  A null host is a host of its own, likewise a
null path of each host.  Labels are learned from as in the toxicity operator; without both classes every document has
probability 0.5.  Repeated rows count each, so there are no ties; an empty table gives an empty result.  Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, appended, column, cut, join_by_key, slices
from .toxicity import logistic, sampled_labels

PER_CLASS = 4000
MAX_PRIOR = 1e6
UPPER, DIGITS, HIGH = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256))
SYMBOLS, STOPS, MARKS, BARS = b"#*$%&<>", b".,;:", b"!?", b"|"
NAMES = ("words", "word_length", "symbols", "stops", "marks", "bars", "upper", "digits", "non_ascii", "distinct", "repeated_lines", "bare_line_ends")


def features(text: str | None) -> list[float]:
    """Shape of a text: counts as logarithms, the rest as shares."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = len(raw)
    count = lambda some: size - len(raw.translate(None, some))
    words = raw.split()
    n, dense = max(1, len(words)), max(1, size - count(ASCII_SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    return [
        np.log1p(len(words)) / 5, min(dense / n, 40) / 10, *(count(x) / dense * 5 for x in (SYMBOLS, STOPS, MARKS, BARS)),
        count(UPPER) / dense * 2, count(DIGITS) / dense * 5, (size - len(raw.translate(None, HIGH))) / max(1, size),
        len(set(words)) / n, 1 - len(set(lines)) / m, sum(x.rstrip()[-1:] not in b".!?" for x in lines) / m,
    ]


class Classifier:
    """Standardised features and logistic weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: tuple[float, float]):
        self.known = len(y) > 0 and 0 < y.mean() < 1
        if self.known:
            self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
            self.beta = logistic(self.design(x), y, np.where(y > 0, weights[1], weights[0]), ridge=1.0)

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), z, z * z])

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        if not texts or not self.known:
            return np.full(len(texts), 0.5)
        z = self.design(np.array([features(t) for t in texts])) @ self.beta
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", per_class: int = PER_CLASS) -> Classifier:
    """The classifier of at most ``per_class`` labelled documents of each class, none of them held out."""
    chosen, totals = sampled_labels(labels, label_col, per_class, "quality")
    none = Classifier(np.zeros((0, len(NAMES))), np.zeros(0), (1.0, 1.0))
    if chosen is None or len(totals) < 2:
        return none
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in slices(batches, "text"):
            yield appended(batch.select(["doc_id", "y"]), {"x": pa.array([features(t) for t in column(batch, "text")], pa.list_(pa.float64()))})

    found = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow().to_pylist()
    if not found:
        return none
    y = np.array([r["y"] for r in found], float)
    return Classifier(np.array([r["x"] for r in found]), y, tuple(totals[c] / max(1, (y == c).sum()) for c in (0, 1)))


def evidence(docs: DataFrame, model: Classifier, text_col: str = "text", out_col: str = "p_doc", keep_text: bool = True) -> DataFrame:
    """``docs`` with each text's own probability of good quality."""
    kept = [c for c in docs.columns if c.lower() != out_col.lower() and (keep_text or c != text_col)]
    read = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text_col])])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, text_col):
            yield appended(batch.select(kept), {out_col: pa.array(shared.value.probabilities(column(batch, text_col)))})

    return read.mapInArrow(run, T.StructType([f for f in read.schema if f.name in kept] + [T.StructField(out_col, T.DoubleType())]))


def site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, for use as host and path."""
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^/([^/]*)", 1)


def prior_strength(groups: DataFrame) -> DataFrame:
    """One row (mu, strength): the mean of n, s, q (rows, sums and sums of squares of p by group) and the number of
    rows that the prior counts for, from the variance between groups left after that within them."""
    g = groups.where("n > 0").select("n", "s", (F.col("s") / F.col("n")).alias("m"), F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("v"))
    one = g.agg((F.sum("s") / F.sum("n")).alias("mu"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("n") * F.col("v")).alias("vv"), F.count("*").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
    within = F.col("vv") / F.col("all")
    typical = (F.col("all") - F.col("nn") / F.col("all")) / F.greatest(F.col("k") - 1, F.lit(1))
    between = (F.col("mm") - F.col("all") * F.col("mu") * F.col("mu")) / F.greatest(F.col("k") - 1, F.lit(1))
    spread = F.greatest(F.lit(0.0), (between - within) / F.greatest(typical, F.lit(1e-9)))
    return one.select("mu", F.least(F.lit(MAX_PRIOR), F.greatest(F.lit(1.0), within / F.greatest(spread, F.lit(1e-12)))).alias("strength"))


def page_sites(pages: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(doc_id, host, path) of documents that pages show: a URL ends with its document's number.  Of several pages of a
    document the one of the smallest id counts; URLs without a number or host are left out."""
    host, path = site(F.col(url_col))
    number = F.try_to_number(F.regexp_extract(F.try_parse_url(F.col(url_col), F.lit("PATH")), r"/(\d+)(?:\.\w+)?/?$", 1), F.lit("9" * 18)).cast("long")
    found = pages.select(number.alias("doc_id"), F.col(id_col).alias("page"), host.alias("host"), path.alias("path")).where("doc_id IS NOT NULL AND host IS NOT NULL")
    return found.groupBy("doc_id").agg(F.min(F.struct("page", "host", "path")).alias("x")).select("doc_id", "x.host", "x.path")


def posteriors(rows: DataFrame) -> DataFrame:
    """(host, path, n, s, host_n, host_s, mu, k_host, k_path) for each path of ``rows`` (host, path, p_doc; no nulls)."""
    p = F.col("p_doc")
    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    k_host = prior_strength(hosts).select("mu", F.col("strength").alias("k_host"))
    k_path = prior_strength(paths).select(F.col("strength").alias("k_path"))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    out = join_by_key(paths.drop("q"), hosts, ["host"])
    return out.join(F.broadcast(k_host.join(F.broadcast(k_path))))  # one row each


def classify(docs: DataFrame, model: Classifier, text_col: str = "text", id_col: str = "doc_id", host: Column | str = "source", path: Column | str = "lang", sites: DataFrame | None = None) -> DataFrame:
    """(doc_id, p_doc, p_host, p_path, score, kept) of each row.  sites: (doc_id, host, path), one row a document, take
    the place of ``host`` and ``path`` where there is one."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    light = docs.select(F.col(id_col).alias("doc_id"), as_col(host).alias("host"), as_col(path).alias("path"), F.col(text_col).alias("text"))
    light = evidence(light, model, keep_text=False)
    if sites is not None:
        own = sites.select("doc_id", F.col("host").alias("h"), F.col("path").alias("u"))
        light = join_by_key(cut(light), own, ["doc_id"], "left")
        light = light.select("doc_id", "p_doc", F.coalesce("h", "host").alias("host"), F.when(F.col("h").isNotNull(), F.col("u")).otherwise(F.col("path")).alias("path"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  null is a name, too
    light = cut(light.select("doc_id", "p_doc", named("host").alias("host"), named("path").alias("path")))
    x = join_by_key(light, cut(posteriors(light)), ["host", "path"])
    own = F.col("p_doc")
    x = x.withColumn("p_host", (F.col("host_s") - own + F.col("k_host") * F.col("mu")) / (F.col("host_n") - 1 + F.col("k_host")))
    x = x.withColumn("p_path", (F.col("s") - own + F.col("k_path") * F.col("p_host")) / (F.col("n") - 1 + F.col("k_path")))
    odds = lambda c: F.log(F.greatest(F.lit(1e-6), c) / F.greatest(F.lit(1e-6), 1 - c))
    x = x.withColumn("score", 1 / (1 + F.exp(-(odds(own) + odds(F.col("p_path")) - odds(F.col("mu"))))))
    return x.select("doc_id", "p_doc", "p_host", "p_path", "score", (F.col("score") >= 0.5).alias("kept"))
