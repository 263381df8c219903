"""Quality rules on repetition, from a suffix array of each text's words.

Suffixes are ranked by prefix doubling, on whole batches of texts at once (a text's word ids are its own, so suffixes
of two texts never compare equal).  Neighbouring suffixes' longest common prefixes (LCP) give the LCP intervals: the
deepest interval of a suffix has the larger of its two LCP values, and its occurrences are a repeated substring that
cannot be extended to the right; those that can be extended to the left lie within the span of one that cannot.  So
the union of these spans is that of all maximal repeated substrings.

The base rules judge 5-word windows.  The method's own rules judge long repeats: MIN_REPEAT words or more in more than
MAX_COVERED of the word bytes, or one repeat of more than MAX_LONGEST words, reject a text that the base rules let pass.

Memory: LCP values come from the ranks of all doubling steps, or, for a single text of more than LINEAR words, from a
scan in text order (Kasai et al., 2001) that needs no more than the array; both give the same values.

Rows: a null text has no words.  A text without words, or with fewer than MIN_WORDS, fails.  Repeated rows are
judged each on its own, so there are no ties.  Texts of any length are read whole.  An empty table gives an empty result.
Other columns pass through; in ``annotate`` a result column replaces an input column of its name, in ``filtered`` all
input columns keep their values.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, appended, column, private, slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_REPEAT = 13
MAX_COVERED = 0.1
MAX_LONGEST = 50
LINEAR = 2_000_000
CHUNK = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")

RESULTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("covered_fraction", T.DoubleType()), T.StructField("longest_repeat", T.LongType())]
)


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a megabyte at a time: a very long text's words never exist all at once."""
    start = 0
    while len(raw) - start > CHUNK and (gap := SPACE.search(raw, start + CHUNK)):
        yield raw[start : gap.start()].split()
        start = gap.end()
    yield raw[start:].split()


def suffix_array(ids: np.ndarray, ends: np.ndarray, keep: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes, and of their prefixes of 1, 2, 4 ... words if ``keep``.  ids: word ids from 0, disjoint
    between texts; ends: the end of each position's text."""
    n = len(ids)
    kind = np.int32 if n < 1 << 31 else np.int64
    counts = np.bincount(ids)
    rank = (np.cumsum(counts) - counts)[ids].astype(kind)  # a class's rank is the place of its first suffix in the array
    levels, k = [rank] if keep else [], 1
    alive = np.flatnonzero(counts[ids] > 1)
    while len(alive):
        nxt = alive + k
        second = np.where(nxt < ends[alive], rank[np.minimum(nxt, n - 1)] + np.int64(1), 0)
        first = rank[alive].astype(np.int64)
        order = np.lexsort((second, first)) if n > 3_000_000_000 else np.argsort(first * (n + 2) + second, kind="stable")
        first, second, alive = first[order], second[order], alive[order]
        spot = np.arange(len(alive))
        new_class = np.r_[True, first[1:] != first[:-1]]
        new_group = new_class | np.r_[True, second[1:] != second[:-1]]
        class_start = np.maximum.accumulate(np.where(new_class, spot, 0))
        group_start = np.maximum.accumulate(np.where(new_group, spot, 0))
        rank = rank.copy() if keep else rank
        rank[alive] = first + group_start - class_start
        if keep:
            levels.append(rank)
        sizes = np.diff(np.r_[np.flatnonzero(new_group), len(alive)])
        alive = alive[np.repeat(sizes, sizes) > 1]
        k *= 2
    return rank, levels


def lcp_by_levels(ids: np.ndarray, ends: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix and the next in ``order``."""
    n, a, b = len(ids), order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    todo = np.flatnonzero(ids[a] == ids[b])
    for h in range(len(levels) - 1, -1, -1):
        x, y = a[todo] + lcp[todo], b[todo] + lcp[todo]
        inside = (x < ends[a[todo]]) & (y < ends[b[todo]])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        lcp[todo[inside & (levels[h][x] == levels[h][y])]] += 1 << h
    return lcp


def lcp_in_text_order(ids: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The same, with one pass over the positions: a suffix shares at most one word less than the one before it."""
    n, h = len(ids), 0
    lcp = np.zeros(max(n - 1, 0), np.int64)
    word, end, at, place, out = (memoryview(np.ascontiguousarray(x)) for x in (ids, ends, order, rank, lcp))
    for i in range(n):
        r = place[i]
        if r == n - 1:
            h = 0
            continue
        j = at[r + 1]
        most = min(end[i] - i, end[j] - j)
        h = min(h, most)
        while h < most and word[i + h] == word[j + h]:
            h += 1
        out[r] = h
        h = max(0, h - 1)
    return lcp


def suffix_lcp(ids: np.ndarray, ends: np.ndarray, linear: int = LINEAR) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and elsewhere in its text: the larger
    LCP of its suffix with the neighbours in the suffix array."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    rank, levels = suffix_array(ids, ends, n <= linear)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = lcp_by_levels(ids, ends, order, levels) if levels else lcp_in_text_order(ids, ends, order, rank)
    longest = np.zeros(n, np.int64)
    longest[order[1:]] = lcp
    longest[order[:-1]] = np.maximum(longest[order[:-1]], lcp)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def profile(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The base counts of each text, the share of its word bytes in repeats of ``min_repeat`` words or more, and its
    longest repeat of WINDOW words or more, in words."""
    m = len(texts)
    out = {n: np.zeros(m, np.int64) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")}
    out["covered_fraction"] = np.zeros(m)
    ids, sizes = array("q"), array("q")
    used = 0  # word ids given to earlier texts
    for t, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        out["word_chars"][t] = len(text or "") - (len(raw) - len(raw.translate(None, ASCII_SPACE)))
        out["n_symbols"][t] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out["n_dup_lines"][t] = len(lines) - len(set(lines))
        own: dict[bytes, int] = {}
        was = len(ids)
        for some in words_of(raw):
            ids.extend([used + own.setdefault(w, len(own)) for w in some])
            sizes.extend(map(len, some))
        out["n_words"][t] = len(ids) - was
        used += len(own)
    count = out["n_words"]
    n = int(count.sum())
    if n:
        ends = np.repeat(np.cumsum(count), count)
        longest = suffix_lcp(np.array(ids, np.int64), ends)
        weight = np.array(sizes, np.int64)
        doc = np.repeat(np.arange(m), count)
        at = np.flatnonzero(longest >= WINDOW)
        windows = covered(at, np.full(len(at), WINDOW), n)
        out["n_repeat_words"] = np.bincount(doc[windows], minlength=m)
        at = np.flatnonzero(longest >= min_repeat)
        spans = covered(at, longest[at], n)
        share = np.bincount(doc, np.where(spans, weight, 0), minlength=m), np.bincount(doc, weight, minlength=m)
        out["covered_fraction"] = share[0] / np.maximum(share[1], 1)
        at = np.flatnonzero(longest >= WINDOW)
        np.maximum.at(out["longest_repeat"], doc[at], longest[at])
    return out


def annotate(docs: DataFrame, text_col: str = "text", keep_text: bool = True, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """``docs`` with the columns of RESULTS; one pass, no shuffle."""
    taken = {f.name for f in RESULTS}
    kept = [c for c in docs.columns if c.lower() not in taken and (keep_text or c != text_col)]
    read = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text_col])])
    schema = T.StructType([f for f in read.schema if f.name in kept] + list(RESULTS))

    def run(batches):
        for batch in slices(batches, text_col, 2 << 20):
            x = judged(column(batch, text_col), min_repeat, max_covered, max_longest)
            yield appended(batch.select(kept), {f.name: pa.array(x[f.name]) for f in RESULTS})

    return read.mapInArrow(run, schema)


def judged(texts: list[str | None], min_repeat: int, max_covered: float, max_longest: int) -> dict[str, np.ndarray]:
    """``profile`` with the verdicts base_failed and kept."""
    x = profile(texts, min_repeat)
    x["base_failed"] = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
    x["kept"] = ~x["base_failed"] & (x["covered_fraction"] <= max_covered) & (x["longest_repeat"] <= max_longest)
    return x


def filtered(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever their names."""
    verdict = private(docs, "kept")["kept"]
    schema = T.StructType([*docs.schema, T.StructField(verdict, T.BooleanType())])

    def run(batches):
        for batch in slices(batches, text_col, 2 << 20):
            yield appended(batch, {verdict: pa.array(judged(column(batch, text_col), min_repeat, max_covered, max_longest)["kept"])})

    return docs.mapInArrow(run, schema).where(F.col(verdict)).drop(verdict)
