"""Periodic runs of words: stretches that repeat with a period, by Main and Lorentz's divide and conquer.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and at least ``min_words`` and
``min_times * q`` words that no neighbouring word extends.  Words are interned as numbers.  At the midpoint of a range, the
Z-functions of its right half and of its reversed left half, each against itself and against the whole range, tell for
every period how far the words before and after the midpoint repeat, so each period costs two sums.  A stretch that goes on
beyond the range is found whole in the smallest range around it, whose midpoint it crosses too.  Equal intervals count once,
with the smallest period.  n words take O(n log n) time.

Ranges without a repeated stretch are left out, which is exact: a run of length e and period q repeats e - q words at
distance q, two thirds of ``min_words`` at least, so somewhere in it a window of that many words equals an earlier one.  Windows
are compared by their hashes; equal windows have equal hashes, and a collision only costs time.

Rows: each row is handled by itself, so repeated rows give repeated results.  A null, empty or wordless text has no runs and
an empty collapsed text.  Texts of any length are one row's work, with memory in proportion to it.  An empty table gives an
empty result.  Further columns pass through; a column named ``runs`` or ``collapsed`` is replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, column, slices

MIN_WORDS = 24
MIN_TIMES = 3
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd number near 2^64 over the golden ratio


def z_function(s: list[int], upto: int) -> list[int]:
    """For each i < upto the length of the longest common prefix of s and s[i:]."""
    n = len(s)
    z = [0] * upto
    if upto:
        z[0] = n
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` numbers, from those of its parts, whose widths are powers of two."""
    power, wide = 1, ids.astype(np.uint64) * _MIX + np.uint64(1)
    out, done = None, 0
    while True:
        if width & power:
            part = wide[done : len(ids) - width + done + 1]
            out = part.copy() if out is None else (out * _MIX) ^ (part + (out >> np.uint64(29)))
            done += power
        if 2 * power > width:
            return out
        wide = (wide[:-power] * _MIX) ^ (wide[power:] + (wide[:-power] >> np.uint64(31)))
        power *= 2


def repeated_windows(ids: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """Starts of windows that equal an earlier one, in order, and the start of the nearest earlier one."""
    if len(ids) <= width:
        return [], []
    h = window_hashes(ids, width)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return [], []
    at, before = order[same + 1], order[same]
    place = np.argsort(at)
    return at[place].tolist(), before[place].tolist()


def crossing(w: list[int], lo: int, mid: int, hi: int, min_words: int, min_times: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs within w[lo:hi] that hold the words on both sides of ``mid`` and that no word of the
    whole text extends."""
    left, right = w[lo:mid], w[mid:hi]
    back = left[::-1]
    # a run of the range has at most this period; at least one period of it lies on one side of the midpoint
    top = (hi - lo) // min_times
    here, there = min(top, len(right) - 1), min(top, len(left))
    after = z_function(right, here + 1)  # words from mid on against words from mid + q on
    before = z_function(back, min(there + 1, len(left)))  # words up to mid - 1 against words up to mid - q - 1, backwards
    # the left half, backwards, against the words up to mid + q, backwards
    shifted = z_function([*back, -1, *w[lo : mid + here][::-1]], len(back) + 1 + here)
    # the right half against the words from mid - q on
    ahead = z_function([*right, -1, *w[mid - there : hi]], len(right) + 1 + there)
    found = []

    def keep(start: int, end: int, q: int) -> None:
        if end - start < min_words or end - start < min_times * q:
            return
        beyond = (start == lo and lo > 0 and w[lo - 1] == w[lo - 1 + q]) or (end == hi and hi < len(w) and w[hi] == w[hi - q])
        if not beyond:
            found.append((start, end, q))

    for q in range(1, here + 1):  # a period of the run lies right of the midpoint
        k = shifted[len(back) + 1 + here - q]
        if k:
            keep(mid - k, mid + q + after[q], q)
    for q in range(1, there + 1):  # a period of the run lies left of the midpoint
        k = ahead[len(right) + 1 + there - q]
        if k:
            keep(mid - q - (before[q] if q < len(before) else 0), mid + k, q)
    return found


def find_runs(w: list[int], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of interned words, by start, then period."""
    least = max(min_words, min_times)
    width = max(1, least - least // min_times)
    at, before = repeated_windows(np.asarray(w, np.int64), width)
    smallest: dict[tuple[int, int], int] = {}
    # ranges with the repeated windows (start, nearest earlier start) that lie in them
    stack = [(0, len(w), at, before)] if at else []
    while stack:
        lo, hi, at, before = stack.pop()
        mid = (lo + hi) // 2
        for start, end, q in crossing(w, lo, mid, hi, min_words, min_times):
            smallest[start, end] = min(q, smallest.get((start, end), q))
        for a, b in ((lo, mid), (mid, hi)):
            if b - a < least:
                continue
            i, j = bisect_left(at, a), bisect_right(at, b - width)
            inside = [k for k in range(i, j) if before[k] >= a]
            if inside:
                stack.append((a, b, [at[k] for k in inside], [before[k] for k in inside]))
    return sorted((s, e - s, q) for (s, e), q in smallest.items())


def intern(words: list) -> list[int]:
    known: dict = {}
    return [known.setdefault(x, len(known)) for x in words]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [x for x, g in zip(words, np.cumsum(gone)) if not g]


def periodic_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, min_times: int = MIN_TIMES, keep_text: bool = True) -> DataFrame:
    """Rows of ``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text whose runs are
    cut to their first period, its words joined by one space."""
    if min_words < 1 or min_times < 2:
        raise ValueError("a run needs a word and two periods at least")
    own = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    kept = own if keep_text else [c for c in own if c != text_col]
    # columns go by number through the workers: any name will do, dots included
    names = [f"c{k}" for k in range(len(kept))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], F.col(f"`{text_col}`").cast("string").alias("whole"))
    schema = inner.select(*names, F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema

    def run(batches):
        for batch in slices(batches, "whole"):
            runs, texts = [], []
            for text in column(batch, "whole"):
                words = text.encode("utf-8").split() if text else []
                found = find_runs(intern(words), min_words, min_times) if len(words) >= min_words else []
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapsed(words, found)).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(runs, _ARROW_RUNS), pa.array(texts, pa.string())], names=[*names, "runs", "collapsed"])

    return inner.mapInArrow(run, schema).toDF(*kept, "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period.  Null if there
    is none."""
    sides = lambda a, b: (a["length"] * b["period"], b["length"] * a["period"])

    def compare(a: Column, b: Column) -> Column:
        x, y = sides(a, b)
        earlier = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))
        return F.when(x > y, -1).when(x < y, 1).when(earlier, -1).when((a["start"] == b["start"]) & (a["period"] == b["period"]), 0).otherwise(1)

    return F.get(F.array_sort(runs, compare), F.lit(0))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of which every tenth, by a hash of its id, gets a repeated end, so that runs of known periods exist: with
    h = crc32(decimal id), g = floor(h / 10), n words, h divisible by 10 and n > 0, each word from number a = g % n on
    becomes the original word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).  A row with a null id keeps its text."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    chosen = (h % 10 == 0) & F.col(text_col).rlike(WORD)
    a = F.col("w.g") % F.col("w.n")
    p = 1 + F.floor((F.col("w.n") - a) / (3 + F.col("w.g") % 8)).cast("long")
    i = lambda x: F.when(x < a, x).otherwise(a + (x - a) % p)
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("w.n") - 1), lambda x: F.get("w.words", i(x).cast("int")))
    w = F.when(chosen, F.struct(g.alias("g"), n.alias("n"), words.alias("words")))
    text = F.when(F.col("w").isNotNull(), F.array_join(parts, " ")).otherwise(F.col(text_col))
    return docs.select(F.col(id_col), F.col(text_col), w.alias("w")).select(F.col(id_col), text.alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of rows with their runs."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("best")
    x = found.withColumn("best", strongest(F.col("runs")))
    return x.select(
        F.col(id_col), F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
