"""Exact top-k search by inner product with multi-resolution segment statistics.

Components are quantised to integers, so scores are exact.  A vector is cut into segments, few long ones at the coarsest
resolution and more, shorter ones at finer ones; each segment has its mean and its deviation.  For a query q and a
candidate c, segments of s components bound the distance from below,

    |q - c|^2 >= sum over segments of s * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2),

and, with |q - c|^2 = |q|^2 + |c|^2 - 2 <q, c> and the norms known, the score from above by
sum of s * (mean_q * mean_c + dev_q * dev_c).  A pair whose bound is below the query's k-th best score known so far goes, from
the coarsest resolution to the finest; survivors get their exact score.  Bounds are widened by far more than their rounding, and
pairs on the bound stay, so no tie is lost.

A query's first threshold is its k-th best score among at most ``seeds`` rows, spread evenly over the table, which only
saves work: any k rows' scores are a lower bound of the k-th best.  Then queries meet all rows in tiles of a bounded number of
queries and rows; every row is numbered, and tiles take rows by number, so no key and no group of copies makes a large one.
A tile holds its queries and the best k rows of each so far, which raise the thresholds while the tile's rows go by; it
returns at most k rows a query.  The best k of those are the answer.

Rows: a vector that is null or holds null or non-finite components takes no part, nor does one whose quantised squared
norm is 2^62 or more (scores would leave the long range).  Vectors of different lengths do not meet; empty ones score 0 with
each other.  A row's own candidates are all rows of other ids; a row with a null id is a candidate, after all others among
ties, and no query.  Repeated query rows each get their list, and repeated candidate rows each a place in it.  An empty
table gives an empty result.  Only the two columns are read, so further columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 20
SCALE = 64
EVERY = 20
#: Numbers of segments, coarse to fine; a vector of fewer components uses those that are below their number.
SEGMENTS = (1, 4, 16, 32)
SEEDS = 2048
#: Rows and queries of a tile at most; a tile's rows are looked at BLOCK at a time.
TILE_ROWS = 1 << 20
TILE_QUERIES = 8192
BLOCK = 4096
#: A tile of fewer rows is not cut further to share the work.
LEAST_ROWS = 256
#: Pairs whose bounds are looked at together.
PAIRS = 1 << 20
LAST = np.iinfo(np.int64).max


def statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of ``parts`` segments of each row, times the root of a segment's length, side by side: the inner
    product of two such rows bounds that of the vectors from above."""
    edges = np.linspace(0, x.shape[1], parts + 1).astype(np.int64)
    sizes = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / sizes
    rest = x - np.repeat(mean, sizes, axis=1)
    dev = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))
    return np.concatenate([mean * np.sqrt(sizes), dev], axis=1)


class Side:
    """Vectors of one length with their statistics at all resolutions."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.f = x.astype(np.float64)
        self.norm = np.sqrt((self.f * self.f).sum(axis=1))
        self.levels = [statistics(self.f, p) for p in SEGMENTS if p < x.shape[1]]

    def take(self, at) -> Side:
        out = object.__new__(Side)
        out.ids, out.x, out.f, out.norm, out.levels = self.ids[at], self.x[at], self.f[at], self.norm[at], [s[at] for s in self.levels]
        return out


def exact(q: Side, c: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the pairs (i, j), in integers."""
    out = np.empty(len(i), np.int64)
    step = max(1, PAIRS // max(1, q.x.shape[1]))
    for s in range(0, len(i), step):
        out[s : s + step] = (q.x[i[s : s + step]] * c.x[j[s : s + step]]).sum(axis=1)
    return out


def survivors(q: Side, c: Side, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of other ids whose bounds reach least[i] at every resolution."""
    slack = 1e-9 * (q.norm[:, None] * c.norm[None, :] + 1)
    alive = q.ids[:, None] != c.ids[None, :]
    i = j = None
    for a, b in zip(q.levels, c.levels):
        if i is None:
            alive &= a @ b.T + slack >= least[:, None]
            # once few pairs are left they are followed one by one
            if np.count_nonzero(alive) * 8 < alive.size:
                i, j = np.nonzero(alive)
        elif len(i):
            keep = np.einsum("ij,ij->i", a[i], b[j]) + slack[i, j] >= least[i]
            i, j = i[keep], j[keep]
    return np.nonzero(alive) if i is None else (i, j)


def best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each query i, ties to smaller ids."""
    order = np.lexsort((ids, -score, i))
    i = i[order]
    first = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1] if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    return order[rank < k]


def search(q: Side, c: Side, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the candidate, score): at most k candidates a query, none below ``least``.  The candidates
    of the best coarse bounds come first and raise the threshold of the others."""
    found = []
    step = max(1, PAIRS // max(1, len(c.ids)))
    for s in range(0, len(q.ids), step):
        part, low = q.take(slice(s, s + step)), least[s : s + step].copy()
        if len(c.ids) > 4 * k and part.levels:
            bound = part.levels[-1] @ c.levels[-1].T
            bound[part.ids[:, None] == c.ids[None, :]] = -np.inf
            top = np.argpartition(-bound, 2 * k, axis=1)[:, : 2 * k]
            rows = np.repeat(np.arange(len(part.ids)), 2 * k)
            score = exact(part, c, rows, top.ravel())
            # rows of the query's own id raise no threshold
            score[part.ids[rows] == c.ids[top.ravel()]] = np.iinfo(np.int64).min
            low = np.maximum(low, np.sort(score.reshape(-1, 2 * k), axis=1)[:, -k])
        i, j = survivors(part, c, low.astype(np.float64))  # its rounding is far below the slack
        score = exact(part, c, i, j)
        keep = np.flatnonzero(score >= low[i])
        i, j, score = i[keep], j[keep], score[keep]
        at = best(i, c.ids[j], score, k)
        found.append((i[at] + s, j[at], score[at]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v: integers, number) of the usable vectors, written to the shared folder so that their numbers stay."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", bad))
    # floor of a double beyond the long range would not be its floor; the norm is tested in doubles first
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.pow(F.ceil(F.abs(x) * scale).cast("double"), F.lit(2.0)))
    rows = rows.where(F.forall("x", lambda x: F.abs(x) * scale < float(1 << 31)) & (square < float(1 << 62)))
    return cut(rows.select("id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"), F.monotonically_increasing_id().alias("number")))


def sides(batch: pa.RecordBatch, ids: str, vectors: str) -> Iterator[tuple[np.ndarray, Side]]:
    """The rows of a batch by vector length: their places and the side that they make."""
    v = batch.column(batch.schema.get_field_index(vectors))
    own = batch.column(batch.schema.get_field_index(ids)).fill_null(LAST).to_numpy(zero_copy_only=False)
    sizes = np.asarray(v.value_lengths())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.asarray(v.take(pa.array(at)).flatten(), np.int64).reshape(len(at), size)
        yield at, Side(own[at], x)


def thresholds(queries: DataFrame, rows: DataFrame, k: int, seeds: int) -> DataFrame:
    """Queries with ``least``: the k-th best score among at most ``seeds`` rows (nothing is missed: it bounds the k-th best of
    all from below), or the smallest long if the seeds are too few."""
    n = rows.count()
    step = max(1, math.ceil(n / seeds))
    # every step-th row; their number is bounded, so they may be gathered and sent to all tasks
    some = rows.where(F.pmod(F.xxhash64("number"), F.lit(step)) == 0).limit(2 * seeds).select("id", "v").toArrow().combine_chunks()
    known = some.to_batches()[0] if some.num_rows else None

    def run(batches):
        by_size = {s.x.shape[1]: s for _, s in sides(known, "id", "v")} if known is not None else {}
        for batch in batches:
            least = np.full(batch.num_rows, np.iinfo(np.int64).min)
            for at, q in sides(batch, "id", "v"):
                c = by_size.get(q.x.shape[1])
                if c is None or len(c.ids) < k:
                    continue
                i, _, score = search(q, c, least[at], k)
                full = np.flatnonzero(np.bincount(i, minlength=len(at)) == k)
                low = np.full(len(at), np.iinfo(np.int64).max)
                np.minimum.at(low, i, score)
                least[at[full]] = low[full]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=[*batch.schema.names, "least"])

    return queries.mapInArrow(run, "id long, v array<int>, number long, least long")


def tiles(rows: int, queries: int, cores: int) -> tuple[int, int]:
    """Slices of the rows and of the queries: two tiles a core at least, if there are rows for them."""
    across = max(1, math.ceil(queries / TILE_QUERIES))
    return max(1, math.ceil(rows / TILE_ROWS), min(math.ceil(2 * cores / across), math.ceil(rows / LEAST_ROWS))), across


class Tile:
    """The queries of a tile, with the best rows of each so far."""

    def __init__(self, number: int, k: int):
        self.number, self.k = number, k
        self.asking: dict[int, dict] = {}
        self.waiting: list[pa.RecordBatch] = []
        self.held = 0

    def ask(self, batch: pa.RecordBatch) -> None:
        number, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
        for at, side in sides(batch, "id", "v"):
            part = self.asking.setdefault(side.x.shape[1], {"ids": [], "x": [], "number": [], "least": []})
            for key, value in (("ids", side.ids), ("x", side.x), ("number", number[at]), ("least", least[at])):
                part[key].append(value)

    def meet(self, batch: pa.RecordBatch | None) -> None:
        """Take rows in, and compare them once there are BLOCK of them, or none come any more."""
        if batch is not None:
            self.waiting.append(batch)
            self.held += batch.num_rows
        if self.held >= BLOCK or (batch is None and self.held):
            rows = pa.Table.from_batches(self.waiting).combine_chunks().to_batches()[0]
            self.waiting, self.held = [], 0
            for _, side in sides(rows, "id", "v"):
                q = self.asking.get(side.x.shape[1])
                if q is None:
                    continue
                if isinstance(q["x"], list):
                    q |= {key: np.concatenate(value) for key, value in q.items()}
                    q |= {"side": Side(q["ids"], q["x"]), "i": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)}
                i, j, score = search(q["side"], side, q["least"], self.k)
                i, c, score = np.concatenate([q["i"], i]), np.concatenate([q["c"], side.ids[j]]), np.concatenate([q["score"], score])
                at = best(i, c, score, self.k)
                q |= {"i": i[at], "c": c[at], "score": score[at]}
                full = np.bincount(q["i"], minlength=len(q["least"])) == self.k
                low = np.full(len(full), np.iinfo(np.int64).max)
                np.minimum.at(low, q["i"], q["score"])
                q["least"] = np.where(full, np.maximum(q["least"], low), q["least"])

    def result(self) -> Iterator[pa.RecordBatch]:
        self.meet(None)
        for q in self.asking.values():
            if "side" in q and len(q["i"]):
                cols = [pa.array(q["number"][q["i"]]), pa.array(q["ids"][q["i"]]), pa.array(q["c"], mask=q["c"] == LAST), pa.array(q["score"])]
                yield pa.RecordBatch.from_arrays(cols, names=["number", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, seeds: int = SEEDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of floor(scale * x) of each row for which ``is_query``, a
    condition on the column ``id``, holds, with all rows of other ids."""
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = cut(thresholds(rows.where(F.coalesce(is_query, F.lit(False))), rows, k, seeds))
    down, across = tiles(rows.count(), asked.count(), vectors.sparkSession.sparkContext.defaultParallelism)
    # places of a row in its table: numbers are dealt anew, evenly
    slot = lambda m: F.pmod(F.xxhash64("number"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    c = rows.select("id", "v", "number", F.lit(None).cast("long").alias("least"), slot(down).alias("down")).withColumn("across", every(across))
    q = asked.select("id", "v", "number", "least", slot(across).alias("across")).withColumn("down", every(down))
    tile = (F.col("down") * across + F.col("across")).alias("tile")
    both = c.unionByName(q).select("id", "v", "number", "least", tile)
    # more parts than tiles, so that few tiles share a part; a tile's queries come before its rows
    both = both.repartition(4 * down * across, "tile").sortWithinPartitions("tile", F.col("least").isNull())

    def run(batches):
        now = None
        for batch in batches:
            number, is_row = np.asarray(batch.column(4)), np.asarray(batch.column(3).is_null())
            edges = np.r_[0, np.flatnonzero((number[1:] != number[:-1]) | (is_row[1:] != is_row[:-1])) + 1, len(number)].tolist()
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi == lo:
                    continue
                if now is None or now.number != number[lo]:
                    if now is not None:
                        yield from now.result()
                    now = Tile(number[lo], k)
                (now.meet if is_row[lo] else now.ask)(batch.slice(lo, hi - lo))
        if now is not None:
            yield from now.result()

    found = both.mapInArrow(run, "number long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
