"""Centroid clustering with Elkan's bounds (Elkan, "Using the triangle inequality to accelerate k-means", 2003), exact in
integers.

Every vector keeps its cluster, an upper bound of the distance to its own centroid and a lower bound of that to each of the k
centroids.  When centroids move, bounds move by as much.  A centroid's distance is taken only if neither its lower bound nor
half the distance between it and the vector's own centroid exceeds the upper bound.  Squared distances are exact integers;
roots and sums are rounded so that bounds stay bounds, and a centroid is skipped only if it is farther for certain, so ties
are seen, and go to the smaller number.

Each round reads the vectors with their bounds from the shared folder and writes them there with new ones, without a
shuffle; then only vectors that changed their cluster are summed, by cluster, within their tasks first.  The driver sees k
centroids and at most 2 k sums a task; k is a parameter.  A lost executor's tasks are repeated from the last round's table, and a
round's table goes when the next but one is written.

Rows: vectors that are null, of another length than ``size``, with null or non-finite components, or with a component of
2^27 or more after scaling (squared distances would leave the long range), are left out.  Repeated rows are vectors of their
own.  The first centroids are the vectors of smallest hash; of rows with one id the smallest vector comes first, rows with a
null id come last.  With fewer vectors than k there are as many centroids as vectors; an empty table gives an empty result.
Only the two columns are read, so further columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_folder, cut

K = 8
ROUNDS = 10
SCALE = 1024
SIZE = 64
STATE = "vec_id bigint, v array<int>, cluster int, was int, upper double, lower array<double>"


def root_up(d: np.ndarray) -> np.ndarray:
    """Not less than the root of integers."""
    return np.nextafter(np.sqrt(np.nextafter(d.astype(np.float64), np.inf)), np.inf)


def root_down(d: np.ndarray) -> np.ndarray:
    """Not more than the root of integers."""
    return np.maximum(np.nextafter(np.sqrt(np.maximum(np.nextafter(d.astype(np.float64), -np.inf), 0)), -np.inf), 0)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=-1)


class Bounds:
    """Elkan's state of some vectors against centroids: cluster, upper bound, k lower bounds."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.cluster, self.upper, self.lower = cluster, upper, lower
        self.taken = 0

    @classmethod
    def unknown(cls, n: int, k: int) -> Bounds:
        return cls(np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k)))

    def move(self, shift: np.ndarray) -> None:
        """Centroids moved by at most ``shift``."""
        self.upper = np.nextafter(self.upper + shift[self.cluster], np.inf)
        self.lower = np.maximum(np.nextafter(self.lower - shift[None, :], -np.inf), 0)

    def assign(self, x: np.ndarray, c: np.ndarray) -> None:
        """Nearest centroid of each vector, ties to the smaller number."""
        k = len(c)
        half = root_down(squares(c[:, None, :], c[None, :, :])) / 2
        others = half + np.where(np.eye(k, dtype=bool), np.inf, 0)
        # a vector nearer to its centroid than half the way to any other needs nothing
        rows = np.flatnonzero(self.upper >= others.min(axis=1, initial=np.inf)[self.cluster])
        some = (self.upper[rows, None] >= np.maximum(self.lower[rows], others[self.cluster[rows]])).any(axis=1)
        rows = rows[some]
        if not len(rows):
            return
        x, a = x[rows], self.cluster[rows]
        d = squares(x, c[a])
        self.taken += len(rows)
        upper, lower = root_up(d), self.lower[rows]
        lower[np.arange(len(rows)), a] = root_down(d)
        for j in range(k):
            at = np.flatnonzero((a != j) & (upper >= lower[:, j]) & (upper >= half[a, j]))
            if not len(at):
                continue
            new = squares(x[at], c[j])
            self.taken += len(at)
            lower[at, j] = root_down(new)
            nearer = (new < d[at]) | ((new == d[at]) & (j < a[at]))
            at, new = at[nearer], new[nearer]
            a[at], d[at], upper[at] = j, new, root_up(new)
        self.cluster[rows], self.upper[rows], self.lower[rows] = a, upper, lower


def matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), np.int64).reshape(len(lists), -1)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    x = F.col(f"`{vector_col}`").cast("array<double>")
    bad = lambda y: y.isNull() | F.isnan(y) | (F.abs(y) * scale >= float(1 << 27))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == size) & ~F.exists("x", bad))
    return rows.select("vec_id", F.transform("x", lambda y: F.floor(y * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of ``seed`` and id."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = rows.orderBy(by.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in top], np.int64)


def moved_centroids(c: np.ndarray, sums: list[list[int]], counts: list[int]) -> np.ndarray:
    """Exact floors of the means; a centroid without vectors stays."""
    return np.array([[s // n for s in row] if n else own.tolist() for own, row, n in zip(c, sums, counts)], np.int64)


def add_changes(table: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Bring sums and counts of the clusters up to date with the vectors of ``table`` that changed theirs."""
    k, width = len(sums), len(sums[0])

    def run(batches):
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                new, old, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), matrix(batch.column(2))
                for j in range(k):
                    come, gone = new == j, old == j
                    total[j] += x[come].sum(axis=0) - x[gone].sum(axis=0)
                    n[j] += come.sum() - gone.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(list(total), pa.list_(pa.int64()))], names=["j", "n", "s"])

    parts = table.where("cluster <> was").select("cluster", "was", "v").mapInArrow(run, "j long, n long, s array<long>")
    long = parts.select("j", "n", F.posexplode("s").alias("i", "x")).groupBy("j", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    for r in long.collect():  # k times the components of a vector
        sums[r.j][r.i] += int(r.x)
        if r.i == 0:
            counts[r.j] += r.n


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = "3") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of the usable vectors after ``rounds`` rounds and a last assignment, and the centroids."""
    spark = vectors.sparkSession
    rows = cut(prepared(vectors, id_col, vector_col, size, scale))
    c = first_centroids(rows, k, seed)
    if not len(c):
        return rows.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c
    k = len(c)
    folder = f"{checkpoint_folder(spark)}/elkan-{uuid.uuid4().hex}"

    def step(c: np.ndarray, shift: np.ndarray | None):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(1))
                if shift is None:
                    state, was = Bounds.unknown(len(x), k), np.full(len(x), -1)
                else:
                    was = np.asarray(batch.column(2), np.int64)
                    state = Bounds(was.copy(), np.array(batch.column(3)), np.array(batch.column(4).flatten()).reshape(-1, k))
                    state.move(shift)
                state.assign(x, c)
                lower = pa.ListArray.from_arrays(np.arange(0, k * len(x) + 1, k, dtype=np.int32), pa.array(state.lower.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(state.cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(state.upper), lower], names=["vec_id", "v", "cluster", "was", "upper", "lower"])

        return run

    def last(c: np.ndarray, shift: np.ndarray | None):
        advance = step(c, shift)

        def run(batches):
            for batch in advance(batches):
                x, a = matrix(batch.column(1)), np.asarray(batch.column(2))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(squares(x, c[a]))], names=["vec_id", "v", "cluster", "distance"])

        return run

    sums, counts, shift, table = [[0] * size for _ in range(k)], [0] * k, None, rows
    held: list[str] = []
    try:
        for r in range(rounds):
            held.append(f"{folder}/{r}")
            table.mapInArrow(step(c, shift), STATE).write.parquet(held[-1])
            table = spark.read.schema(STATE).parquet(held[-1])
            add_changes(table, sums, counts)
            new = moved_centroids(c, sums, counts)
            shift, c = root_up(squares(new, c)), new
            table = table.select("vec_id", "v", "cluster", "upper", "lower")
            if r:
                remove(spark, held[-2])
        return cut(table.mapInArrow(last(c, shift), "vec_id long, v array<int>, cluster int, distance long")), c
    finally:
        remove(spark, folder)


def remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def summary(found: DataFrame, c: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of clustered vectors."""
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    totals = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows

    def by_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

    per = [totals.get(j, 0) for j in range(len(c))]
    return found.select("vec_id", "cluster", "distance", by_cluster(per, "long").alias("cluster_inertia"), F.lit(sum(per)).cast("long").alias("inertia"), by_cluster(digest, "string").alias("centroid_sha256"))


def oracle_sql(k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = "3") -> str:
    """The same rows in DuckDB's SQL, all distances taken: a table expression a round."""
    ctes = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {size} AND list_count(embedding) = {size} AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)"""]
    ctes.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}))")
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(j, (d, j)) AS cluster, min(d) AS distance FROM
    (SELECT vec_id, v, j, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{r}) GROUP BY vec_id, v)""")
        if r < rounds:
            ctes.append(f"""m{r} AS MATERIALIZED (SELECT cluster, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM
    (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster),
  c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON m.cluster = o.j)""")
    return "WITH " + ",\n  ".join(ctes) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON j = cluster"""  # fmt: skip


ORACLE_SQL = oracle_sql()
