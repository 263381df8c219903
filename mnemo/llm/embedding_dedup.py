"""Near-duplicate vectors: random-hyperplane signatures in several tables, exact cosines, connected components.

Two vectors are compared if they have one label and share a bucket (the signs of ``bits`` random projections) in one of
``tables`` tables.  bits grows with the logarithm of the table's rows, so buckets of unlike vectors stay small; tables
follows from it such that a pair at the threshold is missed with probability MISS at most.  A pair is counted in the
first table where it meets, so each link counts once.

Copies of one vector are one class with a multiplicity: they never expand into pairs.  Buckets above ``tile`` vectors
are cut into slices and compared as tiles (slice pairs), so no task holds a large bucket; the number of slices grows
with the square root of the bucket, and so do the copies of a vector that are shuffled.  A tile emits each class's
number of links and a forest of its links, never all pairs.  Counting the links of a crowd of m different near
copies still takes m * m / 2 cosines, spread over tiles: the contract's counts ask for no less in general.

Before vectors move, a pass over the buckets with 128 further sign bits a vector leaves out those that resemble no other
of their bucket (a pair at the threshold is lost with probability 1e-9 at most).  The rest are
shuffled in the precision they come in; cosines are taken in double precision.

Rows: a vector that is null, empty, zero or has null or non-finite components, or whose label is null, links with
nothing.  Vectors of different lengths do not link.  A null id takes part; a component's id is the smallest non-null
one (null if none) and a row with a null id is not kept.  Repeated rows are copies; those with the component's smallest
id are all kept (the contract's rule).  An empty table gives an empty result.  Only the three columns are read, so
further columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_by_key
from .components import components
from .simhash import unite

THRESHOLD = 0.98
MISS = 1e-6
#: A crowd of n vectors is cut into sqrt(n / TILE) slices, of MOST vectors at most: each vector then goes to as many
#: tiles as there are slices.  A tile's vectors are held whole (two slices of MOST vectors of 64 components take 70 MB in
#: double precision) and compared PAIRS at a time.
TILE = 128
MOST = 65_536
PAIRS = 1 << 21
SEED = 20240607
#: Words of 64 sign bits in a sketch, which tells unlike vectors of a bucket apart without their components.
SKETCH = 2
SKETCHES = [f"s{k}" for k in range(SKETCH)]


def plan(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a signature and number of tables for a number of vectors."""
    bits = max(8, math.ceil(math.log2(max(2, rows / 64))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


_planes: dict[tuple[int, int, int], np.ndarray] = {}


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Codes (vectors x tables) of a matrix of vectors."""
    key = (x.shape[1], bits, tables)
    if key not in _planes:
        _planes.clear()
        _planes[key] = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    signs = (x @ _planes[key] > 0).reshape(len(x), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)


def sketches(x: np.ndarray) -> np.ndarray:
    """Further sign bits (vectors x SKETCH, uint64), of planes that no table uses."""
    planes = np.random.default_rng([SEED, 1, x.shape[1]]).standard_normal((x.shape[1], 64 * SKETCH))
    return np.packbits(x @ planes > 0, axis=1).view("<u8")


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length from a list column, each scaled by a power of two so that its largest component is near 1:
    that changes no cosine, and squares neither overflow nor vanish."""
    v = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def compare(a: dict, b: dict | None, threshold: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links within a bucket slice (b None) or between two: (classes, links counted), and (class, class) edges.
    A slice: cid, m (multiplicity), x (unit vectors), codes, table."""
    right = a if b is None else b
    n = len(a["cid"])
    offset = 0 if b is None else n
    counts = np.zeros(n if b is None else n + len(right["cid"]), np.int64)
    labels = np.arange(len(counts))
    t = a["table"]
    step = max(1, PAIRS // max(1, len(right["cid"])))
    for s in range(0, n, step):
        near = a["x"][s : s + step] @ right["x"].T >= threshold
        if b is None:
            near &= np.arange(s, min(s + step, n))[:, None] < np.arange(n)[None, :]
        i, j = np.nonzero(near)
        i += s
        if t and len(i):
            first = ~(a["codes"][i, :t] == right["codes"][j, :t]).any(axis=1)
            i, j = i[first], j[first]
        if len(i):
            np.add.at(counts, i, right["m"][j])
            np.add.at(counts, j + offset, a["m"][i])
            unite(labels, i, j + offset)
    cid = a["cid"] if b is None else np.concatenate([a["cid"], right["cid"]])
    hit, moved = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(labels)))
    return [cid[hit], counts[hit]], [cid[moved], cid[labels[moved]]]


def sketch_limit(threshold: float, bits: int = 64 * SKETCH, miss: float = 1e-9) -> int:
    """Most differing bits of two sketches that count as possibly linked: a pair at the threshold differs in more with
    probability ``miss`` at most."""
    p, below = math.acos(min(1.0, threshold)) / math.pi, 0.0
    for k in range(bits):
        below += math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if 1 - below <= miss:
            return k
    return bits


def partnered(a: np.ndarray, b: np.ndarray | None, limit: int) -> np.ndarray:
    """Which rows of a, or of a then b, have a row of the other side (b None: another row of a) whose sketch differs
    in at most ``limit`` bits.  a, b: uint64 rows x SKETCH."""
    right = a if b is None else b
    rows, columns = np.zeros(len(a), bool), np.zeros(len(right), bool)
    step = max(1, PAIRS // max(1, len(right)))
    for s in range(0, len(a), step):  # a matrix of PAIRS bits' counts at most
        part = a[s : s + step]
        far = np.zeros((len(part), len(right)), np.uint8)
        for k in range(SKETCH):
            far += np.bitwise_count(part[:, None, k] ^ right[None, :, k])
        near = far <= limit
        if b is None:
            near[np.arange(len(part)), np.arange(s, s + len(part))] = False
        rows[s : s + step] = near.any(axis=1)
        columns |= near.any(axis=0)
    return rows if b is None else np.concatenate([rows, columns])


def runs(batches, keys: tuple[int, ...]) -> Iterator[list]:
    """The rows of sorted batches in runs of equal keys (numbers of columns): each run's columns, numbers as numpy
    arrays and lists as they are."""
    held, mark = [], None
    whole = lambda pieces: pieces[0] if len(pieces) == 1 else (np.concatenate(pieces) if isinstance(pieces[0], np.ndarray) else pa.concat_arrays(pieces))
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c if pa.types.is_list(c.type) else np.asarray(c) for c in batch.columns]
        key = np.stack([cols[k] for k in keys], axis=1)
        edges = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)].tolist()
        for lo, hi in zip(edges[:-1], edges[1:]):
            piece = [c[lo:hi] for c in cols]
            if held and (key[lo] == mark).all():
                held.append(piece)
                continue
            if held:
                yield [whole(c) for c in zip(*held)]
            held, mark = [piece], key[lo]
    if held:
        yield [whole(c) for c in zip(*held)]


def packed(parts: Iterable[list[np.ndarray]], names: list[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Small column groups (all of one width) as batches of about ``rows`` rows; -1 in column b means null."""

    def batch(some):
        cols = [np.concatenate(c) for c in zip(*some)]
        return pa.RecordBatch.from_arrays([pa.array(c, mask=c < 0) if n == "b" else pa.array(c) for n, c in zip(names, cols)], names)

    some, n = [], 0
    for part in parts:
        if len(part[0]):
            some.append(part)
            n += len(part[0])
        if n >= rows:
            yield batch(some)
            some, n = [], 0
    if some:
        yield batch(some)


def linked(classes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(a, b, n) from classes (cid, label, m, v): b null: class a has n links found in some table; else a link of the
    forest."""
    rows = classes.count()
    bits, tables = plan(rows, threshold)
    limit = sketch_limit(threshold)

    def sign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cid, label, v = (batch.column(k) for k in (0, 1, 3))
            sizes = np.asarray(v.value_lengths())
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = matrix(v.take(pa.array(at)))
                codes, sketch = signatures(x, bits, tables), sketches(x)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.asarray(cid)[at], tables)), pa.array(np.repeat(np.arange(tables, dtype=np.int32), n)), pa.array(np.tile(np.asarray(label)[at], tables)), pa.array(np.full(n * tables, size, np.int32)), pa.array(codes.T.ravel())]
                    + [pa.array(np.tile(sketch[:, k].view(np.int64), tables)) for k in range(SKETCH)],
                    ["cid", "t", "label", "size", "code", *SKETCHES],
                )

    spots = classes.select("cid", "label", "m", "v").mapInArrow(sign, "cid long, t int, label long, size int, code long, " + ", ".join(f"{c} long" for c in SKETCHES))
    spots = cut(spots.select("cid", "t", F.xxhash64("label", "size", "t", "code").alias("bucket"), *SKETCHES))
    sizes = spots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = join_by_key(spots, sizes, ["bucket"]).select("cid", "t", "bucket", *SKETCHES, F.ceil(F.greatest(F.sqrt(F.col("n") / tile), F.col("n") / MOST)).alias("slices"))
    met = met.withColumn("slice", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("slices")))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    place = ["cid", "t", "bucket", "slice", "lo", "hi"]
    met = met.select("cid", "t", "bucket", "slice", F.least("slice", "o").alias("lo"), F.greatest("slice", "o").alias("hi"), *SKETCHES)
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * tables / 500_000))
    met = met.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "t", "lo", "hi", "slice")

    def sift(batches):
        def found(group):
            s, lo, hi = group[3:6]
            sketch = np.stack(group[6:], axis=1).view(np.uint64)
            cut_ = None if lo[0] == hi[0] else np.searchsorted(s, lo[0], side="right")
            keep = partnered(sketch, None, limit) if cut_ is None else partnered(sketch[:cut_], sketch[cut_:], limit)
            return [c[keep] for c in group[:6]]

        yield from packed(map(found, runs(batches, (2, 1, 4, 5))), place)

    # only rows with a partner by their sketches bring their vectors along
    near = met.mapInArrow(sift, "cid long, t int, bucket long, slice long, lo long, hi long")
    # a bucket is a hash: label and length tell apart those that collide
    full = near.join(classes.select("cid", "m", "label", F.size("v").alias("size"), "v"), "cid")
    full = full.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "label", "size", "t", "lo", "hi", "slice")

    def join(batches):
        def found(group):
            cid, t, _, s, lo, hi, m, _, _, v = group
            v = matrix(v)
            part = {"cid": cid, "m": m, "x": v / np.sqrt((v * v).sum(axis=1))[:, None], "codes": signatures(v, bits, tables), "table": int(t[0])}
            cut_ = np.searchsorted(s, lo[0], side="right")
            pick = lambda k: {n: (x if n == "table" else x[k]) for n, x in part.items()}
            (a, n), (x, y) = compare(part, None, threshold) if lo[0] == hi[0] else compare(pick(slice(0, cut_)), pick(slice(cut_, None)), threshold)
            return [np.concatenate([a, x]), np.concatenate([np.full(len(a), -1, np.int64), y]), np.concatenate([n, np.ones(len(x), np.int64)])]

        yield from packed(map(found, runs(batches, (2, 7, 8, 1, 4, 5))), ["a", "b", "n"])

    return full.select(*place, "m", "label", "size", "v").mapInArrow(join, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    single = vectors.select(vector_col).schema[0].dataType == T.ArrayType(T.FloatType(), True)
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")  # single precision is shuffled as it is
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col(label_col).isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("ok"))
    rows = rows.withColumn("sig_a", F.when(F.col("ok"), F.xxhash64("label", "v"))).withColumn("sig_b", F.when(F.col("ok"), F.xxhash64("v", F.lit(1), "label")))
    light = cut(rows.select("vec_id", "sig_a", "sig_b"))
    classes = rows.where("ok").groupBy("sig_a", "sig_b").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = cut(linked(classes, threshold, tile))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    comp = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cid")
    joined = classes.select("cid", "sig_a", "sig_b", "least", "m").join(comp, "cid", "left").join(counts, "cid", "left")
    joined = joined.withColumn("component", F.coalesce("component", "cid")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("m") - 1)
    joined = cut(joined.select("sig_a", "sig_b", "least", "component", "links"))
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_sig = cut(join_by_key(joined, ids, ["component"]).select("sig_a", "sig_b", "links", "component_id"))
    out = join_by_key(light, by_sig, ["sig_a", "sig_b"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
