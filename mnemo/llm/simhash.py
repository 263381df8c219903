"""SimHash near-duplicates, by a self-join of the fingerprints' binary trie.

A fingerprint is one 64-bit path of a trie.  Two nodes of one depth are traversed together, their differing bits add
up, and a pair whose bits exceed the error budget is dropped with all that is below.  To prune high up, two tries are
joined: of two fingerprints that differ in at most ``budget`` bits, either the high halves differ in at most
``budget // 2``, or the low halves in at most ``budget - budget // 2 - 1``; the first trie starts with the high half,
the second with the low half, each with its smaller budget on the first 32 levels.

Distribution: fingerprints are made distinct first (copies cost nothing further).  The trie's top is cut into nodes of
at most ``node_size`` fingerprints, from counts per prefix, deeper where a prefix is crowded; pairs of cut nodes within
budget are tiles, and each tile joins two bounded arrays in one task.  The driver sees counts per prefix and cut nodes
(at most 4096 plus 64 for each crowded prefix of ``node_size`` or more fingerprints), never fingerprints or links.
Inside a tile, node pairs that are already in one component are skipped, so a crowd of near copies is not compared in
all pairs; a tile emits a forest of its links, at most one edge a fingerprint.

Rows: null, empty and wordless texts have fingerprint 0 and link like any other.  Rows with the same fingerprint are
linked.  Null ids take part; a component's id is its smallest non-null one, null if it has none.  An empty table gives
an empty result.  Texts of any length are read whole.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, column, cut, join_by_key, private, slices
from .components import components

SHINGLE = 4
SEED = 42
BUDGET = 4
HALF = 32
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Node pairs that are expanded at once.
CHUNK = 1 << 20
#: Keys of rows to leave out (16 bytes each) that are broadcast.
BROADCAST_ROWS = 500_000


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    plain = b" ".join(words)
    if len(words) <= size:
        return [plain] if words else []
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    return [plain[s:e] for s, e in zip([0, *(x + 1 for x in ends)], ends[size - 1 :])]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is in over half of the shingles' hashes, repeats included."""
    parts, digest = shingles(text, size), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, len(parts), 1 << 16):
        h = np.array([digest(p, SEED) for p in parts[start : start + (1 << 16)]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp", keep_text: bool = True, size: int = SHINGLE) -> DataFrame:
    """``docs`` with each text's fingerprint as a long (the 64 bits in two's complement)."""
    kept = [c for c in docs.columns if c.lower() != out_col.lower() and (keep_text or c != text_col)]
    read = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text_col])])
    schema = T.StructType([f for f in read.schema if f.name in kept] + [T.StructField(out_col, T.LongType())])

    def run(batches):
        for batch in slices(batches, text_col):
            fps = np.array([fingerprint(t, size) for t in column(batch, text_col)], np.uint64)
            yield appended(batch.select(kept), {out_col: pa.array(fps.view(np.int64))})

    return read.mapInArrow(run, schema)


def turned(fps: np.ndarray, low_first: bool) -> np.ndarray:
    return (fps << np.uint64(HALF)) | (fps >> np.uint64(HALF)) if low_first else fps


def budgets(budget: int, low_first: bool) -> tuple[int, int]:
    """Most differing bits among the first HALF levels, and among all."""
    return (budget - budget // 2 - 1 if low_first else budget // 2), budget


class Side:
    """The trie of a sorted array of distinct numbers; a level's nodes are ranges of it."""

    def __init__(self, keys: np.ndarray, offset: int):
        self.keys, self.offset = keys, offset
        self.starts = [np.zeros(min(1, len(keys)), np.int64)]
        self.child: list[np.ndarray] = []

    def level(self, d: int) -> None:
        """Make the children of the nodes of level d: child[d][bit][node], -1 where there is none."""
        while len(self.child) <= d:
            k = len(self.child)
            top = self.keys >> np.uint64(63 - k)
            starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
            owner = np.searchsorted(self.starts[k], starts, side="right") - 1
            child = np.full((2, len(self.starts[k])), -1, np.int32)
            child[(top[starts] & np.uint64(1)).astype(np.int64), owner] = np.arange(len(starts))
            self.child.append(child)
            self.starts.append(starts)

    def sizes(self, d: int) -> np.ndarray:
        return np.diff(np.r_[self.starts[d], len(self.keys)])

    def uniform(self, d: int, labels: np.ndarray) -> np.ndarray:
        """The one label of each node of level d, -1 if it has several."""
        own = labels[self.offset : self.offset + len(self.keys)]
        lo, hi = np.minimum.reduceat(own, self.starts[d]), np.maximum.reduceat(own, self.starts[d])
        return np.where(lo == hi, lo, -1)


def unite(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merge the components of linked positions; labels hold each position's smallest linked position."""
    while True:
        a, b = labels[x], labels[y]
        open_ = a != b
        if not open_.any():
            return
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def join_tries(a: np.ndarray, b: np.ndarray | None, first: int, total: int) -> np.ndarray:
    """Component labels over a's then b's positions, from all links within and between (b None: within a; else only
    between a and b, whose own links other tiles find).  a, b: sorted, distinct, disjoint uint64 arrays."""
    left = Side(a, 0)
    right = left if b is None else Side(b, len(a))
    keys = a if b is None else np.concatenate([a, b])
    labels = np.arange(len(keys))
    if not len(a) or (b is not None and not len(b)):
        return labels
    zero = np.zeros(1, np.int32)
    stack, fresh = [(0, zero, zero, np.zeros(1, np.int8))], False
    while stack:
        d, i, j, diff = stack.pop()
        if len(i) > CHUNK:
            stack += [(d, i[k : k + CHUNK], j[k : k + CHUNK], diff[k : k + CHUNK]) for k in range(0, len(i), CHUNK)]
            continue
        if fresh and len(i) > 4096:  # drop node pairs whose fingerprints are one component by now
            own, other = left.uniform(d, labels)[i], right.uniform(d, labels)[j]
            live = (own != other) | (own < 0)
            i, j, diff = i[live], j[live], diff[live]
        single = (left.sizes(d)[i] == 1) & (right.sizes(d)[j] == 1)
        if single.any():
            x, y = left.starts[d][i[single]], right.starts[d][j[single]]
            far = np.bitwise_count(left.keys[x] ^ right.keys[y]) <= total
            if far.any():
                unite(labels, x[far] + left.offset, y[far] + right.offset)
                fresh = True
            i, j, diff = i[~single], j[~single], diff[~single]
        if not len(i) or d == 64:
            continue
        left.level(d)
        right.level(d)
        most, found = first if d < HALF else total, []
        for p in (0, 1):
            for q in (0, 1):
                x, y, z = left.child[d][p][i], right.child[d][q][j], diff + np.int8(p != q)
                ok = (x >= 0) & (y >= 0) & (z <= most)
                if b is None and p > q:
                    ok &= i != j  # a node with itself: its two cross pairs are one
                found.append((x[ok], y[ok], z[ok]))
        stack.append((d + 1, *(np.concatenate([f[k] for f in found]) for k in range(3))))
    return labels


def cut_nodes(distinct: DataFrame, low_first: bool, node_size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first keys and the depths of trie nodes that hold at most ``node_size`` fingerprints each, from counts per
    prefix; they cover all keys in order."""
    key = F.expr(f"shiftleft(fp, {HALF}) | shiftrightunsigned(fp, {HALF})") if low_first else F.col("fp")
    depth = 12
    rows = distinct.groupBy(F.shiftrightunsigned(key, 64 - depth).alias("p")).count().collect()
    counts = {(depth, r["p"]): r["count"] for r in rows}
    while hot := [p for (d, p), n in counts.items() if d == depth and n > node_size and depth < 60]:
        deeper = depth + 6
        up = F.shiftrightunsigned(key, 64 - depth)
        rows = distinct.where(up.isin(hot)).groupBy(F.shiftrightunsigned(key, 64 - deeper).alias("p")).count().collect()
        counts |= {(deeper, r["p"]): r["count"] for r in rows}
        for p in hot:
            del counts[depth, p]
        depth = deeper
    leaves = sorted((p << (64 - d), d, n) for (d, p), n in counts.items())
    before = [0, *accumulate(n for _, _, n in leaves)]
    firsts = [k for k, _, _ in leaves]
    nodes, stack = [], [(0, len(leaves), 0, 0)] if leaves else []
    while stack:
        lo, hi, d, key0 = stack.pop()
        if hi - lo == 0:
            continue
        if before[hi] - before[lo] <= node_size or (hi - lo == 1 and leaves[lo][1] <= d):
            nodes.append((key0, d))
        else:
            middle = key0 | 1 << (63 - d)
            at = bisect_left(firsts, middle, lo, hi)
            stack += [(at, hi, d + 1, middle), (lo, at, d + 1, key0)]
    return np.array([k for k, _ in nodes], np.uint64), np.array([d for _, d in nodes], np.int64)


def tiles(starts: np.ndarray, depths: np.ndarray, first: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of cut nodes (i <= j) whose common prefix bits are within budget, by traversing the cut trie."""
    out_i, out_j = [], []
    for i in range(len(starts)):
        j = np.arange(i, len(starts))
        common = np.minimum(depths[i], depths[j]).astype(np.uint64)
        x = starts[i] ^ starts[j]
        high = np.bitwise_count(x >> (np.uint64(64) - np.minimum(common, np.uint64(HALF))))
        every = np.bitwise_count(x >> np.minimum(np.uint64(64) - common, np.uint64(63)))
        j = j[((high <= first) & (every <= total)) | (common == 0)]
        out_i.append(np.full(len(j), i, np.int32))
        out_j.append(j.astype(np.int32))
    return np.concatenate(out_i or [np.zeros(0, np.int32)]), np.concatenate(out_j or [np.zeros(0, np.int32)])


def links(distinct: DataFrame, total: int, budget: int = BUDGET, node_size: int | None = None) -> DataFrame:
    """Edges (a, b) between fingerprints that connect the same fingerprints as all links within ``budget`` bits do.
    distinct: column fp, each value once; total: its row count."""
    spark = distinct.sparkSession
    size = node_size or min(max(512, total // 256), 1 << 20)
    out = None
    for low_first in (False, True):
        first, most = budgets(budget, low_first)
        starts, depths = cut_nodes(distinct, low_first, size)
        i, j = tiles(starts, depths, first, most)

        def assign(batches, starts=starts, low_first=low_first):
            for batch in batches:
                key = turned(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), low_first)
                node = np.searchsorted(starts, key, side="right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node.astype(np.int32))], ["fp", "node"])

        nodes = distinct.select("fp").mapInArrow(assign, "fp long, node int").groupBy("node").agg(F.collect_list("fp").alias("fps"))
        pairs = spark.createDataFrame(pd.DataFrame({"tile": np.arange(len(i)), "i": i, "j": j}), "tile long, i int, j int")
        parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(i) // 64), 20_000)
        sides = pairs.join(nodes.withColumnRenamed("node", "i").withColumnRenamed("fps", "left"), "i")
        sides = sides.join(nodes.withColumnRenamed("node", "j").withColumnRenamed("fps", "right"), "j")
        work = sides.select("tile", "left", F.when(F.col("i") != F.col("j"), F.col("right")).alias("right")).repartition(parts, "tile")

        def join(batches, first=first, most=most, low_first=low_first):
            for batch in batches:
                for r in range(batch.num_rows):
                    left, right = (batch.column(c)[r] for c in (1, 2))
                    got = [np.asarray(x.values).view(np.uint64) if x.is_valid else None for x in (left, right)]
                    a, b = (None if x is None else np.sort(turned(x, low_first)) for x in got)
                    labels = join_tries(a, b, first, most)
                    at = np.flatnonzero(labels != np.arange(len(labels)))
                    if len(at):
                        keys = turned(a if b is None else np.concatenate([a, b]), low_first).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(keys[labels[at]])], ["a", "b"])

        found = work.mapInArrow(join, "a long, b long")
        out = found if out is None else out.union(found)
    return out


def classes(prints: DataFrame, budget: int = BUDGET, node_size: int | None = None, least: Column | str = "doc_id") -> DataFrame:
    """(fp, least, rep) of each distinct fingerprint of ``prints`` (fp and other columns): its smallest ``least``, and one
    fingerprint of its component."""
    distinct = cut(prints.groupBy("fp").agg(F.min(least).alias("least")))
    comp = components(links(distinct, distinct.count(), budget, node_size))
    return distinct.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("rep"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keep_text=False))
    found = cut(classes(prints, budget))
    ids = found.groupBy("rep").agg(F.min("least").alias("component_id"))
    found = cut(join_by_key(found, ids, ["rep"]).select("fp", "component_id"))
    return join_by_key(prints, found, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_hashes(docs: DataFrame) -> list[Column]:
    """128 bits that tell different rows apart, from all columns (maps, which have no hash, as JSON)."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    marks = [F.isnull(c) for c in cols]  # a null leaves a hash as it is
    return [F.xxhash64(F.lit(k), *cols, *marks) for k in (0, 1)]


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns: that of the smallest id, of several rows with this
    id that with the smallest hash of all columns, of several equal rows one.  Groups whose ids are all null keep one
    row too.

    Fingerprints are made once, and what goes is decided on ids and hashes.  Rows that go are then left out by their
    hashes: by a broadcast while they are at most BROADCAST_ROWS, else by a join that moves each text once."""
    p = private(docs, "h", "i")
    keys = [p["h"], p["i"]]
    hashed = docs.select("*", *[c.alias(k) for c, k in zip(row_hashes(docs), keys)])
    light = hashed.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *keys)
    prints = cut(fingerprints(light, keep_text=False))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys, "fp")
    found = classes(prints, budget, least=order)
    first = found.groupBy("rep").agg(F.min("least").alias("x")).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.lit(True).alias("first"))
    rows = prints.groupBy(*keys).agg(F.count("*").alias("n")).join(first, keys, "left")
    rows = cut(rows.select(*keys, F.coalesce("first", F.lit(False)).alias("first"), "n"))
    gone, again = rows.where("NOT first").select(*keys), rows.where("first AND n > 1").select(*keys)
    if gone.count() <= BROADCAST_ROWS:
        kept = hashed.join(F.broadcast(gone), keys, "left_anti")
    else:
        kept = hashed.join(rows.where("first").select(*keys), keys, "left_semi")
    if m := again.count():
        again = F.broadcast(again) if m <= BROADCAST_ROWS else again
        kept = kept.join(again, keys, "left_anti").unionByName(kept.join(again, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*[f"`{c}`" for c in docs.columns])
