"""Reproducible ordering, selection, deduplication and resampling."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import at_fraction, md5_int, sha_int, sha_text
from ..session import cut
from .keys import join_by_key, private
from .positions import numbered


def cluster_table(rows: DataFrame, cluster: str, measures: dict[str, Column]) -> DataFrame:
    """Sums of measures per cluster, clusters numbered from 0 in order: all that a bootstrap needs of the rows."""
    x = rows.groupBy(F.col(cluster).alias("cluster")).agg(*[F.sum(c).cast("double").alias(n) for n, c in measures.items()])
    return numbered(x, ["cluster"], "slot").withColumn("slot", F.col("slot") - 1)


def hash_draws(clusters: DataFrame, reps: int, seed: str) -> DataFrame:
    """(rep, slot): for each repetition as many draws as there are clusters, by md5 of seed, repetition and position."""
    n = clusters.agg(F.count("*").alias("n"))
    grid = clusters.sparkSession.range(reps).select(F.col("id").alias("rep")).join(F.broadcast(n))
    grid = grid.where("n > 0").select("rep", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    return grid.select("rep", (md5_int(seed, F.col("rep"), F.col("k")) % F.col("n")).alias("slot"))


def twister_draws(clusters: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, slot) from one Mersenne Twister stream, as a sequential program with this seed draws them.  One task replays
    the stream, a repetition's draws at a time; nothing of it is on the driver."""
    spark, n = clusters.sparkSession, clusters.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rng = random.Random(seed)
            for r in range(reps if len(batch) and n else 0):
                yield pd.DataFrame({"rep": r, "slot": [rng.randrange(n) for _ in range(n)]})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "rep long, slot long").repartition("rep")


def paired_effect(clusters: DataFrame, draws: DataFrame) -> DataFrame:
    """(effect, low, high, reps): the difference of two rates in percentage points, and its 95 % interval from resampled
    clusters.  clusters: slot, num_a, den_a, num_b, den_b.  Repetitions with an empty denominator are skipped."""
    points = lambda p: 100 * (F.sum(f"{p}num_a") / F.nullif(F.sum(f"{p}den_a"), F.lit(0.0)) - F.sum(f"{p}num_b") / F.nullif(F.sum(f"{p}den_b"), F.lit(0.0)))
    each = draws.join(clusters, "slot").groupBy("rep").agg(points("").alias("d")).where(F.col("d").isNotNull())
    ci = each.agg(F.collect_list(F.round("d", 6)).alias("all"))
    ci = ci.select(at_fraction(F.col("all"), 0.025).alias("low"), at_fraction(F.col("all"), 0.975).alias("high"), F.size("all").cast("long").alias("reps"))
    return clusters.agg(F.round(points(""), 6).alias("effect")).join(F.broadcast(ci))


def hash_rank(rows: DataFrame, by: list[str], seed: str, parts: list[str]) -> DataFrame:
    """Each row's place within its group in the order of sha256(seed:parts)."""
    w = Window.partitionBy(*by).orderBy("rank_key", *parts)
    return rows.withColumn("rank_key", sha_text(seed, *[F.col(p) for p in parts])).withColumn("place", F.row_number().over(w))


def greedy_strata(pool: DataFrame, stratum: str, item: str, unlike: str, per_block: int, blocks: int, strict: bool = True) -> DataFrame:
    """(stratum, block, position, item): blocks of ``per_block`` items in pool order (rank_key), no two of a block with
    the same ``unlike``; an item is used once.  A stratum that runs out is an error, or (not ``strict``) stops at its
    last full block.

    Sequential within a stratum.  A block takes one item of an ``unlike`` value at most, so only each value's first
    ``blocks`` items can be picked: the pool is cut to those before a stratum is gathered."""
    w = Window.partitionBy(stratum, unlike).orderBy("rank_key", item)
    firsts = pool.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= blocks).select(stratum, item, unlike, "rank_key")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = p.sort_values(["rank_key", item]).to_dict("records")
        out, used = [], set()
        for block in range(1, blocks + 1):
            chosen, seen = [], set()
            for r in rows:
                if len(chosen) == per_block:
                    break
                if r[item] not in used and r[unlike] not in seen:
                    chosen.append(r)
                    seen.add(r[unlike])
                    used.add(r[item])
            if len(chosen) < per_block:
                if strict:
                    raise ValueError(f"stratum {rows[0][stratum]!r} has no block {block} of {per_block}")
                break
            out += [(r[stratum], block, k, r[item]) for k, r in enumerate(chosen, 1)]
        return pd.DataFrame(out, columns=["stratum", "block", "position", "item"])

    return firsts.groupBy(stratum).applyInPandas(run, "stratum string, block long, position long, item long")


def sequential_dedupe(rows: DataFrame, order: str, profile: str, summary: str, item: str) -> DataFrame:
    """(item, decision): in order, a row is selected unless a *selected* earlier row has its profile, or its (non-empty)
    summary.

    Only the first row of a (profile, summary) pair can be selected.  Of those that are undecided, a row that is first in
    its profile and in its summary is selected, and all that share either with it are out; this repeats until none is
    undecided.  Each round is two aggregations and joins; no group is gathered.  All other rows compare themselves with
    the selected rows of their profile and summary."""
    first = rows.groupBy(F.col(profile).alias("p"), F.col(summary).alias("s")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(item).alias("i"))).alias("k"))
    open_, taken = cut(first), None
    while open_.limit(1).count():
        of_p = open_.groupBy("p").agg(F.min("k").alias("kp"))
        of_s = open_.where("s <> ''").groupBy("s").agg(F.min("k").alias("ks"))
        chosen = cut(open_.join(of_p, "p").where("k = kp").join(of_s, "s", "left").where("ks IS NULL OR k = ks").select("p", "s", "k"))
        rest = open_.join(chosen.select("p"), "p", "left_anti").join(chosen.where("s <> ''").select("s"), "s", "left_anti")
        taken, open_ = chosen if taken is None else taken.union(chosen), cut(rest.select("p", "s", "k"))
    if taken is None:
        taken = open_
    by_profile = taken.select(F.col("p").alias("pp"), F.col("k").alias("at_p"))
    by_summary = taken.where("s <> ''").select(F.col("s").alias("ss"), F.col("k").alias("at_s"))
    x = rows.join(by_profile, F.col(profile) == F.col("pp"), "left").join(by_summary, F.col(summary) == F.col("ss"), "left")
    me = F.struct(F.col(order).alias("o"), F.col(item).alias("i"))
    why = F.when(me == F.col("at_p"), F.lit("selected")).when(F.col("at_p") < me, F.lit("repeated_profile")).otherwise(F.lit("repeated_summary"))
    return x.select(F.col(item).alias("item"), why.alias("decision"))


def full_blocks(rows: DataFrame, size: int = 3) -> None:
    """Rows must fill their blocks."""
    if n := rows.count() % size:
        raise ValueError(f"{n} rows are left over from blocks of {size}")


def blocks_of(rows: DataFrame, order: list[str], size: int = 3, strict: bool = True) -> DataFrame:
    """Consecutive rows in blocks: block (from 1) and place (from 0).  Rows that leave a block unfilled are an error, unless
    not ``strict``."""
    if strict:
        full_blocks(rows, size)
    (at,) = private(rows, "at")
    return in_blocks(numbered(rows, order, at), at, size)


def in_blocks(rows: DataFrame, number: str, size: int) -> DataFrame:
    """block (from 1) and place (from 0) of rows by their ``number``, which is dropped."""
    n = F.col(number) - 1
    return rows.withColumn("block", (F.floor(n / size) + 1).cast("long")).withColumn("place", (n % size).cast("long")).drop(number)


def rotation(seed: str, key: Column, n: int) -> Column:
    """A number below n from the key's hash: which family a block leaves out, which field a question asks."""
    return sha_int(seed, key) % n


def distractor(fields: Column, asked: Column) -> tuple[Column, Column]:
    """(name, value) that a distractor shows: the asked field if it has it, else its first field by name."""
    name = F.when(F.map_contains_key(fields, asked), asked).otherwise(F.array_min(F.map_keys(fields)))
    return name, F.try_element_at(fields, name)


def reuse_plan(cells: DataFrame, key: list[str], position: list[str], cell: str, content: str | None = None) -> DataFrame:
    """The first cell of each key is a real call; the others reuse it.  content: what the key is a hash of; a key with two
    contents is an error, found where the plan runs."""
    if content is not None:
        apart = F.raise_error(F.concat_ws(" ", F.lit("one hash, two contents:"), *[F.col(k).cast("string") for k in key])).cast("boolean")
        lo, hi = private(cells, "lo", "hi")
        one = cells.groupBy(*key).agg(F.min(content).alias(lo), F.max(content).alias(hi)).where(F.when(F.col(lo).eqNullSafe(F.col(hi)), True).otherwise(apart))
        cells = cells.join(one.select(*key), key)
    cells = cut(cells)
    first = cells.groupBy(*key).agg(F.min(F.struct(*position, cell)).alias("_first")).select(*key, F.col(f"_first.{cell}").alias("first_cell"))
    x = join_by_key(cells, first, key)  # an empty prompt may be every third cell's
    same = F.col(cell) == F.col("first_cell")
    return x.withColumn("kind", F.when(same, F.lit("call")).otherwise(F.lit("reuse"))).withColumn("reused_from", F.when(~same, F.col("first_cell")))


def interleave(rows: DataFrame, order: DataFrame, on: list[str]) -> DataFrame:
    """Rows in a fixed order of their keys; order: the keys and position."""
    return rows.join(order, on).withColumn("message_order", F.row_number().over(Window.partitionBy("episode").orderBy("position")))
