"""Connected components of a graph given by its edges, by alternating large-star and small-star steps (Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014).

Every step joins edges with each node's smallest neighbour and aggregates with a map-side part.  Hubs, the nodes with
more than HOT of all edge ends (1 / HOT of them at most), meet their edges by a broadcast, so no hub's edges meet in one
task; nothing but two numbers an iteration reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, LIGHT, cut


def _with_least(edges: DataFrame, least: DataFrame, light: float | None) -> DataFrame:
    """Edges (u, v) with the value m of u in ``least`` (u, m, n: edge ends of u).  light: most ends of a node that is no hub,
    None if there is no hub."""
    if light is None:
        return edges.join(least.select("u", "m"), "u")
    hub = F.col("n") > light
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u")
    return rest.union(edges.join(hubs, "u").select(*rest.columns))


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(e: DataFrame, light: float | None) -> DataFrame:
    """Link each node's larger neighbours to the smallest node around it.  Edges are (u, v) with u > v."""
    both = _both(e)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least, light).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame, light: float | None) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them.  A node has no more neighbours here than before
    the large step."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(e, least, light).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    """Number of edges, a sum of their hashes, and the most edge ends of a node."""
    ends = e.select("u", F.xxhash64("u", "v").cast("decimal(38,0)").alias("h")).union(e.select("v", F.lit(None)))
    per = ends.groupBy("u").agg(F.count("h").alias("n"), F.sum("h").alias("h"), F.count("*").alias("ends"))
    return tuple(per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.coalesce(F.max("ends"), F.lit(0))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node reachable.  Null ends and loops are
    ignored; repeated edges count once."""
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    now = _mark(e)
    while now[0]:
        light = max(LIGHT, HOT * 2 * now[0])
        light = light if now[2] > light else None
        e = cut(_small(_large(e, light), light))
        was, now = now, _mark(e)
        if now == was:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
