"""Places in an order, without a task that sees all rows: numbers of rows in a global order, and the values at given
places of each group's sorted values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .keys import private

BUCKETS = 1024


def numbered(rows: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Rows with their number, from 1, in the order of ``order`` (which must tell rows apart for a defined result).  Rows
    are dealt to partitions by ranges of the order and counted there; the windows see one row a partition."""
    p, k, n, b = private(rows, "p", "k", "n", "b")
    x = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the rest of a row's id within its partition is its place there
    x = cut(x.withColumn(p, F.spark_partition_id()).withColumn(k, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = x.groupBy(p).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.join(F.broadcast(sizes.select(p, before.alias(b))), p)
    return x.withColumn(name, F.col(b) + F.col(k) + 1).drop(p, k, b)


def numbered_within(rows: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """Rows with their number, from 1, within their group in the order of ``order``: numbers of the whole order by group, less
    those of the groups before.  No task sees a group; there is one small row a group."""
    first, at = private(rows, "first", "at")
    x = numbered(rows, [group, *order], at)
    low = x.groupBy(group).agg((F.min(at) - 1).alias(first))
    own = low.withColumnRenamed(group, f"{first}_g")
    y = x.join(own, x[group].eqNullSafe(own[f"{first}_g"]))
    return y.withColumn(name, F.col(at) - F.col(first)).drop(first, at, f"{first}_g")


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by, n, one column for each of ``places``): the values at 0-based places, given as functions of n, of each group's
    sorted non-null values.  A group's range is cut into BUCKETS; only the values of the buckets that hold a wanted place
    are counted one by one, equal ones together."""
    some = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    size = some.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    size = cut(size)
    share = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    keyed = some.join(size, by).withColumn("b", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))
    hist = keyed.groupBy(*by, "b").agg(F.count("*").alias("m"))
    hist = hist.withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy("b")))
    want = size.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("long").alias("at")) for k, c in places.items()])).alias("w")).select(*by, "w.*")
    hit = cut(hist.join(want, by).where("upto - m <= at AND at < upto").select(*by, "b", "name", (F.col("at") - F.col("upto") + F.col("m")).alias("at")))
    near = keyed.join(hit.select(*by, "b").distinct(), [*by, "b"], "left_semi").groupBy(*by, "b", "v").agg(F.count("*").alias("m"))
    near = near.withColumn("upto", F.sum("m").over(Window.partitionBy(*by, "b").orderBy("v")))
    found = near.join(hit, [*by, "b"]).where("upto - m <= at AND at < upto")
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in places])
    return size.select(*by, "n").join(wide, by, "left")


def middle(low: str = "m0", high: str = "m1") -> tuple[dict[str, Column], Column]:
    """Places of the two middle values, and the interpolated median of them."""
    n = F.col("n")
    return {low: F.floor((n - 1) / 2), high: F.ceil((n - 1) / 2)}, reduce(Column.__add__, [F.col(low), F.col(high)]) / 2
