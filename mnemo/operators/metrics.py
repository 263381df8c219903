"""Rates and summaries.  A rate without denominator is null; failures stay in denominators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from .positions import middle, order_statistics


@dataclass(frozen=True)
class Metric:
    """A rate: of the rows that ``keep`` holds for, those that ``hit`` holds for."""

    name: str
    hit: Column
    keep: Column | None = None


def rates(rows: DataFrame, by: list[str], metrics: list[Metric], grouping_sets: list[list[str]] | None = None) -> DataFrame:
    """Tidy rows (by, metric, num, den, rate), all metrics in one aggregation.  With grouping sets a missing level reads
    "all"."""
    aggs = []
    for m in metrics:
        keep = F.coalesce(m.keep, F.lit(False)) if m.keep is not None else F.lit(True)
        aggs += [F.count_if(keep & F.coalesce(m.hit, F.lit(False))).alias(f"n_{m.name}"), F.count_if(keep).alias(f"d_{m.name}")]
    if grouping_sets is None:
        wide = rows.groupBy(*by).agg(*aggs)
    else:
        level = [F.when(F.grouping(c) == 1, F.lit("all")).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(f"_{c}") for c in by]
        wide = rows.groupingSets([[F.col(c) for c in s] for s in grouping_sets], *[F.col(c) for c in by]).agg(*level, *aggs)
        wide = wide.select(*[F.col(f"_{c}").alias(c) for c in by], *[c for c in wide.columns if c[:2] in ("n_", "d_")])
    parts = ", ".join(f"'{m.name}', n_{m.name}, d_{m.name}" for m in metrics)
    tidy = wide.selectExpr(*[f"`{c}`" for c in by], f"stack({len(metrics)}, {parts}) AS (metric, num, den)")
    return tidy.withColumn("rate", ratio(F.col("num"), F.col("den")))


def micro(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column]:
    """Precision and recall of sums."""
    return ratio(F.sum(tp), F.sum(tp) + F.sum(fp)), ratio(F.sum(tp), F.sum(tp) + F.sum(fn))


def ratio_of_sums(rows: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(num).alias("num"), F.sum(den).alias("den")).withColumn("rate", ratio(F.col("num"), F.col("den")))


def latency(rows: DataFrame, by: list[str], value: str, units: str | None = None) -> DataFrame:
    """Count, interpolated median, the value at floor(0.95 (n - 1)), and units per unit of time.  No group's values are
    gathered."""
    places, median = middle()
    x = order_statistics(rows, by, value, places | {"_p95": F.floor(0.95 * (F.col("n") - 1))})
    out = x.select(*by, "n", F.round(median, 6).alias("median"), F.round("_p95", 6).alias("p95"))
    if units:
        out = out.join(rows.groupBy(*by).agg(ratio(F.sum(units), F.sum(value)).alias("per_unit")), by)
    return out


def paired_table(rows: DataFrame, key: str, condition: str, a: str, b: str, hit: Column) -> DataFrame:
    """One row (both, only_a, only_b, neither) over keys that have both conditions."""
    x = rows.groupBy(key).agg(F.max(F.when(F.col(condition) == a, hit.cast("int"))).alias("a"), F.max(F.when(F.col(condition) == b, hit.cast("int"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return x.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"), F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("neither"),
    )


def histogram(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Counts of a column's values in a given order, zeros included."""
    dim = rows.sparkSession.createDataFrame([(k, v) for k, v in enumerate(order)], "pos int, value string")
    n = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(n, "value", "left").select("pos", "value", F.coalesce("n", F.lit(0)).alias("n"))


def funnel(rows: DataFrame, criterion: str, order: list[str]) -> DataFrame:
    """Rows excluded by each criterion and those left after it."""
    h = histogram(rows.where(F.col(criterion).isNotNull()), criterion, order)
    total = rows.agg(F.count("*").alias("total"))
    gone = F.sum("n").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return h.join(F.broadcast(total)).select("pos", F.col("value").alias("criterion"), F.col("n").alias("excluded"), (F.col("total") - gone).alias("remaining"))


def set_delta(before: Column, after: Column) -> dict[str, Column]:
    return {"added": F.array_sort(F.array_except(after, before)), "removed": F.array_sort(F.array_except(before, after)), "changed": ~F.array_sort(before).eqNullSafe(F.array_sort(after))}


#: Fixed order of merit of answer classes, worst first, for before and after comparisons.
MERIT = {"wrong": 0.0, "partial": 1.0, "complete_unsupported": 1.5, "complete": 2.0}


def merit_change(before: Column, after: Column) -> Column:
    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in MERIT.items() for x in kv]), c)
    return F.when(rank(after) > rank(before), F.lit("improved")).when(rank(after) < rank(before), F.lit("worse")).otherwise(F.lit("equal"))


def warnings(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def fragments(predicted: Column, expected: Column, sep: str = " - ") -> Column:
    """Predicted values that are a part of an expected one: equal to a piece of it, or within it."""
    hit = lambda p: F.exists(expected, lambda e: F.array_contains(F.split(e, sep), p) | ((e != p) & e.contains(p)))
    return F.filter(F.array_except(predicted, expected), hit)


def reconcile(computed: DataFrame, published: DataFrame, key: list[str], value: str) -> DataFrame:
    """Published numbers that differ from the recomputed ones, or exist on one side only."""
    x = computed.select(*key, F.col(value).alias("computed")).join(published.select(*key, F.col(value).alias("published")), key, "full")
    return x.where(~F.col("computed").eqNullSafe(F.col("published")))
