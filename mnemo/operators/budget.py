"""Selection under a token budget, as window expressions over a ranking.

Every rule takes a prefix: the first item that does not fit closes its group.  Token counts are positive, so running
sums grow and a prefix is a comparison with the running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO_SCORE, NO_ROOM = "zero score", "does not fit"
RECENT, ARCHIVE = "recent", "archive"
WINDOW_SESSIONS = 2


def prefix_within_budget(ranked: DataFrame, key: list[str], budget: Column) -> DataFrame:
    """Adds cum_tokens, selected, over_budget_first.  Items need a positive score.  A first item above the budget is
    admitted alone and flagged.  A null budget is no limit; the score threshold still holds."""
    w = Window.partitionBy(*key).orderBy("rank")
    x = ranked.withColumn("cum_tokens", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = budget.isNull() | (F.col("cum_tokens") <= budget) | (F.col("rank") == 1)
    x = x.withColumn("selected", (F.col("score") > 0) & fits)
    first = (F.col("rank") == 1) & F.col("selected") & (F.col("tokens") > budget)
    return x.withColumn("over_budget_first", F.coalesce(first, F.lit(False)))


def selection_summary(selected: DataFrame, key: list[str], item: str) -> DataFrame:
    """One row per key: items and tokens selected, the first excluded item and why."""
    excluded = F.when(~F.col("selected"), F.col("rank"))
    reason = F.when(F.col("score") <= 0, F.lit(ZERO_SCORE)).otherwise(F.lit(NO_ROOM))
    return selected.groupBy(*key).agg(
        F.count("*").alias("examined"),
        F.count_if("selected").alias("n_selected"),
        F.coalesce(F.sum(F.when(F.col("selected"), F.col("tokens"))), F.lit(0)).alias("context_tokens"),
        F.max(F.col("over_budget_first").cast("int")).alias("over_budget_first"),
        F.min_by(item, excluded).alias("stopped_by"),
        F.min_by(reason, excluded).alias("stop_reason"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("selected"), F.struct("rank", F.col(item).alias("i"))))), lambda r: r["i"].cast("string")), ",").alias("selected_items"),
    )


def level(session_order: Column, reached: Column, window: int = WINDOW_SESSIONS) -> Column:
    """Recency tier: the last ``window`` sessions up to the one reached are recent, whatever the entry's status."""
    return F.when(session_order >= reached - (window - 1), F.lit(RECENT)).otherwise(F.lit(ARCHIVE))


def two_phase(ranked: DataFrame, key: list[str], budget: Column) -> DataFrame:
    """Strict tiered selection; ranked has level, score, tokens, rank.  Adds phase (1, 2 or null), selected, outcome.

    Phase 1: each tier takes its own prefix within its quota (recent: half rounded down; archive: the rest).  Phase 2:
    what is left of the whole budget goes to the remaining items of both tiers in rank order.  No item may exceed the
    budget, the first neither, and a context may stay empty."""
    admitted = F.col("score") > 0
    quota = F.when(F.col("level") == RECENT, F.floor(budget / 2)).otherwise(budget - F.floor(budget / 2))
    tier = Window.partitionBy(*key, "level").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = ranked.withColumn("budget", budget).withColumn("_c1", F.sum(F.when(admitted, F.col("tokens")).otherwise(0)).over(tier))
    x = x.withColumn("_one", admitted & (F.col("_c1") <= quota))
    x = x.withColumn("_used", F.coalesce(F.sum(F.when(F.col("_one"), F.col("tokens"))).over(Window.partitionBy(*key)), F.lit(0)))
    rest = Window.partitionBy(*key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_c2", F.sum(F.when(admitted & ~F.col("_one"), F.col("tokens")).otherwise(0)).over(rest))
    x = x.withColumn("_two", admitted & ~F.col("_one") & (F.col("_used") + F.col("_c2") <= F.col("budget")))
    x = x.withColumn("phase", F.when(F.col("_one"), 1).when(F.col("_two"), 2)).withColumn("selected", F.col("_one") | F.col("_two"))
    # the first item that phase 2 leaves out closes it; those after it are not examined
    closes = F.min(F.when(admitted & ~F.col("selected"), F.col("rank"))).over(Window.partitionBy(*key))
    outcome = (
        F.when(~admitted, F.lit(ZERO_SCORE)).when(F.col("_one"), F.lit("quota")).when(F.col("_two"), F.lit("reuse"))
        .when((F.col("rank") == closes) & (F.col("tokens") > F.col("budget")), F.lit("above the budget"))
        .when(F.col("rank") == closes, F.lit("no room left")).otherwise(F.lit("closed"))
    )
    return x.withColumn("outcome", outcome).drop("_c1", "_one", "_used", "_c2", "_two", "budget")


def tier_report(selected: DataFrame, key: list[str], budget: int) -> DataFrame:
    """Per key and level: candidates, quota, tokens used in phase 1, unused, and tokens of phase 2."""
    quota = F.when(F.col("level") == RECENT, F.lit(budget // 2)).otherwise(F.lit(budget - budget // 2))
    one = selected.groupBy(*key, "level").agg(F.count_if(F.col("score") > 0).alias("candidates"), F.coalesce(F.sum(F.when(F.col("phase") == 1, F.col("tokens"))), F.lit(0)).alias("used"), F.coalesce(F.sum(F.when(F.col("phase") == 2, F.col("tokens"))), F.lit(0)).alias("reused"))
    return one.withColumn("quota", quota.cast("long")).withColumn("unused", F.col("quota") - F.col("used"))
