"""Data-quality checks.  Each check is a DataFrame of violations (code, key, detail), empty when all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns of source identifiers and addresses that must not reach a prompt.
LEAKS = {
    "ghsa": r"(?i)GHSA(-[23456789cfghjmpqrvwx]{4}){3}",
    "cve": r"(?i)CVE-[0-9]{4}-[0-9]{3,}",
    "url": r"https?://",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "secret": r"(AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{20,})",
}


def violation(rows: DataFrame, code: Column | str, key: list[str], detail: Column | str = "") -> DataFrame:
    what = F.lit(detail) if isinstance(detail, str) else detail
    return rows.select((F.lit(code) if isinstance(code, str) else code).alias("code"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key]).alias("key"), what.cast("string").alias("detail"))


def union(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def duplicates(rows: DataFrame, key: list[str], code: str = "E-DUP") -> DataFrame:
    n = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return violation(n, code, key, F.col("n"))


def missing_reference(rows: DataFrame, key: list[str], ref: DataFrame, on: list[tuple[str, str]], code: str = "E-REF") -> DataFrame:
    """Rows whose (non-null) reference has no target."""
    cond = reduce(Column.__and__, [rows[a] == ref[b] for a, b in on])
    some = reduce(Column.__and__, [rows[a].isNotNull() for a, _ in on])
    return violation(rows.where(some).join(ref, cond, "left_anti"), code, key, F.concat_ws("|", *[F.col(a).cast("string") for a, _ in on]))


def wrong_count(rows: DataFrame, key: list[str], expected: Column, code: str = "E-COUNT") -> DataFrame:
    n = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return violation(n.where(F.col("n") != expected), code, key, F.col("n"))


def order_gaps(rows: DataFrame, group: list[str], order: str, first: int = 1, code: str = "E-ORDER") -> DataFrame:
    """Rows whose order number does not follow the one before, counting from ``first``."""
    w = Window.partitionBy(*group).orderBy(order)
    x = rows.withColumn("_want", F.coalesce(F.lag(order).over(w) + 1, F.lit(first)))
    return violation(x.where(~F.col(order).eqNullSafe(F.col("_want"))), code, [*group, order], F.col("_want"))


def mismatch(left: DataFrame, right: DataFrame, key: list[str], value: str, code: str = "E-MATCH", tolerance: float | None = None) -> DataFrame:
    """Keys whose values differ between two sides (null equals null), or that only one side has."""
    x = left.select(*key, F.col(value).alias("_l"), F.lit(1).alias("_a")).join(right.select(*key, F.col(value).alias("_r"), F.lit(1).alias("_b")), key, "full")
    same = F.col("_l").eqNullSafe(F.col("_r")) if tolerance is None else F.coalesce(F.abs(F.col("_l") - F.col("_r")) <= tolerance, F.col("_l").isNull() & F.col("_r").isNull())
    return violation(x.where(~same | F.col("_a").isNull() | F.col("_b").isNull()), code, key, F.concat_ws(" <> ", F.coalesce(F.col("_l").cast("string"), F.lit("null")), F.coalesce(F.col("_r").cast("string"), F.lit("null"))))


def field_rules(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows that break a named rule (a null outcome breaks it), one violation a rule, in one pass."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    x = rows.withColumn("_code", F.explode(broken))
    return violation(x, F.col("_code"), key)


def leaks(rows: DataFrame, key: str, text: str, patterns: dict[str, str] = LEAKS) -> DataFrame:
    """(key, code, n): occurrences of each pattern in a text."""
    found = F.array(*[F.struct(F.lit(c).alias("code"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).cast("long").alias("n")) for c, p in patterns.items()])
    return rows.select(F.col(key).alias("key"), F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select("key", "x.code", "x.n")


def unique_value(messages: DataFrame, facts: DataFrame, code: str = "E-UNIQUE") -> DataFrame:
    """Facts (fact_id, episode, value) whose value is not in exactly one message (episode, content) of their episode."""
    n = facts.join(messages, "episode", "left").groupBy("fact_id").agg(F.count_if(F.col("content").contains(F.col("value"))).alias("n"))
    return violation(n.where("n <> 1"), code, ["fact_id"], F.col("n"))


def tier_properties(selected: DataFrame, key: list[str], budget: int) -> DataFrame:
    """What a strict tiered selection must satisfy: no repeats, the budget kept, phase 1 within its quotas."""
    used = selected.where("selected").groupBy(*key).agg(F.sum("tokens").alias("n")).where(F.col("n") > budget)
    one = selected.where("phase = 1").groupBy(*key, "level").agg(F.sum("tokens").alias("n"))
    quota = F.when(F.col("level") == "recent", F.lit(budget // 2)).otherwise(F.lit(budget - budget // 2))
    again = selected.groupBy(*key, "item_id").agg(F.count("*").alias("n")).where("n > 1")
    return union([violation(used, "E-BUDGET", key, F.col("n")), violation(one.where(F.col("n") > quota), "E-QUOTA", [*key, "level"], F.col("n")), violation(again, "E-DUP", [*key, "item_id"], F.col("n"))])


def pinned(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, content) whose sha256 differs from the manifest's (path, sha256), or that one side lacks."""
    return mismatch(files.select("path", F.sha2("content", 256).alias("sha256")), manifest, ["path"], "sha256", "E-HASH")


def same_except(run: DataFrame, reference: DataFrame, key: list[str], declared: tuple[str, ...] = (), code: str = "E-COMPAT") -> DataFrame:
    """Rows of a run that differ from the reference in a field that is not declared to differ, or that only one has."""
    fields = [c for c in run.columns if c not in key and c not in declared]
    pack = lambda df, name: df.select(*key, F.struct(*[F.col(c) for c in fields]).alias(name), F.lit(True).alias(f"_{name}"))
    x = pack(run, "a").join(pack(reference, "b"), key, "full")
    unlike = F.concat_ws(",", *[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields])
    x = x.withColumn("detail", F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unexpected").otherwise(unlike))
    return violation(x.where("detail <> ''"), code, key, F.col("detail"))


def unsupported_causes(cases: DataFrame, code: str = "E-CAUSE") -> DataFrame:
    """Declared causes (case_id, cause, unreachable_ids, not_retrieved_ids) that the trace does not support."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    why = F.when((F.col("cause") == "unreachable") & none("unreachable_ids"), "all evidence was reachable").when((F.col("cause") == "not_retrieved") & none("not_retrieved_ids"), "all evidence was retrieved")
    why = why.when((F.col("cause") == "generation") & ~(none("unreachable_ids") & none("not_retrieved_ids")), "evidence was lost before")
    return violation(cases.withColumn("why", why).where("why IS NOT NULL"), code, ["case_id"], F.col("why"))


def approved(files: DataFrame, approval: DataFrame) -> None:
    """Let an execution begin only if ``approval`` (path, sha256) names each of ``files`` with the content it has now."""
    bad = pinned(files, approval).limit(5).collect()
    if bad or not approval.take(1):
        raise PermissionError("not approved: " + (", ".join(r["key"] for r in bad) or "the approval is empty"))
