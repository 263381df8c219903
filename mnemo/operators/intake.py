"""From raw records and model proposals to rows that the engine trusts.  Nothing is corrected: what cannot be supported
is kept and marked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens
from . import memory

#: Labels that say that a value is not known, and endings of such labels.
UNKNOWN = ("unknown", "other", "na", "n/a", "none", "", "s - unknown", "u - unknown", "s - other", "u - other")
UNKNOWN_ENDS = (" - unknown", " - other")


def numbered_id(prefix: Column, letters: str, number: Column) -> Column:
    """``prefix-<letters>007``; a null prefix or number gives null."""
    return F.when(prefix.isNotNull() & number.isNotNull(), F.format_string(f"%s-{letters}%03d", prefix, number.cast("long")))


def known_list(values: Column) -> Column:
    """The distinct labels of a list in order, without outer spaces.  One unknown or null label makes the whole list
    incomplete: it, a null and an empty list give an empty list."""
    low = lambda v: F.lower(F.trim(v))
    ends = lambda v: reduce(Column.__or__, [F.endswith(low(v), F.lit(e)) for e in UNKNOWN_ENDS])
    bad = F.exists(values, lambda v: v.isNull() | low(v).isin(*UNKNOWN) | ends(v))
    return F.when(bad | values.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.transform(values, lambda v: F.trim(v)))))


def available_fields(fields: dict[str, Column]) -> Column:
    """Map of field name to known labels, without the fields that have none."""
    every = F.create_map(*[x for name, values in fields.items() for x in (F.lit(name), known_list(values))])
    return F.map_filter(every, lambda _, v: F.size(v) > 0)


def families(available: Column, rules: list[tuple[str, str]]) -> Column:
    """Distinct families, in order, of a map's fields: the family of the first rule (pattern, family) that fits."""
    of = lambda k: F.coalesce(*[F.when(k.rlike(p), F.lit(name)) for p, name in rules])
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.map_keys(available), of), lambda f: f.isNotNull())))


def flagged(ids: Column, marker: str, summary: Column, pattern: str) -> Column:
    """Whether a list holds ``marker`` or a text matches ``pattern`` in any case; nulls say no."""
    return F.coalesce(F.array_contains(ids, marker), F.lit(False)) | F.coalesce(summary.rlike(f"(?i){pattern}"), F.lit(False))


def facts(raw: DataFrame, allowed_kinds: tuple[str, ...]) -> DataFrame:
    """Facts from ``raw`` (scenario, order, text, kind, source_message_ids, allowed_message_ids; order is the position in
    the scenario): trimmed, numbered, counted, with kind and provenance judged."""
    x = raw.withColumn("source_message_ids", F.transform(F.coalesce("source_message_ids", F.array().cast("array<string>")), lambda s: F.trim(s)))
    x = x.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).withColumn("kind", F.lower(F.trim(F.coalesce("kind", F.lit("")))))
    foreign = F.filter("source_message_ids", lambda s: ~F.coalesce(F.array_contains("allowed_message_ids", s), F.lit(False)))
    problem = F.when(F.size("source_message_ids") == 0, "no source message").when(F.size(foreign) > 0, F.concat(F.lit("foreign messages: "), F.array_join(foreign, ", ")))
    x = x.withColumn("fact_id", numbered_id(F.col("scenario"), "F", F.col("order"))).withColumn("kind_valid", F.col("kind").isin(*allowed_kinds))
    return x.withColumn("provenance_problem", problem).withColumn("provenance_valid", F.col("provenance_problem").isNull()).withColumn("tokens", count_tokens(F.col("text")))


def register(proposals: DataFrame, known: DataFrame) -> DataFrame:
    """``proposals`` (scenario, session, op_order, fact_id, ...) with op_id, the sources of the cited fact of their own
    session, and why their provenance fails, if it does.  known: scenario, session, fact_id (unique),
    source_message_ids, allowed_message_ids."""
    x = proposals.join(known.withColumn("_known", F.lit(True)), ["scenario", "session", "fact_id"], "left")
    foreign = F.filter("source_message_ids", lambda s: ~F.coalesce(F.array_contains("allowed_message_ids", s), F.lit(False)))
    problem = F.when(F.col("_known").isNull(), "fact of another session").when(F.size(foreign) > 0, F.concat(F.lit("foreign messages: "), F.array_join(foreign, ", ")))
    x = x.withColumn("op_id", numbered_id(F.col("scenario"), "OP", F.col("op_order"))).withColumn("provenance_problem", problem)
    return x.withColumn("provenance_valid", F.col("provenance_problem").isNull()).withColumn("has_fact", F.col("_known").isNotNull()).drop("_known", "allowed_message_ids")


def fold_registered(ops: DataFrame) -> DataFrame:
    """Outcomes of registered proposals: those without a fact are rejected and leave the state alone, the others are
    folded as memory operations."""
    done = memory.fold_operations(ops.where("has_fact"))
    none = F.lit(None).cast("string")
    lost = ops.where(~F.col("has_fact")).select("scenario", "op_order", "op_id", "claim_key", "kind", F.lit(False).alias("applied"), F.concat(F.lit("provenance: "), "provenance_problem").alias("rejection"), none.alias("entry_id"), none.alias("supersedes"))
    return done.unionByName(lost)


def retries(ops: DataFrame) -> DataFrame:
    """``ops`` (scenario, session, fact_id, attempt, op_order, op_id, applied) with links between a rejected proposal
    and the one of the next attempt on its fact: retry_of and retried_by.  Of several in one attempt the last counts."""
    by = ["scenario", "session", "fact_id"]
    last = lambda rows, attempt, name: rows.groupBy(*by, attempt.alias("attempt")).agg(F.max_by("op_id", "op_order").alias(name))
    before = last(ops.where(~F.col("applied")), F.col("attempt") + 1, "retry_of")
    after = last(ops, F.col("attempt") - 1, "_next")
    x = ops.join(before, [*by, "attempt"], "left").join(after, [*by, "attempt"], "left")
    return x.withColumn("retried_by", F.when(~F.col("applied"), F.col("_next"))).drop("_next")
