"""Published summaries of evaluations: rates with their own denominators, never merged across models, conditions or groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import percent, ratio
from .metrics import Metric, rates, warnings
from .quality import field_rules, union, violation
from .validate import ANSWER_CLASSES, DIAGNOSTIC

RETRIEVAL_RATES = ("retrieval_success_rate", "answer_success_rate")


def pilot_metrics(rows: DataFrame) -> DataFrame:
    """Tidy rows (mode, metric, num, den, rate) of annotations (mode, reachable, retrieval_success, answer_class,
    obsolete_used, unsupported_claim): seven rates and the proportions of answer classes.  The diagnostic mode retrieves
    nothing, so it has no retrieval rates."""
    reach, got, cls = F.col("reachable"), F.col("retrieval_success"), F.col("answer_class")
    seven = [
        Metric("reachability_rate", reach), Metric("retrieval_success_rate", got, reach), Metric("complete_answer_rate", cls == "complete"), Metric("answer_success_rate", cls == "complete", reach & got),
        Metric("correct_abstention_rate", cls == "correct_abstention", ~reach), Metric("obsolete_information_use_rate", F.col("obsolete_used")), Metric("unsupported_claim_rate", F.col("unsupported_claim")),
    ]
    x = rates(rows, ["mode"], seven + [Metric(f"class_{c}", cls == c) for c in ANSWER_CLASSES])
    return x.where((F.col("mode") != DIAGNOSTIC) | ~F.col("metric").isin(*RETRIEVAL_RATES))


def corpus_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("annotations"), F.count_distinct("question").alias("questions"), F.count_distinct("scenario").alias("scenarios"))


def handoff_block(rows: DataFrame, by: list[str], classes: tuple[str, ...]) -> DataFrame:
    """Tidy ratios of each model, condition and group.  rows: status, format_ok, declared, matches (context status),
    facts_total, facts_in_corpus, facts_in_context, obsolete, unsupported_ids, final_class (null: pending), uses_obsolete,
    unsupported_claim."""
    ok = F.col("status") == "ok"
    parsed, seen = ok & F.col("format_ok"), F.col("final_class").isNotNull()
    some = [
        Metric("responses", ok), Metric("missing_or_error", ~ok), Metric("format_error", ~F.col("format_ok"), ok), Metric("declared_answered", F.col("declared") == "answered", parsed), Metric("declared_insufficient", F.col("declared") == "insufficient", parsed),
        Metric("status_matches_expected_given_context", F.col("matches"), parsed), Metric("obsolete_marker_flagged", F.col("obsolete"), parsed), Metric("unsupported_identifier_flagged", F.col("unsupported_ids"), parsed),
        Metric("reviewed", seen), *[Metric(f"class_{c}", F.col("final_class") == c, seen) for c in classes], Metric("uses_obsolete_as_current", F.col("uses_obsolete"), seen), Metric("unsupported_claim", F.col("unsupported_claim"), seen),
    ]
    sums = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("facts_in_corpus", "facts_in_context", "facts_total")])
    facts = sums.select(*by, F.explode(F.array(*[F.struct(F.lit(f"evidence_{c}").alias("metric"), F.col(c).alias("num")) for c in ("facts_in_corpus", "facts_in_context")])).alias("x"), F.col("facts_total").alias("den"))
    return rates(rows, by, some).unionByName(facts.select(*by, "x.metric", "x.num", "den", ratio(F.col("x.num"), F.col("den")).alias("rate")))


def variant_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row a scenario and mode: size, means to one digit, and eight rates as counts, rates to four digits and
    percentages.  rows: context_tokens, context_items, reachable, facts_in_context, facts, counts, expected_behavior,
    answer_class, obsolete_used, unsupported_claim, wrong_abstention."""
    reach, counts = F.col("reachable"), F.col("counts")
    got = reach & (F.col("facts_in_context") == F.col("facts"))
    asked = F.col("expected_behavior") == "abstention"
    eight = {
        "reachability": (reach, None), "retrieval_success": (got, reach), "complete_answer": (counts, None), "answer_success": (counts, got), "correct_abstention": (F.col("answer_class") == "correct_abstention", asked),
        "obsolete_use": (F.col("obsolete_used"), None), "unsupported_claim": (F.col("unsupported_claim"), None), "wrong_abstention": (F.col("wrong_abstention"), None),
    }
    aggs = [F.count("*").alias("cells"), F.round(F.avg("context_tokens"), 1).alias("mean_tokens"), F.round(F.avg("context_items"), 1).alias("mean_items")]
    for name, (hit, keep) in eight.items():
        keep = F.lit(True) if keep is None else keep
        n, d = F.count_if(keep & hit), F.count_if(keep)
        aggs += [n.alias(f"{name}_num"), d.alias(f"{name}_den"), ratio(n, d, 4).alias(f"{name}_rate"), percent(n, d).alias(f"{name}_percent")]
    return rows.groupBy(*by).agg(*aggs)


def oracle_coverage(facts: DataFrame, perimeters: DataFrame) -> DataFrame:
    """For each question and condition: facts (question, fact, session; one row a source) whose sessions the condition
    (condition, session) can all read, and the answer that this lets expect."""
    grid = facts.join(F.broadcast(perimeters.select("condition").distinct()))  # a handful of conditions
    x = grid.join(perimeters.withColumn("_in", F.lit(True)), ["condition", "session"], "left")
    per = x.groupBy("question", "condition", "fact").agg(F.bool_and(F.col("_in").isNotNull()).alias("inside"))
    out = per.groupBy("question", "condition").agg(F.count("*").alias("facts"), F.count_if("inside").alias("facts_in_corpus"))
    return out.withColumn("expected_status", F.when(F.col("facts") == F.col("facts_in_corpus"), "answered").otherwise("insufficient"))


def budget_change(cells: DataFrame) -> DataFrame:
    """Cells (scenario, mode, budget_after, changed, unchanged, mismatched, excluded_by_threshold, tokens_before, tokens_after,
    items_after, history_items, whole_history, removed, evidence_before, evidence_after, evidence_applicable) with what a
    reader must know of the change, as codes in a fixed order."""
    free = F.col("budget_after").isNull()
    share = F.col("items_after") / F.nullif(F.col("history_items"), F.lit(0))
    t = (F.col("mode") == "T") & free
    rules = [
        ("W-SOURCES", F.col("mismatched") > 0), ("W-SOME-UNCHANGED", free & (F.col("unchanged") > 0) & (F.col("changed") > 0)), ("W-NOTHING-CHANGED", free & (F.col("changed") == 0)),
        ("W-WHOLE-HISTORY", t & (F.col("whole_history") > 0)), ("W-NEAR-HISTORY", t & (F.col("whole_history") == 0) & (share >= 0.8)), ("W-NO-THRESHOLD", free & (F.col("excluded_by_threshold") == 0)),
        ("W-DOUBLED", free & (F.col("tokens_before") > 0) & (F.col("tokens_after") >= 2 * F.col("tokens_before"))), ("W-REMOVED", free & (F.col("removed") > 0)),
        ("W-PROVENANCE-FULL", free & (F.col("evidence_applicable") > 0) & (F.col("evidence_after") == F.col("evidence_before"))), ("W-BUDGET-KEPT", ~free & (F.col("changed") > 0)),
    ]
    return cells.withColumn("warnings", warnings(rules))


def judgement_coherence(rows: DataFrame, details: DataFrame, facts: DataFrame, key: list[str], classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(coverage, violations) of human judgements.  rows: key, answer_class, supported, counts (nullable); details: key,
    fact_key, in_context, in_answer; facts: key, fact_key.  Coverage strings read found/required."""
    x = facts.join(details, [*key, "fact_key"], "left")
    per = x.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("in_context").alias("c"), F.count_if("in_answer").alias("a"))
    text = lambda c: F.concat_ws("/", F.coalesce(c, F.lit(0)).cast("string"), F.coalesce("n", F.lit(0)).cast("string"))
    both = (F.col("answer_class") == "complete") & F.coalesce("supported", F.lit(False))
    covered = rows.join(per, key, "left").select(*key, text("c").alias("coverage_in_context"), text("a").alias("coverage_in_answer"), both.alias("complete_and_supported"))
    fk = [*key, "fact_key"]
    found = union([
        violation(facts.join(details, fk, "left_anti"), "E-DETAIL-MISSING", fk), violation(details.join(facts, fk, "left_anti"), "E-DETAIL-UNKNOWN", fk),
        field_rules(rows, key, {"E-CLASS": F.col("answer_class").isin(*classes), "E-COUNTS": F.col("counts").isNull() | (F.col("counts") == both)}),
    ])
    return covered, found


def tidy(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, path, value): the numbers of nested structs, one row each, their names joined by dots, depth first."""

    def leaves(kind: T.StructType, at: str) -> list[tuple[str, Column]]:
        out = []
        for f in kind.fields:
            name = f"{at}.{f.name}" if at else f.name
            out += leaves(f.dataType, name) if isinstance(f.dataType, T.StructType) else [(name, F.col(name))]
        return out

    found = leaves(T.StructType([f for f in rows.schema if f.name not in key]), "")
    pairs = F.array(*[F.struct(F.lit(n).alias("path"), c.cast("double").alias("value")) for n, c in found])
    return rows.select(*key, F.explode(pairs).alias("x")).select(*key, "x.path", "x.value")
