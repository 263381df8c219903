"""Checks of an experiment's design and of its error analysis: causes against traces, tiered selections against their source,
overlays, scopes, matrices of modes, evidence outside the last session, sources and behaviours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import duplicates, field_rules, union, violation
from .validate import CONDITIONS, DIAGNOSTIC, EXPECTED_BEHAVIORS

#: Fixed values.
CAUSES = ("reachability", "extraction", "management", "graph", "retrieval", "answer", "benchmark")
FAILED = ("incorrect", "partial")
CASE_FIELDS = ("reachable", "retrieval_success", "answer_class", "obsolete_used", "unsupported_claim")


def some(ids: str) -> Column:
    return F.coalesce(F.size(ids), F.lit(0)) > 0


def causes(cases: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Declared causes must be what the trace shows, the first one that a look along the pipeline meets.

    cases: case_id, scenario, question, condition, primary_cause, secondary_cause, accessible_ids, retrieved_ids,
    unreachable_ids, not_retrieved_ids, benchmark_defect, diagnostic_mode and CASE_FIELDS; evaluation: scenario, question,
    condition and CASE_FIELDS."""
    first, second = F.col("primary_cause"), F.col("secondary_cause")
    known = first.isin(*CAUSES)
    is_ = lambda c: first == c
    defect = F.coalesce("benchmark_defect", F.lit(False))
    # a case of unknown cause is judged no further
    rules = {
        "E-CONDITION": F.col("condition").isin(*CONDITIONS),
        "E-CAUSE": known & (second.isNull() | (second.isin(*CAUSES) & (second != first))),
        "E-TRACE": ~known | (F.size(F.array_except(F.coalesce("retrieved_ids", F.array()), F.coalesce("accessible_ids", F.array()))) == 0),
        "E-CAUSE-EVIDENCE": F.when(is_("reachability"), ~F.col("reachable") & some("unreachable_ids")).when(is_("retrieval"), F.col("reachable") & some("not_retrieved_ids")).when(is_("answer"), ~some("unreachable_ids") & ~some("not_retrieved_ids")).otherwise(True),
        "E-BENCHMARK": ~known | ((~is_("benchmark") | defect) & (~defect | is_("benchmark") | F.coalesce(second == "benchmark", F.lit(False)))),
        "E-CASE": ~known | F.col("answer_class").isin(*FAILED),
        "E-DIAGNOSTIC": ~known | F.col("diagnostic_mode").isNull() | ((F.col("diagnostic_mode") == DIAGNOSTIC) & is_("retrieval")),
    }
    key = ["scenario", "question", "condition"]
    told = evaluation.select(*key, F.struct(*CASE_FIELDS).alias("_told"))
    x = cases.join(told, key, "left")
    unlike = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_told.{c}")), F.lit(c)) for c in CASE_FIELDS]))
    return union([
        duplicates(cases, ["case_id"]), field_rules(cases, ["case_id"], rules), violation(x.where("_told IS NULL"), "E-EVAL-MISSING", ["case_id"]),
        violation(x.where("_told IS NOT NULL").withColumn("_field", F.explode(unlike)), "E-EVAL-MATCH", ["case_id"], F.col("_field")),
    ])


def tiers(selected: DataFrame, source: DataFrame, memory: DataFrame, totals: DataFrame, key: list[str], budget: int) -> DataFrame:
    """Tiered selections (key, item_id, tokens, score, render) against the selection of the same memory that they are derived from:
    source (key, item_id, score), memory (item_id, value), totals (key, context_tokens, quota_tokens, over_first).  Tokens add
    up, quotas make the budget, there is no exception for a first item, scores are those of the source, texts are whole."""
    per = selected.groupBy(*key).agg(F.sum("tokens").alias("_sum"))
    t = totals.join(per, key, "left").withColumn("_sum", F.coalesce("_sum", F.lit(0)))
    rules = {"E-TOKENS": F.col("_sum") == F.col("context_tokens"), "E-BUDGET": F.col("_sum") <= budget, "E-QUOTAS": F.col("quota_tokens") == budget, "E-FIRST": ~F.col("over_first")}
    s = selected.join(source.select(*key, "item_id", F.col("score").alias("_score")), [*key, "item_id"], "left").join(memory, "item_id", "left")
    items = {"E-SCORE": F.abs(F.col("score") - F.col("_score")) <= 1e-9, "E-WHOLE": F.contains("render", F.col("value"))}
    return union([field_rules(t, key, rules), field_rules(s, [*key, "item_id"], items), duplicates(selected, [*key, "item_id"])])


def overlaid(base: DataFrame, notes: DataFrame) -> DataFrame:
    """Questions of a base (question, position, category, text, present, evidence_ids) with an overlay's facts (question, place,
    fact_sources: an array of arrays of message ids) and what follows from both: expected_behavior from whether the fact is in
    the corpus, required_evidence_ids, each once in order of first mention, and where a question comes from.  Questions that the
    overlay lacks keep their own evidence."""
    x = base.join(notes, "question", "left")
    derived = F.array_distinct(F.flatten(F.coalesce("fact_sources", F.array().cast("array<array<string>>"))))
    has = F.col("place").isNotNull()
    return x.select(
        "question", "position", "category", "text", F.when(F.col("present"), EXPECTED_BEHAVIORS[0]).otherwise(EXPECTED_BEHAVIORS[1]).alias("expected_behavior"),
        F.when(has, derived).otherwise(F.col("evidence_ids")).alias("required_evidence_ids"), F.when(has, "base and overlay").otherwise("base").alias("origin"), "place", "evidence_ids",
    )


def overlays(base: DataFrame, notes: DataFrame) -> DataFrame:
    """An overlay must list the base's questions, in its order, and its facts must come from the base's evidence."""
    x = overlaid(base, notes)
    lost = notes.join(base.select("question"), "question", "left_anti")
    unlike = F.when(F.col("place").isNull(), "not in the overlay").when(F.col("place") != F.col("position"), "another place").when(F.col("required_evidence_ids") != F.col("evidence_ids"), "other evidence")
    return union([violation(lost, "E-OVERLAY", ["question"], "not in the base"), violation(x.withColumn("_why", unlike).where("_why IS NOT NULL"), "E-OVERLAY", ["question"], F.col("_why"))])


def scopes(scenarios: DataFrame) -> DataFrame:
    """A scenario's declared scope (scenario, scope, sessions: arrays) must list all of its sessions in order."""
    return field_rules(scenarios, ["scenario"], {"E-SCOPE": F.col("scope") == F.col("sessions")})


def outside_last_session(evidence: DataFrame, sessions: DataFrame, least: int) -> DataFrame:
    """Each scenario needs ``least`` questions with evidence from before its last session.  evidence: scenario, question, session;
    sessions: scenario, session, session_order."""
    w = Window.partitionBy("scenario")
    x = sessions.withColumn("_last", F.max("session_order").over(w))
    early = evidence.join(x, ["scenario", "session"]).where(F.col("session_order") < F.col("_last")).groupBy("scenario").agg(F.count_distinct("question").alias("n"))
    per = sessions.select("scenario").distinct().join(early, "scenario", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return violation(per.where(F.col("n") < least), "E-LASTSESSION", ["scenario"], F.col("n"))


def matrix(planned: DataFrame, expected: DataFrame, implemented: list[str], code: str = "E-MATRIX") -> DataFrame:
    """A configuration's rows (scenario, planned, runnable: arrays of modes) against the expected ones (scenario, modes): rows that
    are missing, not expected, or of other modes; runnable modes that are not planned or not implemented."""
    x = expected.join(planned, "scenario", "full")
    ran = lambda test: F.transform(F.filter(F.coalesce("runnable", F.array().cast("array<string>")), test[0]), lambda m: F.concat(F.lit(test[1]), m))
    row = F.when(F.col("planned").isNull(), "row missing").when(F.col("modes").isNull(), "row not expected").when(F.col("planned") != F.col("modes"), "other modes")
    modes = F.when(row.isNull() | (row == "other modes"), F.concat(ran((lambda m: ~F.array_contains("modes", m), "not planned: ")), ran((lambda m: ~m.isin(*implemented), "not implemented: ")))).otherwise(F.array())
    return violation(x.withColumn("_why", F.explode(F.array_compact(F.concat(F.array(row), modes)))), code, ["scenario"], F.col("_why"))


def behaviours(rows: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """Questions by condition (scenario, question, condition, reachable, behavior): the behaviour follows from reachability.  Source
    files that are declared (scenario, path) must be among the ``files`` (path)."""
    want = F.when(F.col("reachable"), EXPECTED_BEHAVIORS[0]).otherwise(EXPECTED_BEHAVIORS[1])
    return union([field_rules(rows, ["scenario", "question", "condition"], {"E-BEHAVIOR": F.col("behavior") == want}), violation(sources.join(files.select("path").distinct(), "path", "left_anti"), "E-SOURCE-FILE", ["scenario"], F.col("path"))])


def collection(rows: DataFrame, expected: dict[str, int], n_questions: int) -> DataFrame:
    """A whole collection (scenario, question, condition, reachable): question ids are its own, and conditions reach as many
    questions as planned."""
    twice = rows.groupBy("question").agg(F.count_distinct("scenario").alias("n")).where("n > 1")
    n = rows.agg(F.count_distinct("question").alias("n"), *[F.count_if(F.col("reachable") & (F.col("condition") == c)).alias(c) for c in expected])
    want = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n"), F.lit(k).cast("long").alias("want")) for c, k in ({"n": n_questions} | expected).items()])
    x = n.select(F.explode(want).alias("x")).select("x.*").where("n <> want").withColumn("c", F.when(F.col("c") == "n", "questions").otherwise(F.col("c")))
    return union([violation(twice, "E-DUP", ["question"], F.col("n")), violation(x, "E-COVERAGE", ["c"], F.concat_ws(" of ", F.col("n").cast("string"), F.col("want").cast("string")))])
