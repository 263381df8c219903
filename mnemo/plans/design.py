"""Queries on the checks of a design: documents are cases and questions, conversations scenarios, with faults planted by number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import design
from ..operators.budget import prefix_within_budget
from ..operators.quality import union
from .common import BUDGET, R_SQL, ranked, table, turns
from .validation import _ctes, _rules, _view

_SHOW = ("code", "key", "detail")
_CASES = """SELECT CAST(doc_id AS STRING) AS case_id, source AS scenario, CAST(doc_id AS STRING) AS question, CASE WHEN doc_id % 29 = 3 THEN 'FULL_HISTORY' ELSE 'C1' END AS condition,
  CASE doc_id % 5 WHEN 0 THEN 'reachability' WHEN 1 THEN 'retrieval' WHEN 2 THEN 'answer' WHEN 3 THEN 'benchmark' ELSE CASE WHEN doc_id % 3 = 0 THEN 'weather' ELSE 'graph' END END AS primary_cause,
  CASE WHEN doc_id % 7 = 0 THEN 'retrieval' WHEN doc_id % 7 = 1 THEN 'luck' WHEN doc_id % 7 = 2 THEN 'benchmark' END AS secondary_cause,
  n_chars > 400 AS reachable, n_chars <= 400 OR doc_id % 31 = 4 AS lost, doc_id % 5 = 1 AND doc_id % 17 <> 5 AS unseen, doc_id % 37 = 6 AS foreign_, doc_id % 5 = 3 AND doc_id % 11 <> 0 AS benchmark_defect,
  CASE WHEN doc_id % 13 = 0 THEN 'FULL_HISTORY' WHEN doc_id % 13 = 1 THEN 'C2' END AS diagnostic_mode, CASE WHEN doc_id % 19 = 7 THEN 'complete' ELSE 'partial' END AS answer_class,
  lang = 'en' AS retrieval_success, doc_id % 2 = 0 AS obsolete_used, doc_id % 3 = 0 AS unsupported_claim FROM {documents}"""
_EVAL = """SELECT source AS scenario, CAST(doc_id AS STRING) AS question, CASE WHEN doc_id % 29 = 3 THEN 'FULL_HISTORY' ELSE 'C1' END AS condition, n_chars > 400 AS reachable, CASE WHEN doc_id % 41 = 8 THEN NULL ELSE lang = 'en' END AS retrieval_success,
  CASE WHEN doc_id % 19 = 7 THEN 'complete' ELSE 'partial' END AS answer_class, doc_id % 2 = 0 OR doc_id % 43 = 9 AS obsolete_used, doc_id % 3 = 0 AS unsupported_claim FROM {documents} WHERE doc_id % 47 <> 10"""


def validate_causes(spark, d):
    """Causes of failures against their traces and the evaluation."""
    ids = lambda c, name: F.when(F.col(c), F.array(F.lit("m9"))).otherwise(F.array().cast("array<string>")).alias(name)
    x = _view(spark, d, _CASES)
    x = x.select(*[c for c in x.columns if c not in ("lost", "unseen", "foreign_")], F.array(F.lit("m1"), F.lit("m2")).alias("accessible_ids"), F.when(F.col("foreign_"), F.array(F.lit("m1"), F.lit("m7"))).otherwise(F.array(F.lit("m2"))).alias("retrieved_ids"), ids("lost", "unreachable_ids"), ids("unseen", "not_retrieved_ids"))
    return design.causes(x, _view(spark, d, _EVAL)).select("code", "key", "detail")


def validate_tiers(spark, d):
    """Budgeted selections of turns against the ranking that they come from, with changed scores, cut texts, wrong totals."""
    r = prefix_within_budget(ranked(spark, d), ["conv_id"], F.lit(BUDGET).cast("long"))
    k = F.col("conv_id")
    name = F.concat_ws("-", "conv_id", "turn").alias("item_id")
    s = r.where("selected").select("conv_id", name, "tokens", F.when((k % 9 == 1) & (F.col("rank") == 1), F.col("score") + 1).otherwise(F.col("score")).alias("score"), F.when((k % 11 == 2) & (F.col("rank") == 1), F.lit("[")).otherwise(F.col("render")).alias("render"))
    totals = r.groupBy("conv_id").agg((F.coalesce(F.sum(F.when(F.col("selected"), F.col("tokens"))), F.lit(0)) + F.when(k % 13 == 3, 1).otherwise(0)).alias("context_tokens"), (F.lit(BUDGET) - F.when(k % 17 == 4, 1).otherwise(0)).alias("quota_tokens"), F.bool_or("over_budget_first").alias("over_first"))
    return design.tiers(s, r.select("conv_id", name, "score"), r.select(name, F.col("text").alias("value")), totals, ["conv_id"], BUDGET).select(*_SHOW)


def _overlay(spark, d):
    c = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    i = F.col("doc_id")
    text = lambda x: x.cast("string")
    base = c.select(text(i).alias("question"), i.alias("position"), F.col("source").alias("category"), F.col("lang").alias("text"), (F.coalesce(F.col("n_chars"), F.lit(0)) > 300).alias("present"), F.array(text(i), text(i + 1)).alias("evidence_ids"))
    sources = F.when(i % 23 == 5, F.array(F.array(text(i)), F.array(text(i), text(i + 2)))).otherwise(F.array(F.array(text(i)), F.array(text(i), text(i + 1))))
    notes = c.where(i % 19 != 4).select(text(i).alias("question"), F.when(i % 29 == 6, i + 1).otherwise(i).alias("place"), sources.alias("fact_sources"))
    extra = c.where(i % 53 == 7).select(F.concat(F.lit("x"), text(i)).alias("question"), i.alias("place"), sources.alias("fact_sources"))
    return base, notes.union(extra)


def overlay_flags(spark, d):
    """Questions with what follows from a base and its overlay."""
    x = design.overlaid(*_overlay(spark, d))
    return x.select("question", "expected_behavior", F.array_join("required_evidence_ids", ",").alias("evidence"), "origin")


def validate_overlay(spark, d):
    return design.overlays(*_overlay(spark, d)).select(*_SHOW)


def validate_design(spark, d):
    """Scopes, modes, evidence outside the last session, behaviours and sources of scenarios made from conversations."""
    t = turns(spark, d).select(F.col("conv_id").alias("k"), F.col("conv_id").cast("string").alias("scenario"), F.col("session_order").alias("s"), F.col("n_user").alias("n"))
    s, k = F.col("s"), F.col("k")
    text = lambda c: c.cast("string")
    one = t.where("s = 1")
    every = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")), text)
    scoped = one.select("scenario", F.when(k % 7 == 1, F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(1)))).otherwise(every).alias("scope"), every.alias("sessions"))
    evidence = t.select("scenario", text(s).alias("question"), text(F.when(s % 2 == 0, s - 1).otherwise(s)).alias("session"))
    sessions = t.select("scenario", text(s).alias("session"), s.alias("session_order"))
    modes = lambda *m: F.array(*map(F.lit, m))
    planned = one.where(k % 11 != 2).select("scenario", F.when(k % 13 == 3, modes("T", "F")).otherwise(modes("T", "F", "U")).alias("planned"), F.when(k % 17 == 4, modes("T", "G")).when(k % 19 == 5, modes("F", "X")).otherwise(modes("T")).alias("runnable"))
    planned = planned.union(one.where(k % 23 == 6).select(F.concat(F.lit("x"), "scenario"), modes("T"), modes("T")))
    expected = one.select("scenario", modes("T", "F", "U").alias("modes"))
    shown = t.select("scenario", text(s).alias("question"), F.lit("C1").alias("condition"), (s < F.col("n")).alias("reachable"), F.when((s < F.col("n")) != (k % 29 == 7), "complete_answer").otherwise("abstention").alias("behavior"))
    paths = one.select("scenario", F.concat(F.lit("c/"), F.when(k % 31 == 8, "gone").otherwise(F.col("scenario"))).alias("path"))
    files = one.select(F.concat(F.lit("c/"), F.col("scenario")).alias("path"))
    return union([design.scopes(scoped), design.outside_last_session(evidence, sessions, 2), design.matrix(planned, expected, ["T", "F", "U", "G"]), design.behaviours(shown, paths, files)]).select(*_SHOW)


def validate_collection(spark, d):
    """Questions (user turns) of all conversations: some ids occur in two scenarios; as many are reachable as planned, but one."""
    t = turns(spark, d).select(F.col("conv_id").cast("string").alias("scenario"), F.concat_ws("-", F.when(F.col("conv_id") % 17 == 1, F.col("conv_id") - 1).otherwise(F.col("conv_id")), "session_order").alias("question"), (F.col("session_order") > 1).alias("reachable"))
    rows = t.withColumn("condition", F.explode(F.array(F.lit("C0"), F.lit("C1")))).withColumn("reachable", F.col("reachable") & (F.col("condition") == "C1"))
    return design.collection(rows, {"C0": 0, "C1": 1}, 2).select(*_SHOW)


_CASE_SQL = _rules("ca", "case_id", {
    "E-CONDITION": "condition IN ('C0', 'C1', 'C2')",
    "E-CAUSE": "known AND (secondary_cause IS NULL OR (secondary_cause <> 'luck' AND secondary_cause <> primary_cause))",
    "E-TRACE": "NOT known OR NOT foreign_",
    "E-CAUSE-EVIDENCE": "CASE primary_cause WHEN 'reachability' THEN NOT reachable AND lost WHEN 'retrieval' THEN reachable AND unseen WHEN 'answer' THEN NOT lost AND NOT unseen ELSE true END",
    "E-BENCHMARK": "NOT known OR ((primary_cause <> 'benchmark' OR benchmark_defect) AND (NOT benchmark_defect OR primary_cause = 'benchmark'))",
    "E-CASE": "NOT known OR answer_class <> 'complete'",
    "E-DIAGNOSTIC": "NOT known OR diagnostic_mode IS NULL OR (diagnostic_mode = 'FULL_HISTORY' AND primary_cause = 'retrieval')",
})
_FIELDS = "".join(f"UNION ALL SELECT 'E-EVAL-MATCH', case_id, '{c}' FROM c JOIN ev ON c.scenario IS NOT DISTINCT FROM ev.scenario AND c.question = ev.question AND c.condition = ev.condition WHERE c.scenario IS NOT NULL AND c.{c} IS DISTINCT FROM ev.{c} " for c in design.CASE_FIELDS)
_U = "u AS (SELECT conv_id AS k, conv_id::VARCHAR AS scenario, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS s, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'), o AS (SELECT * FROM u WHERE s = 1)"
QUERIES = {
    "validate_causes": (validate_causes, f"""{_ctes(c=_CASES, ev=_EVAL)}, ca AS (SELECT *, primary_cause <> 'weather' AS known FROM c)
SELECT code, key, '' AS detail FROM ({_CASE_SQL}) UNION ALL SELECT 'E-EVAL-MISSING', case_id, '' FROM c WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.scenario = c.scenario AND ev.question = c.question AND ev.condition = c.condition) {_FIELDS}"""),
    "validate_tiers": (validate_tiers, f"""WITH {R_SQL}, z AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank) AS cum FROM r),
  p AS (SELECT *, score > 0 AND (cum <= {BUDGET} OR rank = 1) AS selected, score > 0 AND rank = 1 AND tokens > {BUDGET} AS over_first FROM z),
  tq AS (SELECT conv_id, coalesce(sum(tokens) FILTER (WHERE selected), 0) AS n, bool_or(over_first) AS over_first FROM p GROUP BY conv_id)
SELECT 'E-TOKENS' AS code, conv_id::VARCHAR AS key, '' AS detail FROM tq WHERE conv_id % 13 = 3 UNION ALL SELECT 'E-BUDGET', conv_id::VARCHAR, '' FROM tq WHERE n > {BUDGET}
UNION ALL SELECT 'E-QUOTAS', conv_id::VARCHAR, '' FROM tq WHERE conv_id % 17 = 4 UNION ALL SELECT 'E-FIRST', conv_id::VARCHAR, '' FROM tq WHERE over_first
UNION ALL SELECT 'E-SCORE', conv_id || '|' || conv_id || '-' || turn, '' FROM p WHERE selected AND rank = 1 AND conv_id % 9 = 1 UNION ALL SELECT 'E-WHOLE', conv_id || '|' || conv_id || '-' || turn, '' FROM p WHERE selected AND rank = 1 AND conv_id % 11 = 2"""),
    "overlay_flags": (overlay_flags, """SELECT doc_id::VARCHAR AS question, CASE WHEN coalesce(n_chars, 0) > 300 THEN 'complete_answer' ELSE 'abstention' END AS expected_behavior, doc_id || ',' || CASE WHEN doc_id % 23 = 5 AND doc_id % 19 <> 4 THEN doc_id + 2 ELSE doc_id + 1 END AS evidence,
  CASE WHEN doc_id % 19 = 4 THEN 'base' ELSE 'base and overlay' END AS origin FROM documents"""),
    "validate_overlay": (validate_overlay, """SELECT 'E-OVERLAY' AS code, 'x' || doc_id AS key, 'not in the base' AS detail FROM documents WHERE doc_id % 53 = 7
UNION ALL SELECT 'E-OVERLAY', doc_id::VARCHAR, CASE WHEN doc_id % 19 = 4 THEN 'not in the overlay' WHEN doc_id % 29 = 6 THEN 'another place' ELSE 'other evidence' END FROM documents WHERE doc_id % 19 = 4 OR doc_id % 29 = 6 OR doc_id % 23 = 5"""),
    "validate_design": (validate_design, f"""WITH {_U}
SELECT 'E-SCOPE' AS code, scenario AS key, '' AS detail FROM o WHERE k % 7 = 1 AND n > 1
UNION ALL SELECT 'E-LASTSESSION', scenario, least(n, n - 1 + (n % 2 = 0)::INT)::BIGINT::VARCHAR FROM o WHERE n - 1 + (n % 2 = 0)::INT < 2
UNION ALL SELECT 'E-MATRIX', scenario, 'row missing' FROM o WHERE k % 11 = 2 UNION ALL SELECT 'E-MATRIX', 'x' || scenario, 'row not expected' FROM o WHERE k % 23 = 6
UNION ALL SELECT 'E-MATRIX', scenario, 'other modes' FROM o WHERE k % 11 <> 2 AND k % 13 = 3 UNION ALL SELECT 'E-MATRIX', scenario, 'not planned: G' FROM o WHERE k % 11 <> 2 AND k % 17 = 4
UNION ALL SELECT 'E-MATRIX', scenario, 'not planned: X' FROM o WHERE k % 11 <> 2 AND k % 17 <> 4 AND k % 19 = 5 UNION ALL SELECT 'E-MATRIX', scenario, 'not implemented: X' FROM o WHERE k % 11 <> 2 AND k % 17 <> 4 AND k % 19 = 5
UNION ALL SELECT 'E-BEHAVIOR', scenario || '|' || s || '|C1', '' FROM u WHERE k % 29 = 7 UNION ALL SELECT 'E-SOURCE-FILE', scenario, 'c/gone' FROM o WHERE k % 31 = 8"""),
    "validate_collection": (validate_collection, f"""WITH {_U}, q AS (SELECT scenario, CASE WHEN k % 17 = 1 THEN k - 1 ELSE k END || '-' || s AS question, s > 1 AS reachable FROM u)
SELECT 'E-DUP' AS code, question AS key, count(DISTINCT scenario)::VARCHAR AS detail FROM q GROUP BY question HAVING count(DISTINCT scenario) > 1
UNION ALL SELECT 'E-COVERAGE', 'questions', count(DISTINCT question) || ' of 2' FROM q HAVING count(DISTINCT question) <> 2 UNION ALL SELECT 'E-COVERAGE', 'C1', count(*) FILTER (WHERE reachable) || ' of 1' FROM q HAVING count(*) FILTER (WHERE reachable) <> 1"""),
}
