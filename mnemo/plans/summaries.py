"""Queries on published summaries, over stand-in evaluations of documents (one SQL text for both engines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ratio
from ..operators import resample, summaries
from .common import table
from .validation import _ANN, _FOUR, _against, _ctes, _rules, _view

_PIL = f"SELECT *, length(question) % 3 = 0 AS obsolete_used, length(question) % 4 = 1 AS unsupported_claim FROM ({_ANN}) a"
_SEVEN = {
    "reachability_rate": ("true", "reachable"), "retrieval_success_rate": ("reachable", "retrieval_success"), "complete_answer_rate": ("true", "answer_class = 'complete'"), "answer_success_rate": ("reachable AND retrieval_success", "answer_class = 'complete'"),
    "correct_abstention_rate": ("NOT reachable", "answer_class = 'correct_abstention'"), "obsolete_information_use_rate": ("true", "obsolete_used"), "unsupported_claim_rate": ("true", "unsupported_claim"),
    **{f"class_{c}": ("true", f"answer_class = '{c}'") for c in ("complete", "partial", "incorrect", "correct_abstention")},
}


def pilot_metrics(spark, d):
    return summaries.pilot_metrics(_view(spark, d, _PIL))


def corpus_totals(spark, d):
    return summaries.corpus_totals(_view(spark, d, _PIL))


_HAN = f"""SELECT CASE WHEN doc_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, CASE WHEN m < 2 THEN 'shared' ELSE 'separated' END AS condition, lang AS grp, CASE WHEN (doc_id + m) % 13 = 0 THEN 'error' ELSE 'ok' END AS status, (doc_id + m) % 7 <> 0 AS format_ok,
  CASE WHEN (doc_id + m) % 3 = 0 THEN 'answered' ELSE 'insufficient' END AS declared, (doc_id + m) % 4 = 0 AS matches, CAST(doc_id % 4 AS BIGINT) AS facts_total, CAST(CASE WHEN m < 2 THEN doc_id % 4 ELSE 0 END AS BIGINT) AS facts_in_corpus, CAST(CASE WHEN m = 0 AND doc_id % 4 > 0 THEN 1 ELSE 0 END AS BIGINT) AS facts_in_context,
  (doc_id + m) % 9 = 0 AS obsolete, (doc_id + m) % 10 = 0 AS unsupported_ids, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'complete' ELSE 'partial' END AS final_class, doc_id % 6 = 0 AS uses_obsolete, doc_id % 8 = 0 AS unsupported_claim FROM {{documents}} CROSS JOIN {_FOUR} f"""
HANDOFF = ("complete", "partial", "incorrect")


def handoff_block(spark, d):
    return summaries.handoff_block(_view(spark, d, _HAN), ["model", "condition", "grp"], HANDOFF)


_OKF = "status = 'ok' AND format_ok"
_HB = {
    "responses": ("true", "status = 'ok'"), "missing_or_error": ("true", "status <> 'ok'"), "format_error": ("status = 'ok'", "NOT format_ok"), "declared_answered": (_OKF, "declared = 'answered'"), "declared_insufficient": (_OKF, "declared = 'insufficient'"),
    "status_matches_expected_given_context": (_OKF, "matches"), "obsolete_marker_flagged": (_OKF, "obsolete"), "unsupported_identifier_flagged": (_OKF, "unsupported_ids"), "reviewed": ("true", "final_class IS NOT NULL"),
    **{f"class_{c}": ("final_class IS NOT NULL", f"final_class = '{c}'") for c in HANDOFF}, "uses_obsolete_as_current": ("final_class IS NOT NULL", "uses_obsolete"), "unsupported_claim": ("final_class IS NOT NULL", "unsupported_claim"),
}


def _tidy_sql(rows: str, by: str, some: dict) -> str:
    parts = [f"SELECT {by}, '{n}' AS metric, count(*) FILTER (WHERE ({k}) AND ({h})) AS num, count(*) FILTER (WHERE {k}) AS den FROM {rows} GROUP BY {by}" for n, (k, h) in some.items()]
    return " UNION ALL ".join(parts)


_VAR = f"""SELECT source AS scenario, CASE WHEN m = 0 THEN 'T' WHEN m = 1 THEN 'F' WHEN m = 2 THEN 'U' ELSE 'G' END AS mode, CAST(n_chars % 400 + m AS BIGINT) AS context_tokens, CAST(n_chars % 9 AS BIGINT) AS context_items, doc_id % 7 <> 0 AS reachable, CAST((doc_id + m) % 3 AS BIGINT) AS facts_in_context, CAST(2 AS BIGINT) AS facts,
  (doc_id + m) % 4 = 0 AS counts, CASE WHEN doc_id % 7 = 0 THEN 'abstention' ELSE 'complete_answer' END AS expected_behavior, CASE WHEN doc_id % 14 = 0 THEN 'correct_abstention' ELSE 'partial' END AS answer_class, doc_id % 10 = m AS obsolete_used, doc_id % 11 = m AS unsupported_claim, doc_id % 12 = m AS wrong_abstention FROM {{documents}} CROSS JOIN {_FOUR} f"""
_EIGHT = {
    "reachability": ("true", "reachable"), "retrieval_success": ("reachable", "facts_in_context = facts"), "complete_answer": ("true", "counts"), "answer_success": ("reachable AND facts_in_context = facts", "counts"), "correct_abstention": ("expected_behavior = 'abstention'", "answer_class = 'correct_abstention'"),
    "obsolete_use": ("true", "obsolete_used"), "unsupported_claim": ("true", "unsupported_claim"), "wrong_abstention": ("true", "wrong_abstention"),
}


def variant_summary(spark, d):
    return summaries.variant_summary(_view(spark, d, _VAR), ["scenario", "mode"])


def _eight_sql() -> str:
    out = []
    for n, (k, h) in _EIGHT.items():
        a, b = f"count(*) FILTER (WHERE ({k}) AND ({h}))", f"count(*) FILTER (WHERE {k})"
        out += [f"{a} AS {n}_num", f"{b} AS {n}_den", f"round({a} / nullif({b}, 0)::DOUBLE, 4) AS {n}_rate", f"round(100 * {a} / nullif({b}, 0)::DOUBLE, 1) AS {n}_percent"]
    return ", ".join(out)


_FAC = "SELECT CAST(conv_id AS STRING) AS question, CAST(CAST(floor(turn / 3) AS BIGINT) AS STRING) AS fact, turn AS session FROM {conversations}"
_CON = "SELECT DISTINCT 'separated' AS condition, turn AS session FROM {conversations} WHERE turn >= 4 UNION ALL SELECT DISTINCT 'shared', turn FROM {conversations} WHERE turn < 7"


def oracle_coverage(spark, d):
    return summaries.oracle_coverage(_view(spark, d, _FAC), _view(spark, d, _CON))


_CHG = f"""SELECT CAST(doc_id AS STRING) AS scenario, CASE WHEN m = 0 THEN 'T' ELSE 'U' END AS mode, CASE WHEN doc_id % 4 = 0 THEN 200 END AS budget_after, doc_id % 5 AS changed, doc_id % 3 AS unchanged, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS mismatched, doc_id % 6 AS excluded_by_threshold,
  n_chars % 200 AS tokens_before, n_chars % 500 AS tokens_after, n_chars % 11 AS items_after, 10 AS history_items, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 0 END AS whole_history, doc_id % 7 % 2 AS removed, doc_id % 3 AS evidence_before, doc_id % 4 AS evidence_after, doc_id % 5 AS evidence_applicable FROM {{documents}} CROSS JOIN {_FOUR} f WHERE m < 2"""


def budget_warnings(spark, d):
    return summaries.budget_change(_view(spark, d, _CHG)).select("scenario", "mode", F.array_join("warnings", ",").alias("warnings"))


_FREE = "budget_after IS NULL AND"
_WARN = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in (
    ("W-SOURCES", "mismatched > 0"), ("W-SOME-UNCHANGED", f"{_FREE} unchanged > 0 AND changed > 0"), ("W-NOTHING-CHANGED", f"{_FREE} changed = 0"), ("W-WHOLE-HISTORY", f"{_FREE} mode = 'T' AND whole_history > 0"), ("W-NEAR-HISTORY", f"{_FREE} mode = 'T' AND whole_history = 0 AND items_after >= 8"),
    ("W-NO-THRESHOLD", f"{_FREE} excluded_by_threshold = 0"), ("W-DOUBLED", f"{_FREE} tokens_before > 0 AND tokens_after >= 2 * tokens_before"), ("W-REMOVED", f"{_FREE} removed > 0"), ("W-PROVENANCE-FULL", f"{_FREE} evidence_applicable > 0 AND evidence_after = evidence_before"), ("W-BUDGET-KEPT", "budget_after IS NOT NULL AND changed > 0"),
))

_JUD = "SELECT source AS scenario, CAST(doc_id AS STRING) AS question, CASE WHEN doc_id % 19 = 0 THEN 'odd' WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'partial' END AS answer_class, doc_id % 3 <> 0 AS supported, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 4 = 0 END AS counts FROM {documents}"
_JFA = f"SELECT source AS scenario, CAST(doc_id AS STRING) AS question, 'f' || CAST(m AS STRING) AS fact_key FROM {{documents}} CROSS JOIN {_FOUR} f WHERE m < doc_id % 4"
_JDE = f"SELECT source AS scenario, CAST(doc_id AS STRING) AS question, 'f' || CAST(m AS STRING) AS fact_key, (doc_id + m) % 2 = 0 AS in_context, (doc_id + m) % 3 = 0 AS in_answer FROM {{documents}} CROSS JOIN {_FOUR} f WHERE m < doc_id % 4 AND (doc_id + m) % 23 <> 0 OR m = 3 AND doc_id % 29 = 0"
_JK = ["scenario", "question"]


def _judged(spark, d):
    return summaries.judgement_coherence(_view(spark, d, _JUD), _view(spark, d, _JDE), _view(spark, d, _JFA), _JK, ["complete", "partial"])


def judgement_coverage(spark, d):
    return _judged(spark, d)[0]


def judgement_violations(spark, d):
    return _judged(spark, d)[1].select("code", "key")


def tidy_metrics(spark, d):
    """A nested summary of each source as numbers with paths."""
    x = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.sum("n_chars").alias("chars"))
    nested = x.select("source", F.struct(F.col("n").alias("count"), F.struct(F.col("en").alias("num"), ratio(F.col("en"), F.col("n")).alias("rate")).alias("english")).alias("documents"), F.col("chars"))
    return summaries.tidy(nested, ["source"])


def rotations(spark, d):
    """Which of four families a case leaves out and the field that a distractor shows in its place."""
    x = table(spark, d, "documents").select("doc_id", F.map_from_arrays(F.array(F.lit("b"), F.lit("a"), F.col("source")), F.array(F.lit("vb"), F.lit("va"), F.col("lang"))).alias("fields"))
    name, value = resample.distractor(F.col("fields"), F.when(F.col("doc_id") % 3 == 0, F.lit("src1")).when(F.col("doc_id") % 3 == 1, F.lit("b")).otherwise(F.lit("zz")))
    return x.select("doc_id", resample.rotation("20260923:questions", F.col("doc_id"), 4).alias("shift"), name.alias("field"), value.alias("value"))


QUERIES = {
    "pilot_metrics": (pilot_metrics, f"""{_ctes(o=_PIL)}, t AS ({_tidy_sql('o', 'mode', _SEVEN)}) SELECT *, round(num / nullif(den, 0)::DOUBLE, 6) AS rate FROM t WHERE mode <> 'FULL_HISTORY' OR metric NOT IN ('retrieval_success_rate', 'answer_success_rate')"""),
    "corpus_totals": (corpus_totals, f"{_ctes(o=_PIL)} SELECT count(*) AS annotations, count(DISTINCT question) AS questions, count(DISTINCT scenario) AS scenarios FROM o"),
    "handoff_block": (handoff_block, f"""{_ctes(o=_HAN)}, t AS ({_tidy_sql('o', 'model, condition, grp', _HB)}
  UNION ALL SELECT model, condition, grp, 'evidence_facts_in_corpus', sum(facts_in_corpus)::BIGINT, sum(facts_total)::BIGINT FROM o GROUP BY ALL UNION ALL SELECT model, condition, grp, 'evidence_facts_in_context', sum(facts_in_context)::BIGINT, sum(facts_total)::BIGINT FROM o GROUP BY ALL)
SELECT *, round(num / nullif(den, 0)::DOUBLE, 6) AS rate FROM t"""),
    "variant_summary": (variant_summary, f"{_ctes(o=_VAR)} SELECT scenario, mode, count(*) AS cells, round(avg(context_tokens), 1) AS mean_tokens, round(avg(context_items), 1) AS mean_items, {_eight_sql()} FROM o GROUP BY scenario, mode"),
    "oracle_coverage": (oracle_coverage, f"""{_ctes(f=_FAC, c=_CON)}, p AS (SELECT question, condition, fact, bool_and((condition, session) IN (SELECT * FROM c)) AS inside FROM f CROSS JOIN (SELECT DISTINCT condition FROM c) k GROUP BY ALL)
SELECT question, condition, count(*) AS facts, count(*) FILTER (WHERE inside) AS facts_in_corpus, CASE WHEN bool_and(inside) THEN 'answered' ELSE 'insufficient' END AS expected_status FROM p GROUP BY question, condition"""),
    "budget_warnings": (budget_warnings, f"{_ctes(o=_CHG)} SELECT scenario, mode, array_to_string(list_filter([{_WARN}], lambda v: v IS NOT NULL), ',') AS warnings FROM o"),
    "judgement_coverage": (judgement_coverage, f"""{_ctes(j=_JUD, f=_JFA, d=_JDE)}, p AS (SELECT scenario, question, count(*) AS n, count(*) FILTER (WHERE in_context) AS c, count(*) FILTER (WHERE in_answer) AS a FROM f LEFT JOIN d USING (scenario, question, fact_key) GROUP BY ALL)
SELECT scenario, question, coalesce(c, 0) || '/' || coalesce(n, 0) AS coverage_in_context, coalesce(a, 0) || '/' || coalesce(n, 0) AS coverage_in_answer, answer_class = 'complete' AND supported AS complete_and_supported FROM j LEFT JOIN p USING (scenario, question)"""),
    "judgement_violations": (judgement_violations, f"""{_ctes(j=_JUD, f=_JFA, d=_JDE)}
{_against('f', 'd', 'E-DETAIL-MISSING', 'E-NONE', [], 'E-DETAIL-UNKNOWN', 'scenario, question, fact_key', "scenario || '|' || question || '|' || fact_key")}
UNION ALL {_rules('j', "scenario || '|' || question", {'E-CLASS': "answer_class IN ('complete', 'partial')", 'E-COUNTS': "counts IS NULL OR counts = (answer_class = 'complete' AND supported)"})}"""),
    "tidy_metrics": (tidy_metrics, """WITH x AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS en, sum(n_chars) AS c FROM documents GROUP BY source)
SELECT source, 'documents.count' AS path, n::DOUBLE AS value FROM x UNION ALL SELECT source, 'documents.english.num', en::DOUBLE FROM x UNION ALL SELECT source, 'documents.english.rate', round(en / n::DOUBLE, 6) FROM x UNION ALL SELECT source, 'chars', c::DOUBLE FROM x"""),
    "rotations": (rotations, """SELECT doc_id, ('0x' || substr(sha256('20260923:questions:' || doc_id), 1, 8))::BIGINT % 4 AS shift, CASE WHEN doc_id % 3 = 0 AND source = 'src1' THEN 'src1' WHEN doc_id % 3 = 1 THEN 'b' ELSE 'a' END AS field,
  CASE WHEN doc_id % 3 = 0 AND source = 'src1' THEN lang WHEN doc_id % 3 = 1 THEN 'vb' ELSE 'va' END AS value FROM documents"""),
}
