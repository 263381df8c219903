"""Queries on ranking, budgets, tiers, perimeters and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import count_tokens, ordered_join
from ..operators import budget, evaluate, perimeter, ranking
from ..operators.perimeter import HISTORY_MARKERS
from .common import BUDGET, R_SQL, T_SQL, count_sql, ranked, rendered, scored, scores_sql, table, turns

KEY = ["conv_id"]
#: The invented prose has no real questions, so neutral parts of words join the markers.
MARKERS = (*HISTORY_MARKERS, "re th", "que la", "der st")


def tokens_count(spark, d):
    parts = [(("pages", "page_id"), "html"), (("documents", "doc_id"), "text"), (("conversations", "conv_id"), "text")]
    rows = None
    for (name, key), text in parts:
        x = table(spark, d, name).groupBy(F.lit(name).alias("source"), F.col(key).alias("id")).agg(F.sum(count_tokens(F.col(text))).alias("tokens"))
        rows = x if rows is None else rows.union(x)
    return rows


def msg_flatten_user_order(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.col("session_order").cast("long").alias("session_order"), count_tokens(F.col("text")).alias("tokens"))


def perimeter_c0_c1_c2(spark, d):
    t = turns(spark, d)
    c = spark.createDataFrame([("C0",), ("C1",), ("C2",)], "condition string")
    n = perimeter.conditions(perimeter.history(t)).groupBy("conv_id", "condition").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("turn")), ",").alias("turns"))
    cells = perimeter.questions(t).select("conv_id").join(F.broadcast(c))
    return cells.join(n, ["conv_id", "condition"], "left").select("conv_id", "condition", F.coalesce("n", F.lit(0)).alias("n_accessible"), F.coalesce("turns", F.lit("")).alias("turns"))


def tfidf_topk_conversations(spark, d):
    t = turns(spark, d)
    docs = perimeter.conditions(perimeter.history(t)).select("conv_id", "condition", "session_order", "text")
    q = perimeter.questions(t).join(docs.select("conv_id", "condition").distinct(), "conv_id")
    s = ranking.cosine_scores(q, docs, ["conv_id", "condition"], ["session_order"])
    top = ranking.top_k(ranking.rank_exact(s, ["conv_id", "condition"], [F.col("session_order")]), 2)
    return top.select("conv_id", "condition", F.col("session_order").cast("long").alias("session_order"), "score", F.col("rank").cast("long").alias("rank"))


def tfidf_perimeters(spark, d):
    """The two best turns of each conversation under each condition, from one pass over the turns' words."""
    t = turns(spark, d)
    docs = perimeter.history(t)
    last = F.col("session_order") == F.col("n_user") - 1
    s = ranking.perimeter_scores(perimeter.questions(t), docs, ["conv_id"], ["session_order"], {"C1": last, "C2": F.lit(True)})
    top = ranking.top_k(ranking.rank_exact(s, ["conv_id", "perimeter"], [F.col("session_order")]), 2)
    return top.select("conv_id", F.col("perimeter").alias("condition"), F.col("session_order").cast("long").alias("session_order"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def tfidf_rank_rounded(spark, d):
    return ranked(spark, d).select("conv_id", F.col("session_order").cast("long").alias("session_order"), "score", F.col("rank").cast("long").alias("rank"))


LANGUAGES = ("de", "en", "es", "fr")


def tfidf_topk_documents_benchmark(spark, d):
    """Each benchmark item asks the documents of one language, which are a corpus of their own."""
    lang = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.pmod("item_id", F.lit(len(LANGUAGES))) + 1).cast("int"))
    q = table(spark, d, "benchmark").select("item_id", "text", lang.alias("lang"))
    s = ranking.top_scores(q, table(spark, d, "documents"), "item_id", "lang", "doc_id", 5)
    return s.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _prefix(spark, d, limit):
    b = F.lit(limit).cast("long")
    x = budget.selection_summary(budget.prefix_within_budget(ranked(spark, d), KEY, b), KEY, "turn")
    return x.select("conv_id", "examined", "n_selected", "context_tokens", F.col("over_budget_first").cast("long").alias("over_budget_first"), "stopped_by", "stop_reason", "selected_items")


def budget_prefix_t(spark, d):
    return _prefix(spark, d, BUDGET)


def budget_unlimited(spark, d):
    return _prefix(spark, d, None)


def full_history(spark, d):
    x = rendered(perimeter.history(turns(spark, d)))
    return x.groupBy("conv_id").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("context_tokens"), F.sum("content_tokens").alias("content_tokens"), F.sha2(ordered_join(F.col("session_order"), F.col("render")), 256).alias("context_sha256"))


def _tiered(spark, d):
    x = ranked(spark, d).withColumn("level", budget.level(F.col("session_order"), F.col("n_user") - 1))
    return budget.two_phase(x.withColumn("item_id", F.col("turn")), KEY, F.lit(BUDGET))


def ger_two_phase(spark, d):
    return _tiered(spark, d).select("conv_id", "turn", "level", F.col("rank").cast("long").alias("rank"), "tokens", F.coalesce(F.col("phase"), F.lit(0)).cast("long").alias("phase"), "selected", "outcome")


def ger_tiers(spark, d):
    return budget.tier_report(_tiered(spark, d), KEY, BUDGET).select("conv_id", "level", "candidates", "quota", "used", "unused", "reused")


def reading_scope(spark, d):
    return turns(spark, d).select("conv_id", "turn", perimeter.scope(F.col("text"), MARKERS).alias("scope"))


def _evidence(t):
    """One earlier turn per conversation, by md5 order, stands for the annotated evidence."""
    k = F.struct(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), F.col("session_order").alias("e"))
    return perimeter.history(t).groupBy("conv_id").agg(F.min(k).alias("k")).select("conv_id", F.col("k.e").alias("evidence"))


def _trials(spark, d):
    t = turns(spark, d)
    docs = perimeter.conditions(perimeter.history(t)).select("conv_id", "condition", "session_order", "text")
    q = perimeter.questions(t).join(docs.select("conv_id", "condition").distinct(), "conv_id")
    r = ranking.rank_exact(ranking.cosine_scores(q, docs, ["conv_id", "condition"], ["session_order"]), ["conv_id", "condition"], [F.col("session_order")])
    per = r.groupBy("conv_id", "condition").agg(F.collect_list("session_order").alias("readable"), F.collect_list(F.when(F.col("rank") <= 2, F.col("session_order"))).alias("retrieved"))
    per = per.join(_evidence(t), "conv_id").withColumn("required", F.array("evidence"))
    reach, success = evaluate.retrieval_outcome(F.col("required"), F.col("readable"), F.col("retrieved"))
    lost, missed = evaluate.evidence_loss(F.col("required"), F.col("readable"), F.col("retrieved"))
    return per.select("conv_id", "condition", "evidence", reach.alias("reachable"), success.alias("success"), F.size(lost).alias("lost"), F.size(missed).alias("missed"))


def retrieval_success(spark, d):
    return _trials(spark, d).select("conv_id", "condition", F.col("evidence").cast("long").alias("evidence"), "reachable", "success")


def evidence_loss(spark, d):
    return _trials(spark, d).groupBy("condition").agg(F.count("*").alias("trials"), F.sum("lost").alias("unreachable"), F.sum("missed").alias("not_retrieved"), F.count_if("success").alias("success"))


def fact_coverage(spark, d):
    """Facts are pairs of neighbouring earlier turns; the corpus is the last half of the memory, the context the budget's
    selection of it."""
    x = budget.prefix_within_budget(ranked(spark, d), KEY, F.lit(BUDGET)).withColumn("message", F.col("session_order"))
    half = x.where(F.col("session_order") * 2 >= F.col("n_user"))
    pair = x.select("conv_id", F.explode(F.array("session_order", F.col("session_order") + 1)).alias("fact"), F.col("session_order").alias("message"), "n_user").where((F.col("fact") > 1) & (F.col("fact") < F.col("n_user")))
    return evaluate.fact_coverage(pair, half, half.where("selected"), KEY)


def added_removed_context(spark, d):
    from ..operators.metrics import set_delta

    r = ranked(spark, d)
    ids = lambda b, n: budget.prefix_within_budget(r, KEY, F.lit(b)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("selected"), F.col("turn")))).alias(n), F.coalesce(F.sum(F.when(F.col("selected"), F.col("tokens"))), F.lit(0)).alias(f"{n}_tokens"))
    x = ids(100, "before").join(ids(200, "after"), "conv_id")
    s = set_delta(F.col("before"), F.col("after"))
    return x.select("conv_id", F.array_join(s["added"], ",").alias("added"), F.array_join(s["removed"], ",").alias("removed"), s["changed"].alias("changed"), (F.col("after_tokens") - F.col("before_tokens")).alias("token_delta"))


def prompt_assembly_hash(spark, d):
    x = budget.prefix_within_budget(ranked(spark, d), KEY, F.lit(BUDGET))
    ctx = x.groupBy("conv_id").agg(ordered_join(F.col("rank"), F.when(F.col("selected"), F.col("render"))).alias("context"))
    q = perimeter.questions(turns(spark, d)).withColumnRenamed("text", "question")
    c = F.when(F.col("context") == "", F.lit("No message is available.")).otherwise(F.col("context"))
    prompt = F.concat(F.lit("SYSTEM\nAnswer from the context only.\n\nUSER\nContext:\n"), c, F.lit("\n\nQuestion: "), F.col("question"))
    return ctx.join(q, "conv_id").select("conv_id", F.sha2(prompt, 256).alias("prompt_sha256"), count_tokens(prompt).alias("prompt_tokens"))


def context_size_by_length(spark, d):
    """Mean items, content and overhead tokens of the budgeted contexts, by number of user turns."""
    x = budget.prefix_within_budget(ranked(spark, d), KEY, F.lit(BUDGET)).where("selected")
    per = x.groupBy("conv_id", "n_user").agg(F.count("*").alias("items"), F.sum("content_tokens").alias("content"), F.sum(F.col("tokens") - F.col("content_tokens")).alias("overhead"))
    return per.groupBy(F.col("n_user").cast("long").alias("n_user")).agg(F.count("*").alias("contexts"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("items", "content", "overhead")])


def recency_levels(spark, d):
    t = perimeter.history(turns(spark, d))
    reached, basis = perimeter.session_reached(F.when(F.col("conv_id") % 2 == 0, F.col("n_user")), F.col("session_order"), KEY)
    return t.select("conv_id", "turn", budget.level(F.col("session_order"), reached).alias("level"), basis.alias("basis"))


def _prefix_sql(limit: str) -> str:
    fits = "true" if limit == "NULL" else f"(cum <= {limit} OR rank = 1)"
    over = "false" if limit == "NULL" else f"(rank = 1 AND score > 0 AND tokens > {limit})"
    return f"""WITH {R_SQL},
  c AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank) AS cum FROM r),
  p AS (SELECT *, score > 0 AND {fits} AS selected, {over} AS over_first FROM c)"""


def _summary_sql(limit: str) -> str:
    return f"""{_prefix_sql(limit)}
SELECT conv_id, count(*) AS examined, count(*) FILTER (WHERE selected) AS n_selected, coalesce(sum(tokens) FILTER (WHERE selected), 0)::BIGINT AS context_tokens,
  max(over_first::INT)::BIGINT AS over_budget_first, min_by(turn, rank) FILTER (WHERE NOT selected) AS stopped_by,
  min_by(CASE WHEN score <= 0 THEN 'zero score' ELSE 'does not fit' END, rank) FILTER (WHERE NOT selected) AS stop_reason,
  coalesce(string_agg(turn::VARCHAR, ',' ORDER BY rank) FILTER (WHERE selected), '') AS selected_items
FROM p GROUP BY conv_id"""


TIERS_SQL = f"""WITH {R_SQL},
  a AS (SELECT *, CASE WHEN session_order >= n_user - 1 - 1 THEN 'recent' ELSE 'archive' END AS level, score > 0 AS ok FROM r),
  b AS (SELECT *, CASE WHEN level = 'recent' THEN {BUDGET // 2} ELSE {BUDGET - BUDGET // 2} END AS quota,
    sum(CASE WHEN ok THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id, level ORDER BY rank) AS c1 FROM a),
  c AS (SELECT *, ok AND c1 <= quota AS one FROM b),
  e AS (SELECT *, coalesce(sum(CASE WHEN one THEN tokens END) OVER (PARTITION BY conv_id), 0) AS used,
    sum(CASE WHEN ok AND NOT one THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY rank) AS c2 FROM c),
  f AS (SELECT *, ok AND NOT one AND used + c2 <= {BUDGET} AS two FROM e),
  g AS (SELECT *, min(CASE WHEN ok AND NOT one AND NOT two THEN rank END) OVER (PARTITION BY conv_id) AS closes FROM f)"""

_TRIALS = f"""WITH {T_SQL},
  dc AS (SELECT h.*, c.condition FROM h JOIN (VALUES ('C1'), ('C2')) c(condition) ON c.condition = 'C2' OR session_order = n_user - 1),
  qc AS (SELECT DISTINCT q.conv_id, condition, q.text FROM q JOIN dc USING (conv_id)),
  {scores_sql('qc', 'dc', 'conv_id, condition', 'session_order')},
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, condition ORDER BY round(score, 12) DESC, session_order) AS rank FROM s),
  ev AS (SELECT conv_id, arg_min(session_order, md5(conv_id || ':' || turn)) AS evidence FROM h GROUP BY conv_id),
  tr AS (SELECT r.conv_id, condition, any_value(evidence) AS evidence, bool_or(session_order = evidence) AS reachable,
    CASE WHEN bool_or(session_order = evidence) THEN bool_or(session_order = evidence AND rank <= 2) END AS success
    FROM r JOIN ev USING (conv_id) GROUP BY r.conv_id, condition)"""

_BENCH = """WITH items AS (SELECT item_id, text, ['de', 'en', 'es', 'fr'][item_id % 4 + 1] AS lang FROM benchmark),
  tf AS (SELECT lang, doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_-]+')) AS term FROM documents WHERE lang IS NOT NULL) GROUP BY ALL),
  n AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang),
  idf AS (SELECT lang, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN n USING (lang) GROUP BY lang, term),
  dw AS (SELECT lang, doc_id, term, tf * idf AS w FROM tf JOIN idf USING (lang, term)),
  norm AS (SELECT lang, doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY ALL),
  qt AS (SELECT item_id, lang, term, count(*)::DOUBLE AS tf FROM (SELECT item_id, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9_-]+')) AS term FROM items) GROUP BY ALL),
  qw AS (SELECT item_id, lang, term, tf * idf AS qw FROM qt JOIN idf USING (lang, term)),
  qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY item_id),
  s AS (SELECT item_id, doc_id, sum(w * qw) / any_value(norm) / any_value(qnorm) AS score FROM dw JOIN qw USING (lang, term) JOIN norm USING (lang, doc_id) JOIN qn USING (item_id) GROUP BY item_id, doc_id),
  r AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 5"""

LIKES_SQL = " OR ".join("contains(lower(text), '{}')".format(m.replace("'", "''")) for m in MARKERS)
_DELTA = f"""WITH {R_SQL}, c AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank) AS cum FROM r),
  p AS (SELECT conv_id, turn, tokens, score > 0 AND (cum <= 100 OR rank = 1) AS a, score > 0 AND (cum <= 200 OR rank = 1) AS b FROM c)
SELECT conv_id, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE b AND NOT a), '') AS added,
  coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE a AND NOT b), '') AS removed, bool_or(a <> b) AS changed,
  (coalesce(sum(tokens) FILTER (WHERE b), 0) - coalesce(sum(tokens) FILTER (WHERE a), 0))::BIGINT AS token_delta FROM p GROUP BY conv_id"""
_PROMPT = "('SYSTEM' || chr(10) || 'Answer from the context only.' || chr(10) || chr(10) || 'USER' || chr(10) || 'Context:' || chr(10) || coalesce(context, 'No message is available.') || chr(10) || chr(10) || 'Question: ' || text)"

QUERIES = {
    "tokens_count": (tokens_count, " UNION ALL ".join(f"SELECT '{t}' AS source, {k} AS id, sum({count_sql(x)})::BIGINT AS tokens FROM {t} GROUP BY {k}" for t, k, x in (("pages", "page_id", "html"), ("documents", "doc_id", "text"), ("conversations", "conv_id", "text")))),
    "msg_flatten_user_order": (msg_flatten_user_order, f"WITH {T_SQL} SELECT conv_id, turn, session_order, {count_sql('text')} AS tokens FROM u"),
    "perimeter_c0_c1_c2": (perimeter_c0_c1_c2, f"""WITH {T_SQL}
SELECT q.conv_id, condition, count(h.turn) AS n_accessible, coalesce(string_agg(h.turn::VARCHAR, ',' ORDER BY h.turn), '') AS turns
FROM q CROSS JOIN (VALUES ('C0'), ('C1'), ('C2')) c(condition) LEFT JOIN h ON h.conv_id = q.conv_id AND (condition = 'C2' OR condition = 'C1' AND session_order = n_user - 1) GROUP BY ALL"""),
    "tfidf_topk_conversations": (tfidf_topk_conversations, f"{_TRIALS} SELECT conv_id, condition, session_order, round(score, 6) AS score, rank FROM r WHERE rank <= 2"),
    "tfidf_perimeters": (tfidf_perimeters, f"{_TRIALS} SELECT conv_id, condition, session_order, round(score, 6) AS score, rank FROM r WHERE rank <= 2"),
    "tfidf_rank_rounded": (tfidf_rank_rounded, f"WITH {R_SQL} SELECT conv_id, session_order, score, rank FROM r"),
    "tfidf_topk_documents_benchmark": (tfidf_topk_documents_benchmark, _BENCH),
    "budget_prefix_t": (budget_prefix_t, _summary_sql(str(BUDGET))),
    "budget_unlimited": (budget_unlimited, _summary_sql("NULL")),
    "full_history": (full_history, f"""WITH {T_SQL}, x AS (SELECT *, '[' || conv_id || '-' || turn || '] ' || text AS render FROM h)
SELECT conv_id, count(*) AS n_items, sum({count_sql('render')})::BIGINT AS context_tokens, sum({count_sql('text')})::BIGINT AS content_tokens, sha256(string_agg(render, chr(10) ORDER BY session_order)) AS context_sha256 FROM x GROUP BY conv_id"""),
    "ger_two_phase": (ger_two_phase, f"""{TIERS_SQL} SELECT conv_id, turn, level, rank, tokens, CASE WHEN one THEN 1 WHEN two THEN 2 ELSE 0 END::BIGINT AS phase, one OR two AS selected,
  CASE WHEN NOT ok THEN 'zero score' WHEN one THEN 'quota' WHEN two THEN 'reuse' WHEN rank = closes AND tokens > {BUDGET} THEN 'above the budget' WHEN rank = closes THEN 'no room left' ELSE 'closed' END AS outcome FROM g"""),
    "ger_tiers": (ger_tiers, f"""{TIERS_SQL} SELECT conv_id, level, count(*) FILTER (WHERE ok) AS candidates, any_value(quota)::BIGINT AS quota, coalesce(sum(tokens) FILTER (WHERE one), 0)::BIGINT AS used,
  any_value(quota)::BIGINT - coalesce(sum(tokens) FILTER (WHERE one), 0)::BIGINT AS unused, coalesce(sum(tokens) FILTER (WHERE two), 0)::BIGINT AS reused FROM g GROUP BY conv_id, level"""),
    "reading_scope": (reading_scope, f"WITH {T_SQL} SELECT conv_id, turn, CASE WHEN {LIKES_SQL} THEN 'history' ELSE 'current' END AS scope FROM u"),
    "retrieval_success": (retrieval_success, f"{_TRIALS} SELECT * FROM tr"),
    "evidence_loss": (evidence_loss, f"{_TRIALS} SELECT condition, count(*) AS trials, count(*) FILTER (WHERE NOT reachable) AS unreachable, count(*) FILTER (WHERE reachable AND NOT success) AS not_retrieved, count(*) FILTER (WHERE success) AS success FROM tr GROUP BY condition"),
    "fact_coverage": (fact_coverage, f"""{_prefix_sql(str(BUDGET))},
  f AS (SELECT conv_id, session_order + k AS fact, session_order * 2 >= n_user AS inc, session_order * 2 >= n_user AND selected AS inx, n_user FROM p CROSS JOIN (VALUES (0), (1)) v(k)),
  g AS (SELECT conv_id, fact, bool_and(inc) AS c, bool_and(inx) AS x FROM f WHERE fact > 1 AND fact < n_user GROUP BY conv_id, fact)
SELECT conv_id, count(*) AS facts, count(*) FILTER (WHERE c) AS facts_in_corpus, count(*) FILTER (WHERE x) AS facts_in_context, count(*) FILTER (WHERE c) - count(*) FILTER (WHERE x) AS retrieval_loss FROM g GROUP BY conv_id"""),
    "added_removed_context": (added_removed_context, _DELTA),
    "prompt_assembly_hash": (prompt_assembly_hash, f"""{_prefix_sql(str(BUDGET))}, x AS (SELECT conv_id, string_agg(render, chr(10) ORDER BY rank) FILTER (WHERE selected) AS context FROM p GROUP BY conv_id)
SELECT conv_id, sha256({_PROMPT}) AS prompt_sha256, {count_sql(_PROMPT)} AS prompt_tokens FROM x JOIN q USING (conv_id)"""),
    "context_size_by_length": (context_size_by_length, f"""{_prefix_sql(str(BUDGET))}, x AS (SELECT conv_id, n_user, count(*) AS items, sum(content_tokens) AS content, sum(tokens - content_tokens) AS overhead FROM p WHERE selected GROUP BY ALL)
SELECT n_user, count(*) AS contexts, round(avg(items), 6) AS mean_items, round(avg(content), 6) AS mean_content, round(avg(overhead), 6) AS mean_overhead FROM x GROUP BY n_user"""),
    "recency_levels": (recency_levels, f"""WITH {T_SQL} SELECT conv_id, turn, CASE WHEN session_order >= CASE WHEN conv_id % 2 = 0 THEN n_user ELSE max(session_order) OVER (PARTITION BY conv_id) END - 1 THEN 'recent' ELSE 'archive' END AS level,
  CASE WHEN conv_id % 2 = 0 THEN 'declared' ELSE 'fallback' END AS basis FROM h"""),
}
