"""Queries on evaluation and metrics.  Labels joined to documents stand for outcomes, sources for conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parse import parse_embedded_array, parse_many_values, parse_one_value, parse_status_answer
from ..functions.text import normalised_value, percent, ratio
from ..operators import evaluate, metrics, resample
from ..operators.metrics import Metric
from .common import table

REPETITIONS = 10_000


def _outcomes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    x = docs.join(table(spark, d, "labels"), "doc_id")
    return x.withColumn("long", F.col("n_chars") >= 1500).withColumn("good", F.col("quality") == 1).withColumn("bad", F.col("toxic") == 1)


def _metrics():
    good, bad, long = F.col("good"), F.col("bad"), F.col("long")
    return [Metric("good", good), Metric("good_given_long", good, long), Metric("toxic_given_good", bad, good), Metric("abstained", ~long, ~good), Metric("never", good, F.lit(False))]


def metrics_by_condition(spark, d):
    return metrics.rates(_outcomes(spark, d), ["source"], _metrics())


def rate_table_grouping_sets(spark, d):
    return metrics.rates(_outcomes(spark, d), ["lang", "source"], _metrics(), [["source"], ["lang", "source"], []])


def micro_precision_recall(spark, d):
    x = _outcomes(spark, d)
    hit = lambda a, b: (a & b).cast("long")
    p, r = metrics.micro(hit(F.col("long"), F.col("good")), hit(F.col("long"), ~F.col("good")), hit(~F.col("long"), F.col("good")))
    return x.groupBy("lang").agg(p.alias("precision"), r.alias("recall"), F.count("*").alias("n"))


def paired_2x2(spark, d):
    x = _outcomes(spark, d).select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("condition"), F.col("good").alias("hit")), F.struct(F.lit("toxic").alias("condition"), F.col("bad").alias("hit")))).alias("x")).select("doc_id", "x.*")
    return metrics.paired_table(x, "doc_id", "condition", "quality", "toxic", F.col("hit"))


def contamination(spark, d):
    """Share of other languages among each source's documents, as a ratio of sums."""
    x = table(spark, d, "documents").select("source", (F.col("lang") != "en").cast("long").alias("foreign"), F.lit(1).cast("long").alias("one"))
    return metrics.ratio_of_sums(x, ["source"], "foreign", "one")


def latency_stats(spark, d):
    return metrics.latency(table(spark, d, "events").where(F.col("value").isNotNull()), ["event_type"], "value")


def answer_rates_4dp(spark, d):
    """Rates to four digits with percentages to one."""
    x = _outcomes(spark, d)
    n, m = F.count_if("good"), F.count("*")
    return x.groupBy("lang").agg(n.alias("num"), m.alias("den"), ratio(n, m, 4).alias("rate"), percent(n, m).alias("percent"))


def _clusters(spark, d):
    x = _outcomes(spark, d)
    one = lambda c: c.cast("long")
    lang = lambda cond: cond.cast("long")
    en = F.col("lang") == "en"
    return resample.cluster_table(x, "source", {"num_a": one(F.col("good") & en), "den_a": lang(en), "num_b": one(F.col("good") & ~en), "den_b": lang(~en)})


def bootstrap_ci_hash(spark, d):
    c = _clusters(spark, d)
    return resample.paired_effect(c, resample.hash_draws(c, REPETITIONS, "20260922"))


def bootstrap_ci_mt(spark, d):
    c = _clusters(spark, d)
    return resample.paired_effect(c, resample.twister_draws(c, REPETITIONS, 20260922))


#: Answers as models give them, good and bad, for each of the strict parsers.
ANSWERS = (
    '{"value": "x"}', '{"value": null}', '{"value": 3}', '{"value": "x", "more": 1}', "{}", "no json", "[1]", "",
    '{"values": ["a", "b"]}', '{"values": []}', '{"values": "a"}', '{"values": [1]}', '{"values": ["a"], "z": 0}',
    '{"status": "answered", "answer": "a"}', '{"status": "other", "answer": "a"}', '{"status": "abstained"}', '{"status": "answered", "answer": 1}',
    '```json\n[{"a": 1}, 2]\n```', 'text [1, 2] text', '{"value": "x"} tail',
)
#: What the parsers say of them: (one value, many values, status and answer, number of embedded elements or -1).
SAID = (
    ("x", "missing_values_key", "missing_keys:answer,status", -1), ("null", "missing_values_key", "missing_keys:answer,status", -1), ("value_type:int", "missing_values_key", "missing_keys:answer,status", -1), ("extra_keys:more", "missing_values_key", "missing_keys:answer,status", -1),
    ("missing_value_key", "missing_values_key", "missing_keys:answer,status", -1), ("not_json", "not_json", "not_json", -1), ("not_json_object", "not_json_object", "not_json_object", 1), ("empty_text", "empty_content", "empty_text", -1),
    ("missing_value_key", "a+b", "missing_keys:answer,status", 2), ("missing_value_key", "", "missing_keys:answer,status", 0), ("missing_value_key", "values_not_list", "missing_keys:answer,status", -1), ("missing_value_key", "values_not_list_of_strings", "missing_keys:answer,status", 1), ("missing_value_key", "extra_keys:z", "missing_keys:answer,status", 1),
    ("missing_value_key", "missing_values_key", "answered=a", -1), ("missing_value_key", "missing_values_key", "status_not_allowed:'other'", -1), ("missing_value_key", "missing_values_key", "missing_keys:answer", -1), ("missing_value_key", "missing_values_key", "answer_type:int", -1),
    ("not_json", "not_json", "not_json", 2), ("not_json", "not_json", "not_json", 2), ("not_json", "not_json", "not_json", -1),
)


def strict_json_parse(spark, d):
    """Each document's id picks one of the answers; all parsers read it.  Errors in their words, values otherwise."""
    x = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ANSWERS)), (F.pmod("doc_id", F.lit(len(ANSWERS))) + 1).cast("int")).alias("t"))
    x = x.select("doc_id", parse_one_value("t").alias("a"), parse_many_values("t").alias("b"), parse_status_answer(F.col("t"), ("answered", "abstained")).alias("c"), parse_embedded_array("t").alias("r"))
    one = F.coalesce("a.error", "a.value", F.lit("null"))
    return x.select("doc_id", one.alias("one"), F.coalesce("b.error", F.array_join("b.values", "+")).alias("many"), F.coalesce("c.error", F.concat_ws("=", "c.status", "c.answer")).alias("answer"), F.coalesce(F.size("r"), F.lit(-1)).cast("long").alias("embedded"))


def answers_exact_match(spark, d):
    """Cells of one-value answers: expected is a document's language, the answer is derived from its id, so every cause
    of error occurs."""
    x = table(spark, d, "documents").select(F.col("doc_id").alias("cell_id"), "source", "lang", "doc_id")
    m = F.col("doc_id") % 7
    content = F.when(m == 0, F.lit('{"value": null}')).when(m == 1, F.lit("not json")).when(m == 2, F.lit('{"value": "xx"}')).otherwise(F.concat(F.lit('{"value": " '), F.upper("lang"), F.lit('"}')))
    cells = x.select("cell_id", F.col("source").alias("episode"), F.lit("a").alias("activity"), F.when(m == 6, F.lit("missing")).otherwise(F.lit("ok")).alias("status"), content.alias("content"), F.col("lang").alias("expected"), F.lit("languages: de en es fr").alias("context"), (m != 5).alias("reachable"), F.when(m != 5, F.col("doc_id") % 2 == 0).alias("success"))
    facts = cells.select("episode").distinct().select("episode", F.lit("b").alias("activity"), F.lit("code").alias("field"), F.lit("XX").alias("value"))
    v = evaluate.value_cells(cells, facts)
    return v.groupBy(F.coalesce("cause", F.lit("none")).alias("cause")).agg(F.count("*").alias("n"), F.count_if("exact_match").alias("exact"), F.count_if("confusion").alias("confused"), F.count_if("supported").alias("supported"), F.count_if("null_despite_evidence").alias("null_despite"))


def set_scores_by_pair(spark, d):
    """Set comparison of a part's type words (expected) with its name's words (predicted)."""
    p = table(spark, d, "part").select("p_partkey", F.split(F.lower("p_type"), " ").alias("e"), F.split(F.lower("p_name"), " ").alias("p"))
    s = evaluate.set_scores(F.col("e"), F.col("p"), F.array(F.lit("steel"), F.lit("green")))
    return p.select("p_partkey", *[c.alias(n) for n, c in s.items()])


def label_fragmentation(spark, d):
    """Words of a part's name that are pieces of its type."""
    p = table(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("p"), F.array(F.lower("p_type")).alias("e"))
    return p.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(metrics.fragments(F.col("p"), F.col("e"), " "))), ",").alias("fragments"))


def merit_changes(spark, d):
    """Answer classes before and after, by source."""
    x = _outcomes(spark, d)
    cls = lambda a, b: F.when(a & b, F.lit("complete")).when(a, F.lit("complete_unsupported")).when(b, F.lit("partial")).otherwise(F.lit("wrong"))
    x = x.withColumn("change", metrics.merit_change(cls(F.col("good"), F.col("long")), cls(F.col("long"), F.col("good"))))
    n = x.groupBy("source").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("improved", "worse", "equal")])
    return n.withColumn("warnings", F.array_join(metrics.warnings([("W-WORSE", F.col("worse") > F.col("improved")), ("W-STILL", F.col("equal") == 0)]), ","))


def value_normalisation(spark, d):
    """Values as answers are compared: composed, trimmed, caseless."""
    x = table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), F.col("text"), F.lit("\t")).alias("v"))
    return x.select("doc_id", F.md5(normalised_value("v")).alias("md5"))


def judgement_merge(spark, d):
    """Approved judgements by cell; the others are pending."""
    cells = table(spark, d, "documents").select("doc_id")
    j = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("approved")).otherwise(F.lit("proposed")).alias("review"), F.col("toxic").cast("string").alias("judgement"))
    return evaluate.merge_judgements(cells, j, ["doc_id"]).groupBy("judgement").agg(F.count("*").alias("n"))


def published_reconciliation(spark, d):
    """Order totals against their lines, to a cent a line: keys that differ."""
    li = table(spark, d, "lineitem")
    own = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))), 2).alias("v"))
    told = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("v"))
    return metrics.reconcile(own, told, ["k"], "v").agg(F.count("*").alias("different"), F.count_if(F.col("computed").isNull()).alias("without_lines"))


_OUT = "o AS (SELECT d.doc_id, lang, source, n_chars, n_chars >= 1500 AS long, quality = 1 AS good, toxic = 1 AS bad FROM documents d JOIN labels USING (doc_id))"
_M = {"good": ("true", "good"), "good_given_long": ("long", "good"), "toxic_given_good": ("good", "bad"), "abstained": ("NOT good", "NOT long"), "never": ("false", "good")}


def _rates_sql(group: str, select: str) -> str:
    parts = [f"SELECT {select}, '{n}' AS metric, count(*) FILTER (WHERE {k} AND {h}) AS num, count(*) FILTER (WHERE {k}) AS den FROM o GROUP BY {group}" for n, (k, h) in _M.items()]
    return f"WITH {_OUT}, t AS ({' UNION ALL '.join(parts)}) SELECT *, round(num / nullif(den, 0)::DOUBLE, 6) AS rate FROM t"


_CLU = f"""{_OUT}, c AS (SELECT source, sum((good AND lang = 'en')::INT)::DOUBLE AS na, sum((lang = 'en')::INT)::DOUBLE AS da, sum((good AND lang <> 'en')::INT)::DOUBLE AS nb, sum((lang <> 'en')::INT)::DOUBLE AS db, row_number() OVER (ORDER BY source) - 1 AS slot FROM o GROUP BY source),
  g AS (SELECT rep, k, (('0x' || substr(md5('20260922:' || rep || ':' || k), 1, 8))::BIGINT % n) AS slot FROM (SELECT count(*) AS n FROM c), range(10000) r(rep), LATERAL (SELECT unnest(range(n)) AS k)),
  e AS (SELECT rep, round(100 * (sum(na) / nullif(sum(da), 0) - sum(nb) / nullif(sum(db), 0)), 6) AS d FROM g JOIN c USING (slot) GROUP BY rep),
  l AS (SELECT list_sort(list(d)) AS v FROM e WHERE d IS NOT NULL)"""

_q = lambda v: "'" + v.replace("'", "''") + "'"
_SAID_SQL = f"""WITH said(k, one, many, answer, embedded) AS (VALUES {', '.join(f"({k}, {_q(a)}, {_q(b)}, {_q(c)}, {n}::BIGINT)" for k, (a, b, c, n) in enumerate(SAID))})
SELECT doc_id, one, many, answer, embedded FROM documents JOIN said ON k = doc_id % {len(ANSWERS)}"""

QUERIES = {
    "metrics_by_condition": (metrics_by_condition, _rates_sql("source", "source")),
    "rate_table_grouping_sets": (rate_table_grouping_sets, _rates_sql("GROUPING SETS ((source), (lang, source), ())", "CASE WHEN grouping(lang) = 1 THEN 'all' ELSE coalesce(lang, 'null') END AS lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE coalesce(source, 'null') END AS source")),
    "micro_precision_recall": (micro_precision_recall, f"WITH {_OUT} SELECT lang, round(count(*) FILTER (WHERE long AND good) / nullif(count(*) FILTER (WHERE long), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (WHERE long AND good) / nullif(count(*) FILTER (WHERE good), 0)::DOUBLE, 6) AS recall, count(*) AS n FROM o GROUP BY lang"),
    "paired_2x2": (paired_2x2, f"WITH {_OUT}, x AS (SELECT doc_id, bool_or(good) AS a, bool_or(bad) AS b FROM o GROUP BY doc_id) SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM x"),
    "contamination": (contamination, "SELECT source, sum((lang <> 'en')::INT)::BIGINT AS num, count(*) AS den, round(sum((lang <> 'en')::INT) / count(*)::DOUBLE, 6) AS rate FROM documents GROUP BY source"),
    "latency_stats": (latency_stats, "SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(list_sort(list(value))[floor(0.95 * (count(*) - 1))::BIGINT + 1], 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type"),
    "answer_rates_4dp": (answer_rates_4dp, f"WITH {_OUT} SELECT lang, count(*) FILTER (WHERE good) AS num, count(*) AS den, round(count(*) FILTER (WHERE good) / count(*)::DOUBLE, 4) AS rate, round(100 * count(*) FILTER (WHERE good) / count(*)::DOUBLE, 1) AS percent FROM o GROUP BY lang"),
    "bootstrap_ci_hash": (bootstrap_ci_hash, f"WITH {_CLU} SELECT round(100 * ((SELECT sum(na) / nullif(sum(da), 0) FROM c) - (SELECT sum(nb) / nullif(sum(db), 0) FROM c)), 6) AS effect, v[floor(0.025 * (len(v) - 1))::BIGINT + 1] AS low, v[floor(0.975 * (len(v) - 1))::BIGINT + 1] AS high, len(v)::BIGINT AS reps FROM l"),
    "bootstrap_ci_mt": (bootstrap_ci_mt, None),
    "strict_json_parse": (strict_json_parse, _SAID_SQL),
    "answers_exact_match": (answers_exact_match, """WITH x AS (SELECT doc_id, lang, doc_id % 7 AS m, doc_id % 7 <> 5 AS reachable, CASE WHEN doc_id % 7 <> 5 THEN doc_id % 2 = 0 END AS success FROM documents),
  y AS (SELECT *, m IN (3, 4, 5) AND lang IS NOT NULL AS exact FROM x),
  z AS (SELECT *, CASE WHEN exact THEN 'none' WHEN m = 6 THEN 'missing_response' WHEN NOT reachable THEN 'evidence_unreachable' WHEN NOT success THEN 'retrieval' WHEN m = 1 THEN 'format' ELSE 'generation' END AS cause FROM y)
SELECT cause, count(*) AS n, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE m = 2) AS confused, count(*) FILTER (WHERE m IN (3, 4, 5)) AS supported, count(*) FILTER (WHERE m = 0 AND success) AS null_despite FROM z GROUP BY cause"""),
    "set_scores_by_pair": (set_scores_by_pair, """WITH x AS (SELECT p_partkey, list_distinct(string_split(lower(p_type), ' ')) AS e, list_distinct(string_split(lower(p_name), ' ')) AS p FROM part),
  y AS (SELECT *, list_filter(p, lambda v: NOT list_contains(e, v)) AS extra, list_filter(e, lambda v: NOT list_contains(p, v)) AS miss FROM x)
SELECT p_partkey, len(extra) = 0 AND len(miss) = 0 AS exact, (len(p) - len(extra))::BIGINT AS tp, len(extra)::BIGINT AS fp, len(miss)::BIGINT AS fn, len(extra) > 0 AS unsupported, list_has_any(extra, ['steel', 'green']) AS intrusion FROM y"""),
    "label_fragmentation": (label_fragmentation, """WITH x AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS p, lower(p_type) AS e FROM part)
SELECT p_partkey, coalesce(string_agg(DISTINCT p, ',' ORDER BY p) FILTER (WHERE p <> e AND (list_contains(string_split(e, ' '), p) OR contains(e, p))), '') AS fragments FROM x GROUP BY p_partkey"""),
    "merit_changes": (merit_changes, f"""WITH {_OUT}, x AS (SELECT source, CASE WHEN good AND long THEN 2.0 WHEN good THEN 1.5 WHEN long THEN 1.0 ELSE 0.0 END AS a, CASE WHEN good AND long THEN 2.0 WHEN long THEN 1.5 WHEN good THEN 1.0 ELSE 0.0 END AS b FROM o),
  y AS (SELECT source, count(*) FILTER (WHERE b > a) AS improved, count(*) FILTER (WHERE b < a) AS worse, count(*) FILTER (WHERE a = b) AS equal FROM x GROUP BY source)
SELECT *, array_to_string(list_filter([CASE WHEN worse > improved THEN 'W-WORSE' END, CASE WHEN equal = 0 THEN 'W-STILL' END], lambda v: v IS NOT NULL), ',') AS warnings FROM y"""),
    "value_normalisation": (value_normalisation, None),
    "judgement_merge": (judgement_merge, "SELECT CASE WHEN quality = 1 THEN coalesce(toxic::VARCHAR, 'pending') ELSE 'pending' END AS judgement, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "published_reconciliation": (published_reconciliation, """WITH a AS (SELECT l_orderkey AS k, round(sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)), 2) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS v FROM orders)
SELECT count(*) AS different, count(*) FILTER (WHERE a.k IS NULL) AS without_lines FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v"""),
}
