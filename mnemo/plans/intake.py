"""Queries on raw records and proposals.

Events stand for records and proposals: a user is a scenario, event_id modulo 20 a slot or session; a proposal cites the
fact of its own event unless the event's number is divisible by 7.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, intake, quality
from .common import table, turns

FAMILIES = [(r"^kind\.", "kind"), (r"^place", "place")]


def _slots(spark, d):
    """Labels per user and slot; a view counts as an unknown label."""
    label = F.when(F.col("event_type") == "view", "Unknown").otherwise(F.concat(F.lit(" "), "event_type"))
    return table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 20).alias("slot")).agg(F.collect_list(label).alias("labels"), F.count("*").alias("n"))


def known_label_lists(spark, d):
    return _slots(spark, d).select("user_id", "slot", F.array_join(intake.known_list(F.col("labels")), ",").alias("labels"))


def label_families(spark, d):
    x = _slots(spark, d).withColumn("n_label", F.array(F.when(F.col("n") > 3, F.col("n").cast("string")).otherwise("n/a")))
    fields = intake.available_fields({"kind.variety": F.col("labels"), "place.label": F.col("n_label")})
    return x.select("user_id", "slot", F.array_join(intake.families(fields, FAMILIES), ",").alias("families"))


def flagged_records(spark, d):
    docs = table(spark, d, "documents")
    hit = intake.flagged(F.array("lang", "source"), "de", F.col("text"), "password|licen[cs]e")
    return docs.groupBy("source").agg(F.count("*").alias("records"), F.count_if(hit).alias("flagged"))


def _proposals(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("scenario"), (F.col("event_id") % 20).cast("string").alias("session"), F.col("event_id").alias("op_order"), "event_type", "ts")
    fact = F.when(F.col("op_order") % 7 == 0, F.lit("F0")).otherwise(F.concat(F.lit("F"), F.col("op_order").cast("string")))
    return e.withColumn("fact_id", fact)


def proposal_register(spark, d):
    """Facts have their event and the half of its number as sources; those of the user's smallest event id on may be
    read."""
    p = _proposals(spark, d)
    first = p.groupBy("scenario").agg(F.min("op_order").alias("first"))
    known = p.where("fact_id <> 'F0'").join(first, "scenario")
    ids = F.array(F.col("op_order").cast("string"), F.expr("CAST(op_order DIV 2 AS STRING)"))
    known = known.select("scenario", "session", "fact_id", ids.alias("source_message_ids"), F.filter(ids, lambda s: s.cast("long") >= F.col("first")).alias("allowed_message_ids"))
    return intake.register(p, known).select("scenario", "op_id", "has_fact", "provenance_valid", "provenance_problem")


def retry_links(spark, d):
    """Events of one user and slot are attempts on one fact; errors are rejected."""
    w = Window.partitionBy("scenario", "session").orderBy("ts", "op_order")
    p = _proposals(spark, d).withColumn("fact_id", F.lit("F")).withColumn("attempt", F.row_number().over(w)).withColumn("op_id", F.col("op_order").cast("string"))
    x = intake.retries(p.withColumn("applied", F.col("event_type") != "error"))
    return x.select("scenario", "session", "attempt", "op_id", "applied", "retry_of", "retried_by")


def relation_trace(spark, d):
    """Relations between a user turn and the next but one; items are windows of three user turns."""
    t = turns(spark, d).select("conv_id", "session_order")
    both = lambda *steps: F.array(*[(F.col("session_order") + k).cast("string") for k in steps])
    relations = t.select("conv_id", F.col("session_order").cast("string").alias("relation_id"), both(0, 2).alias("source_message_ids"))
    items = t.where("session_order % 2 = 1").select("conv_id", F.col("session_order").cast("string").alias("item_id"), both(0, 1, 2).alias("source_message_ids"))
    return graph.relation_trace(relations, items, ["conv_id"])


def run_compatibility(spark, d):
    """Orders against a run in which some statuses (declared) and some totals (not declared) differ."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("total"))
    k = F.col("o_orderkey")
    run = o.withColumn("o_orderstatus", F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("total", F.when(k % 50 == 1, F.col("total") + 1).otherwise(F.col("total")))
    return quality.same_except(run.where(k % 101 != 5), o.where(k % 103 != 6), ["o_orderkey"], ("o_orderstatus",))


_SLOT = "SELECT user_id, event_id % 20 AS slot, bool_or(event_type = 'view' OR event_type IS NULL) AS bad, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS labels, count(*) AS n FROM events GROUP BY ALL"
_P = "SELECT user_id::VARCHAR AS scenario, (event_id % 20)::VARCHAR AS session, event_id AS o, event_type, ts, event_id % 7 <> 0 AS has FROM events"
_FOREIGN = "concat_ws(', ', CASE WHEN o < first THEN o::VARCHAR END, CASE WHEN o // 2 < first THEN (o // 2)::VARCHAR END)"
QUERIES = {
    "known_label_lists": (known_label_lists, f"SELECT user_id, slot, CASE WHEN bad THEN '' ELSE labels END AS labels FROM ({_SLOT})"),
    "label_families": (label_families, f"SELECT user_id, slot, concat_ws(',', CASE WHEN NOT bad THEN 'kind' END, CASE WHEN n > 3 THEN 'place' END) AS families FROM ({_SLOT})"),
    "flagged_records": (flagged_records, "SELECT source, count(*) AS records, count(*) FILTER (WHERE coalesce(lang = 'de', false) OR coalesce(source = 'de', false) OR coalesce(regexp_matches(text, '(?i)password|licen[cs]e'), false)) AS flagged FROM documents GROUP BY source"),
    "proposal_register": (proposal_register, f"SELECT scenario, printf('%s-OP%03d', scenario, o) AS op_id, has AS has_fact, has AND {_FOREIGN} = '' AS provenance_valid, CASE WHEN NOT has THEN 'fact of another session' WHEN {_FOREIGN} <> '' THEN 'foreign messages: ' || {_FOREIGN} END AS provenance_problem FROM (SELECT *, min(o) OVER (PARTITION BY scenario) AS first FROM ({_P}))"),
    "retry_links": (retry_links, f"SELECT scenario, session, row_number() OVER w AS attempt, o::VARCHAR AS op_id, event_type <> 'error' AS applied, CASE WHEN lag(event_type) OVER w = 'error' THEN (lag(o) OVER w)::VARCHAR END AS retry_of, CASE WHEN event_type = 'error' THEN (lead(o) OVER w)::VARCHAR END AS retried_by FROM ({_P}) WINDOW w AS (PARTITION BY scenario, session ORDER BY ts, o)"),
    "relation_trace": (relation_trace, "WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations WHERE role = 'user'), m AS (SELECT r.conv_id, r.s, i.s AS item FROM t r JOIN t i ON r.conv_id = i.conv_id AND i.s % 2 = 1 AND r.s = i.s) SELECT t.conv_id, t.s::VARCHAR AS relation_id, coalesce(m.item::VARCHAR, '') AS item_ids, m.item IS NOT NULL AS present FROM t LEFT JOIN m USING (conv_id, s)"),
    "run_compatibility": (run_compatibility, "SELECT 'E-COMPAT' AS code, o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 101 = 5 THEN 'missing' WHEN o_orderkey % 103 = 6 THEN 'unexpected' ELSE 'total' END AS detail FROM orders WHERE NOT (o_orderkey % 101 = 5 AND o_orderkey % 103 = 6) AND (o_orderkey % 101 = 5 OR o_orderkey % 103 = 6 OR (o_orderkey % 50 = 1 AND o_totalprice IS NOT NULL))"),
}
