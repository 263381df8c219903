"""Queries on annotation templates and evidence ranks: conversations are scenarios, each of their user turns is a question whose
facts and relations come from turns around it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import template
from .common import table, turns

MODES = ("T", "F", "G")
TOP = 3


def annotation_template(spark, d):
    """Memory of mode T is every user turn, of F the turns with a long text, of G every other turn; the context has the last three
    of them.  A question's facts come from its turn, its turn and the one before, and nothing; its relations join it with the turn
    before (declared by turns with an even number) and, but for every fourth turn, with the next but one (declared by none)."""
    t = turns(spark, d).select("conv_id", F.col("session_order").alias("s"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    text = lambda c: c.cast("string")
    s, scenario = F.col("s"), text(F.col("conv_id")).alias("scenario")
    ids = lambda *x: F.array(*map(text, x))
    question = text(s).alias("question")
    cells = t.select(scenario, question, F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    fact = lambda name, x: F.struct(F.lit(name).alias("fact_key"), x.alias("source_message_ids"))
    facts = t.select(scenario, question, F.explode(F.array(fact("own", ids(s)), fact("pair", ids(s, s - 1)), fact("bare", F.array().cast("array<string>")))).alias("f")).select("scenario", "question", "f.*")
    kept = F.filter(F.array(F.when(F.lit(True), F.lit("T")), F.when(F.col("size") > 200, F.lit("F")), F.when(s % 2 == 1, F.lit("G"))), lambda m: m.isNotNull())
    held = t.select(scenario, F.explode(kept).alias("mode"), s)
    memory = held.select("scenario", "mode", text(s).alias("message_id"))
    last = held.withColumn("back", F.row_number().over(Window.partitionBy("scenario", "mode").orderBy(s.desc()))).where(F.col("back") <= TOP)
    shown = cells.join(last, ["scenario", "mode"])
    context = shown.select(*template.CELL, text(s).alias("message_id"))
    selected = shown.select(*template.CELL, text(s).alias("item_id"), F.when(F.col("mode") == "G", "edge").otherwise("message").alias("unit"), ids(s, s - 1).alias("source_message_ids"))
    rel = lambda name, x: F.concat(F.lit(name), text(x))
    required = t.select(scenario, question, F.explode(F.array_compact(F.array(rel("a", s), F.when(s % 4 != 2, rel("b", s))))).alias("relation_id"))
    declared = t.where("s % 2 = 0").select(scenario, rel("a", s).alias("relation_id"), ids(s, s - 1).alias("source_message_ids"))
    chains = t.select(scenario, question, F.when(s % 3 == 0, F.array(rel("a", s))).otherwise(F.array().cast("array<string>")).alias("chain"))
    return template.annotation_template(cells, facts, memory, context, required, declared, selected, chains)


def evidence_ranks(spark, d):
    """Each conversation's turns ranked by length; the evidence is a turn of its own number modulo 5, which may not be there or not
    be accessible; activities are roles."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("none")).alias("role"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    # a conversation's turns
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("a"), "turn", "role"))), lambda x: F.struct(x["turn"].cast("string").alias("id"), x["role"].alias("role"))).alias("r"))
    take = lambda x: F.transform(x, lambda y: y["id"])
    some = F.slice("r", 1, TOP)
    rows = rows.select(F.col("conv_id").cast("string").alias("question"), F.lit("user").alias("activity"), take(F.filter("r", lambda x: x["role"] == "user")).alias("accessible"), take(F.col("r")).alias("ranked"), take(some).alias("retrieved"), F.transform(some, lambda y: y["role"]).alias("retrieved_activities"))
    oracle = c.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("question"), (F.col("conv_id") % 5).cast("string").alias("evidence_id"))
    return template.evidence_ranks(rows, oracle)


_T = """t AS (SELECT conv_id::VARCHAR AS scenario, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS s, length(coalesce(text, '')) AS size FROM conversations WHERE role = 'user'),
  held AS (SELECT scenario, s, m AS mode FROM t CROSS JOIN (VALUES ('T'), ('F'), ('G')) v(m) WHERE m = 'T' OR (m = 'F' AND size > 200) OR (m = 'G' AND s % 2 = 1)),
  last3 AS (SELECT scenario, mode, s FROM (SELECT *, row_number() OVER (PARTITION BY scenario, mode ORDER BY s DESC) AS b FROM held) WHERE b <= 3),
  c AS (SELECT t.scenario, t.s, m AS mode FROM t CROSS JOIN (VALUES ('T'), ('F'), ('G')) v(m)),
  x AS (SELECT c.*, EXISTS (SELECT 1 FROM held h WHERE h.scenario = c.scenario AND h.mode = c.mode AND h.s = c.s) AS m0, EXISTS (SELECT 1 FROM held h WHERE h.scenario = c.scenario AND h.mode = c.mode AND h.s = c.s - 1) AS m1,
    EXISTS (SELECT 1 FROM last3 h WHERE h.scenario = c.scenario AND h.mode = c.mode AND h.s = c.s) AS c0, EXISTS (SELECT 1 FROM last3 h WHERE h.scenario = c.scenario AND h.mode = c.mode AND h.s = c.s - 1) AS c1 FROM c)"""
QUERIES = {
    "annotation_template": (annotation_template, f"""WITH {_T}
SELECT scenario, s::VARCHAR AS question, mode, 3::BIGINT AS facts, 1 + m0::BIGINT + (m0 AND m1)::BIGINT AS facts_in_memory, concat_ws(',', CASE WHEN NOT c0 THEN 'own' END, CASE WHEN NOT (c0 AND c1) THEN 'pair' END) AS facts_missing,
  CASE WHEN s % 4 = 2 THEN 1 ELSE 2 END::BIGINT AS relations, concat_ws(',', CASE WHEN NOT (s % 2 = 0 AND c0) THEN 'a' || s END, CASE WHEN s % 4 <> 2 THEN 'b' || s END) AS relations_missing, CASE WHEN s % 3 = 0 THEN s % 2 = 0 AND c0 END AS chain_covered,
  CASE WHEN NOT (c0 AND c1 AND s % 4 = 2) THEN false END AS evidence_complete FROM x"""),
    "evidence_ranks": (evidence_ranks, f"""WITH c AS (SELECT conv_id, turn, coalesce(role, 'none') AS role, row_number() OVER (PARTITION BY conv_id ORDER BY length(coalesce(text, '')) DESC, turn) AS rank FROM conversations)
SELECT conv_id::VARCHAR AS question, bool_or(turn = conv_id % 5 AND role = 'user') AS reachable, bool_or(turn = conv_id % 5 AND rank <= {TOP}) AS success, max(rank) FILTER (WHERE turn = conv_id % 5) AS evidence_rank,
  count(*) FILTER (WHERE rank <= {TOP} AND role <> 'user') AS contamination, count(*) FILTER (WHERE rank <= {TOP} AND role <> 'user') / least(count(*), {TOP})::DOUBLE AS contamination_rate FROM c GROUP BY conv_id"""),
}
