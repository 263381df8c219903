"""What an annotator is given: for each question and memory mode, which required facts and relations are in the memory and in the
context by provenance, and what is left to be judged by hand.

Provenance says that the right messages were read and are cited; it doesn't say that their content was kept.  So evidence that
lacks a source is incomplete (false), and evidence that lacks none is open (null), never true.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import relation_trace

CELL = ["scenario", "question", "mode"]


def fact_rows(cells: DataFrame, facts: DataFrame, memory: DataFrame, context: DataFrame) -> DataFrame:
    """(cell, fact_key, in_memory, in_context): whether all of a required fact's messages are sources of the mode's whole memory,
    and of the cell's context.  cells: scenario, question, mode; facts: scenario, question, fact_key, source_message_ids; memory:
    scenario, mode, message_id; context: cell, message_id.  A fact without sources has all of them."""
    need = cells.join(facts, ["scenario", "question"]).select(*CELL, "fact_key", F.explode_outer("source_message_ids").alias("message_id"))
    seen = lambda x, by, name: x.select(*by, "message_id").distinct().withColumn(name, F.lit(True))
    x = need.join(seen(memory, ["scenario", "mode"], "m"), ["scenario", "mode", "message_id"], "left").join(seen(context, CELL, "c"), [*CELL, "message_id"], "left")
    has = lambda c: F.bool_and(F.col("message_id").isNull() | F.col(c).isNotNull())
    return x.groupBy(*CELL, "fact_key").agg(has("m").alias("in_memory"), has("c").alias("in_context"))


def relation_rows(cells: DataFrame, required: DataFrame, declared: DataFrame, selected: DataFrame) -> DataFrame:
    """(cell, relation_id, item_ids, edge_ids, present, problem): the selected items, and the edges among them, that come from all
    messages of a required relation.  required: scenario, question, relation_id; declared: scenario, relation_id,
    source_message_ids; selected: cell, item_id, unit, source_message_ids.  A relation that nobody declared is a problem."""
    known = declared.select("scenario", "relation_id", "source_message_ids", F.lit(True).alias("known"))
    r = cells.join(required, ["scenario", "question"]).join(known, ["scenario", "relation_id"], "left")
    r = r.select(*CELL, "relation_id", F.coalesce("source_message_ids", F.array().cast("array<string>")).alias("source_message_ids"), "known")
    items = relation_trace(r, selected, CELL)
    edges = relation_trace(r, selected.where("unit = 'edge'"), CELL).select(*CELL, "relation_id", F.col("item_ids").alias("edge_ids"))
    x = items.join(edges, [*CELL, "relation_id"]).join(r.select(*CELL, "relation_id", "known"), [*CELL, "relation_id"])
    return x.select(*CELL, "relation_id", "item_ids", "edge_ids", "present", F.when(F.col("known").isNull(), "relation not declared").alias("problem"))


def annotation_template(cells: DataFrame, facts: DataFrame, memory: DataFrame, context: DataFrame, required: DataFrame, declared: DataFrame, selected: DataFrame, chains: DataFrame) -> DataFrame:
    """One row a cell: facts and relations that are missing by provenance, whether the question's chain of relations (chains:
    scenario, question, chain) is covered (null without one), and evidence_complete: false if something is missing, else null."""
    f, r = fact_rows(cells, facts, memory, context), relation_rows(cells, required, declared, selected)
    sorted_ = lambda c, name: F.array_join(F.array_sort(F.collect_list(c)), ",").alias(name)
    fs = f.groupBy(*CELL).agg(F.count("*").alias("facts"), F.count_if("in_memory").alias("facts_in_memory"), sorted_(F.when(~F.col("in_context"), F.col("fact_key")), "facts_missing"))
    rs = r.groupBy(*CELL).agg(F.count("*").alias("relations"), F.collect_set(F.when(~F.col("present"), F.col("relation_id"))).alias("_missing"))
    x = cells.join(fs, CELL, "left").join(rs, CELL, "left").join(chains, ["scenario", "question"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.coalesce("_missing", F.array().cast("array<string>"))
    covered = F.when(F.coalesce(F.size("chain"), F.lit(0)) > 0, ~F.arrays_overlap("chain", none))
    lacks = (F.coalesce("facts_missing", F.lit("")) != "") | (F.size(none) > 0)
    return x.select(*CELL, zero("facts"), zero("facts_in_memory"), F.coalesce("facts_missing", F.lit("")).alias("facts_missing"), zero("relations"), F.array_join(F.array_sort(none), ",").alias("relations_missing"), covered.alias("chain_covered"), F.when(lacks, False).alias("evidence_complete"))


def evidence_ranks(rows: DataFrame, oracle: DataFrame) -> DataFrame:
    """Retrievals (question, activity, accessible, ranked, retrieved, retrieved_activities: arrays in rank order) with, by the
    oracle's (question, evidence_id), whether the evidence could be read and was retrieved, its rank in the whole ranking (null:
    none), and how much of what was retrieved is of another activity."""
    x = rows.join(oracle, "question")
    n = F.size("retrieved")
    other = F.size(F.filter("retrieved_activities", lambda a: ~a.eqNullSafe(F.col("activity"))))
    place = F.array_position("ranked", F.col("evidence_id"))
    return x.select("question", F.array_contains("accessible", F.col("evidence_id")).alias("reachable"), F.array_contains("retrieved", F.col("evidence_id")).alias("success"), F.when(place > 0, place).alias("evidence_rank"), other.cast("long").alias("contamination"), F.when(n > 0, other / n).alias("contamination_rate"))
