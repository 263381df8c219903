"""Context items: what every memory architecture offers to a ranking and a budget, in one schema.

An item has item_id, text (what is ranked), render (the line that a context shows, and what the budget counts),
content_tokens, overhead_tokens, tokens, session_order, item_order, source_message_ids, source_fact_ids, unit, state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens, ordered_join
from .budget import ARCHIVE, RECENT
from .perimeter import ACTIVE, RETRACTED, SUPERSEDED, readable

#: Fixed formats of context lines.
MESSAGE_LINE = "[%s] %s"
FACT_LINE = "[%s | da: %s] %s"
STATE_LINE = "[%s | %s | da: %s] %s"
TIER_LINE = "[%s | %s | %s | da: %s] %s"
NODE_LINE = "[NODO %s | %s | da: %s]"
EDGE_LINE = "[%s | %s -%s-> %s | %s | da: %s]"
#: Fixed labels of tiers in a line.
TIER_LABELS = {RECENT: "recente", ARCHIVE: "archivio"}
#: What an entry's date rests on, by its status.
RECENCY_BASIS = {
    ACTIVE: "creazione",
    SUPERSEDED: "creazione (la versione successiva e' una voce a se')",
    RETRACTED: "creazione (la sessione del ritiro non e' registrata nello stato)",
}


def sources(ids: Column | str) -> Column:
    return F.array_join(ids, ", ")


def by_value(column: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


def make(rows: DataFrame, key: list[str], item_id: Column, text: Column, render: Column, session_order: Column, item_order: Column, messages: Column, facts: Column | None = None, unit: str = "", state: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Items of ``rows``, with ``key`` columns before and ``more`` after the schema's own."""
    total, content = count_tokens(render), count_tokens(text)
    return rows.select(
        *key, item_id.alias("item_id"), text.alias("text"), render.alias("render"), content.alias("content_tokens"), (total - content).alias("overhead_tokens"), total.alias("tokens"),
        session_order.alias("session_order"), item_order.alias("item_order"), messages.alias("source_message_ids"),
        (F.array().cast("array<string>") if facts is None else facts).alias("source_fact_ids"), F.lit(unit).alias("unit"), (F.lit(None).cast("string") if state is None else state).alias("state"),
        *[c.alias(n) for n, c in (more or {}).items()],
    )


def message_items(messages: DataFrame, key: list[str]) -> DataFrame:
    """One message a line; messages: key, message_id, content, session_order, message_order."""
    m = F.col("message_id")
    return make(messages, key, m, F.col("content"), F.format_string(MESSAGE_LINE, m, "content"), F.col("session_order"), F.col("message_order"), F.array(m), unit="messaggio")


def fact_items(facts: DataFrame, key: list[str]) -> DataFrame:
    """One extracted fact a line; facts: key, fact_id, text, session_order, order, source_message_ids."""
    f = F.col("fact_id")
    return make(facts, key, f, F.col("text"), F.format_string(FACT_LINE, f, sources("source_message_ids"), "text"), F.col("session_order"), F.col("order"), F.col("source_message_ids"), F.array(f), "fatto")


def state_items(entries: DataFrame, key: list[str], scope: Column) -> DataFrame:
    """Entries that ``scope`` may read, with their state; entries: key, entry_id, claim_key, value, status, session_order,
    order, source_message_ids, source_fact_ids."""
    line = F.format_string(STATE_LINE, "entry_id", "status", sources("source_message_ids"), "value")
    return make(entries.where(readable(F.col("status"), scope)), key, F.col("entry_id"), F.col("value"), line, F.col("session_order"), F.col("order"), F.col("source_message_ids"), F.col("source_fact_ids"), "fatto con stato", F.col("status"), {"claim_key": F.col("claim_key")})


def tier_items(entries: DataFrame, key: list[str], scope: Column, level: Column) -> DataFrame:
    """The same entries with their recency tier, which the line shows, and what their date rests on."""
    line = F.format_string(TIER_LINE, "entry_id", by_value(level, TIER_LABELS), "status", sources("source_message_ids"), "value")
    more = {"claim_key": F.col("claim_key"), "level": level, "recency_basis": by_value(F.col("status"), RECENCY_BASIS)}
    return make(entries.where(readable(F.col("status"), scope)), key, F.col("entry_id"), F.col("value"), line, F.col("session_order"), F.col("order"), F.col("source_message_ids"), F.col("source_fact_ids"), "fatto con stato e livello", F.col("status"), more)


def edge_items(edges: DataFrame, key: list[str]) -> DataFrame:
    """One edge a line; edges: key, edge_id, subject, relation, object, state, order, source_message_ids, source_fact_ids."""
    line = F.format_string(EDGE_LINE, "edge_id", "subject", "relation", "object", "state", sources("source_message_ids"))
    return make(edges, key, F.col("edge_id"), F.concat_ws(" ", "subject", "relation", "object"), line, F.lit(0), F.col("order"), F.col("source_message_ids"), F.col("source_fact_ids"), "arco", F.col("state"))


def node_line(node_id: Column, label: Column, messages: Column) -> Column:
    return F.format_string(NODE_LINE, node_id, label, sources(messages))


def provenance(rank: Column, messages: Column) -> Column:
    """Aggregate: the different message ids of items, in the order in which a context shows them first."""
    rows = F.collect_list(F.when(messages.isNotNull(), F.struct(rank.alias("r"), messages.alias("m"))))
    return F.array_distinct(F.flatten(F.transform(F.array_sort(rows), lambda x: x["m"])))


def contexts(selected: DataFrame, key: list[str]) -> DataFrame:
    """One context per key from ranked items with ``selected``: sizes, ids and lines in rank order (whatever the tiers),
    and the messages that it comes from."""
    own = lambda c: F.when(F.col("selected"), F.col(c))
    total = lambda c: F.coalesce(F.sum(own(c)), F.lit(0)).cast("long")
    return selected.groupBy(*key).agg(
        F.count("*").alias("examined"), F.count_if("selected").alias("n_items"), total("tokens").alias("context_tokens"), total("content_tokens").alias("content_tokens"), total("overhead_tokens").alias("overhead_tokens"),
        ordered_join(F.col("rank"), own("item_id"), ",").alias("item_ids"), ordered_join(F.col("rank"), own("render")).alias("context"), provenance(F.col("rank"), own("source_message_ids")).alias("provenance"),
    )


def trial(context: DataFrame, selected: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """Whether a context holds what a question needs.  facts: key, fact_key, source_message_ids.  Per key: facts, facts that
    some selected item comes from all sources of, evidence (different messages of all facts) in the context, and whether
    it is complete: null where the question needs nothing."""
    need = facts.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("source_message_ids"))).alias("evidence"), F.count("*").alias("facts"))
    have = selected.where("selected").select(*key, F.col("source_message_ids").alias("_have"), "item_id")
    met = facts.join(have, key).where(F.size(F.array_except("source_message_ids", "_have")) == 0)
    met = met.groupBy(*key).agg(F.count_distinct("fact_key").alias("facts_matched"), F.count_distinct("fact_key", "item_id").alias("matches"))
    x = context.join(need, key, "left").join(met, key, "left")
    seen = F.array_intersect("evidence", "provenance")
    return x.select(*key, F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("facts_matched", F.lit(0)).alias("facts_matched"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce(F.size(seen), F.lit(0)).cast("long").alias("evidence_in_context"), (F.size(seen) == F.size("evidence")).alias("evidence_complete"))


def budget_required(mode: Column, budget: Column, strict: tuple[str, ...] = ("GER",)) -> Column:
    """The budget, which a strict tiered mode cannot do without."""
    wrong = F.raise_error(F.concat(mode, F.lit(" needs a budget"))).cast("long")
    return F.when(mode.isin(*strict) & budget.isNull(), wrong).otherwise(budget.cast("long"))
