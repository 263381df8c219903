"""Names of many nodes in many texts by Aho-Corasick automata, and what a proposed graph's nodes and edges come from.

All different names make one automaton, which goes through a text once, however many names there are.  It is sent to every
task up to ``limit`` names and characters, which are counted.  Beyond, names are dealt to shards by their first symbol, symbols
with many names to several; a text goes to the shards of the symbols that it holds, and each shard makes its own automaton.
Names that are found meet nodes by an equi join on graph and name.

Two ways of comparing: *tokens* (a name's words stand side by side in the text's words; words have no spaces, so that is a
search of spaced words) and *raw* (a lower-case name anywhere in the lower-case text).
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rank_tokens
from ..session import cut

#: Most names, and most of their characters, that an automaton holds.
LIMIT = 200_000
LIMIT_CHARACTERS = 8_000_000


def spaced(text: Column) -> Column:
    """A text's words, each between spaces; null without a word."""
    words = rank_tokens(text)
    return F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))


def lowered(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low != "", low)


FORMS = {"tokens": spaced, "raw": lowered}


def symbols(form: Column, how: str) -> Column:
    """The symbols that a name may begin with in a text: its words, or its characters."""
    return F.array_distinct(F.split(F.trim(form), " ") if how == "tokens" else F.split(form, ""))


def first_symbol(form: Column, how: str) -> Column:
    return F.split(F.trim(form), " ")[0] if how == "tokens" else F.substring(form, 1, 1)


def automaton(names: list[str]):
    out = ahocorasick.Automaton()
    for k, n in enumerate(names):
        out.add_word(n, k)
    if len(out):
        out.make_automaton()
    return out


def hits(machine, text: str) -> list[int]:
    """Numbers of the different names in a text, in order."""
    return sorted({k for _, k in machine.iter(text)}) if text and len(machine) else []


def _emit(batch_keys: list[pa.Array], columns: list[str], rows: list[int], found: list[str]) -> pa.RecordBatch:
    at = pa.array(np.asarray(rows, np.int64))
    return pa.RecordBatch.from_arrays([*[k.take(at) for k in batch_keys], pa.array(found, pa.string())], names=[*columns, "form"])


def found_forms(texts: DataFrame, forms: DataFrame, how: str, limit: int = LIMIT, characters: int = LIMIT_CHARACTERS) -> DataFrame:
    """(columns of ``texts`` other than ``form``, form): the different ``forms`` (column form) that each text's form holds."""
    keep = [c for c in texts.columns if c != "form"]
    forms = cut(forms.select("form").where("form IS NOT NULL").distinct())
    n, size = forms.agg(F.count("*"), F.coalesce(F.sum(F.length("form")), F.lit(0))).first()
    schema = texts.select(*keep, F.lit("").alias("form")).schema
    if n <= limit and size <= characters:
        names = [r.form for r in forms.collect()]  # counted above
        shared = texts.sparkSession.sparkContext.broadcast(sorted(names))

        def run(batches):
            names = shared.value
            machine = automaton(names)
            for batch in batches:
                rows, found = [], []
                for e, text in enumerate(batch.column(len(keep)).to_pylist()):
                    got = hits(machine, text)
                    rows += [e] * len(got)
                    found += [names[k] for k in got]
                yield _emit(batch.columns[: len(keep)], keep, rows, found)

        return texts.select(*keep, "form").mapInArrow(run, schema)

    # a symbol with many names has several shards, its names dealt to them by hash; such symbols are fewer than 2 * shards
    shards = max(1, int(-(-n // limit)), int(-(-size // characters)))
    named = forms.withColumn("_symbol", first_symbol(F.col("form"), how))
    counts = named.groupBy("_symbol").agg(F.ceil(F.greatest(F.count("*") / limit, F.sum(F.length("form")) / characters)).cast("int").alias("_parts"))
    many = cut(counts.where("_parts > 1"))
    place = lambda symbol, part: F.pmod(F.pmod(F.xxhash64(symbol), F.lit(shards)) + part, F.lit(shards)).cast("int")
    dealt = named.join(F.broadcast(many), "_symbol", "left").select(place(F.col("_symbol"), F.pmod(F.xxhash64("form"), F.coalesce("_parts", F.lit(1)))).alias("_shard"), "form")
    # a text comes to a shard once, whichever of its symbols lead there: it is copied for shards, not for symbols
    held = F.broadcast(many.agg(F.map_from_entries(F.collect_list(F.struct("_symbol", "_parts"))).alias("_many")))
    each = lambda s: F.transform(F.sequence(F.lit(0), F.coalesce(F.try_element_at("_many", s), F.lit(1)) - 1), lambda part: place(s, part))
    sent = texts.select(*keep, "form").where("form IS NOT NULL").crossJoin(held)
    sent = sent.select(*keep, "form", F.explode(F.array_distinct(F.flatten(F.transform(symbols(F.col("form"), how), each)))).alias("_shard"))
    both = dealt.select(*[F.lit(None).cast(schema[c].dataType).alias(c) for c in keep], "form", "_shard", F.lit(True).alias("_name")).union(sent.select(*keep, "form", "_shard", F.lit(False)))
    both = both.repartition(shards, "_shard").sortWithinPartitions("_shard", F.col("_name").desc())

    def scan(batches):
        shard, names, machine = None, [], None
        for batch in batches:
            where, is_name = np.asarray(batch.column(len(keep) + 1)), np.asarray(batch.column(len(keep) + 2))
            rows, found = [], []
            for e, text in enumerate(batch.column(len(keep)).to_pylist()):
                if where[e] != shard:
                    shard, names, machine = where[e], [], None
                if is_name[e]:
                    names.append(text)
                    continue
                if machine is None:
                    machine = automaton(names)
                got = hits(machine, text)
                rows += [e] * len(got)
                found += [names[k] for k in got]
            yield _emit(batch.columns[: len(keep)], keep, rows, found)

    return both.mapInArrow(scan, schema)


def _names(nodes: DataFrame, key: list[str], how: str, label: bool) -> DataFrame:
    """(key, node_id, node_order, name, place, form): a node's id, aliases and, if wanted, label, in this order."""
    parts = [F.array(F.col("node_id")), F.coalesce("aliases", F.array().cast("array<string>"))] + ([F.array(F.col("label"))] if label else [])
    x = nodes.select(*key, "node_id", "node_order", F.posexplode(F.concat(*parts)).alias("place", "name"))
    return x.withColumn("form", FORMS[how](F.col("name"))).where("form IS NOT NULL")


def mentioned_nodes(questions: DataFrame, nodes: DataFrame, key: list[str], question: str = "question_id", limit: int = LIMIT) -> DataFrame:
    """(key, question, node_id, node_order, matched_name): the nodes (key, node_id, node_order, aliases, label) of which a name's
    words stand side by side in a question (key, question, text), with the first such name.  A name without words, or null,
    is none."""
    names = cut(_names(nodes, key, "tokens", True))
    texts = questions.select(*key, question, spaced(F.col("text")).alias("form"))
    met = found_forms(texts, names, "tokens", limit).join(names, [*key, "form"])
    return met.groupBy(*key, question, "node_id", "node_order").agg(F.min_by("name", "place").alias("matched_name"))


def seed_nodes(items: DataFrame, nodes: DataFrame, key: list[str], most: int = 3, limit: int = LIMIT) -> DataFrame:
    """(key, node_id, from_item, pos): the first ``most`` nodes, by an item's rank, then the node's order, that an item names in its
    raw text by id or alias, or with which it shares a source fact.  items: key, rank, item_id, text, source_fact_ids; an
    item's rank is its own within its key."""
    names = cut(_names(nodes, key, "raw", False))
    texts = items.select(*key, "rank", "item_id", lowered(F.col("text")).alias("form"))
    named = found_forms(texts, names, "raw", limit).join(names, [*key, "form"]).select(*key, "rank", "item_id", "node_id", "node_order")
    facts = lambda x, *more: x.select(*key, *more, F.explode(F.array_distinct("source_fact_ids")).alias("fact_id"))
    shared = facts(items, "rank", "item_id").join(facts(nodes, "node_id", "node_order"), [*key, "fact_id"]).select(*named.columns)
    first = named.union(shared).groupBy(*key, "node_id").agg(F.min(F.struct("rank", "node_order", "item_id")).alias("_first"))
    pos = F.row_number().over(Window.partitionBy(*key).orderBy("_first"))
    return first.withColumn("pos", pos).where(F.col("pos") <= most).select(*key, "node_id", F.col("_first.item_id").alias("from_item"), "pos")


# --- provenance ---------------------------------------------------------------


def provenance(rows: DataFrame, facts: DataFrame, allowed: DataFrame, key: list[str], row: str) -> DataFrame:
    """(key, row, source_message_ids, problems) of rows (key, row, source_fact_ids): the messages of their facts, each once in
    order of first appearance, and what is wrong, in order: facts that do not exist, messages that are not allowed, no fact at
    all.  facts: key, fact_id, source_message_ids (of repeated ids one, the last by ``fact_order``, counts); allowed: key,
    message_id.  Nothing is corrected."""
    at = [*key, row]
    one = facts.groupBy(*key, "fact_id").agg(F.max_by("source_message_ids", "fact_order").alias("messages")).withColumn("known", F.lit(True))
    cited = rows.select(*at, F.posexplode("source_fact_ids").alias("i", "fact_id")).join(one, [*key, "fact_id"], "left")
    message = cited.where("known").select(*at, "i", F.posexplode("messages").alias("j", "message_id")).join(allowed.select(*key, "message_id").distinct().withColumn("ok", F.lit(True)), [*key, "message_id"], "left")
    told = lambda text, what: F.concat(F.lit(text), F.coalesce(what, F.lit("null")))
    parts = message.select(*at, "i", "j", F.when(F.col("ok"), F.col("message_id")).alias("message_id"), F.when(F.col("ok").isNull(), told("message not allowed: ", F.col("message_id"))).alias("problem"))
    parts = parts.union(cited.where("known IS NULL").select(*at, "i", F.lit(-1), F.lit(None).cast("string"), told("unknown fact: ", F.col("fact_id"))))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("i", "j", c)))), lambda x: x[c])
    got = parts.groupBy(*at).agg(F.array_distinct(in_order("message_id")).alias("source_message_ids"), in_order("problem").alias("problems"))
    x = rows.join(got, at, "left")
    none = F.array().cast("array<string>")
    empty = F.when(F.coalesce(F.size("source_fact_ids"), F.lit(0)) <= 0, F.array(F.lit("no source fact"))).otherwise(none)
    return x.withColumn("source_message_ids", F.coalesce("source_message_ids", none)).withColumn("problems", F.concat(F.coalesce("problems", none), empty))


def judged(rows: DataFrame) -> DataFrame:
    """``problems`` as ``provenance_valid`` and ``provenance_problem`` (joined by '; ', null if there is none)."""
    good = F.size("problems") == 0
    return rows.withColumn("provenance_valid", good).withColumn("provenance_problem", F.when(~good, F.array_join("problems", "; "))).drop("problems")


def normalised_graph(nodes: DataFrame, edges: DataFrame, facts: DataFrame, allowed: DataFrame, key: list[str], states: tuple[str, ...], active: str) -> tuple[DataFrame, DataFrame]:
    """A proposed graph with the messages that its nodes and edges come from and what is wrong with them; nothing is corrected.

    nodes: key, node_order, node_id, source_fact_ids; edges: key, order, subject, object, state, source_fact_ids.  Ids and ends are
    trimmed.  An edge's ends must be nodes; its state, ``active`` if null, is lower-cased and judged; its id is its place."""
    trim = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    nodes = nodes.withColumn("node_id", trim("node_id"))
    whole = judged(provenance(nodes, facts, allowed, key, "node_order"))
    ids = nodes.select(*key, "node_id").distinct()
    e = edges.withColumn("subject", trim("subject")).withColumn("object", trim("object")).withColumn("state", F.lower(F.trim(F.coalesce("state", F.lit(active)))))
    e = provenance(e, facts, allowed, key, "order")
    for end in ("subject", "object"):
        e = e.join(ids.withColumnRenamed("node_id", end).withColumn(f"has_{end}", F.lit(True)), [*key, end], "left")
        missing = F.when(F.col(f"has_{end}").isNull(), F.array(F.concat(F.lit(f"{end} is not a declared node: "), F.col(end)))).otherwise(F.array().cast("array<string>"))
        e = e.withColumn("problems", F.concat("problems", missing)).drop(f"has_{end}")
    e = judged(e).withColumn("state_valid", F.col("state").isin(*states)).withColumn("edge_id", F.format_string("E%03d", F.col("order").cast("long")))
    return whole, e
