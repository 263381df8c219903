"""Small entity graphs: mentions, shortest paths of a few hops, expansion around them.

Paths are chained joins on the edge table, pruned to simple paths.  Of the shortest paths between two anchors the one
with the least sequence of edge ids is taken, which is what a breadth-first search that visits edges by id finds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordered_join, rank_tokens
from ..session import cut
from . import items, naming
from .budget import prefix_within_budget
from .keys import join_by_key
from .perimeter import readable
from .positions import numbered


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of (edge_id, subject, object); loops once."""
    ahead = edges.select("edge_id", F.col("subject").alias("a"), F.col("object").alias("b"))
    return ahead.union(edges.where("subject <> object").select("edge_id", F.col("object").alias("a"), F.col("subject").alias("b")))


def shortest_paths(edges: DataFrame, anchors: DataFrame, hops: int = 3) -> DataFrame:
    """(source, target, hops, edge_ids) for anchor pairs source < target that a path of at most ``hops`` edges joins.
    anchors: column node."""
    adj = cut(adjacency(edges))
    # rings around the anchors: a path goes on only to nodes from which an anchor is near enough, so a hub's other neighbours
    # never meet a path
    ring = cut(anchors.select(F.col("node").alias("b")).distinct())
    rings = [ring]
    for _ in range(hops - 1):
        more = adj.join(ring, "b", "left_semi").select(F.col("a").alias("b"))
        ring = cut(ring.union(more).distinct())
        rings.insert(0, ring)
    step = adj.join(anchors.select(F.col("node").alias("a")), "a", "left_semi").join(rings[0], "b", "left_semi").select(F.col("a").alias("source"), F.col("b").alias("at"), F.array("edge_id").alias("ids"), F.array("a", "b").alias("nodes")).where("source <> at")
    found = [step]
    for near in rings[1:]:
        onward = adj.join(near, "b", "left_semi")
        nxt = step.join(onward, step["at"] == onward["a"]).where(~F.array_contains("nodes", F.col("b")))
        step = nxt.select("source", F.col("b").alias("at"), F.concat("ids", F.array("edge_id")).alias("ids"), F.concat("nodes", F.array("b")).alias("nodes"))
        # a least shortest path's beginnings are least shortest paths themselves: one way to each node is enough
        step = step.groupBy("source", "at").agg(F.min(F.struct("ids", "nodes")).alias("x")).select("source", "at", "x.ids", "x.nodes")
        found.append(step)
    every = reduce(DataFrame.union, found).where("source < at").join(anchors.select(F.col("node").alias("at")), "at", "left_semi")
    best = every.groupBy("source", F.col("at").alias("target")).agg(F.min(F.struct(F.size("ids").alias("hops"), "ids")).alias("x"))
    return best.select("source", "target", F.col("x.hops").cast("long").alias("hops"), F.array_join("x.ids", ",").alias("edge_ids"))


def path_edges(paths: DataFrame) -> DataFrame:
    """Edges of paths in the order in which they are first seen (paths by source and target, hops in order), once each,
    with score 1 + 1 / position."""
    x = paths.select("source", "target", F.posexplode(F.split("edge_ids", ",")).alias("hop", "edge_id"))
    first = x.groupBy("edge_id").agg(F.min(F.struct("source", "target", "hop")).alias("k"))
    return numbered(first, ["k"]).select("edge_id", "pos").withColumn("score", F.round(1 + 1 / F.col("pos"), 6))


def incident_edges(edges: DataFrame, nodes: DataFrame, used: DataFrame) -> DataFrame:
    """Edges that touch one of ``nodes`` and are not ``used``, by id, with score 0.5 / position."""
    n = nodes.select("node").distinct()
    touch = edges.join(n, edges["subject"] == n["node"], "left_semi").union(edges.join(n, edges["object"] == n["node"], "left_semi")).select("edge_id").distinct()
    rest = touch.join(used.select("edge_id"), "edge_id", "left_anti")
    return numbered(rest, ["edge_id"]).withColumn("score", F.round(0.5 / F.col("pos"), 6))


def composite(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """One ranking from (group, edges with pos and score), group by group."""
    rows = [df.select("edge_id", "pos", "score", F.lit(name).alias("part"), F.lit(k).alias("k")) for k, (name, df) in enumerate(parts)]
    return numbered(reduce(DataFrame.union, rows), ["k", "pos"], "rank").drop("k")


def mentioned(text: Column, name: Column) -> Column:
    """Whether a name's tokens stand side by side in the text's tokens."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(rank_tokens(c), " "), F.lit(" "))
    return (F.size(rank_tokens(name)) > 0) & padded(text).contains(padded(name))


def mentions(texts: DataFrame, key: list[str], names: DataFrame, limit: int = naming.LIMIT) -> DataFrame:
    """(key, name) for each text and each row of ``names`` whose tokens stand side by side in it.  A text goes through an
    automaton of all different names where it is, or in shards beyond ``limit`` names; only keys and found names are joined."""
    n = cut(names.select("name", naming.spaced(F.col("name")).alias("_form")).where("_form IS NOT NULL"))
    found = naming.found_forms(texts.select(*key, naming.spaced(F.col("text")).alias("form")), n.select(F.col("_form").alias("form")), "tokens", limit).withColumnRenamed("form", "_form")
    if n.count() <= limit:
        met = found.join(F.broadcast(n), "_form")
    else:
        met = join_by_key(cut(found), cut(n.groupBy("_form").agg(F.collect_list("name").alias("_names"))), ["_form"]).withColumn("name", F.explode("_names"))
    return met.select(*key, "name")


def path_complete(paths: DataFrame, selected: DataFrame) -> DataFrame:
    """For each path, whether all its edges are selected, and those that are not."""
    x = paths.select("source", "target", F.explode(F.split("edge_ids", ",")).alias("edge_id"))
    x = x.join(selected.select("edge_id", F.lit(True).alias("in")), "edge_id", "left")
    return x.groupBy("source", "target").agg(F.bool_and(F.col("in").isNotNull()).alias("complete"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("in").isNull(), F.col("edge_id")))), ",").alias("missing"))


def normalise(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark what a proposed graph cannot support: nodes (node_id, source_fact_ids) without sources, and edges
    (subject, object, source_fact_ids) without sources or with an end that no node declares; edge ids by position."""
    has = (F.size("source_fact_ids") > 0)
    nodes = nodes.withColumn("provenance_valid", has)
    ids = nodes.select("node_id").distinct()
    e = edges.join(ids.withColumnsRenamed({"node_id": "subject"}).withColumn("_s", F.lit(True)), "subject", "left")
    e = e.join(ids.withColumnsRenamed({"node_id": "object"}).withColumn("_o", F.lit(True)), "object", "left")
    e = e.withColumn("provenance_valid", has & F.col("_s").isNotNull() & F.col("_o").isNotNull()).drop("_s", "_o")
    return nodes, e.withColumn("edge_id", F.format_string("E%03d", F.col("order").cast("long")))


def relation_trace(relations: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """For each required relation (key, relation_id, source_message_ids) the selected items (key, item_id,
    source_message_ids) that come from all of its messages, joined by commas, and whether there is any.  That shows
    shared provenance, not that the relation is stated correctly.  A relation without sources has no items."""
    need = relations.select(*key, "relation_id", F.size(F.array_distinct("source_message_ids")).alias("need"), F.explode(F.array_distinct("source_message_ids")).alias("message_id"))
    have = items.select(*key, "item_id", F.explode(F.array_distinct("source_message_ids")).alias("message_id"))
    met = need.join(have, [*key, "message_id"]).groupBy(*key, "relation_id", "item_id", "need").agg(F.count("*").alias("n")).where("n = need")
    met = met.groupBy(*key, "relation_id").agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("item_ids"))
    x = relations.select(*key, "relation_id").join(met, [*key, "relation_id"], "left")
    return x.select(*key, "relation_id", F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.col("item_ids").isNotNull().alias("present"))


def unselected_reason(can_read: Column, on_topic: Column, selected: Column) -> Column:
    """Why an edge is not in the context; null for a selected one."""
    return F.when(selected, None).when(~can_read, "state not readable").when(~on_topic, "off topic").otherwise("outside the budget")


def anchors(question_nodes: DataFrame, entry_nodes: DataFrame, key: list[str]) -> DataFrame:
    """(key, node, a): the nodes that a question names (key, node, node_order), then those of its seed items (key, node,
    pos) that are not among them, numbered."""
    late = entry_nodes.join(question_nodes.select(*key, "node"), [*key, "node"], "left_anti")
    both = question_nodes.select(*key, "node", F.lit(0).alias("part"), F.col("node_order").alias("o")).union(late.select(*key, "node", F.lit(1), "pos"))
    return both.select(*key, "node", F.row_number().over(Window.partitionBy(*key).orderBy("part", "o")).alias("a"))


def question_paths(edges: DataFrame, ends: DataFrame, key: list[str], hops: int = 3) -> DataFrame:
    """Every pair of anchors (source before target) of each key with its shortest path: source, target, i, j, ids (null: none
    within ``hops`` edges), path number k and path_id in the order of pairs.  edges: key, edge_id, subject, object; ends:
    key, node, a."""
    adj = edges.select(*key, "edge_id", F.col("subject").alias("_a"), F.col("object").alias("_b")).union(edges.where("subject <> object").select(*key, "edge_id", "object", "subject"))
    least = lambda x: x.groupBy(*key, "source", "at").agg(F.min(F.struct("ids", "nodes")).alias("x")).select(*key, "source", "at", "x.ids", "x.nodes")
    start = ends.select(*key, F.col("node").alias("_a")).join(adj, [*key, "_a"])
    step = least(start.select(*key, F.col("_a").alias("source"), F.col("_b").alias("at"), F.array("edge_id").alias("ids"), F.array("_a", "_b").alias("nodes")).where("source <> at"))
    found = [step]
    for _ in range(hops - 1):
        nxt = step.withColumnRenamed("at", "_a").join(adj, [*key, "_a"]).where(~F.array_contains("nodes", F.col("_b")))
        step = least(nxt.select(*key, "source", F.col("_b").alias("at"), F.concat("ids", F.array("edge_id")).alias("ids"), F.concat("nodes", F.array("_b")).alias("nodes")))
        found.append(step)
    best = reduce(DataFrame.union, found).groupBy(*key, "source", F.col("at").alias("target")).agg(F.min(F.struct(F.size("ids").alias("h"), "ids")).alias("x")).select(*key, "source", "target", "x.ids")
    pairs = ends.select(*key, F.col("node").alias("source"), F.col("a").alias("i")).join(ends.select(*key, F.col("node").alias("target"), F.col("a").alias("j")), key).where("i < j")
    x = pairs.join(best, [*key, "source", "target"], "left")
    k = F.when(F.col("ids").isNotNull(), F.row_number().over(Window.partitionBy(*key, F.col("ids").isNull()).orderBy("i", "j")))
    return x.withColumn("k", k).withColumn("path_id", F.format_string("P%02d", "k")).withColumn("path_id", F.when(F.col("k").isNotNull(), F.col("path_id")))


def context(questions: DataFrame, edges: DataFrame, nodes: DataFrame, ranked: DataFrame, key: list[str], budget: int, seeds: int = 3, seed_limit: int = 3, hops: int = 3) -> dict[str, DataFrame]:
    """Relational retrieval of each question, within a budget: path edges, seed items, edges at anchors and paths, and the
    remaining items, in this order.

    questions: key, text, scope; edges and their states: key, edge_id, subject, relation, object, state, order and sources;
    nodes: key, node, node_order, source_fact_ids and, if they have other names, aliases and label; ranked: state items with
    score and rank.
    Returns anchors, paths, ordered (items with part, pos, rank, selected) and edges (with ``readable``)."""
    edges = cut(edges.join(questions.select(*key, "scope"), key).withColumn("readable", readable(F.col("state"), F.col("scope"))))
    usable, ranked = edges.where("readable"), cut(ranked)
    positive = ranked.where("score > 0")
    known = nodes.withColumnRenamed("node", "node_id")
    for name, kind in (("aliases", "array<string>"), ("label", "string")):
        known = known if name in known.columns else known.withColumn(name, F.lit(None).cast(kind))
    named = naming.mentioned_nodes(questions.select(*key, F.lit(0).alias("question_id"), "text"), known, key).withColumnRenamed("node_id", "node")
    hit = naming.seed_nodes(positive.where(F.col("rank") <= seeds).select(*key, "rank", "item_id", "text", "source_fact_ids"), known, key, seed_limit).withColumnRenamed("node_id", "node")
    ends = cut(anchors(named.select(*key, "node", "node_order"), hit.select(*key, "node", "pos"), key))
    paths = cut(question_paths(usable, ends, key, hops))
    own = Window.partitionBy(*key)
    on_path = paths.where("ids IS NOT NULL").select(*key, "k", F.posexplode("ids").alias("hop", "edge_id")).groupBy(*key, "edge_id").agg(F.min(F.struct("k", "hop")).alias("_k"))
    on_path = cut(on_path.select(*key, "edge_id", F.row_number().over(own.orderBy("_k")).alias("pos")))
    ours = usable.join(on_path.select(*key, "edge_id"), [*key, "edge_id"], "left_semi")
    touched = ends.select(*key, "node").union(ours.select(*key, "subject")).union(ours.select(*key, "object")).distinct()
    at = lambda end: usable.join(touched.withColumnRenamed("node", end), [*key, end], "left_semi").select(*key, "edge_id")
    other = at("subject").union(at("object")).distinct().join(on_path.select(*key, "edge_id"), [*key, "edge_id"], "left_anti")
    other = other.select(*key, "edge_id", F.row_number().over(own.orderBy("edge_id")).alias("pos"))
    shown = lambda part, places, score: items.edge_items(usable.join(places, [*key, "edge_id"]), key).join(places.withColumnRenamed("edge_id", "item_id"), [*key, "item_id"]).select(*key, "item_id", "render", "tokens", F.lit(part).alias("part"), "pos", score.alias("score"))
    rest = positive.select(*key, "item_id", "render", "tokens", F.when(F.col("rank") <= seeds, 1).otherwise(3).alias("part"), F.col("rank").alias("pos"), "score")
    every = shown(0, on_path, F.round(1 + 1 / F.col("pos"), 6)).union(rest).union(shown(2, other, F.round(0.5 / F.col("pos"), 6)))
    every = every.withColumn("rank", F.row_number().over(own.orderBy("part", "pos")))
    return {"questions": questions, "anchors": ends, "paths": paths, "ordered": cut(prefix_within_budget(every, key, F.lit(budget))), "edges": edges}


def context_report(found: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One row a question: anchors, pairs searched, paths found and not, whether all found paths are in the context (false
    without any), and the context."""
    chosen = F.when(F.col("selected"), F.col("item_id"))
    c = found["ordered"].groupBy(*key).agg(ordered_join(F.col("rank"), chosen, ",").alias("item_ids"), ordered_join(F.col("rank"), F.when(F.col("selected"), F.col("render"))).alias("context"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("tokens"))), F.lit(0)).alias("context_tokens"))
    a = found["anchors"].groupBy(*key).agg(ordered_join(F.col("a"), F.col("node"), ",").alias("anchors"))
    p = found["paths"].groupBy(*key).agg(F.count("*").alias("pairs"), F.count("ids").alias("paths"))
    inside = found["ordered"].where("selected").select(*key, F.col("item_id").alias("edge_id"), F.lit(True).alias("_in"))
    whole = found["paths"].where("ids IS NOT NULL").select(*key, F.explode("ids").alias("edge_id")).join(inside, [*key, "edge_id"], "left").groupBy(*key).agg(F.bool_and(F.col("_in").isNotNull()).alias("complete"))
    x = found["questions"].select(*key)
    for part in (a, p, whole, c):
        x = x.join(part, key, "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return x.select(*key, F.coalesce("anchors", F.lit("")).alias("anchors"), zero("pairs"), zero("paths"), F.coalesce(F.col("pairs") - F.col("paths"), F.lit(0)).alias("discarded"), F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("context", F.lit("")).alias("context"), zero("context_tokens"))


def unselected(found: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """(key, edge_id, reason) of edges that are not in the context."""
    ranked = found["ordered"].select(*key, F.col("item_id").alias("edge_id"), F.lit(True).alias("_topic"), "selected")
    x = found["edges"].join(ranked, [*key, "edge_id"], "left")
    why = unselected_reason(F.col("readable"), F.coalesce("_topic", F.lit(False)), F.coalesce("selected", F.lit(False)))
    return x.select(*key, "edge_id", why.alias("reason")).where("reason IS NOT NULL")
