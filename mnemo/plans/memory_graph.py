"""Queries on versioned memory and entity graphs.

Events stand for the operation log: per user, in order of (ts, event_id), signup and click add, purchase updates, error
deletes, view changes nothing; the claim key is props.k modulo 5, and updates and deletes name the entry that the last
proposed add or update of their key would have made.  Foreign keys of the star schema stand for the graph.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, memory, naming, perimeter
from ..functions.text import rank_tokens
from ..session import cut
from .common import table, turns

KIND = {"signup": "ADD", "click": "ADD", "purchase": "UPDATE", "error": "DELETE"}


def _ops(spark, d):
    e = table(spark, d, "events").where(F.col("user_id").isNotNull())
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv]), F.col("event_type")), F.lit("NOOP"))
    k = (F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) % 5).cast("string")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = e.select(F.col("user_id").cast("string").alias("scenario"), order.cast("long").alias("op_order"), k.alias("claim_key"), kind.alias("kind"), F.col("value").cast("string").alias("value"))
    x = x.withColumn("op_id", F.format_string("%s-OP%03d", "scenario", "op_order"))
    w = Window.partitionBy("scenario", "claim_key").orderBy("op_order").rowsBetween(Window.unboundedPreceding, -1)
    maker = F.last(F.when(F.col("kind").isin("ADD", "UPDATE"), F.format_string("%s-M%03d", "scenario", "op_order")), ignorenulls=True).over(w)
    return x.withColumn("target", F.when(F.col("kind").isin("UPDATE", "DELETE"), maker))


def memory_fold_ops(spark, d):
    x = memory.fold_operations(_ops(spark, d))
    return x.select("scenario", "op_order", "claim_key", "kind", "applied", "rejection", "entry_id", "supersedes")


def memory_fold_state(spark, d):
    return memory.fold_state(_ops(spark, d)).select("scenario", "entry_id", "claim_key", "status", "superseded_by_entry")


def memory_current_archive(spark, d):
    current, archive = memory.split_state(memory.fold_state(_ops(spark, d)))
    both = current.withColumn("part", F.lit("current")).union(archive.withColumn("part", F.lit("archive")))
    return both.groupBy("scenario", "part").agg(F.count("*").alias("entries"), F.countDistinct("claim_key").alias("keys"))


def memory_log_counters(spark, d):
    return memory.log_counters(memory.fold_operations(_ops(spark, d)))


def memory_fingerprints(spark, d):
    """The state's fingerprint around each operation: one scenario a group, since it covers all of its keys."""
    return memory.fold_with_fingerprints(_ops(spark, d)).select("scenario", "op_order", "applied", "rejection", "before", "after", "active")


def memory_foreign_targets(spark, d):
    """The same log with targets of other keys: every seventh change names the newest entry of its user, whatever its key."""
    ops = _ops(spark, d)
    w = Window.partitionBy("scenario").orderBy("op_order").rowsBetween(Window.unboundedPreceding, -1)
    any_ = F.last(F.when(F.col("kind").isin("ADD", "UPDATE"), F.format_string("%s-M%03d", "scenario", "op_order")), ignorenulls=True).over(w)
    ops = ops.withColumn("target", F.when((F.col("op_order") % 7 == 0) & F.col("kind").isin("UPDATE", "DELETE"), any_).otherwise(F.col("target")))
    return memory.told_apart(memory.fold_operations(ops), ops, memory.fold_state(ops)).select("scenario", "op_order", "applied", "rejection")


def readable_entries(spark, d):
    """Entries that a current and a historical question may read."""
    s = memory.fold_state(_ops(spark, d)).withColumn("scope", F.explode(F.array(F.lit("current"), F.lit("history"))))
    return s.where(perimeter.readable(F.col("status"), F.col("scope"))).groupBy("scenario", "scope").agg(F.count("*").alias("entries"))


def _edges(spark, d):
    """supplier - nation - region and customer - nation, with zero-padded ids: their text order is their number order."""
    n = table(spark, d, "nation")
    node = lambda kind, c: F.concat(F.lit(kind), F.lpad(F.col(c).cast("string"), 8, "0"))
    return (
        table(spark, d, "supplier").select(F.concat(F.lit("ES"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("edge_id"), node("S", "s_suppkey").alias("subject"), node("N", "s_nationkey").alias("object"))
        .union(table(spark, d, "customer").select(F.concat(F.lit("EC"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("edge_id"), node("C", "c_custkey").alias("subject"), node("N", "c_nationkey").alias("object")))
        .union(n.select(F.concat(F.lit("EN"), F.lpad(F.col("n_nationkey").cast("string"), 8, "0")).alias("edge_id"), node("N", "n_nationkey").alias("subject"), node("R", "n_regionkey").alias("object")))
    )


def _anchors(spark, d):
    """Suppliers with a number divisible by 20, nations with one divisible by 5, and all regions."""
    e = _edges(spark, d)
    nodes = e.select(F.col("subject").alias("node")).union(e.select("object")).distinct()
    small = F.col("node").rlike(r"^(S\d*[02468]0|N\d*[05]|R.*)$")
    return nodes.where(small)


def graph_paths_3hop(spark, d):
    return graph.shortest_paths(_edges(spark, d), _anchors(spark, d), 3)


def _parts(spark, d):
    e, a = _edges(spark, d), _anchors(spark, d)
    paths = cut(graph.shortest_paths(e, a, 3))  # read several times below
    on_path = cut(graph.path_edges(paths))
    ends = e.join(on_path.select("edge_id"), "edge_id", "left_semi")
    nodes = a.union(ends.select("subject")).union(ends.select("object"))
    return paths, on_path, graph.incident_edges(e, nodes, on_path)


def graph_incident_edges(spark, d):
    return _parts(spark, d)[2]


def graph_composite_rank(spark, d):
    _, on_path, incident = _parts(spark, d)
    return graph.composite([("path", on_path), ("incident", incident)]).select("edge_id", "part", "rank", "score")


def graph_path_complete(spark, d):
    """Paths whose edges are all among the ten first of the composite ranking."""
    paths, on_path, incident = _parts(spark, d)
    first = graph.composite([("path", on_path), ("incident", incident)]).where(F.col("rank") <= 10)
    return graph.path_complete(paths, first)


def mentioned_nodes(spark, d):
    """Names of nations and regions, and frequent words as names, in user turns and documents: a name's tokens side by
    side.  One automaton of all names goes through each text where it is."""
    t = turns(spark, d).select(F.lit("turn").alias("kind"), F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    t = t.union(table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text"))
    extra = spark.createDataFrame([("of the",), ("de la",), ("in the",), ("der und",), ("que",)], "name string")
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).union(extra)
    return graph.mentions(t, ["kind", "id"], names)


def _named(spark, d):
    """Each user turn but a conversation's last one stands for a node with names of one to three words, and for facts of its
    own and the next turn; the last turn is the question."""
    t = turns(spark, d).withColumn("w", rank_tokens(F.col("text")))
    last = F.max("session_order").over(Window.partitionBy("conv_id"))
    t = t.withColumn("n_user", last).select("conv_id", "session_order", "n_user", "text", "w")
    word = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    s = F.col("session_order").cast("string")
    nodes = t.where("session_order < n_user AND size(w) > 0").select(
        "conv_id", F.col("session_order").alias("node_order"), F.col("w")[0].alias("node_id"), F.array(word(2, 2), word(4, 1)).alias("aliases"), word(5, 3).alias("label"),
        F.array(s, (F.col("session_order") + 1).cast("string")).alias("source_fact_ids"),
    )
    items = t.where("session_order < n_user").select("conv_id", (F.col("n_user") - F.col("session_order")).alias("rank"), s.alias("item_id"), "text", F.array(s).alias("source_fact_ids"))
    return nodes, t.where("session_order = n_user").select("conv_id", F.lit("q").alias("question_id"), "text"), items


def graph_named_nodes(spark, d):
    """Nodes that a conversation's question names by id, alias or label, and by which name first."""
    nodes, questions, _ = _named(spark, d)
    return naming.mentioned_nodes(questions, nodes, ["conv_id"]).select("conv_id", "node_id", "node_order", "matched_name")


def graph_seed_nodes(spark, d):
    """The first three nodes of every other turn that the newest turns name in their raw text or share a fact with."""
    nodes, _, items = _named(spark, d)
    return naming.seed_nodes(items, nodes.where("node_order % 2 = 1"), ["conv_id"])


def graph_provenance(spark, d):
    """Proposed nodes and edges of each conversation with the messages that they come from, and what is wrong with them: every
    third node cites an unknown fact, every fifth none; the last edge ends at a node that nobody declares; messages of every fourth
    turn are not allowed."""
    t = turns(spark, d).select("conv_id", F.col("session_order").alias("s"))
    text = lambda c: c.cast("string")
    s = F.col("s")
    cited = F.when(s % 5 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(text(s)), F.when(s % 3 == 0, F.array(F.lit("F0"))).otherwise(F.array(text(s + 1)))))
    nodes = t.select("conv_id", s.alias("node_order"), F.concat(F.lit(" N"), text(s)).alias("node_id"), cited.alias("source_fact_ids"))
    edges = t.select("conv_id", s.alias("order"), F.concat(F.lit("N"), text(s)).alias("subject"), F.concat(F.lit("N"), text(s + 1), F.lit(" ")).alias("object"), F.when(s % 4 == 1, "Superato ").when(s % 4 == 2, "altro").alias("state"), cited.alias("source_fact_ids"))
    facts = t.select("conv_id", text(s).alias("fact_id"), s.alias("fact_order"), F.array(text(s), text(s - 1)).alias("source_message_ids"))
    whole, e = naming.normalised_graph(nodes, edges, facts, t.where("s % 4 <> 3").select("conv_id", text(s).alias("message_id")), ["conv_id"], (perimeter.ACTIVE, perimeter.SUPERSEDED, perimeter.RETRACTED), perimeter.ACTIVE)
    shown = lambda x, kind, name, state: x.select("conv_id", F.lit(kind).alias("kind"), name.alias("name"), F.array_join("source_message_ids", ",").alias("messages"), "provenance_valid", "provenance_problem", state.alias("state"))
    return shown(whole, "node", F.col("node_id"), F.lit(None).cast("string")).union(shown(e, "edge", F.concat_ws(" ", "edge_id", "subject", "object"), F.concat_ws(" ", "state", text(F.col("state_valid")))))


_OPS = """ops AS (SELECT user_id::VARCHAR AS scenario, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS op_order,
    (coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 5)::VARCHAR AS claim_key,
    CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'click' THEN 'ADD' WHEN 'purchase' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' ELSE 'NOOP' END AS kind
    FROM events WHERE user_id IS NOT NULL),
  ids AS (SELECT *, printf('%s-M%03d', scenario, op_order) AS mid FROM ops),
  t AS (SELECT *, CASE WHEN kind IN ('UPDATE', 'DELETE') THEN last_value(CASE WHEN kind IN ('ADD', 'UPDATE') THEN mid END IGNORE NULLS)
      OVER (PARTITION BY scenario, claim_key ORDER BY op_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS target,
    last_value(CASE WHEN kind IN ('ADD', 'DELETE') THEN kind END IGNORE NULLS) OVER (PARTITION BY scenario, claim_key ORDER BY op_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM ids)"""
# A chain of updates: the target is active if the last proposed add or update was applied and nothing took it since.  An
# update after a delete is rejected and so are those that name it, until the next add.
_FOLD = f"""{_OPS},
  o AS (SELECT *, kind IN ('ADD', 'NOOP') OR (before = 'ADD') IS TRUE AS applied FROM t),
  made AS (SELECT scenario, mid FROM o WHERE applied AND kind IN ('ADD', 'UPDATE')),
  f AS (SELECT o.*, CASE WHEN applied THEN NULL WHEN target IS NULL THEN 'target missing' WHEN made.mid IS NULL THEN 'target unknown' ELSE 'target not active' END AS rejection
    FROM o LEFT JOIN made ON made.scenario = o.scenario AND made.mid = o.target),
  taken AS (SELECT scenario, target, kind, CASE WHEN kind = 'UPDATE' THEN mid END AS successor FROM f WHERE applied AND kind IN ('UPDATE', 'DELETE')),
  st AS (SELECT f.scenario, f.mid AS entry_id, claim_key, CASE taken.kind WHEN 'UPDATE' THEN 'superato' WHEN 'DELETE' THEN 'ritirato' ELSE 'attivo' END AS status, successor AS superseded_by_entry
    FROM f LEFT JOIN taken ON taken.scenario = f.scenario AND taken.target = f.mid WHERE f.applied AND f.kind IN ('ADD', 'UPDATE'))"""

_EDGES = """ed AS (SELECT 'ES' || lpad(s_suppkey::VARCHAR, 8, '0') AS edge_id, 'S' || lpad(s_suppkey::VARCHAR, 8, '0') AS subject, 'N' || lpad(s_nationkey::VARCHAR, 8, '0') AS object FROM supplier
    UNION ALL SELECT 'EC' || lpad(c_custkey::VARCHAR, 8, '0'), 'C' || lpad(c_custkey::VARCHAR, 8, '0'), 'N' || lpad(c_nationkey::VARCHAR, 8, '0') FROM customer
    UNION ALL SELECT 'EN' || lpad(n_nationkey::VARCHAR, 8, '0'), 'N' || lpad(n_nationkey::VARCHAR, 8, '0'), 'R' || lpad(n_regionkey::VARCHAR, 8, '0') FROM nation),
  an AS (SELECT DISTINCT node FROM (SELECT subject AS node FROM ed UNION SELECT object FROM ed) WHERE regexp_full_match(node, 'S\\d*[02468]0|N\\d*[05]|R.*')),
  adj AS (SELECT edge_id, subject AS a, object AS b FROM ed UNION ALL SELECT edge_id, object, subject FROM ed WHERE subject <> object),
  p1 AS (SELECT a AS source, b AS at1, [edge_id] AS ids, [a, b] AS nodes FROM adj WHERE a IN (SELECT node FROM an)),
  p2 AS (SELECT source, b AS at1, list_append(ids, edge_id) AS ids, list_append(nodes, b) AS nodes FROM p1 JOIN adj ON at1 = a WHERE NOT list_contains(nodes, b)),
  p2m AS (SELECT source, at1, min(ids) AS ids, arg_min(nodes, ids) AS nodes FROM p2 GROUP BY ALL),
  p3 AS (SELECT source, b AS at1, list_append(ids, edge_id) AS ids FROM p2m JOIN adj ON at1 = a WHERE NOT list_contains(nodes, b)),
  pa AS (SELECT source, at1, ids FROM p1 UNION ALL SELECT source, at1, ids FROM p2m UNION ALL SELECT * FROM p3),
  paths AS (SELECT source, at1 AS target, min(len(ids)) AS hops, arg_min(ids, (len(ids), ids)) AS ids FROM pa WHERE source < at1 AND at1 IN (SELECT node FROM an) GROUP BY ALL)"""
_RANKS = f"""{_EDGES},
  pe0 AS (SELECT source, target, unnest(ids) AS edge_id, generate_subscripts(ids, 1) AS hop FROM paths),
  pe1 AS (SELECT edge_id, min((source, target, hop)) AS k FROM pe0 GROUP BY edge_id),
  pe AS (SELECT edge_id, row_number() OVER (ORDER BY k) AS pos FROM pe1),
  nd AS (SELECT node FROM an UNION SELECT subject FROM ed WHERE edge_id IN (SELECT edge_id FROM pe) UNION SELECT object FROM ed WHERE edge_id IN (SELECT edge_id FROM pe)),
  ie AS (SELECT edge_id, row_number() OVER (ORDER BY edge_id) AS pos FROM ed WHERE edge_id NOT IN (SELECT edge_id FROM pe) AND (subject IN (SELECT node FROM nd) OR object IN (SELECT node FROM nd))),
  rk AS (SELECT edge_id, part, row_number() OVER (ORDER BY k, pos) AS rank, CASE WHEN k = 0 THEN round(1 + 1 / pos, 6) ELSE round(0.5 / pos, 6) END AS score
    FROM (SELECT edge_id, 'path' AS part, 0 AS k, pos::DOUBLE AS pos FROM pe UNION ALL SELECT edge_id, 'incident', 1, pos FROM ie))"""
_TOK = "' ' || array_to_string(regexp_extract_all(lower({}), '[a-z0-9_-]+'), ' ') || ' '"

_NAMED = f"""u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS s, count(*) OVER (PARTITION BY conv_id) AS n, text,
    regexp_extract_all(lower(text), '[a-z0-9_-]+') AS w FROM conversations WHERE role = 'user'),
  nd AS (SELECT conv_id, s AS node_order, w[1] AS node_id, [w[1], array_to_string(w[2:3], ' '), array_to_string(w[4:4], ' '), array_to_string(w[5:7], ' ')] AS names, [s, s + 1] AS facts FROM u WHERE s < n AND len(w) > 0),
  nm AS (SELECT conv_id, node_order, node_id, unnest(names) AS name, generate_subscripts(names, 1) AS place FROM nd)"""
_PROV = """t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS s, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
  p AS (SELECT *, s % 5 = 0 AS bare, s % 3 = 0 AS unknown, s + 1 > n AS past FROM t),
  f AS (SELECT *, CASE WHEN bare THEN [] WHEN unknown OR past THEN [s, s - 1] ELSE [s, s - 1, s + 1, s] END AS ms, CASE WHEN bare THEN [] WHEN unknown THEN ['unknown fact: F0'] WHEN past THEN ['unknown fact: ' || (s + 1)] ELSE [] END AS un FROM p),
  g AS (SELECT *, list_filter(ms, lambda m: m > 0 AND m % 4 <> 3) AS good, list_transform(list_filter(ms, lambda m: m <= 0 OR m % 4 = 3), lambda m: 'message not allowed: ' || m) AS bad FROM f),
  h AS (SELECT *, list_concat(bad, un, CASE WHEN bare THEN ['no source fact'] ELSE [] END) AS problems,
    list_filter(good, lambda m, i: NOT list_contains(good[1:i - 1], m)) AS messages FROM g)"""
QUERIES = {
    "graph_named_nodes": (graph_named_nodes, f"""WITH {_NAMED} SELECT u.conv_id, node_id, node_order, arg_min(name, place) AS matched_name FROM u JOIN nm ON u.conv_id = nm.conv_id
WHERE s = n AND name <> '' AND contains({_TOK.format('text')}, {_TOK.format('name')}) GROUP BY ALL"""),
    "graph_seed_nodes": (graph_seed_nodes, f"""WITH {_NAMED}, it AS (SELECT conv_id, n - s AS rank, s, lower(text) AS low FROM u WHERE s < n),
  hit AS (SELECT it.conv_id, rank, s, node_id, node_order FROM it JOIN nm ON it.conv_id = nm.conv_id WHERE node_order % 2 = 1 AND place < 4 AND name <> '' AND contains(low, name)
    UNION SELECT it.conv_id, rank, s, node_id, node_order FROM it JOIN nd ON it.conv_id = nd.conv_id AND list_contains(facts, s) WHERE node_order % 2 = 1),
  k AS (SELECT conv_id, node_id, min((rank, node_order, s)) AS k FROM hit GROUP BY ALL),
  r AS (SELECT conv_id, node_id, k[3]::VARCHAR AS from_item, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS pos FROM k)
SELECT * FROM r WHERE pos <= 3"""),
    "graph_provenance": (graph_provenance, f"""WITH {_PROV}
SELECT conv_id, 'node' AS kind, 'N' || s AS name, array_to_string(messages, ',') AS messages, len(problems) = 0 AS provenance_valid, CASE WHEN len(problems) > 0 THEN array_to_string(problems, '; ') END AS provenance_problem, NULL::VARCHAR AS state FROM h
UNION ALL SELECT conv_id, 'edge', printf('E%03d N%d N%d', s, s, s + 1), array_to_string(messages, ','), len(problems) = 0 AND NOT past,
  CASE WHEN len(problems) > 0 OR past THEN array_to_string(list_concat(problems, CASE WHEN past THEN ['object is not a declared node: N' || (s + 1)] ELSE [] END), '; ') END,
  CASE s % 4 WHEN 1 THEN 'superato true' WHEN 2 THEN 'altro false' ELSE 'attivo true' END FROM h"""),
    "memory_fold_ops": (memory_fold_ops, f"WITH {_FOLD} SELECT scenario, op_order, claim_key, kind, applied, rejection, CASE WHEN applied AND kind IN ('ADD', 'UPDATE') THEN mid END AS entry_id, CASE WHEN applied AND kind IN ('UPDATE', 'DELETE') THEN target END AS supersedes FROM f"),
    "memory_fold_state": (memory_fold_state, f"WITH {_FOLD} SELECT * FROM st"),
    "memory_current_archive": (memory_current_archive, f"WITH {_FOLD} SELECT scenario, CASE WHEN status = 'attivo' THEN 'current' ELSE 'archive' END AS part, count(*) AS entries, count(DISTINCT claim_key) AS keys FROM st GROUP BY ALL"),
    "memory_log_counters": (memory_log_counters, f"WITH {_FOLD} SELECT scenario, count(*) AS proposed, count(*) FILTER (WHERE applied) AS applied, count(*) FILTER (WHERE NOT applied) AS rejected, " + ", ".join(f"count(*) FILTER (WHERE applied AND kind = '{k}') AS n_{k.lower()}" for k in memory.KINDS) + " FROM f GROUP BY scenario"),
    "memory_fingerprints": (memory_fingerprints, None),
    "memory_foreign_targets": (memory_foreign_targets, None),
    "readable_entries": (readable_entries, f"WITH {_FOLD} SELECT scenario, scope, count(*) AS entries FROM st CROSS JOIN (VALUES ('current'), ('history')) s(scope) WHERE scope = 'history' OR status = 'attivo' GROUP BY ALL"),
    "graph_paths_3hop": (graph_paths_3hop, f"WITH {_EDGES} SELECT source, target, hops, array_to_string(ids, ',') AS edge_ids FROM paths"),
    "graph_incident_edges": (graph_incident_edges, f"WITH {_RANKS} SELECT edge_id, pos, round(0.5 / pos, 6) AS score FROM ie"),
    "graph_composite_rank": (graph_composite_rank, f"WITH {_RANKS} SELECT * FROM rk"),
    "graph_path_complete": (graph_path_complete, f"""WITH {_RANKS} SELECT source, target, bool_and(rank IS NOT NULL) AS complete, coalesce(string_agg(pe0.edge_id, ',' ORDER BY pe0.edge_id) FILTER (WHERE rank IS NULL), '') AS missing
FROM pe0 LEFT JOIN (SELECT edge_id, rank FROM rk WHERE rank <= 10) x USING (edge_id) GROUP BY source, target"""),
    "mentioned_nodes": (mentioned_nodes, f"""WITH names AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL VALUES ('of the'), ('de la'), ('in the'), ('der und'), ('que'))
SELECT kind, id, name FROM (SELECT 'turn' AS kind, conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'user' UNION ALL SELECT 'document', doc_id::VARCHAR, text FROM documents)
JOIN names ON contains({_TOK.format('text')}, {_TOK.format('name')})"""),
}
