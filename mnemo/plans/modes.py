"""Queries on memory architectures end to end: facts, versioned state, tiers and graphs as contexts of a question.

Stand-ins over conversations: the sentences of earlier user turns are facts; a fact's tokens modulo 5 are its claim key,
and in each key the operations run ADD, UPDATE, UPDATE, DELETE and again.  A fact's first and last word are the ends of
an edge.  The last user turn is the question.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import count_tokens, rank_tokens
from ..operators import budget, graph, items, memory, perimeter, ranking
from ..operators.perimeter import ACTIVE, SUPERSEDED
from .common import BUDGET, T_SQL, count_sql, scores_sql, turns
from .retrieval import LIKES_SQL, MARKERS

KEY = ["conv_id"]
SEEDS, SEED_NODES, HOPS = 3, 3, 3


def _facts(spark, d):
    h = perimeter.history(turns(spark, d))
    s = h.select("conv_id", "session_order", F.format_string("c%d-%d", "conv_id", "turn").alias("message"), F.posexplode(F.split("text", r"\. ")).alias("pos", "text")).where(F.length(F.trim("text")) > 0)
    s = s.withColumn("order", F.row_number().over(Window.partitionBy("conv_id").orderBy("session_order", "pos")).cast("long"))
    return s.select("conv_id", "session_order", "order", "text", F.format_string("c%d-F%03d", "conv_id", "order").alias("fact_id"), F.array("message").alias("source_message_ids"))


def _entries(spark, d):
    """The facts' operations, folded."""
    f = _facts(spark, d).withColumn("claim_key", (count_tokens(F.col("text")) % 5).cast("string"))
    own = Window.partitionBy("conv_id", "claim_key").orderBy("order")
    turn = F.row_number().over(own) % 4
    scenario = F.col("conv_id").cast("string")
    made = F.format_string("%s-M%03d", scenario, "order")
    kind = F.when(turn == 1, "ADD").when(turn == 0, "DELETE").otherwise("UPDATE")
    ops = f.withColumn("kind", kind).withColumn("target", F.when(F.col("kind") != "ADD", F.lag(made).over(own)))
    log = ops.select(scenario.alias("scenario"), F.col("order").alias("op_order"), F.format_string("%s-OP%03d", scenario, "order").alias("op_id"), "claim_key", "kind", "target", F.col("text").alias("value"))
    state = memory.fold_state(log).select(F.col("scenario").cast("long").alias("conv_id"), "entry_id", "claim_key", "value", "status", F.col("op_order").alias("order"))
    return state.join(f.select("conv_id", "order", "session_order", "source_message_ids", F.array("fact_id").alias("source_fact_ids")), ["conv_id", "order"])


def _questions(spark, d):
    q = perimeter.questions(turns(spark, d))
    return q.withColumn("scope", perimeter.scope(F.col("text"), MARKERS))


def _ranked(q, rows):
    s = ranking.cosine_scores(q.select("conv_id", "text"), rows.select("conv_id", "item_id", "text"), KEY, ["item_id"])
    return ranking.rank_rounded(rows.join(s, [*KEY, "item_id"]), KEY, [F.col("session_order"), F.col("item_order")])


def _mode_f(spark, d):
    return budget.prefix_within_budget(_ranked(_questions(spark, d), items.fact_items(_facts(spark, d), KEY)), KEY, F.lit(BUDGET))


def _readable(spark, d):
    return _entries(spark, d).join(_questions(spark, d).select("conv_id", "scope"), "conv_id")


def _state_ranked(spark, d):
    return _ranked(_questions(spark, d), items.state_items(_readable(spark, d), KEY, F.col("scope")))


def _mode_u(spark, d):
    return budget.prefix_within_budget(_state_ranked(spark, d), KEY, F.lit(BUDGET))


def _mode_ger(spark, d):
    e = _readable(spark, d).withColumn("reached", F.max("session_order").over(Window.partitionBy("conv_id")))
    rows = items.tier_items(e, KEY, F.col("scope"), budget.level(F.col("session_order"), F.col("reached")))
    limit = items.budget_required(F.lit("GER"), F.lit(BUDGET))
    return budget.two_phase(_ranked(_questions(spark, d), rows), KEY, limit)


def _context(x):
    c = items.contexts(x, KEY)
    return c.select("conv_id", "examined", "n_items", "context_tokens", "content_tokens", "overhead_tokens", "item_ids", F.sha2("context", 256).alias("context_sha256"), F.array_join("provenance", ",").alias("provenance"))


def context_facts(spark, d):
    return _context(_mode_f(spark, d))


def context_state(spark, d):
    return _context(_mode_u(spark, d))


def context_tiers(spark, d):
    return _context(_mode_ger(spark, d))


def trial_state(spark, d):
    """What the question needs: every third fact, from its own message and the message before it, if any."""
    f = _facts(spark, d).where("order % 3 = 0")
    before = F.regexp_replace(F.col("source_message_ids")[0], "-[0-9]+$", "-0")
    f = f.select("conv_id", F.col("fact_id").alias("fact_key"), F.array_distinct(F.when(F.col("order") % 2 == 0, F.concat("source_message_ids", F.array(before))).otherwise(F.col("source_message_ids"))).alias("source_message_ids"))
    x = _mode_u(spark, d)
    return items.trial(items.contexts(x, KEY), x, f, KEY)


def tier_basis(spark, d):
    """Entries by what their date rests on."""
    return _entries(spark, d).groupBy(items.by_value(F.col("status"), items.RECENCY_BASIS).alias("basis")).agg(F.count("*").alias("n"))


def _graph(spark, d):
    """(edges, nodes) of each conversation's graph."""
    t = _facts(spark, d).withColumn("w", rank_tokens(F.col("text"))).where(F.size("w") > 1)
    e = t.select("conv_id", "order", F.format_string("c%d-E%03d", "conv_id", "order").alias("edge_id"), F.col("w")[0].alias("subject"), F.lit("segue").alias("relation"), F.element_at("w", -1).alias("object"), F.when(F.col("order") % 5 == 0, SUPERSEDED).otherwise(ACTIVE).alias("state"), "source_message_ids", F.array("fact_id").alias("source_fact_ids"))
    e = e.where("subject <> object")
    ends = e.select("conv_id", F.explode(F.array(F.struct(F.col("subject").alias("node"), (2 * F.col("order")).alias("o")), F.struct(F.col("object").alias("node"), (2 * F.col("order") + 1).alias("o")))).alias("x"), F.col("source_fact_ids")[0].alias("fact"))
    n = ends.groupBy("conv_id", "x.node").agg(F.min("x.o").alias("node_order"), F.collect_set("fact").alias("source_fact_ids"))
    return e, n


def _retrieval(spark, d):
    e, n = _graph(spark, d)
    q = _questions(spark, d)
    ranked = _state_ranked(spark, d)
    return graph.context(q, e, n, ranked, KEY, BUDGET, SEEDS, SEED_NODES, HOPS)


def graph_context(spark, d):
    """Anchors, paths between them, and the context that they give, of each question."""
    return graph.context_report(_retrieval(spark, d), KEY).select("conv_id", "anchors", "pairs", "paths", "discarded", "complete", "item_ids", "context_tokens", F.sha2("context", 256).alias("context_sha256"))


def graph_question_paths(spark, d):
    """Paths with their ids, and pairs without one."""
    return _retrieval(spark, d)["paths"].select("conv_id", "source", "target", "path_id", F.array_join("ids", ",").alias("edge_ids"))


def graph_unselected(spark, d):
    """Why an edge is not in the context."""
    return graph.unselected(_retrieval(spark, d), KEY)


_FACTS = f"""{T_SQL},
  se AS (SELECT conv_id, session_order, turn, unnest(string_split(text, '. ')) AS text, generate_subscripts(string_split(text, '. '), 1) AS pos FROM h),
  fa AS (SELECT conv_id, session_order, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY session_order, pos) AS ord, 'c' || conv_id || '-' || turn AS message FROM se WHERE length(trim(text)) > 0),
  op AS (SELECT *, row_number() OVER w AS j, lead(ord) OVER w AS nxt FROM (SELECT *, {count_sql('text')} % 5 AS ck FROM fa) WINDOW w AS (PARTITION BY conv_id, ck ORDER BY ord)),
  en AS (SELECT conv_id, session_order, ord, text, message, CASE WHEN nxt IS NULL THEN 'attivo' WHEN (j + 1) % 4 = 0 THEN 'ritirato' ELSE 'superato' END AS status, printf('%s-M%03d', conv_id::VARCHAR, ord) AS entry_id FROM op WHERE j % 4 <> 0),
  qs AS (SELECT conv_id, text, {LIKES_SQL} AS past FROM q),
  rd AS (SELECT en.*, max(session_order) OVER (PARTITION BY en.conv_id) AS reached FROM en),
  re AS (SELECT rd.* FROM rd JOIN qs USING (conv_id) WHERE past OR status = 'attivo')"""
_F = "dd AS (SELECT conv_id, session_order, ord AS item_order, printf('c%s-F%03d', conv_id::VARCHAR, ord) AS item_id, text, message, printf('[c%s-F%03d | da: %s] ', conv_id::VARCHAR, ord, message) || text AS render FROM fa)"
_U = "dd AS (SELECT conv_id, session_order, ord AS item_order, entry_id AS item_id, text, message, '[' || entry_id || ' | ' || status || ' | da: ' || message || '] ' || text AS render FROM re)"
_GER = """dd AS (SELECT conv_id, session_order, ord AS item_order, entry_id AS item_id, text, message, CASE WHEN session_order >= reached - 1 THEN 'recent' ELSE 'archive' END AS level,
    '[' || entry_id || ' | ' || CASE WHEN session_order >= reached - 1 THEN 'recente' ELSE 'archivio' END || ' | ' || status || ' | da: ' || message || '] ' || text AS render FROM re)"""
_RANKED = f"""{scores_sql('q', 'dd', 'conv_id', 'item_id')},
  rr AS (SELECT dd.*, round(score, 6) AS score, row_number() OVER (PARTITION BY dd.conv_id ORDER BY round(score, 6) DESC, session_order, item_order) AS rank, {count_sql('render')} AS tokens, {count_sql('text')} AS content FROM dd JOIN s USING (conv_id, item_id))"""
_PREFIX = f"sl AS (SELECT *, score > 0 AND (sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank) <= {BUDGET} OR rank = 1) AS selected FROM rr)"
_TWO = f"""b1 AS (SELECT *, score > 0 AS ok, CASE WHEN level = 'recent' THEN {BUDGET // 2} ELSE {BUDGET - BUDGET // 2} END AS quota, sum(CASE WHEN score > 0 THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id, level ORDER BY rank) AS c1 FROM rr),
  b2 AS (SELECT *, ok AND c1 <= quota AS one FROM b1),
  b3 AS (SELECT *, coalesce(sum(CASE WHEN one THEN tokens END) OVER (PARTITION BY conv_id), 0) AS used, sum(CASE WHEN ok AND NOT one THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY rank) AS c2 FROM b2),
  sl AS (SELECT *, one OR (ok AND used + c2 <= {BUDGET}) AS selected FROM b3)"""
_CONTEXT = """pv AS (SELECT conv_id, string_agg(message, ',' ORDER BY r) AS provenance FROM (SELECT conv_id, message, min(rank) AS r FROM sl WHERE selected GROUP BY ALL) GROUP BY conv_id),
  cx AS (SELECT conv_id, count(*) AS examined, count(*) FILTER (WHERE selected) AS n_items, coalesce(sum(tokens) FILTER (WHERE selected), 0)::BIGINT AS context_tokens, coalesce(sum(content) FILTER (WHERE selected), 0)::BIGINT AS content_tokens,
    coalesce(sum(tokens - content) FILTER (WHERE selected), 0)::BIGINT AS overhead_tokens, coalesce(string_agg(item_id, ',' ORDER BY rank) FILTER (WHERE selected), '') AS item_ids,
    sha256(coalesce(string_agg(render, chr(10) ORDER BY rank) FILTER (WHERE selected), '')) AS context_sha256 FROM sl GROUP BY conv_id)"""
_SHOW = "SELECT cx.*, coalesce(provenance, '') AS provenance FROM cx LEFT JOIN pv USING (conv_id)"

_GRAPH = f"""WITH {_FACTS}, {_U}, {_RANKED},
  tk AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9_-]+') AS w FROM fa),
  ed AS (SELECT conv_id, ord, printf('c%s-E%03d', conv_id::VARCHAR, ord) AS edge_id, w[1] AS subject, w[len(w)] AS object, CASE WHEN ord % 5 = 0 THEN 'superato' ELSE 'attivo' END AS state, message,
    printf('c%s-F%03d', conv_id::VARCHAR, ord) AS fact FROM tk WHERE len(w) > 1 AND w[1] <> w[len(w)]),
  us AS (SELECT ed.* FROM ed JOIN qs USING (conv_id) WHERE past OR state = 'attivo'),
  nd AS (SELECT conv_id, node, min(o) AS node_order, list(DISTINCT fact) AS facts FROM (SELECT conv_id, subject AS node, 2 * ord AS o, fact FROM ed UNION ALL SELECT conv_id, object, 2 * ord + 1, fact FROM ed) GROUP BY ALL),
  qn AS (SELECT nd.conv_id, node, node_order FROM nd JOIN qs USING (conv_id) WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9_-]+'), node)),
  sd AS (SELECT conv_id, rank, text, printf('c%s-F%03d', conv_id::VARCHAR, item_order) AS fact FROM rr WHERE score > 0 AND rank <= {SEEDS}),
  en0 AS (SELECT nd.conv_id, node, min((rank, node_order)) AS k FROM nd JOIN sd USING (conv_id) WHERE contains(lower(sd.text), node) OR list_contains(facts, sd.fact) GROUP BY ALL),
  en1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS pos FROM en0),
  an AS (SELECT conv_id, node, row_number() OVER (PARTITION BY conv_id ORDER BY part, o) AS a FROM (SELECT conv_id, node, 0 AS part, node_order AS o FROM qn
    UNION ALL SELECT conv_id, node, 1, pos FROM en1 WHERE pos <= {SEED_NODES} AND (conv_id, node) NOT IN (SELECT conv_id, node FROM qn))),
  adj AS (SELECT conv_id, edge_id, subject AS a, object AS b FROM us UNION ALL SELECT conv_id, edge_id, object, subject FROM us),
  p1 AS (SELECT an.conv_id, node AS source, b AS at1, [edge_id] AS ids, [adj.a, b] AS nodes FROM an JOIN adj ON adj.conv_id = an.conv_id AND adj.a = node),
  p1m AS (SELECT conv_id, source, at1, min(ids) AS ids, arg_min(nodes, ids) AS nodes FROM p1 GROUP BY ALL),
  p2 AS (SELECT p.conv_id, source, b AS at1, list_append(ids, edge_id) AS ids, list_append(nodes, b) AS nodes FROM p1m p JOIN adj ON p.conv_id = adj.conv_id AND at1 = a WHERE NOT list_contains(nodes, b)),
  p2m AS (SELECT conv_id, source, at1, min(ids) AS ids, arg_min(nodes, ids) AS nodes FROM p2 GROUP BY ALL),
  p3 AS (SELECT p.conv_id, source, b AS at1, list_append(ids, edge_id) AS ids FROM p2m p JOIN adj ON p.conv_id = adj.conv_id AND at1 = a WHERE NOT list_contains(nodes, b)),
  pa AS (SELECT conv_id, source, at1, ids FROM p1m UNION ALL SELECT conv_id, source, at1, ids FROM p2m UNION ALL SELECT * FROM p3),
  be AS (SELECT conv_id, source, at1 AS target, arg_min(ids, (len(ids), ids)) AS ids FROM pa GROUP BY ALL),
  pr AS (SELECT s.conv_id, s.node AS source, t.node AS target, s.a AS i, t.a AS j, be.ids FROM an s JOIN an t ON s.conv_id = t.conv_id AND s.a < t.a LEFT JOIN be ON be.conv_id = s.conv_id AND be.source = s.node AND be.target = t.node),
  pw AS (SELECT *, CASE WHEN ids IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, ids IS NULL ORDER BY i, j) END AS k FROM pr),
  pe0 AS (SELECT conv_id, k, unnest(ids) AS edge_id, generate_subscripts(ids, 1) AS hop FROM pw WHERE ids IS NOT NULL),
  pe AS (SELECT conv_id, edge_id, row_number() OVER (PARTITION BY conv_id ORDER BY min((k, hop))) AS pos FROM pe0 GROUP BY conv_id, edge_id),
  tc AS (SELECT conv_id, node FROM an UNION SELECT us.conv_id, subject FROM us JOIN pe USING (conv_id, edge_id) UNION SELECT us.conv_id, object FROM us JOIN pe USING (conv_id, edge_id)),
  ot AS (SELECT conv_id, edge_id, row_number() OVER (PARTITION BY conv_id ORDER BY edge_id) AS pos FROM us WHERE (conv_id, edge_id) NOT IN (SELECT conv_id, edge_id FROM pe) AND ((conv_id, subject) IN (SELECT * FROM tc) OR (conv_id, object) IN (SELECT * FROM tc))),
  er AS (SELECT conv_id, edge_id, '[' || edge_id || ' | ' || subject || ' -segue-> ' || object || ' | ' || state || ' | da: ' || message || ']' AS render FROM us),
  al AS (SELECT conv_id, 0 AS part, pos, edge_id AS item_id, round(1 + 1 / pos::DOUBLE, 6) AS score, render FROM pe JOIN er USING (conv_id, edge_id)
    UNION ALL SELECT conv_id, CASE WHEN rank <= {SEEDS} THEN 1 ELSE 3 END, rank, item_id, score, render FROM rr WHERE score > 0
    UNION ALL SELECT conv_id, 2, pos, edge_id, round(0.5 / pos, 6), render FROM ot JOIN er USING (conv_id, edge_id)),
  am AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS rank, {count_sql('render')} AS tokens FROM al),
  sl AS (SELECT *, score > 0 AND (sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank) <= {BUDGET} OR rank = 1) AS selected FROM am),
  ch AS (SELECT * FROM sl WHERE selected)"""

QUERIES = {
    "context_facts": (context_facts, f"WITH {_FACTS}, {_F}, {_RANKED}, {_PREFIX}, {_CONTEXT} {_SHOW}"),
    "context_state": (context_state, f"WITH {_FACTS}, {_U}, {_RANKED}, {_PREFIX}, {_CONTEXT} {_SHOW}"),
    "context_tiers": (context_tiers, f"WITH {_FACTS}, {_GER}, {_RANKED}, {_TWO}, {_CONTEXT} {_SHOW}"),
    "trial_state": (trial_state, f"""WITH {_FACTS}, {_U}, {_RANKED}, {_PREFIX},
  nf AS (SELECT conv_id, ord, message FROM fa WHERE ord % 3 = 0 UNION SELECT conv_id, ord, 'c' || conv_id || '-0' FROM fa WHERE ord % 6 = 0),
  hv AS (SELECT DISTINCT conv_id, item_id, message FROM sl WHERE selected),
  mt AS (SELECT nf.conv_id, ord, item_id FROM nf JOIN hv USING (conv_id, message) GROUP BY ALL HAVING count(*) = any_value((SELECT count(*) FROM nf n WHERE n.conv_id = nf.conv_id AND n.ord = nf.ord))),
  ev AS (SELECT DISTINCT conv_id, message FROM nf), sn AS (SELECT DISTINCT conv_id, message FROM hv)
SELECT conv_id, coalesce((SELECT count(DISTINCT ord) FROM nf WHERE nf.conv_id = k.conv_id), 0) AS facts, (SELECT count(DISTINCT ord) FROM mt WHERE mt.conv_id = k.conv_id) AS facts_matched, (SELECT count(*) FROM mt WHERE mt.conv_id = k.conv_id) AS matches,
  (SELECT count(*) FROM ev JOIN sn USING (conv_id, message) WHERE ev.conv_id = k.conv_id) AS evidence_in_context,
  CASE WHEN (SELECT count(*) FROM ev WHERE ev.conv_id = k.conv_id) > 0 THEN (SELECT count(*) FROM ev JOIN sn USING (conv_id, message) WHERE ev.conv_id = k.conv_id) = (SELECT count(*) FROM ev WHERE ev.conv_id = k.conv_id) END AS evidence_complete
FROM (SELECT DISTINCT conv_id FROM sl) k"""),
    "tier_basis": (tier_basis, f"WITH {_FACTS} SELECT CASE status WHEN 'attivo' THEN 'creazione' WHEN 'superato' THEN 'creazione (la versione successiva e'' una voce a se'')' ELSE 'creazione (la sessione del ritiro non e'' registrata nello stato)' END AS basis, count(*) AS n FROM en GROUP BY 1"),
    "graph_context": (graph_context, f"""{_GRAPH}
SELECT k.conv_id, coalesce((SELECT string_agg(node, ',' ORDER BY a) FROM an WHERE an.conv_id = k.conv_id), '') AS anchors, (SELECT count(*) FROM pw WHERE pw.conv_id = k.conv_id) AS pairs,
  (SELECT count(ids) FROM pw WHERE pw.conv_id = k.conv_id) AS paths, (SELECT count(*) - count(ids) FROM pw WHERE pw.conv_id = k.conv_id) AS discarded,
  coalesce((SELECT bool_and((pe0.conv_id, edge_id) IN (SELECT conv_id, item_id FROM ch)) FROM pe0 WHERE pe0.conv_id = k.conv_id), false) AS complete,
  coalesce((SELECT string_agg(item_id, ',' ORDER BY rank) FROM ch WHERE ch.conv_id = k.conv_id), '') AS item_ids, coalesce((SELECT sum(tokens) FROM ch WHERE ch.conv_id = k.conv_id), 0)::BIGINT AS context_tokens,
  sha256(coalesce((SELECT string_agg(render, chr(10) ORDER BY rank) FROM ch WHERE ch.conv_id = k.conv_id), '')) AS context_sha256
FROM q k"""),
    "graph_question_paths": (graph_question_paths, f"{_GRAPH} SELECT conv_id, source, target, CASE WHEN k IS NOT NULL THEN printf('P%02d', k) END AS path_id, array_to_string(ids, ',') AS edge_ids FROM pw"),
    "graph_unselected": (graph_unselected, f"""{_GRAPH}
SELECT conv_id, edge_id, CASE WHEN NOT past AND state <> 'attivo' THEN 'state not readable' WHEN (conv_id, edge_id) NOT IN (SELECT conv_id, edge_id FROM pe UNION SELECT conv_id, edge_id FROM ot) THEN 'off topic' ELSE 'outside the budget' END AS reason
FROM ed JOIN qs USING (conv_id) WHERE (conv_id, edge_id) NOT IN (SELECT conv_id, item_id FROM ch)"""),
}
