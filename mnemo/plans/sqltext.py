"""Queries whose work is one SQL text over registered functions, and optional paths into records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import register
from ..operators import paths
from .common import BUDGET, table
from .evaluation import _SAID_SQL, ANSWERS
from .retrieval import _summary_sql

#: Ranking of each conversation's earlier user turns against its last one, and a budget over it.
BUDGET_TEXT = f"""
WITH u AS (SELECT conv_id, turn, text, rank_tokens(text) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS s, count(*) OVER (PARTITION BY conv_id) AS n_user FROM {{conversations}} WHERE role = 'user'),
  h AS (SELECT * FROM u WHERE s < n_user),
  tf AS (SELECT conv_id, s, term, count(*) AS tf FROM h LATERAL VIEW explode(words) t AS term GROUP BY conv_id, s, term),
  n AS (SELECT conv_id, count(*) AS n FROM h GROUP BY conv_id),
  df AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY conv_id, term),
  idf AS (SELECT conv_id, term, smoothed_idf(n, df) AS idf FROM df JOIN n USING (conv_id)),
  dw AS (SELECT conv_id, s, term, tf * idf AS w FROM tf JOIN idf USING (conv_id, term)),
  qw AS (SELECT conv_id, term, count(*) * first(idf) AS q FROM (SELECT conv_id, term FROM u LATERAL VIEW explode(words) t AS term WHERE s = n_user) JOIN idf USING (conv_id, term) GROUP BY conv_id, term),
  norms AS (SELECT conv_id, s, sqrt(sum(w * w)) AS norm FROM dw GROUP BY conv_id, s),
  qn AS (SELECT conv_id, sqrt(sum(q * q)) AS norm FROM qw GROUP BY conv_id),
  dots AS (SELECT conv_id, s, sum(w * q) AS dot FROM dw JOIN qw USING (conv_id, term) GROUP BY conv_id, s),
  sc AS (SELECT h.conv_id, h.s, turn, text, round(coalesce(dot / (norms.norm * qn.norm), 0), 6) AS score FROM h LEFT JOIN dots ON dots.conv_id = h.conv_id AND dots.s = h.s
    LEFT JOIN norms ON norms.conv_id = h.conv_id AND norms.s = h.s LEFT JOIN qn ON qn.conv_id = h.conv_id),
  r AS (SELECT conv_id, turn, score, count_tokens(concat('[', conv_id, '-', turn, '] ', text)) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, s) AS rank FROM sc),
  b AS (SELECT * FROM within_budget(TABLE(SELECT * FROM r), key => 'conv_id', budget => {BUDGET}))
SELECT conv_id, count(*) AS examined, count_if(selected) AS n_selected, coalesce(sum(tokens) FILTER (WHERE selected), 0) AS context_tokens, CAST(max(CAST(over_budget_first AS INT)) AS BIGINT) AS over_budget_first,
  min_by(turn, rank) FILTER (WHERE NOT selected) AS stopped_by, min_by(CASE WHEN score <= 0 THEN 'zero score' ELSE 'does not fit' END, rank) FILTER (WHERE NOT selected) AS stop_reason,
  array_join(transform(array_sort(collect_list(struct(rank, CAST(turn AS STRING) AS t)) FILTER (WHERE selected)), x -> x.t), ',') AS selected_items
FROM b GROUP BY conv_id"""
PARSE_TEXT = """
SELECT doc_id, coalesce(a.error, a.value, 'null') AS one, coalesce(b.error, array_join(b.values, '+')) AS many, coalesce(c.error, concat_ws('=', c.status, c.answer)) AS answer, CAST(coalesce(size(r.elements), -1) AS BIGINT) AS embedded
FROM {said} AS s, LATERAL parse_answer('one', s.t) AS a, LATERAL parse_answer('many', s.t) AS b, LATERAL parse_answer('status', s.t) AS c, LATERAL parse_answer('array', s.t) AS r"""


def sql_rank_and_budget(spark, d):
    return register(spark).sql(BUDGET_TEXT, conversations=table(spark, d, "conversations"))


def sql_parse_answers(spark, d):
    said = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ANSWERS)), (F.pmod("doc_id", F.lit(len(ANSWERS))) + 1).cast("int")).alias("t"))
    return register(spark).sql(PARSE_TEXT, said=said)


#: What is read of a record; the levels may be missing, null or of another type.
RECORD_PATHS = {"k": ("$.props.k", "long"), "kind": ("$.event.kind", "string"), "worth": ("$.event.amounts[1]", "double"), "flag": ("$.event.flag", "boolean"), "none": ("$.a.b[0].c", "string")}


def _records(spark, d):
    """Events as nested records whose levels are missing, null or of another type, by number."""
    e = table(spark, d, "events").where("event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL")
    i = F.col("event_id")
    text = lambda c: c.cast("string")
    event = F.when(i % 7 == 0, "null").when(i % 7 == 1, F.lit("[1]")).otherwise(
        F.concat(F.lit('{"kind": '), F.when(i % 5 == 0, text(i)).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))), F.lit(', "amounts": ['), text(i), F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(", "), text(F.col("user_id")))), F.lit('], "flag": '), F.when(i % 4 == 0, '"true"').otherwise("true"), F.lit("}"))
    )
    return e.select("event_id", F.when(i % 23 == 0, "{").otherwise(F.concat(F.lit('{"props": '), F.coalesce("props", F.lit("null")), F.lit(', "event": '), event, F.lit("}"))).alias("record"))


def optional_paths(spark, d):
    return paths.at_paths(_records(spark, d), "record", RECORD_PATHS).drop("record")


def optional_elements(spark, d):
    return paths.elements(_records(spark, d), "record", "$.event.amounts", {"amount": ("$", "long")}).select("event_id", F.col("place").cast("long").alias("place"), "amount")


_E = "e AS (SELECT event_id AS i, user_id, event_type, props, event_id % 23 = 0 AS broken, event_id % 7 > 1 AS whole FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL)"
QUERIES = {
    "sql_rank_and_budget": (sql_rank_and_budget, _summary_sql(str(BUDGET))),
    "sql_parse_answers": (sql_parse_answers, _SAID_SQL),
    "optional_paths": (optional_paths, f"""WITH {_E} SELECT i AS event_id, CASE WHEN NOT broken THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN NOT broken AND whole AND i % 5 <> 0 THEN event_type END AS kind,
  CASE WHEN NOT broken AND whole AND i % 3 <> 0 THEN user_id::DOUBLE END AS worth, CASE WHEN NOT broken AND whole AND i % 4 <> 0 THEN true END AS flag, NULL::VARCHAR AS none FROM e"""),
    "optional_elements": (optional_elements, f"WITH {_E} SELECT i AS event_id, p::BIGINT AS place, CASE p WHEN 0 THEN i ELSE user_id END AS amount FROM e CROSS JOIN (VALUES (0), (1)) v(p) WHERE NOT broken AND whole AND (p = 0 OR i % 3 <> 0)"),
}
