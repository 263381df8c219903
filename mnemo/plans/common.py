"""Shared views of the test tables, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BUDGET_TOKEN, RANK_TOKEN, count_tokens
from ..operators import perimeter, ranking

BUDGET = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perimeter.user_turns(table(spark, sf_dir, "conversations"))


def rendered(df: DataFrame) -> DataFrame:
    """Memory rows with the line that a context shows and its tokens."""
    line = F.concat(F.lit("["), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("] "), F.col("text"))
    return df.withColumn("render", line).withColumn("tokens", count_tokens(line)).withColumn("content_tokens", count_tokens(F.col("text")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's memory with its score against the question."""
    t = turns(spark, sf_dir)
    memory = perimeter.history(t)
    s = ranking.cosine_scores(perimeter.questions(t), memory.select("conv_id", "session_order", "text"), ["conv_id"], ["session_order"])
    return rendered(memory).join(s, ["conv_id", "session_order"])


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_rounded(scored(spark, sf_dir), ["conv_id"], [F.col("session_order")])


T_SQL = """u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS session_order,
    count(*) OVER (PARTITION BY conv_id) AS n_user FROM conversations WHERE role = 'user'),
  q AS (SELECT conv_id, text FROM u WHERE session_order = n_user),
  h AS (SELECT * FROM u WHERE session_order < n_user)"""


def count_sql(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{BUDGET_TOKEN}')) AS BIGINT)"


def scores_sql(queries: str, docs: str, corpus: str, doc: str, out: str = "s") -> str:
    """CTEs that end in ``out`` (corpus, doc, score), as ranking.cosine_scores computes them."""
    c, d = corpus, doc
    on = " AND ".join(f"{{0}}.{x} = {{1}}.{x}" for x in c.split(", "))
    both = " AND ".join(f"{{0}}.{x} = {{1}}.{x}" for x in (c + ", " + d).split(", "))
    pre = lambda a, cols: ", ".join(f"{a}.{x}" for x in cols.split(", "))
    return f"""{out}_tf AS (SELECT {c}, {d}, term, count(*)::DOUBLE AS tf FROM (SELECT {c}, {d}, unnest(regexp_extract_all(lower(text), '{RANK_TOKEN}')) AS term FROM {docs}) GROUP BY ALL),
  {out}_n AS (SELECT {c}, count(*) AS n FROM {docs} GROUP BY ALL),
  {out}_df AS (SELECT {c}, term, count(*) AS df FROM {out}_tf GROUP BY ALL),
  {out}_idf AS (SELECT {pre('f', c)}, f.term, ln((1 + n) / (1 + df)) + 1 AS idf FROM {out}_df f JOIN {out}_n g ON {on.format('f', 'g')}),
  {out}_dw AS (SELECT {pre('t', c + ', ' + d)}, t.term, tf * idf AS w FROM {out}_tf t JOIN {out}_idf i ON t.term = i.term AND {on.format('t', 'i')}),
  {out}_norm AS (SELECT {c}, {d}, sqrt(sum(w * w)) AS norm FROM {out}_dw GROUP BY ALL),
  {out}_qt AS (SELECT {c}, term, count(*)::DOUBLE AS tf FROM (SELECT {c}, unnest(regexp_extract_all(lower(text), '{RANK_TOKEN}')) AS term FROM {queries}) GROUP BY ALL),
  {out}_qw AS (SELECT {pre('t', c)}, t.term, tf * idf AS qw FROM {out}_qt t JOIN {out}_idf i ON t.term = i.term AND {on.format('t', 'i')}),
  {out}_qn AS (SELECT {c}, sqrt(sum(qw * qw)) AS qnorm FROM {out}_qw GROUP BY ALL),
  {out}_dot AS (SELECT {pre('x', c + ', ' + d)}, sum(w * qw) AS dot FROM {out}_dw x JOIN {out}_qw y ON x.term = y.term AND {on.format('x', 'y')} GROUP BY ALL),
  {out} AS (SELECT {pre('d', c + ', ' + d)}, coalesce(dot / (norm * qnorm), 0) AS score FROM {docs} d
    LEFT JOIN {out}_dot o ON {both.format('d', 'o')} LEFT JOIN {out}_norm m ON {both.format('d', 'm')} LEFT JOIN {out}_qn k ON {on.format('d', 'k')})"""


R_SQL = f"""{T_SQL},
  {scores_sql('q', 'h', 'conv_id', 'session_order')},
  r AS (SELECT h.*, '[' || h.conv_id || '-' || turn || '] ' || text AS render, round(score, 6) AS score,
      row_number() OVER (PARTITION BY h.conv_id ORDER BY round(score, 6) DESC, h.session_order) AS rank,
      {count_sql("('[' || h.conv_id || '-' || turn || '] ' || text)")} AS tokens, {count_sql('text')} AS content_tokens
    FROM h JOIN s ON h.conv_id = s.conv_id AND h.session_order = s.session_order)"""
