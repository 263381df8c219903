"""Queries on whether an experiment's inputs hold together: episodes are conversations, their turns are messages of three
activities; selections and retrievals are made twice, once with planted faults."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import rank_tokens
from ..operators import reproduce, validate
from ..operators.quality import union
from .common import table

TOP = 4
PER_SOURCE = 50
_SHOW = ("code", "key", "detail")


def _messages(spark, d):
    c = table(spark, d, "conversations")
    turn = F.col("turn")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("episode"), "turn", (turn % 3).alias("activity"), F.coalesce("text", F.lit("")).alias("content"))


def reproduced_selection(spark, d):
    """The first documents of each source by a hash of their id, saved with swaps (every 97th id has another rank, every 89th
    is there twice, every 83rd is lost, every 79th of another source), and made again from rows in another order."""
    docs = table(spark, d, "documents").select("doc_id", "source")

    def select(rows):
        rank = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= PER_SOURCE)

    saved = select(docs).withColumn("rank", F.when(F.col("doc_id") % 97 == 0, F.col("rank") + 1).otherwise(F.col("rank")))
    saved = saved.where("doc_id % 83 <> 0").withColumn("source", F.when(F.col("doc_id") % 79 == 0, "other").otherwise(F.col("source")))
    saved = saved.union(saved.where("doc_id % 89 = 0"))
    return reproduce.differences(saved, select(docs.repartition("source", "doc_id")), ["doc_id"]).select(*_SHOW)


def permuted_ranking(spark, d):
    """A ranking of turns by a score that must not see the oracle, made from the turns as they come and from turns dealt out
    anew, in the columns of the messages only: nothing may differ.  Fingerprints of both, by episode."""
    messages = validate.without_oracle(_messages(spark, d))

    def rank(rows):
        score = F.size(F.array_distinct(rank_tokens(F.col("content"))))
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("episode").orderBy(score.desc(), "message_id"))).select("episode", "message_id", "rank")

    a, b = (reproduce.fingerprints(rank(x), ["episode", "message_id", "rank"], [F.col("episode")]) for x in (messages, messages.repartition(7, "content")))
    both = a.join(b.select("episode", F.struct("n", "a", "b").alias("again")), "episode", "left")
    return both.select("episode", "n", F.struct("n", "a", "b").eqNullSafe(F.col("again")).alias("same"))


def validate_splits(spark, d):
    """Episodes, questions and messages of two splits, of which some have slipped into the other one."""
    m = _messages(spark, d)
    split = lambda e: F.when(e % 4 == 0, "development").otherwise("evaluation")
    rows = m.select(split(F.col("episode")).alias("split"), "episode", F.concat_ws("/", "episode", "activity").alias("question"), "message_id")
    slipped = rows.where("episode % 37 = 5").withColumn("split", F.lit("development")).withColumn("message_id", F.lit(None).cast("string"))
    again = rows.where("message_id LIKE '%7-1'").withColumn("split", F.lit("development")).withColumn("episode", F.lit(None).cast("long")).withColumn("question", F.lit(None).cast("string"))
    return reproduce.disjoint(rows.union(slipped).union(again), "split", ["episode", "question", "message_id"]).select(*_SHOW)


def _oracle_tables(spark, d):
    m = _messages(spark, d)
    words = F.split("content", " ")
    first = m.where("turn < 3").withColumn("words", words)
    few = F.array_join(F.slice("words", 2, F.when(F.col("episode") % 7 == 0, 1).otherwise(4)), " ")
    value = F.when(F.col("episode") % 29 == 3, F.concat(few, F.lit(" "))).otherwise(few)
    q = F.concat_ws("/", "episode", "activity")
    answers = first.where("episode % 31 <> 4").select(q.alias("question_id"), "episode", "activity", value.alias("value"), F.when(F.col("episode") % 23 == 2, F.concat_ws("-", "episode", F.lit(1))).otherwise(F.col("message_id")).alias("evidence_id"))
    questions = first.select(q.alias("question_id"), F.when(F.col("episode") % 11 == 1, F.concat(F.lit("Is it "), few, F.lit("?"))).otherwise("What is it?").alias("text"))
    return m, questions, answers


def validate_oracle(spark, d):
    """Values of two to five words that must be in one turn of their activity: short ones are in several, some have a blank at the
    end, some evidence is of another activity, some questions tell the value, some have no answer."""
    m, questions, answers = _oracle_tables(spark, d)
    return reproduce.oracle(questions, answers, m).select(*_SHOW)


def value_places(spark, d):
    """Turns that hold a value of their episode and activity."""
    m, _, answers = _oracle_tables(spark, d)
    values = answers.select("episode", "activity", F.col("question_id").alias("value_id"), "value")
    return reproduce.value_places(m, values, ["episode", "activity"], "message_id").select("value_id", "message_id")


def validate_retrieval(spark, d):
    """The longest turns of each episode, with faults: ranks that skip one, foreign turns, scores that rise, turns left out."""
    m = _messages(spark, d).withColumn("score", F.length("content").cast("long"))
    rank = F.row_number().over(Window.partitionBy("episode").orderBy(F.desc("score"), "message_id"))
    r = m.withColumn("rank", rank).where(F.col("rank") <= TOP).where("NOT (episode % 13 = 1 AND rank = 2)")
    r = r.withColumn("message_id", F.when((F.col("episode") % 17 == 2) & (F.col("rank") == 1), F.lit("0-0")).otherwise(F.col("message_id")))
    r = r.withColumn("score", F.when((F.col("episode") % 19 == 3) & (F.col("rank") == 1), F.lit(-1)).otherwise(F.col("score")))
    return reproduce.retrieval(r.select("episode", "rank", "message_id", "score"), m.select("episode", "message_id"), ["episode"], TOP).select(*_SHOW)


def validate_audit(spark, d):
    """Documents as a snapshot: labelled ones are candidates, the others are excluded for want of a label, with faults."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    k = F.col("doc_id")
    candidates = docs.join(labels.distinct(), "doc_id", "left_semi").where(k % 41 != 1).union(docs.where(k % 43 == 2)).union(docs.where(k % 47 == 3).select((k + 10_000_000_000).alias("doc_id")))
    excluded = docs.join(labels, "doc_id", "left_anti").select("doc_id", F.when(k % 53 == 4, "because").otherwise("unlabelled").alias("criterion"))
    return reproduce.audit(docs, candidates, excluded, "doc_id", ["unlabelled"]).select(*_SHOW)


def validate_pairs(spark, d):
    """Requests of each turn under two conditions, which may differ in their context only; and what leads back to a source."""
    m = _messages(spark, d).where("turn < 2")
    one = lambda name: m.select("message_id", F.lit(name).alias("condition"), F.concat_ws("|", F.lit(name), "content").alias("context"), F.col("activity"), F.length("content").alias("size"))
    k = F.split("message_id", "-")[0].cast("long")
    other = one("shared").withColumn("size", F.when(k % 15 == 3, F.col("size") + 1).otherwise(F.col("size"))).withColumn("activity", F.when(k % 25 == 3, F.lit(None)).otherwise(F.col("activity")))
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("page"), F.concat_ws(" ", "url", "html").alias("prompt"))
    return union([reproduce.paired(one("separated").union(other), ["message_id"], "condition", ["context"]), reproduce.prompt_leaks(pages, ["page"], "prompt")]).select(*_SHOW)


_M = "m AS (SELECT conv_id || '-' || turn AS message_id, conv_id AS episode, turn, turn % 3 AS activity, coalesce(text, '') AS content FROM conversations)"
_SEL = f"sel AS (SELECT * FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS rank FROM documents) WHERE rank <= {PER_SOURCE})"
_ANS = f"""{_M}, w AS (SELECT *, string_split(content, ' ') AS ws, episode || '/' || activity AS question_id FROM m WHERE turn < 3),
  v AS (SELECT *, array_to_string(ws[2:CASE WHEN episode % 7 = 0 THEN 2 ELSE 5 END], ' ') AS few FROM w),
  an AS (SELECT *, few || CASE WHEN episode % 29 = 3 THEN ' ' ELSE '' END AS value, CASE WHEN episode % 23 = 2 THEN episode || '-1' ELSE message_id END AS evidence_id FROM v WHERE episode % 31 <> 4),
  pl AS (SELECT an.question_id AS value_id, m.message_id FROM an JOIN m ON m.episode = an.episode AND m.activity = an.activity AND value <> '' AND contains(m.content, value))"""
_PLACES = f"WITH {_ANS} SELECT value_id, message_id FROM pl"
QUERIES = {
    "reproduced_selection": (reproduced_selection, f"""WITH {_SEL}, f AS (SELECT doc_id, doc_id % 83 = 0 AS lost, doc_id % 89 = 0 AS twice, doc_id % 97 = 0 OR doc_id % 79 = 0 AS other FROM sel)
SELECT 'E-REPRODUCE' AS code, doc_id::VARCHAR AS key, CASE WHEN lost THEN 'missing' WHEN twice THEN 'repeated' ELSE 'changed' END AS detail FROM f WHERE lost OR twice OR other"""),
    "permuted_ranking": (permuted_ranking, "SELECT conv_id AS episode, count(*) AS n, true AS same FROM conversations GROUP BY conv_id"),
    "validate_splits": (validate_splits, f"""WITH {_M}, r AS (SELECT CASE WHEN episode % 4 = 0 THEN 'development' ELSE 'evaluation' END AS split, episode, episode || '/' || activity AS question, message_id FROM m),
  x AS (SELECT split, 'episode' AS kind, episode::VARCHAR AS id FROM r UNION ALL SELECT split, 'question', question FROM r UNION ALL SELECT split, 'message_id', message_id FROM r
    UNION ALL SELECT 'development', 'episode', episode::VARCHAR FROM r WHERE episode % 37 = 5 UNION ALL SELECT 'development', 'question', question FROM r WHERE episode % 37 = 5
    UNION ALL SELECT 'development', 'message_id', message_id FROM r WHERE message_id LIKE '%7-1')
SELECT 'E-SPLIT' AS code, kind || '|' || id AS key, string_agg(DISTINCT split, ',' ORDER BY split) AS detail FROM x GROUP BY kind, id HAVING count(DISTINCT split) > 1"""),
    "value_places": (value_places, _PLACES),
    "validate_oracle": (validate_oracle, f"""WITH {_ANS}, n AS (SELECT an.question_id, count(pl.message_id) AS n, min(pl.message_id) AS lone, any_value(evidence_id) AS evidence_id FROM an LEFT JOIN pl ON value_id = an.question_id GROUP BY an.question_id)
SELECT 'E-UNIQUE' AS code, question_id AS key, n::VARCHAR AS detail FROM n WHERE (n = 1 AND lone = evidence_id) IS NOT TRUE
UNION ALL SELECT 'E-QUESTION-LEAK', an.question_id, value FROM an WHERE value <> '' AND contains(CASE WHEN episode % 11 = 1 THEN 'Is it ' || few || '?' ELSE 'What is it?' END, value)
UNION ALL SELECT 'E-EVIDENCE', question_id, an.evidence_id FROM an LEFT JOIN m ON m.message_id = an.evidence_id WHERE (m.activity = an.activity) IS NOT TRUE
UNION ALL SELECT 'E-ORACLE-ROWS', question_id, '0' FROM v WHERE episode % 31 = 4
UNION ALL SELECT 'E-TRIM', question_id, '' FROM an WHERE value <> trim(value)"""),
    "validate_retrieval": (validate_retrieval, f"""WITH {_M}, s AS (SELECT episode, message_id, length(content) AS score, row_number() OVER (PARTITION BY episode ORDER BY length(content) DESC, message_id) AS rank FROM m),
  r AS (SELECT episode, rank, CASE WHEN episode % 17 = 2 AND rank = 1 THEN '0-0' ELSE message_id END AS message_id, CASE WHEN episode % 19 = 3 AND rank = 1 THEN -1 ELSE score END AS score FROM s WHERE rank <= {TOP} AND NOT (episode % 13 = 1 AND rank = 2)),
  n AS (SELECT episode, count(*) AS n FROM m GROUP BY episode), p AS (SELECT episode, count(*) AS c, max(rank) AS last, count(DISTINCT message_id) AS d FROM r GROUP BY episode),
  o AS (SELECT episode, bool_or(score > was) AS rises FROM (SELECT *, lag(score) OVER (PARTITION BY episode ORDER BY rank) AS was FROM r) GROUP BY episode)
SELECT 'E-TOP-K' AS code, n.episode::VARCHAR AS key, '' AS detail FROM n LEFT JOIN p USING (episode) WHERE coalesce(c, 0) <> least(n, {TOP})
UNION ALL SELECT 'E-RANK', episode::VARCHAR, '' FROM p WHERE last <> c OR d <> c
UNION ALL SELECT 'E-SCORE-ORDER', episode::VARCHAR, '' FROM o WHERE rises
UNION ALL SELECT 'E-ACCESS', episode || '|' || message_id, '' FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.episode = r.episode AND m.message_id = r.message_id)"""),
    "validate_audit": (validate_audit, """WITH c AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id % 41 <> 1 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 43 = 2 UNION ALL SELECT doc_id + 10000000000 FROM documents WHERE doc_id % 47 = 3),
  e AS (SELECT doc_id, CASE WHEN doc_id % 53 = 4 THEN 'because' ELSE 'unlabelled' END AS criterion FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
  x AS (SELECT doc_id, count(*) FILTER (k = 's') AS s, count(*) FILTER (k = 'c') AS c, count(*) FILTER (k = 'e') AS e FROM (SELECT doc_id, 's' AS k FROM documents UNION ALL SELECT doc_id, 'c' FROM c UNION ALL SELECT doc_id, 'e' FROM e) GROUP BY doc_id)
SELECT 'E-AUDIT-MISSING' AS code, doc_id::VARCHAR AS key, '' AS detail FROM x WHERE s > 0 AND c + e = 0
UNION ALL SELECT 'E-AUDIT-UNKNOWN', doc_id::VARCHAR, '' FROM x WHERE s = 0 UNION ALL SELECT 'E-AUDIT-BOTH', doc_id::VARCHAR, '' FROM x WHERE c > 0 AND e > 0
UNION ALL SELECT 'E-AUDIT-DUP', doc_id::VARCHAR, '' FROM x WHERE c > 1 OR e > 1 UNION ALL SELECT 'E-CRITERION', doc_id::VARCHAR, criterion FROM e WHERE criterion <> 'unlabelled'"""),
    "validate_pairs": (validate_pairs, f"""WITH {_M}, f AS (SELECT message_id, array_to_string(list_filter([CASE WHEN episode % 25 = 3 THEN 'activity' END, CASE WHEN episode % 15 = 3 THEN 'size' END], lambda x: x IS NOT NULL), ',') AS detail FROM m WHERE turn < 2),
  p AS (SELECT page_id, concat_ws(' ', url, html) AS t FROM pages)
SELECT 'E-PAIR-FIELD' AS code, message_id AS key, detail FROM f WHERE detail <> ''
""" + "".join(f"UNION ALL SELECT 'E-PROMPT', page_id::VARCHAR, '{n}' FROM p WHERE regexp_matches(t, '{r}') " for n, r in reproduce.RECORD_IDS.items()) + "".join(f"UNION ALL SELECT 'E-PROMPT', page_id::VARCHAR, '{s}' FROM p WHERE contains(lower(t), '{s}') " for s in reproduce.FORBIDDEN_SUBSTRINGS)),
}
