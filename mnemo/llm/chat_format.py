"""Preference formatting of conversations, with DataFrame functions only.

A chosen and a rejected conversation share their longest common prefix of turns (same role and text).  It is rendered
once as the prompt; what follows on each side is that side's completion, with the character spans that a loss may use:
the assistant's text and end mark, not the headers and not other roles' turns.

The prefix is found turn by turn: rows meet by (pair, position), and a pair's prefix ends before the first position
where the two sides differ, a minimum with a map-side part.  Turns are gathered into strings only per pair and side.

Headers and end marks are the only "<|" of a rendering: within texts and roles a backslash goes between "<" and "|" (one
more where there are some already), in roles also between "|" and ">".  So no text can pass for a turn, and the
rendering can be read back (``plain``).

Rows: turns are ordered by (turn, role, text), nulls last, ties being equal turns; repeated rows are repeated turns.  Null
text is empty, null role is "unknown".  Rows without a conversation id are left out.  A conversation without a partner
has an empty prompt and the other side null.  Two equal conversations have empty completions.  An empty table gives an
empty result.  Texts of any length are rendered whole.  Only the four columns are read, so further columns play no part.

Size: a pair's result is one row, and one string a side, so a conversation has at most the 2 GB of a string.  Its turns are
numbered and gathered in one task, sorted with spilling; conversations of any size below that share no task by key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def by_parity(conv_id: Column) -> tuple[Column, Column]:
    """The pairing of a table without preferences: conversations 2k (chosen) and 2k + 1 (rejected) are pair k."""
    return F.shiftright(conv_id.cast("long"), 1), F.pmod(conv_id.cast("long"), F.lit(2)).cast("int")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(<\\*)\|", r"$1\\|")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(escaped(role), r"(\|\\*)>", r"$1\\>")


def plain(text: str) -> str:
    """The text of a rendered turn without the backslashes that ``escaped`` has put in."""
    return re.sub(r"(<\\*)\\\|", r"\1|", text)


def format_pairs(turns: DataFrame, pairing=by_parity) -> DataFrame:
    """One row per pair from turns (conv_id, turn, role, text): pair_id, chosen_id, rejected_id, n_prompt_turns, prompt,
    chosen, chosen_spans, rejected, rejected_spans; spans are "start-end" in characters of the completion, joined with
    commas.  pairing: conv_id to (pair, side), side 0 chosen, 1 rejected."""
    pair, side = pairing(F.col("conv_id"))
    role, text = F.coalesce("role", F.lit("unknown")), escaped(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    t = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "role", "text", F.row_number().over(order).alias("pos"))
    head = F.concat(F.lit(HEAD), escaped_role(role), F.lit(TAIL))
    t = t.select(pair.alias("pair_id"), side.alias("side"), "conv_id", "pos", (role == TRAINED).alias("trained"), F.length(head).alias("skip"), F.concat(head, text, F.lit(END)).alias("shown"))
    same = (F.count("*") == 2) & (F.min("shown") == F.max("shown"))
    # escaped, two turns are the same if and only if they render the same
    per = t.groupBy("pair_id", "pos").agg(same.alias("same"))
    ends = per.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("pos"))) - 1, F.max("pos")).alias("n"))
    t = t.join(ends, "pair_id").withColumn("after", F.col("pos") > F.col("n"))
    before = Window.partitionBy("pair_id", "side", "after").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("shown")).over(before), F.lit(0)))
    span = F.concat((F.col("at") + F.col("skip")).cast("string"), F.lit("-"), (F.col("at") + F.length("shown")).cast("string"))
    gather = lambda cond, what, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("pos"), what.alias("x"))))), lambda r: r["x"]), sep)
    one = lambda k: (F.col("side") == k) & F.col("after")
    here = lambda k, x: F.when(F.max(F.col("side") == k), x)
    return t.groupBy("pair_id").agg(
        F.min(F.when(F.col("side") == 0, F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"),
        F.max("n").cast("long").alias("n_prompt_turns"),
        gather((F.col("side") == 0) & ~F.col("after"), F.col("shown"), "").alias("prompt"),
        here(0, gather(one(0), F.col("shown"), "")).alias("chosen"),
        here(0, gather(one(0) & F.col("trained"), span, ",")).alias("chosen_spans"),
        here(1, gather(one(1), F.col("shown"), "")).alias("rejected"),
        here(1, gather(one(1) & F.col("trained"), span, ",")).alias("rejected_spans"),
    )


def _side(k: int, name: str) -> str:
    return f"""
  CASE WHEN bool_or(side = {k}) THEN coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = {k} AND after), '') END AS {name},
  CASE WHEN bool_or(side = {k}) THEN coalesce(string_agg((begun + skip)::BIGINT || '-' || (begun + length(shown))::BIGINT, ',' ORDER BY pos) FILTER (WHERE side = {k} AND after AND trained), '') END AS {name}_spans"""


ORACLE_SQL = rf"""
WITH t0 AS (
  SELECT conv_id, coalesce(role, 'unknown') AS given, regexp_replace(regexp_replace(coalesce(role, 'unknown'), '(<\\*)\|', '\1\\|', 'g'), '(\|\\*)>', '\1\\>', 'g') AS r,
    regexp_replace(coalesce(text, ''), '(<\\*)\|', '\1\\|', 'g') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, role ASC NULLS LAST, text ASC NULLS LAST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT ((conv_id - ((conv_id % 2) + 2) % 2) // 2)::BIGINT AS pair_id, ((conv_id % 2) + 2) % 2 AS side, conv_id, pos, given = '{TRAINED}' AS trained,
    length('{HEAD}' || r || '|>' || chr(10)) AS skip, '{HEAD}' || r || '|>' || chr(10) || x || '<|end|>' || chr(10) AS shown FROM t0),
per AS (SELECT pair_id, pos, count(*) = 2 AND min(shown) = max(shown) AS same FROM t GROUP BY ALL),
ends AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN pos END) - 1, max(pos)) AS n FROM per GROUP BY pair_id),
u AS (SELECT t.*, n, pos > n AS after FROM t JOIN ends USING (pair_id)),
v AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, after ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM u)
SELECT pair_id, min(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, min(CASE WHEN side = 1 THEN conv_id END) AS rejected_id,
  max(n)::BIGINT AS n_prompt_turns, coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = 0 AND NOT after), '') AS prompt,
  {_side(0, 'chosen')}, {_side(1, 'rejected')}
FROM v GROUP BY pair_id
"""
