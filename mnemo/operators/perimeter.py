"""What a query may read: conversation turns, conditions, reading policy, phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a question's lower-case text that ask about the past.
HISTORY_MARKERS = (
    "superat", "precedent", "inizial", "in origine", "in passato", "storic", "cambia", "modifica", "sostitu",
    "ritirat", "non e' piu'", "non è più", "e' ancora", "è ancora", "ancora un", "prima ipotesi", "prima decisione",
)
ACTIVE, SUPERSEDED, RETRACTED = "attivo", "superato", "ritirato"


def flatten_sessions(scenarios: DataFrame, role: str = "user") -> DataFrame:
    """Messages of one role from nested scenario documents: sessions[] -> messages[]."""
    s = scenarios.select("scenario_id", F.explode("sessions").alias("s"))
    m = s.select("scenario_id", F.col("s.session_id").alias("session_id"), F.col("s.order").alias("session_order"), F.explode("s.messages").alias("m"))
    m = m.where(F.col("m.role") == role)
    return m.select("scenario_id", "session_id", "session_order", F.col("m.message_id").alias("message_id"), F.col("m.order").alias("message_order"), F.col("m.content").alias("content"))


def user_turns(conversations: DataFrame) -> DataFrame:
    """User turns of (conv_id, turn, role, text), numbered within each conversation, with their number in all."""
    w = Window.partitionBy("conv_id")
    u = conversations.where(F.col("role") == "user")
    return u.select("conv_id", "turn", "text", F.row_number().over(w.orderBy("turn")).alias("session_order"), F.count("*").over(w).alias("n_user"))


def questions(turns: DataFrame) -> DataFrame:
    """Each conversation's last user turn is its question ..."""
    return turns.where(F.col("session_order") == F.col("n_user")).select("conv_id", "text")


def history(turns: DataFrame) -> DataFrame:
    """... and the earlier ones are its memory."""
    return turns.where(F.col("session_order") < F.col("n_user"))


def conditions(memory: DataFrame) -> DataFrame:
    """Memory rows by condition: C0 reads nothing, C1 the last earlier session, C2 all of them."""
    last = F.col("session_order") == F.col("n_user") - 1
    return memory.withColumn("condition", F.explode(F.when(last, F.array(F.lit("C1"), F.lit("C2"))).otherwise(F.array(F.lit("C2")))))


def accessible(messages: DataFrame, perimeter: DataFrame, on: list[str]) -> DataFrame:
    """Messages whose session is in the perimeter (left semi join)."""
    return messages.join(perimeter, on, "left_semi")


def by_activity(messages: DataFrame, condition: Column, activity: Column, asked: Column) -> DataFrame:
    """``separated`` reads one activity, any other condition all."""
    return messages.where((condition != "separated") | (activity == asked))


def scope(text: Column, markers: tuple[str, ...] = HISTORY_MARKERS) -> Column:
    low, out = F.lower(text), F.lit(False)
    for m in markers:
        out = out | low.contains(m)
    return F.when(out, F.lit("history")).otherwise(F.lit("current"))


def readable(status: Column, asked: Column) -> Column:
    """History reads entries of every state, current only active ones."""
    return status.isin(ACTIVE, SUPERSEDED, RETRACTED) & ((asked == "history") | (status == ACTIVE))


def session_reached(declared: Column, entry_order: Column, by: list[str]) -> tuple[Column, Column]:
    """(session reached, basis).  Declared below an entry's session is an error; undeclared falls back to the largest."""
    top = F.max(entry_order).over(Window.partitionBy(*by))
    wrong = F.raise_error(F.concat(F.lit("session reached "), declared.cast("string"), F.lit(" is before an entry's session"))).cast("int")
    return F.when(declared.isNull(), top).when(declared < top, wrong).otherwise(declared), F.when(declared.isNull(), F.lit("fallback")).otherwise(F.lit("declared"))


def phase(session_order: Column, phases: dict[str, tuple[int, ...]]) -> Column:
    """The phase that lists a session; a session of no phase is an error."""
    out = F.raise_error(F.concat(F.lit("session of no phase: "), session_order.cast("string")))
    for name, orders in reversed(list(phases.items())):
        out = F.when(session_order.isin(*orders), F.lit(name)).otherwise(out)
    return out


def split_of(number: Column, bounds: dict[str, tuple[int, int]]) -> Column:
    """The split whose bounds hold an episode's number, else an error."""
    out = F.raise_error(F.concat(F.lit("episode of no split: "), number.cast("string")))
    for name, (lo, hi) in reversed(list(bounds.items())):
        out = F.when(number.between(lo, hi), F.lit(name)).otherwise(out)
    return out


def first_failing(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check, in order, that does not hold (a null check does not hold); null if all hold."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(F.coalesce(~ok, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def budget_for(scenario: Column, default: int, overrides: dict[str, int | None]) -> Column:
    """A scenario's budget: its override (null: unlimited), else the default."""
    out = F.lit(default).cast("long")
    for name, b in overrides.items():
        out = F.when(scenario == name, F.lit(b).cast("long")).otherwise(out)
    return out
