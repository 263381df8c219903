"""Functions for SQL text: after ``register``, statements alone parse answers, rank and keep budgets.

``parse_answer('one' | 'many' | 'status' | 'array', text)`` has columns that depend on its first argument, which must be a
constant.  ``within_budget(TABLE (ranked), key => 'a,b', budget => n)`` takes any table with rank, score and tokens and adds
cum_tokens, selected and over_budget_first; it asks Spark to partition by the key and order by the rank, and goes through a
partition row by row with a running sum, so no group is held.  ``rank_tokens``, ``count_tokens`` and ``smoothed_idf`` are SQL
expressions, which the optimiser sees through.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .parse import ANSWER, MANY, ONE, embedded_array, many_values, one_value, status_answer
from .text import BUDGET_TOKEN, RANK_TOKEN

STATUSES = ("answered", "abstained")
ELEMENTS = T.StructType([T.StructField("elements", T.ArrayType(T.StringType()))])
KINDS = {"one": ONE, "many": MANY, "status": ANSWER, "array": ELEMENTS}
ADDED = [T.StructField("cum_tokens", T.LongType()), T.StructField("selected", T.BooleanType()), T.StructField("over_budget_first", T.BooleanType())]


def constant(argument: AnalyzeArgument, name: str):
    if not argument.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return argument.value


class ParseAnswer:
    @staticmethod
    def analyze(kind: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        k = constant(kind, "the kind of answer")
        if k not in KINDS:
            raise ValueError(f"no kind of answer: {k}; there are {', '.join(KINDS)}")
        return AnalyzeResult(schema=KINDS[k])

    def eval(self, kind: str, text: str) -> Iterator[tuple]:
        if kind == "array":
            found = embedded_array(text)
            yield (None if found is None else [json.dumps(e, sort_keys=True, ensure_ascii=False) for e in found],)
            return
        row = one_value(text) if kind == "one" else many_values(text) if kind == "many" else status_answer(text, STATUSES)
        yield tuple(row[f] for f in KINDS[kind].names)


class WithinBudget:
    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        names = [n.strip() for n in constant(key, "the key").split(",")]
        if lacking := sorted({*names, "rank", "score", "tokens"} - set(rows.dataType.names)):
            raise ValueError("the table lacks " + ", ".join(lacking))
        constant(budget, "the budget")
        return AnalyzeResult(schema=T.StructType([*rows.dataType.fields, *ADDED]), partitionBy=[PartitioningColumn(f"`{n}`") for n in names], orderBy=[OrderingColumn("rank")])

    def __init__(self):
        self.sum = 0

    def eval(self, rows, key: str, budget: int | None) -> Iterator[tuple]:
        self.sum += rows["tokens"] or 0
        fits = budget is None or self.sum <= budget or rows["rank"] == 1
        selected = rows["score"] is not None and rows["score"] > 0 and fits
        first = bool(selected and budget is not None and rows["rank"] == 1 and rows["tokens"] > budget)
        yield (*rows, self.sum, selected, first)


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to a session's SQL, under the names above."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("parse_answer", udtf(ParseAnswer))
    spark.udtf.register("within_budget", udtf(WithinBudget))
    quoted = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    for name, inputs, kind, body in (
        ("rank_tokens", "t STRING", "ARRAY<STRING>", f"regexp_extract_all(lower(t), {quoted(RANK_TOKEN)}, 0)"),
        ("count_tokens", "t STRING", "BIGINT", f"CAST(coalesce(regexp_count(t, {quoted(BUDGET_TOKEN)}), 0) AS BIGINT)"),
        ("smoothed_idf", "n BIGINT, df BIGINT", "DOUBLE", "ln((1 + n) / (1 + df)) + 1"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({inputs}) RETURNS {kind} RETURN {body}")
    return spark
