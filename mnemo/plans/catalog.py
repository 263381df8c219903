"""Named queries over the test tables, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

from ..session import query
from . import annotation, design, evaluation, inputs, intake, memory_graph, modes, records, retrieval, selection, sqltext, summaries, validation

ALL = retrieval.QUERIES | memory_graph.QUERIES | evaluation.QUERIES | selection.QUERIES | intake.QUERIES | modes.QUERIES | validation.QUERIES | summaries.QUERIES | records.QUERIES | inputs.QUERIES | sqltext.QUERIES | annotation.QUERIES | design.QUERIES


def queries() -> dict:
    return {name: query(f) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
