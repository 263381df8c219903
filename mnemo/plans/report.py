"""Small results as text: Markdown tables, n/d where a rate has no denominator."""

from __future__ import annotations

from pyspark.sql import DataFrame

LIMIT = 10_000


def cell(value) -> str:
    if value is None:
        return "n/d"
    return f"{value:.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value).replace("|", "\\|")


def markdown(title: str, tidy: DataFrame, order: list[str]) -> str:
    """A table of a tidy result.  Reports are for summaries: above LIMIT rows this raises."""
    rows = tidy.orderBy(*order).limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError("too many rows for a report: aggregate first")
    head = ["| " + " | ".join(tidy.columns) + " |", "|" + "---|" * len(tidy.columns)]
    return "\n".join([f"## {title}", "", *head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def rate_line(num: int, den: int) -> str:
    return f"{num}/{den} ({100 * num / den:.1f} %)" if den else "n/d"
