"""Joins on keys of which some may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A key is hot if it holds more than this share of the rows; so there are at most 1 / HOT hot keys.
HOT = 1e-3
#: Rows of a key that are no load for a task.
LIGHT = 250


def private(rows: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``rows``."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        new = f"__{name}"
        while new in taken:
            new = f"_{new}"
        taken.add(new)
        out.append(new)
    return out


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined ("inner" or "left") with ``table``, which has one row for each value of ``keys``.  Rows of hot keys
    meet their few table rows by a broadcast (1 / HOT rows at most) where they are, and rows with a null key, which match
    nothing, aren't moved either; so no key meets in one task.  Both are read more than once: give tables that are cut."""
    n = rows.count()
    left = rows.dropna(subset=keys)
    out = left.join(table, keys, how)
    heavy = cut(left.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > max(LIGHT, HOT * n)).select(*keys)) if n > LIGHT else None
    if heavy is not None and heavy.count():
        some = F.broadcast(heavy)
        hot = F.broadcast(table.join(some, keys, "left_semi"))
        out = left.join(some, keys, "left_anti").join(table, keys, how).unionByName(left.join(some, keys, "left_semi").join(hot, keys, how))
    if how == "left":
        lone = rows.where(" OR ".join(f"`{k}` IS NULL" for k in keys))
        out = out.unionByName(lone, allowMissingColumns=True)
    return out
