"""Values at optional paths of JSON records, the paths being data.

A record is parsed once, to a VARIANT; a path that is absent, null, or of another type than wanted gives null, and no level
need be there.  Paths are written like ``$.a.b[0].c``.  A record that is no JSON gives null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def at_paths(rows: DataFrame, record: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with a column for each of ``paths`` {name: (path, type)} into the JSON text ``record``.  A value of another JSON type
    counts as absent: a number is no string, and 1.5 no integer."""
    name = "__record"
    while name in rows.columns:
        name = f"_{name}"
    x = rows.withColumn(name, parsed(F.col(f"`{record}`")))
    return x.select(*[F.col(f"`{c}`") for c in rows.columns], *[typed(F.col(name), path, kind).alias(n) for n, (path, kind) in paths.items()])


def typed(value: Column, path: str, kind: str) -> Column:
    """The value at a path if its own type is ``kind``'s (string, long, double, boolean or array)."""
    found = F.try_variant_get(value, path, "variant")
    own = F.schema_of_variant(found)
    if kind == "array":
        return F.when(own.startswith("ARRAY"), F.try_variant_get(value, path, "array<variant>"))
    wanted = {"string": own == "STRING", "long": own == "BIGINT", "double": own.rlike("^(BIGINT|DOUBLE|DECIMAL)"), "boolean": own == "BOOLEAN"}[kind]
    return F.when(wanted, F.try_variant_get(value, path, kind))


def elements(rows: DataFrame, record: str, path: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each element of the array at ``path``, with its place and the values at ``paths`` within it; records
    without such an array have none."""
    x = rows.withColumn("__array", typed(parsed(F.col(f"`{record}`")), path, "array"))
    x = x.select(*[F.col(f"`{c}`") for c in rows.columns], F.posexplode("__array").alias("place", "__element"))
    return x.select(*[F.col(f"`{c}`") for c in rows.columns], "place", *[typed(F.col("__element"), p, kind).alias(n) for n, (p, kind) in paths.items()])
