"""Column functions on text: tokens, normalisation, rates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns: words that ranking compares, and units that a budget counts (words, numbers, punctuation marks).
RANK_TOKEN = "[a-z0-9_-]+"
BUDGET_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"


def rank_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(RANK_TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    """Tokens of a rendered line as the budget counts them; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(BUDGET_TOKEN)), F.lit(0)).cast("long")


def plain_spaces(text: Column) -> Column:
    """Lower case, with single spaces and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def ratio(num: Column, den: Column, digits: int | None = 6) -> Column:
    """num / den, null (not 0) where den is 0."""
    x = num.cast("double") / F.nullif(den, F.lit(0))
    return x if digits is None else F.round(x, digits)


def percent(num: Column, den: Column) -> Column:
    return F.round(100 * num.cast("double") / F.nullif(den, F.lit(0)), 1)


def at_fraction(values: Column, fraction: float) -> Column:
    """The element at floor(fraction * (n - 1)) of an array's sorted values: percentiles and interval ends."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), (F.floor(F.lit(fraction) * (n - 1)) + 1).cast("int")))


def sha_text(*parts: Column | str, sep: str = ":") -> Column:
    return F.sha2(F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def sha_int(*parts: Column | str) -> Column:
    """A non-negative integer from the first eight hex digits of sha256."""
    return F.conv(F.substring(sha_text(*parts), 1, 8), 16, 10).cast("long")


def md5_int(*parts: Column | str) -> Column:
    joined = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


@F.pandas_udf(T.StringType())
def normalised_value(values: pd.Series) -> pd.Series:
    """NFC, no white space at the ends, caseless: how answers are compared."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v).strip().casefold())


@F.pandas_udf(T.BooleanType())
def usable_value(values: pd.Series) -> pd.Series:
    """Whether a value can be quoted: not empty, trimmed, in NFC, without control characters."""

    def ok(v):
        return bool(v) and v == v.strip() and unicodedata.is_normalized("NFC", v) and not any(unicodedata.category(c) in ("Cc", "Zl", "Zp") for c in v)

    return values.map(lambda v: v is not None and ok(v))


def ordered_join(rank: Column, text: Column, sep: str = "\n") -> Column:
    """Aggregate: texts joined in rank order, "" without rows.  Rows whose text is null are left out."""
    rows = F.collect_list(F.when(text.isNotNull(), F.struct(rank.alias("r"), text.alias("t"))))
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["t"]), sep)
