"""Pieces that several corpus operators share: scratch storage, row splits, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import HOT, LIGHT, join_by_key  # noqa: F401
from ..session import checkpoint_folder, cut  # noqa: F401

#: A word is a run of characters other than ASCII white space.  ``bytes.split()`` yields the same words.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows that nothing is learned from: crc32 of the id's decimal text is divisible by five.  A null id
    counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts joined by ':' (a null part reads 'null').
    The same expression exists in other SQL engines, so decisions can be checked there."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def private(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for helper columns that clash with none of ``df``."""
    taken, out = {c.lower() for c in df.columns}, {}
    for n in names:
        new = f"__{n}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[n] = new
    return out


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces whose ``column`` (a string) holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, int(batch.num_rows * limit / max(total, limit)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def appended(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])
