"""Text files with line numbers, read in byte ranges.

Spark cuts a large file into ranges and gives each line to the range in which it starts.  Lines are numbered within their
range as they are read; counts per range and their running sums per file, one small row a range, tell how many lines come
before.  So no file is one task's work, and the numbers are those of a reader that goes from start to end.  Lines end with
LF, CR or CRLF, as Python's text files do.

Empty files have no rows.  A last line without an end counts.  Files that are compressed have one range.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: The rest of a row's id within its partition is its place there.
PLACE = (1 << 33) - 1


def placed(spark: SparkSession, path: str) -> DataFrame:
    """(text, file, start, part, k): each line with the range that it was read in (its start, the task's number) and its place
    among the task's lines."""
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.spark_partition_id().alias("part"), at.alias("k"))
    return lines.withColumn("k", F.col("k").bitwiseAND(F.lit(PLACE)))


def offsets(lines: DataFrame) -> DataFrame:
    """(file, start, shift): what to add to a line's place, from 0, in its task to get its number, from 1, in its file.  A
    task may read several ranges, one after the other; a range's least place is where it starts."""
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("file", "start", (before - F.col("k") + 1).alias("shift"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of all lines.  The files are read twice, once to count; what is counted is small."""
    shifts = cut(offsets(placed(spark, path)))
    return placed(spark, path).join(shifts, ["file", "start"]).select("file", (F.col("k") + F.col("shift")).alias("line"), "text")


def fault(text: str, kind: type | None = None) -> str | None:
    """Why a line is no JSON value (of a kind), None if it is one or blank."""
    text = text.strip()
    if not text:
        return None
    try:
        value = json.loads(text)
    except ValueError as e:
        return str(e)
    except RecursionError:
        return "nested too deeply"
    return None if kind is None or isinstance(value, kind) else f"not a JSON {kind.__name__}"


def bad_lines(spark: SparkSession, path: str, objects: bool = True) -> DataFrame:
    """(file, line, text, error) of the lines that are not blank and no JSON value, or no object if ``objects``."""
    kind = dict if objects else None

    def run(batches):
        for b in batches:
            why = [fault(t, kind) for t in b.column(0).to_pylist()]
            keep = pa.array([w is not None for w in why])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(why, pa.string())], names=["text", "file", "start", "part", "k", "error"]).filter(keep)

    lines = placed(spark, path)
    bad = lines.mapInArrow(run, "text string, file string, start bigint, part int, k bigint, error string")
    # few lines are bad; counting is left to a pass that reads no text beyond its line ends
    bad = cut(bad.select("file", "start", "k", "text", "error"))
    shifts = offsets(lines).join(bad.select("file").distinct(), "file", "left_semi")
    return bad.join(shifts, ["file", "start"]).select("file", (F.col("k") + F.col("shift")).alias("line"), "text", "error")


def strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of JSON lines, blank ones left out.  If a line is no JSON value this raises with the file and number of the
    first such line."""
    first = bad_lines(spark, path, objects=False).orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].file}:{first[0].line}: not valid JSON: {first[0].error}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
