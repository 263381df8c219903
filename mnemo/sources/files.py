"""Sources and sinks: JSON documents, JSON lines, CSV, tar archives, pinned files, durable appends."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import archives, lines


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row per file; a file that does not parse is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, drop_bad: bool = False) -> DataFrame:
    """One row per line, blank lines left out.  A line that does not parse is an error, unless bad lines are to be dropped;
    ``bad_lines`` names them."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if drop_bad else "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of lines that are no JSON object: what a read stops at."""
    return lines.bad_lines(spark, path).select("file", "line", "text")


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A directory of JSON lines with keys in order; parts stay apart, so the write is as parallel as ``df``."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def canonical_line(row: dict, ascii_only: bool = False) -> str:
    return json.dumps(row, sort_keys=True, ensure_ascii=ascii_only)


def dump_json_lines(rows: list[dict], path: str, ascii_only: bool = False) -> str:
    """Write a small result as one byte-stable file and return its sha256."""
    data = "".join(canonical_line(r, ascii_only) + "\n" for r in rows).encode("utf-8")
    with open(path, "wb") as f:
        f.write(data)
    return hashlib.sha256(data).hexdigest()


def dump_json(value, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def append(df: DataFrame, path: str) -> None:
    """Append rows to a log; a file shows only when complete."""
    df.write.mode("append").json(path)


class DurableLog:
    """A local log of JSON lines in which each row is on disk before ``add`` returns, and from which a run resumes."""

    def __init__(self, path: str, key: str = "cell_id"):
        self.path, self.key = path, key

    def add(self, row: dict) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(canonical_line(row) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def finished(self) -> set:
        """Keys whose last row is a finished one: status ok, with content."""
        if not os.path.exists(self.path):
            return set()
        with open(self.path, encoding="utf-8") as f:
            last = {r[self.key]: r for r in map(json.loads, filter(str.strip, f))}
        return {k for k, r in last.items() if r.get("status") == "ok" and r.get("content")}


def tar_members(spark: SparkSession, path: str, under: str = "", suffix: str = ".json") -> DataFrame:
    """(archive, member, content) of the text files of tar archives below folder ``under``, the archive's root folder
    stripped."""
    return archives.texts(archives.members(spark, path, under, suffix))


def write_tar_gz(members: list[tuple[str, bytes]], path: str) -> str:
    """A byte-stable archive: sorted members, no times or owners.  Returns its sha256."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, data in sorted(members):
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(data), 0o644
            tar.addfile(info, io.BytesIO(data))
    packed = io.BytesIO()
    with gzip.GzipFile(fileobj=packed, mode="wb", mtime=0, filename="") as z:
        z.write(raw.getvalue())
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    return hashlib.sha256(packed.getvalue()).hexdigest()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files, for freeze manifests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def overlay(base: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Annotations over base questions: every annotated key must exist in the base (else the query fails), base columns
    are filled from the annotation where it has a value."""
    b = base.withColumn("_base", F.lit(True))
    both = [c for c in notes.columns if c in base.columns and c != key]
    n = notes.withColumnsRenamed({c: f"_n_{c}" for c in both})
    x = b.join(n, key, "full")
    known = F.when(F.col("_base").isNull(), F.raise_error(F.concat(F.lit("annotation of an unknown key: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    x = x.where(known)
    for c in both:
        x = x.withColumn(c, F.coalesce(f"_n_{c}", c)).drop(f"_n_{c}")
    return x.drop("_base")


def answers(requests: DataFrame, model, schema: str = "cell_id string, status string, content string, error string") -> DataFrame:
    """Responses of an external model to (cell_id, prompt), through a pluggable callable prompt -> text.  A call that
    raises becomes an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cell, prompt in zip(batch["cell_id"], batch["prompt"]):
                try:
                    out.append((cell, "ok", model(prompt), None))
                except Exception as e:  # a failed call is a row, not a failed job
                    out.append((cell, "error", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["cell_id", "status", "content", "error"])

    return requests.select("cell_id", "prompt").mapInPandas(run, schema)


def replay(answers_by_prompt: dict[str, str]):
    """A model that returns canned answers."""

    def model(prompt: str) -> str:
        if prompt not in answers_by_prompt:
            raise KeyError("no canned answer for this prompt")
        return answers_by_prompt[prompt]

    return model


def replay_in_order(canned: list[str]):
    """A model for one process that returns canned answers one after the other, whatever the prompt; asked too often, it
    fails."""
    left = iter(canned)

    def model(prompt: str) -> str:
        for answer in left:
            return answer
        raise IndexError("no canned answer is left")

    return model
