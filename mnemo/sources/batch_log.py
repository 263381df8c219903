"""A log of rows in shared storage to which batches are committed exactly once.

A batch's rows are written to a folder of their own; then a marker named after the batch is made, which only one attempt can
do, and which names that folder.  Readers see folders with a marker only.  So an attempt that dies leaves nothing that shows,
and a batch that is replayed, by a restarted stream or by hand, adds no row.  Compaction folds all batches up to a number to
the last row of each key, as a new base behind a marker of its own; what it replaces stays until ``vacuum``.

Rows carry ``log_batch`` and ``log_row``, their order.  The last row of a key is the one that counts: a run resumes with the
requests whose last row is not a finished one, found by an anti join.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = ("log_batch", "log_row")


class BatchLog:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str | list[str] = "cell_id"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.key = [key] if isinstance(key, str) else list(key)
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._store.mkdirs(self._hadoop(f"{self.path}/_commits"))

    # --- markers ---

    def _commit(self, name: str, folder: str) -> bool:
        """Make a marker; False if there is one."""
        at = self._hadoop(f"{self.path}/_commits/{name}")
        if self._store.exists(at):
            return False
        try:
            out = self._store.create(at, False)
        except Exception as e:
            if self._store.exists(at):
                return False
            raise e
        out.write(bytearray(json.dumps({"folder": folder}).encode()))
        out.close()
        return True

    def _marker(self, name: str) -> str:
        reader = self._store.open(self._hadoop(f"{self.path}/_commits/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8"))["folder"]
        finally:
            reader.close()

    def _names(self, below: str = "_commits") -> list[str]:
        return [s.getPath().getName() for s in self._store.listStatus(self._hadoop(f"{self.path}/{below}" if below else self.path))]

    def batches(self) -> list[int]:
        """Numbers of the committed batches that no base holds, in order."""
        base = self.base()
        return sorted(n for n in (int(x) for x in self._names() if x.isdigit()) if n > base)

    def base(self) -> int:
        """The last batch that the newest base holds, -1 if there is none."""
        return max([-1, *(int(m[1]) for x in self._names() if (m := re.fullmatch(r"base-(\d+)", x)))])

    def committed(self, batch: int) -> bool:
        return batch <= self.base() or str(batch) in self._names()

    # --- rows ---

    def _full(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("log_batch", T.LongType()), T.StructField("log_row", T.LongType())])

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Commit ``rows`` as a batch; False if it is committed already."""
        if self.committed(batch):
            return False
        folder = f"rows-{batch}-{uuid.uuid4().hex}"
        own = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        own.withColumn("log_batch", F.lit(batch).cast("long")).withColumn("log_row", F.monotonically_increasing_id()).write.parquet(f"{self.path}/{folder}")
        if self._commit(str(batch), folder):
            return True
        self._store.delete(self._hadoop(f"{self.path}/{folder}"), True)
        return False

    def rows(self) -> DataFrame:
        """All committed rows; of batches that a base holds, the last of each key."""
        base = self.base()
        names = [str(n) for n in self.batches()] + ([f"base-{base}"] if base >= 0 else [])
        folders = [f"{self.path}/{self._marker(n)}" for n in names]
        return self.spark.read.schema(self._full()).parquet(*folders) if folders else self.spark.createDataFrame([], self._full())

    def last(self) -> DataFrame:
        """The last row of each key."""
        return _last(self.rows(), self.key)

    def write(self, stream: DataFrame, checkpoint: str):
        """A query that commits a stream's micro-batches."""
        return stream.writeStream.foreachBatch(lambda rows, n: self.append(rows, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def compact(self) -> int:
        """Fold all committed batches into a base; returns its number."""
        upto = max([self.base(), *self.batches()])
        if upto > self.base():
            folder = f"rows-base-{upto}-{uuid.uuid4().hex}"
            self.last().write.parquet(f"{self.path}/{folder}")
            if not self._commit(f"base-{upto}", folder):
                self._store.delete(self._hadoop(f"{self.path}/{folder}"), True)
        return upto

    def vacuum(self) -> list[str]:
        """Remove the folders that no reader needs: of compacted batches, and of attempts that were never committed.  To be run
        when nothing writes."""
        base = self.base()
        names = [str(n) for n in self.batches()] + ([f"base-{base}"] if base >= 0 else [])
        needed = {self._marker(n) for n in names}
        gone = [n for n in self._names("") if n.startswith("rows-") and n not in needed]
        for n in gone:
            self._store.delete(self._hadoop(f"{self.path}/{n}"), True)
        return sorted(gone)

    # --- resuming ---

    def pending(self, requests: DataFrame, finished: Column | None = None, any_row: bool = False) -> DataFrame:
        """The requests that are still to be answered: those whose last row (``any_row``: all of whose rows) is not
        ``finished``; by default that is status 'ok' with content."""
        done = F.expr("status = 'ok' AND content <> ''") if finished is None else finished
        rows = self.rows() if any_row else self.last()
        return requests.join(rows.where(done).select(*self.key).distinct(), self.key, "left_anti")


def _last(rows: DataFrame, key: list[str]) -> DataFrame:
    """A row with a null key is a key of its own kind: nulls are grouped like values."""
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*ORDER)).alias("r")
    return rows.groupBy(*key).agg(newest).select("r.*")
