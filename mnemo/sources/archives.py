"""Tar archives as a Spark data source: ``archives`` reads members and writes archives.

A read has two forms.  *Headers* (``contents`` false) walk an archive once and skip the members' bytes: one row a member with
the place of its bytes.  *Contents* stream members in parts of at most ``part_bytes``, so neither an archive nor a member
must fit in memory.  A compressed archive can only be read from its start, so it is one partition; ``members`` reads plain
archives in ranges instead: headers first, then the ranges' bytes in parallel, each by a seek.

The wanted folder and ending are options, so they reach the reader: bytes of other members are skipped, never copied.  (Spark 4.1
keeps the filters that it has once pushed to a Python source with the loaded table, and applies them to later, unlike
queries on it; so the source doesn't take part in that.)  The root folder of an archive is stripped from its members'
names.

A write makes one archive a task, from rows (member, content) in the task's order, without times or owners, so equal rows
give equal bytes.  Archives get their names when all tasks are done; those of failed attempts are removed.
"""

from __future__ import annotations

import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import cut
from .storage import listed, opened, packed, resolved

PART_BYTES = 32 << 20
RANGE_BYTES = 128 << 20
BLOCK = 1 << 20
SCHEMA = "archive string, member string, size bigint, place bigint, part int, content binary"
PLAIN = (".tar",)
PACKED = {".gz": "gzip", ".tgz": "gzip", ".bz2": "bz2", ".zst": "zstd"}


@dataclass
class Archive(InputPartition):
    address: str


def member_name(name: str, strip: bool) -> str:
    return name.split("/", 1)[-1] if strip else name


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.contents = options.get("contents", "true") == "true"
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.strip = options.get("strip_root", "true") == "true"
        self.under, self.suffix = options.get("under", ""), options.get("suffix", "")

    def partitions(self):
        return [Archive(a) for a in self.files]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition of a source that has none
            return
        store, path = opened(partition.address)
        # unpacked by a stream of bounded buffers: tarfile would unpack a whole block at once, however much comes out of it
        packing = next((p for ending, p in PACKED.items() if partition.address.lower().endswith(ending)), None)
        with store.open_input_stream(path, compression=packing) as raw, tarfile.open(fileobj=raw, mode="r|" if packing else "r|*", bufsize=BLOCK) as tar:
            rows, held = [], 0
            for m in tar:
                # a stream keeps every header it has met; they are not needed again
                tar.members = []
                name = member_name(m.name, self.strip)
                if not (m.isfile() and name.startswith(self.under) and name.endswith(self.suffix)):
                    continue
                if not self.contents:
                    rows.append((partition.address, name, m.size, m.offset_data, 0, None))
                else:
                    body, left, part = tar.extractfile(m), m.size, 0
                    while left or not part:
                        data = body.read(min(left, self.part_bytes))
                        if len(data) < min(left, self.part_bytes):
                            raise EOFError(f"{partition.address}: member {m.name} ends early")
                        rows.append((partition.address, name, m.size, m.offset_data, part, data))
                        left, part, held = left - len(data), part + 1, held + len(data)
                        if held >= self.part_bytes:
                            yield batch(rows)
                            rows, held = [], 0
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), ("content", pa.binary())])


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class ArchiveWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.root, self.overwrite = options["folder"], options.get("root", "root"), overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        store, folder = opened(self.folder)
        task = TaskContext.get()
        final = f"{folder}/part-{task.partitionId():05d}-{self.job}.tar"
        temporary = f"{folder}/.{self.job}-{task.taskAttemptId()}.tmp"
        with store.open_output_stream(temporary, compression=None, buffer_size=BLOCK) as raw, tarfile.open(fileobj=raw, mode="w|", format=tarfile.PAX_FORMAT, bufsize=BLOCK) as tar:
            for row in rows:
                data = row["content"]
                data = data.encode("utf-8") if isinstance(data, str) else bytes(data)
                info = tarfile.TarInfo(f"{self.root}/{row['member']}")
                info.size, info.mode = len(data), 0o644
                tar.addfile(info, pa.BufferReader(data))
        return Written(temporary, final)

    def commit(self, messages) -> None:
        store, folder = opened(self.folder)
        kept = {m.final for m in messages if m}
        if self.overwrite:
            for f in store.get_file_info(_all(folder)):
                if f.is_file and f.path.endswith(".tar") and f.path not in kept:
                    store.delete_file(f.path)
        for m in messages:
            store.move(m.temporary, m.final)
        self._clear(store, folder)

    def abort(self, messages) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, store, folder) -> None:
        """Remove what attempts of this job left behind."""
        for f in store.get_file_info(_all(folder)):
            if f.base_name.startswith(f".{self.job}-"):
                store.delete_file(f.path)


def _all(folder: str):
    from pyarrow.fs import FileSelector

    return FileSelector(folder, allow_not_found=True)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ArchiveSource)
    return spark


def _scan(spark: SparkSession, files: list[str], under: str, suffix: str, contents: bool, part_bytes: int, strip_root: bool = True) -> DataFrame:
    options = {"files": packed(files), "under": under.rstrip("/") + "/" if under else "", "suffix": suffix, "contents": str(contents).lower(), "part_bytes": part_bytes, "strip_root": str(strip_root).lower()}
    return registered(spark).read.format("archives").options(**options).load()


def scan(spark: SparkSession, path: str, under: str = "", suffix: str = "", contents: bool = True, part_bytes: int = PART_BYTES, strip_root: bool = True) -> DataFrame:
    """(archive, member, size, place, part, content) of all archives of ``path``, an archive a partition.  ``place`` is where
    the member's bytes start in the (unpacked) archive; without contents a member is one row."""
    return _scan(spark, [a for a, _ in listed(spark, path)], under, suffix, contents, part_bytes, strip_root)


def members(spark: SparkSession, path: str, under: str = "", suffix: str = "", part_bytes: int = PART_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, member, size, part, content) of the members below folder ``under`` whose names end in ``suffix``.  Plain
    archives are read in ranges of about ``range_bytes`` of member bytes, compressed ones from start to end."""
    columns = ["archive", "member", "size", "part", "content"]
    files = listed(spark, path)
    plain = [(a, n) for a, n in files if a.lower().endswith(PLAIN)]
    rest = [a for a, _ in files if not a.lower().endswith(PLAIN)]
    out = None
    if plain:
        heads = cut(_scan(spark, [a for a, _ in plain], under, suffix, False, part_bytes).select("archive", "member", "size", "place"))
        # a member of many parts is dealt out by its parts, so that one long member is no single task's work
        parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / part_bytes) - 1, F.lit(0)).cast("int"))
        ranges = heads.select("*", F.explode(parts).alias("part")).withColumn("range", F.floor((F.col("place") + F.col("part") * F.lit(part_bytes).cast("long")) / range_bytes))
        ranges = ranges.repartition(max(1, -(-sum(n for _, n in plain) // range_bytes)), "archive", "range").sortWithinPartitions("archive", "place", "part")

        def run(batches):
            address = file = None
            try:
                for b in batches:
                    rows, held = [], 0
                    for a, member, size, place, part in zip(*[b.column(k).to_pylist() for k in range(5)]):
                        if a != address:
                            if file:
                                file.close()
                            store, p = opened(a)
                            address, file = a, store.open_input_file(p)
                        want = min(part_bytes, size - part * part_bytes)
                        data = file.read_at(want, place + part * part_bytes)
                        if len(data) < want:
                            raise EOFError(f"{a}: member {member} ends early")
                        rows.append((a, member, size, part, data))
                        held += want
                        if held >= part_bytes:
                            yield chunk(rows)
                            rows, held = [], 0
                    if rows:
                        yield chunk(rows)
            finally:
                if file:
                    file.close()

        out = ranges.select("archive", "member", "size", "place", "part").mapInArrow(run, "archive string, member string, size bigint, part int, content binary")
    if rest or out is None:
        some = _scan(spark, rest, under, suffix, True, part_bytes).select(*columns)
        out = some if out is None else out.unionByName(some)
    return out


def chunk(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["archive", "member", "size", "part", "content"])


def texts(found: DataFrame) -> DataFrame:
    """(archive, member, content as text) of members whose parts fit in one value (2 GB at most); others are an error."""
    whole = found.where("size <= 2000000000 OR raise_error(concat('member too long for one value: ', member)) IS NULL")
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.hex("content").alias("h")))), lambda p: p["h"]), "")
    single = whole.where(F.col("size") == F.octet_length("content"))
    several = whole.where(F.col("size") > F.octet_length("content")).groupBy("archive", "member").agg(F.unhex(one).alias("content"))
    return single.select("archive", "member", "content").unionByName(several).withColumn("content", F.decode("content", "UTF-8"))


def write(rows: DataFrame, path: str, root: str = "root", overwrite: bool = False) -> None:
    """One archive a partition of ``rows`` (member, content: text or bytes), members by name within it."""
    spark = registered(rows.sparkSession)
    ordered = rows.select("member", "content").sortWithinPartitions("member")
    ordered.write.format("archives").option("folder", resolved(spark, path)).option("root", root).mode("overwrite" if overwrite else "append").save()
