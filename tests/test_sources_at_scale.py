"""Archives, numbered lines, the stateful fold and the log, against sequential readers and batch results."""

import io
import json
import os
import random
import subprocess
import sys
import tarfile

import pytest
from pyspark.sql import functions as F

from mnemo.operators import memory
from mnemo.sources import archives, lines
from mnemo.sources.batch_log import BatchLog
from mnemo.streaming import memory_stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# --- archives -----------------------------------------------------------------


def make_archive(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        folder = tarfile.TarInfo("root/folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)


def by_tarfile(path, under, suffix):
    with tarfile.open(path) as tar:
        found = [(m.name.split("/", 1)[-1], tar.extractfile(m).read()) for m in tar if m.isfile()]
    return [(n, d) for n, d in found if n.startswith(under) and n.endswith(suffix)]


@pytest.mark.parametrize("mode,ending", [("w", "tar"), ("w:gz", "tar.gz"), ("w:bz2", "tar.bz2")])
@pytest.mark.parametrize("part,ranges", [(1 << 20, 1 << 20), (100, 512)])
def test_archives_equal_tarfile(spark, tmp_path, mode, ending, part, ranges):
    rng = random.Random(part)
    for k in range(3):
        members = [(f"root/{rng.choice(['x', 'xy', 'z/deep'])}/{'long' * rng.randint(0, 60)}{i}.{rng.choice(['json', 'txt'])}", rng.randbytes(rng.choice([0, 1, 99, 100, 101, 2000]))) for i in range(40)]
        make_archive(tmp_path / f"a{k}.{ending}", members, mode)
    for under, suffix in (("", ""), ("x", ".json"), ("z/deep", ""), ("none", "")):
        got = archives.members(spark, str(tmp_path), under, suffix, part, ranges)
        whole = {}
        for r in sorted(got.collect(), key=lambda r: r.part):
            assert len(r.content) <= part
            key = (r.archive.rsplit("/", 1)[1], r.member)
            whole[key] = whole.get(key, b"") + r.content
        want = {(f"a{k}.{ending}", n): d for k in range(3) for n, d in by_tarfile(tmp_path / f"a{k}.{ending}", under + "/" if under else "", suffix)}
        assert whole == want
        assert all(r.size == len(whole[r.archive.rsplit("/", 1)[1], r.member]) for r in got.collect())


def test_archive_filters_reach_the_reader(spark, tmp_path):
    make_archive(tmp_path / "a.tar", [("root/a/1", b"x"), ("root/b/2", b"yy")])
    make_archive(tmp_path / "b.tar", [("root/a/3", b"z")])
    some = archives.scan(spark, str(tmp_path), under="a")
    assert sorted(r.member for r in some.collect()) == ["a/1", "a/3"] and some.rdd.getNumPartitions() == 2
    # a filter of one query has no part in another one on the same table
    all_ = archives.scan(spark, str(tmp_path))
    assert all_.where(F.col("member").isin("b/2", "a/3")).count() == 2 and all_.where("member = 'b/2' OR size = 1").count() == 3 == all_.count()
    heads = archives.scan(spark, str(tmp_path), contents=False, strip_root=False)
    assert sorted((r.member, r.size, r.content) for r in heads.collect()) == [("root/a/1", 1, None), ("root/a/3", 1, None), ("root/b/2", 2, None)]
    with open(tmp_path / "a.tar", "rb") as f:
        data = f.read()
    for r in heads.where(F.col("archive").endswith("a.tar")).collect():
        assert data[r.place : r.place + r.size] in (b"x", b"yy")
    os.makedirs(tmp_path / "empty")
    assert archives.members(spark, str(tmp_path / "empty")).count() == 0


def test_cut_archive_is_an_error(spark, tmp_path):
    make_archive(tmp_path / "a.tar", [("root/1", b"x" * 5000)])
    with open(tmp_path / "a.tar", "r+b") as f:
        f.truncate(2000)
    with pytest.raises(Exception):
        archives.members(spark, str(tmp_path / "a.tar")).collect()
    with pytest.raises(Exception):
        archives.scan(spark, str(tmp_path / "a.tar")).collect()


def test_archive_larger_than_a_worker(tmp_path):
    """Half a GB, one member of it 400 MB, in a process whose memory stays far below."""
    path = tmp_path / "big.tar.gz"
    with tarfile.open(path, "w:gz", compresslevel=1) as tar:
        for name, size in (("root/big.json", 400 << 20), ("root/more.json", 100 << 20)):
            info = tarfile.TarInfo(name)
            info.size = size
            with open("/dev/zero", "rb") as zeros:
                tar.addfile(info, zeros)
    code = f"""
import sys, json, resource
sys.path.insert(0, {ROOT!r})
from mnemo.sources import archives
reader = archives.ArchiveReader({{"files": json.dumps([{str(path)!r}]), "part_bytes": str(8 << 20)}})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(sum(len(x) for x in b.column(5).to_pylist()) for p in reader.partitions() for b in reader.read(p))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n == 500 << 20 and grown < 120


def test_archives_written_by_tasks(spark, tmp_path):
    rows = spark.range(200).select(F.format_string("d/%03d.json", "id").alias("member"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("content"))
    for k in "ab":
        archives.write(rows.repartition(3, "member"), str(tmp_path / k), overwrite=True)
    names = [sorted(os.listdir(tmp_path / k)) for k in "ab"]
    assert len(names[0]) == 3 and not [n for n in names[0] if n.startswith(".")]
    assert all((tmp_path / "a" / x).read_bytes() == (tmp_path / "b" / y).read_bytes() for x, y in zip(*names))
    assert sorted(map(tuple, archives.texts(archives.members(spark, str(tmp_path / "a"), part_bytes=50)).select("member", "content").collect())) == sorted(map(tuple, rows.collect()))
    archives.write(rows.limit(5), str(tmp_path / "a"), overwrite=True)
    assert archives.members(spark, str(tmp_path / "a")).select("member").distinct().count() == 5
    bad = rows.withColumn("content", F.when(F.expr("member < 'd/150'"), F.col("content")).otherwise(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception):
        archives.write(bad.repartition(3, "member"), str(tmp_path / "c"))
    assert os.listdir(tmp_path / "c") == []


# --- numbered lines -----------------------------------------------------------


@pytest.fixture(scope="module")
def odd_lines(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("lines"), random.Random(1)
    for k in range(3):
        with open(folder / f"f{k}.jsonl", "wb") as f:
            for i in range(300):
                text = rng.choice([f'{{"a": {i}}}', f"broken é {i}", "", "  ", "[1]", '{"a": NaN}', '{"a":1,"a":2}', '{"a":1} x', "x" * rng.randint(1, 60)])
                f.write(text.encode() + rng.choice([b"\n", b"\r\n", b"\n", b"\r"]))
            f.write(b"last" if k else b"")
    (folder / "none.jsonl").write_bytes(b"")
    return folder


@pytest.mark.parametrize("size", [1 << 20, 7, 64, 333])
def test_lines_cut_at_any_byte(spark, odd_lines, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {(os.path.basename(r.file), r.line, r.text) for r in lines.numbered(spark, str(odd_lines)).collect()}
        bad = [(os.path.basename(r.file), r.line, r.text) for r in lines.bad_lines(spark, str(odd_lines)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, wrong = set(), []
    for name in os.listdir(odd_lines):
        with open(odd_lines / name, encoding="utf-8") as f:
            for n, t in enumerate(f, 1):
                t = t.rstrip("\n")
                want.add((name, n, t))
                try:
                    ok = not t.strip() or isinstance(json.loads(t), dict)
                except ValueError:
                    ok = False
                wrong += [] if ok else [(name, n, t)]
    assert got == want and sorted(bad) == sorted(wrong) and len(bad) > 100


def test_strict_read_names_file_and_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n{"a"\n')
    with pytest.raises(ValueError, match=r"a\.jsonl:4: not valid JSON"):
        lines.strict(spark, str(tmp_path), "a int")
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in lines.strict(spark, str(tmp_path), "a int").collect()) == [1, 2]


# --- the fold as a stream -----------------------------------------------------

OPS = "scenario string, op_order long, op_id string, claim_key string, kind string, target string, value string"


def random_ops(rng, n):
    """Operations that mostly name entries that exist, of all kinds of faults."""
    out, made = [], {}
    for o in range(1, n + 1):
        s, k = rng.choice("st"), rng.choice("ab")
        kind = rng.choice(["ADD", "ADD", "UPDATE", "UPDATE", "DELETE", "NOOP", "WRONG"])
        target = rng.choice(made.get((s, k), []) + [None, f"{s}-M999"]) if kind in ("UPDATE", "DELETE") or rng.random() < 0.1 else None
        out.append((s, o, f"{s}-OP{o}", k, kind, target, rng.choice(["v", "w", None])))
        made.setdefault((s, k), []).append(f"{s}-M{o:03d}")
    return out


def run_stream(spark, batches, tmp_path, initial=None):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in batches:  # each a start of its own: the state comes from the checkpoint
        spark.createDataFrame(part, OPS).coalesce(1).write.mode("append").parquet(src)
        stream = memory_stream.fold_stream(spark.readStream.schema(OPS).parquet(src), initial)
        memory_stream.write_log(stream, out, cp).awaitTermination(120)
    return spark.read.parquet(out), memory_stream.folded_entries(spark, cp)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_batch_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    ops = random_ops(rng, 60)
    cuts = sorted(rng.sample(range(1, 60), 3))
    got, entries = run_stream(spark, [ops[a:b] for a, b in zip([0, *cuts], [*cuts, 60])], tmp_path)
    all_ops = spark.createDataFrame(ops, OPS)
    assert rows(got) == rows(memory.fold_operations(all_ops)) and rows(entries) == rows(memory.fold_state(all_ops))


def test_stream_goes_on_from_a_batch_fold_and_rejects_late_sessions(spark, tmp_path):
    ops = random_ops(random.Random(3), 50)
    first, rest = ops[:30], ops[30:]
    done = memory.fold_state(spark.createDataFrame(first, OPS))
    s, o, i, k, *_ = next(x for x in reversed(first) if x[4] == "ADD")
    late = (s, o, "again", k, "ADD", None, "z")
    got, entries = run_stream(spark, [rest[:10], [*rest[10:], late]], tmp_path, done)
    whole = memory.fold_operations(spark.createDataFrame(ops, OPS)).where("op_order > 30")
    assert rows(got.where("op_id <> 'again'")) == rows(whole)
    assert got.where("op_id = 'again'").first().rejection.startswith(f"late: {o} is not after")
    touched = {(x[0], x[3]) for x in rest}
    assert {(r.scenario, r.claim_key) for r in entries.collect()} >= touched
    assert rows(entries) == rows(memory.fold_state(spark.createDataFrame(ops, OPS)))


# --- the log ------------------------------------------------------------------

ROW = "cell_id string, status string, content string"


def test_log_commits_once_and_resumes(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"), ROW)
    requests = spark.createDataFrame([(f"c{k}",) for k in range(6)], "cell_id string")
    assert log.rows().count() == 0 and log.pending(requests).count() == 6
    first = spark.createDataFrame([("c0", "ok", "a"), ("c1", "error", None), ("c2", "ok", ""), ("c3", "ok", "d")], ROW)
    assert log.append(first, 0) and not log.append(first, 0) and log.rows().count() == 4
    assert sorted(r.cell_id for r in log.pending(requests).collect()) == ["c1", "c2", "c4", "c5"]
    # an attempt that dies before its marker leaves nothing that shows
    first.withColumn("log_batch", F.lit(1)).withColumn("log_row", F.lit(1)).write.parquet(str(tmp_path / "log" / "rows-1-dead"))
    assert log.rows().count() == 4
    again = BatchLog(spark, str(tmp_path / "log"), ROW)
    assert again.append(spark.createDataFrame([("c1", "ok", "b"), ("c0", "error", None)], ROW), 1)
    assert again.rows().count() == 6 and {r.cell_id: r.status for r in again.last().collect()} == {"c0": "error", "c1": "ok", "c2": "ok", "c3": "ok"}
    assert sorted(r.cell_id for r in again.pending(requests).collect()) == ["c0", "c2", "c4", "c5"]
    assert sorted(r.cell_id for r in again.pending(requests, any_row=True).collect()) == ["c2", "c4", "c5"]
    assert again.compact() == 1 == again.compact() and again.rows().count() == 4 and not again.append(first, 1) and not again.append(first, 0)
    assert len(again.vacuum()) == 3 and again.rows().count() == 4 and again.vacuum() == []
    assert again.append(spark.createDataFrame([("c4", "ok", "x")], ROW), 2) and again.last().count() == 5


def test_log_of_a_stream_that_is_killed_and_replayed(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    log = BatchLog(spark, str(tmp_path / "log"), ROW)
    stream = lambda: spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(src)
    for k in range(3):
        spark.createDataFrame([(f"c{k}", "ok", "x"), ("c0", "ok", str(k))], ROW).coalesce(1).write.mode("append").parquet(src)
    dies = {"after": 1}

    class Dying(BatchLog):
        def append(self, rows, batch):
            done = super().append(rows, batch)
            if batch == dies["after"]:
                dies["after"] = None
                raise RuntimeError("killed after its commit")
            return done

    with pytest.raises(Exception):
        Dying(spark, log.path, ROW).write(stream(), cp).awaitTermination(120)
    assert log.rows().count() == 4
    log.write(stream(), cp).awaitTermination(120)
    assert log.rows().count() == 6 and log.batches() == [0, 1, 2]
    log.write(stream(), cp).awaitTermination(120)
    assert log.rows().count() == 6 and {r.cell_id for r in log.last().collect()} == {"c0", "c1", "c2"}
    assert log.last().where("cell_id = 'c0'").first().log_batch == 2


def test_log_keeps_one_of_two_writers(spark, tmp_path):
    a, b = (BatchLog(spark, str(tmp_path / "log"), ROW) for _ in range(2))
    one = spark.createDataFrame([("c0", "ok", "a")], ROW)
    # both saw no marker; the second one to make it gives way
    b.committed = lambda batch: False
    assert a.append(one, 7) and not b.append(one, 7) and a.rows().count() == 1
    assert len(os.listdir(tmp_path / "log")) == 2
