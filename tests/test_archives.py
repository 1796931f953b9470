"""The archive sink: what is committed, what is left after failures, and folders packed by pattern."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomset.sources import archives, tar


def listed(folder):
    return sorted(f for f in os.listdir(folder) if f.endswith(".tar")) if os.path.isdir(folder) else []


def everything(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)


def rows_of(spark, n, size=100):
    return spark.range(n).select(F.concat(F.lit("m"), "id").alias("name"), F.encode(F.rpad(F.col("id").cast("string"), size, "x"), "UTF-8").alias("data"))


def members(spark, folder):
    index = spark.read.format("tarindex").load(folder)
    return {r.name: bytes(r.content) for r in tar.read_members(index, split=4096, flush=300).collect()}


def test_shards_are_committed(spark, tmp_path):
    archives.register(spark)
    folder = str(tmp_path / "out")
    rows_of(spark, 200).repartition(3).write.format("tarshards").mode("append").option("most", 20_000).save(folder)
    assert len(listed(folder)) > 3 and not os.path.exists(f"{folder}/{archives.STAGING}")
    named = archives.archives_of(spark, folder).collect()
    assert sorted(os.path.basename(r.archive) for r in named) == listed(folder) and sum(r.members for r in named) == 200
    assert all(r.bytes == os.path.getsize(r.archive) for r in named)
    want = {f"m{i}": str(i).ljust(100, "x").encode() for i in range(200)}
    assert members(spark, folder) == want
    rows_of(spark, 5).write.format("tarshards").mode("append").save(folder)  # a second job's archives stand beside them
    assert archives.archives_of(spark, folder).agg(F.sum("members")).first()[0] == 205
    rows_of(spark, 7, 50).coalesce(1).write.format("tarshards").mode("overwrite").save(folder)
    assert len(listed(folder)) == 1 and len(members(spark, folder)) == 7 and len(archives.manifests(folder)) == 1


def test_failed_jobs_leave_nothing(spark, tmp_path):
    archives.register(spark)
    folder = str(tmp_path / "out")
    bad = rows_of(spark, 100).repartition(4).withColumn("name", F.when(F.col("name") == "m63", F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("tarshards").mode("append").save(folder)
    assert everything(folder) == []
    rows_of(spark, 3).coalesce(1).write.format("tarshards").mode("append").save(folder)
    before = everything(folder)
    with pytest.raises(Exception, match="lost"):
        bad.write.format("tarshards").mode("overwrite").save(folder)
    assert everything(folder) == before  # what was there still is
    with pytest.raises(Exception, match="tarshards takes"):
        spark.range(2).write.format("tarshards").mode("append").save(folder)


def test_repeated_attempts(tmp_path, monkeypatch):
    """An attempt that dies leaves its staged file to the sweep, and one that counts is all that is named."""

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    writer = archives.ShardWriter(str(tmp_path), 1 << 20, False)
    batch = pa.record_batch([pa.array(["a", "b"]), pa.array([b"1", b"2"])], names=["name", "data"])

    def killed():
        yield batch
        raise KeyboardInterrupt

    monkeypatch.setattr(archives.TaskContext, "get", lambda: Task(1))
    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    assert not [f for f in everything(tmp_path) if f.endswith((".tar", ".part"))]
    writer.write(iter([batch]))  # an attempt whose message is lost
    monkeypatch.setattr(archives.TaskContext, "get", lambda: Task(2))
    message = writer.write(iter([batch]))
    writer.commit([message, None])
    assert len(listed(tmp_path)) == 1 and not os.path.exists(tmp_path / archives.STAGING)
    assert [x["members"] for x in json.load(open(archives.manifests(str(tmp_path))[0]))] == [2]


def test_folder_is_packed(spark, tmp_path):
    src, into = tmp_path / "src", str(tmp_path / "packed")
    names = [f"d{i % 3}/file {i}.txt" for i in range(30)] + ["top.txt", "skip.bin", "d0/deep/é.txt"]
    for n in names:
        os.makedirs(os.path.dirname(src / n), exist_ok=True)
        (src / n).write_bytes(n.encode() * 50)
    (src / "d1/empty.txt").write_bytes(b"")
    wanted = {n: n.encode() * 50 for n in names if n.endswith(".txt")} | {"d1/empty.txt": b""}
    with pytest.raises(FileNotFoundError):
        archives.pack_folder(spark, str(src), into, ("*.zip",))
    done = archives.pack_folder(spark, str(src), into, ("**/*.txt",), shards=3)
    assert done.agg(F.sum("members")).first()[0] == len(wanted) and members(spark, into) == wanted
    (src / "d0/deep/é.txt").write_bytes(b"changed")
    before = everything(into)
    with pytest.raises(ValueError, match="size"):  # archives that are there are held against the files, and stay
        archives.pack_folder(spark, str(src), into, ("**/*.txt",), delete=True)
    assert everything(into) == before and (src / "top.txt").exists()
    (src / "d0/deep/é.txt").write_bytes("d0/deep/é.txt".encode() * 50)
    archives.pack_folder(spark, str(src), into, ("**/*.txt",), delete=True)
    assert (src / "top.txt").exists()
    archives.pack_folder(spark, str(src), into + "2", ("**/*.txt",), delete=True)
    assert not (src / "top.txt").exists() and (src / "skip.bin").exists() and members(spark, into + "2") == wanted


def test_safely(tmp_path):
    path = str(tmp_path / "f")
    with archives.safely(path) as f:
        f.write(b"one")
    for error in (ValueError, KeyboardInterrupt):
        with pytest.raises(error), archives.safely(path) as f:
            f.write(b"half")
            raise error
    assert open(path, "rb").read() == b"one" and os.listdir(tmp_path) == ["f"]
