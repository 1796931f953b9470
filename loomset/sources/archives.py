"""Archives as a sink: files packed into tar shards by tasks that commit or leave nothing.

`df.write.format("tarshards")` streams rows (name, and data or the path of a file) into archives in a staging
folder, one after another in each task. The driver's commit moves the archives of the tasks that count into place and
then names them in a manifest; an abort, or a task that was repeated or killed, leaves no archive. `archives_of`
lists what manifests name. `pack_folder` packs the files of a folder by pattern, holds the archives against the files,
and only then deletes these. Folders are paths that driver and workers mount.
"""

from __future__ import annotations

import contextlib
import glob
import hashlib
import io
import json
import os
import shutil
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from loomset.plans.lineage import materialised
from loomset.sources import tar

MANIFEST, STAGING = "_manifest", "_staging"
CHUNK = 1 << 20
#: Bytes of files that one task packs, about, where the caller does not say.
PACK = 128 << 20


@contextlib.contextmanager
def safely(path: str, mode: str = "wb", sync: bool = True):
    """A file that takes `path` when the block ends, and is gone if the block fails; what was there before stays till then.

    sync: wait until the disk has it; not needed for files that are made again if the machine fails."""
    own = f"{path}.part-{uuid.uuid4().hex}"
    try:
        with open(own, mode) as f:
            yield f
            if sync:
                f.flush()
                os.fsync(f.fileno())
        os.replace(own, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(own)
        raise


@dataclass
class Packed(WriterCommitMessage):
    """What one task has staged: (staged path, final name, members, bytes)."""

    archives: list


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, most: int, overwrite: bool):
        self.folder, self.most, self.overwrite = folder, most, overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packed:
        task = TaskContext.get()
        staging = f"{self.folder}/{STAGING}/{self.job}"
        os.makedirs(staging, exist_ok=True)
        done, archive, path, members = [], None, None, 0

        def closed() -> tuple:
            archive.close()
            return path, f"shard-{task.partitionId():05d}-{len(done):03d}-{self.job}.tar", members, os.path.getsize(path)

        try:
            for batch in iterator:
                for row in zip(*(batch.column(batch.schema.get_field_index(c)) if c in batch.schema.names else [pa.scalar(None)] * batch.num_rows for c in ("name", "data", "path", "mtime"))):
                    name, data, source, mtime = row
                    if archive and archive.offset >= self.most:
                        done.append(closed())
                        archive = None
                    if archive is None:
                        path, members = f"{staging}/{task.partitionId()}-{task.taskAttemptId()}-{len(done)}.part", 0
                        archive = tarfile.open(path, "w:")
                    info = tarfile.TarInfo(name.as_py())
                    info.mode, info.uid, info.gid, info.uname, info.gname = tar.MODE, tar.GROUP_ID, tar.GROUP_ID, tar.OWNER, tar.OWNER
                    info.mtime = mtime.as_py() or 0
                    if data.as_py() is None and source.as_py() is not None:
                        with open(source.as_py(), "rb") as f:
                            info.size = os.fstat(f.fileno()).st_size
                            archive.addfile(info, f)  # copied in pieces
                    else:
                        body = data.as_py() or b""
                        info.size = len(body)
                        archive.addfile(info, io.BytesIO(body))
                    members += 1
            if archive:
                done.append(closed())
            return Packed(done)
        except BaseException:
            if archive:
                archive.close()
            for name in glob.glob(f"{staging}/{task.partitionId()}-{task.taskAttemptId()}-*.part"):
                os.unlink(name)
            raise

    def commit(self, messages: list) -> None:
        before = manifests(self.folder) if self.overwrite else []
        archives = [x for m in messages if m is not None for x in m.archives]
        for staged, name, _, _ in archives:
            os.replace(staged, f"{self.folder}/{name}")
        os.makedirs(f"{self.folder}/{MANIFEST}", exist_ok=True)
        with safely(f"{self.folder}/{MANIFEST}/{self.job}.json", "w") as f:
            json.dump([{"archive": name, "members": members, "bytes": size} for _, name, members, size in archives], f)
        for path in before:  # after the new ones are named
            with open(path) as f:
                old = json.load(f)
            os.unlink(path)
            for x in old:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(f"{self.folder}/{x['archive']}")
        self.swept()

    def abort(self, messages: list) -> None:
        self.swept()

    def swept(self) -> None:
        shutil.rmtree(f"{self.folder}/{STAGING}/{self.job}", ignore_errors=True)
        with contextlib.suppress(OSError):  # another job may be at work
            os.rmdir(f"{self.folder}/{STAGING}")


class TarShards(DataSource):
    """df.write.format("tarshards").mode(append or overwrite).option("most", bytes).save(folder); df: name, data or path, perhaps mtime.

    An archive is closed once it has `most` bytes."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        names = schema.fieldNames()
        if "name" not in names or not {"data", "path"} & set(names):
            raise ValueError(f"tarshards takes name, and data or path: {names}")
        return ShardWriter(self.options["path"].rstrip("/"), int(self.options.get("most", 512 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarShards)
    tar.register(spark)


def manifests(folder: str) -> list[str]:
    return sorted(glob.glob(f"{folder}/{MANIFEST}/*.json"))


def archives_of(spark: SparkSession, folder: str) -> DataFrame:
    """archive, members, bytes of the archives that a folder's manifests name; archives that no manifest names are not there yet."""
    schema = "array<struct<archive: string, members: long, bytes: long>>"
    if not manifests(folder):
        return spark.createDataFrame([], "archive string, members long, bytes long")
    rows = spark.read.text(f"file://{folder}/{MANIFEST}/*.json", wholetext=True).select(F.explode(F.from_json("value", schema)).alias("x"))
    return rows.select(F.concat(F.lit(f"{folder}/"), "x.archive").alias("archive"), "x.members", "x.bytes")


def files_of(spark: SparkSession, folder: str, patterns: tuple[str, ...] = ("**/*",)) -> DataFrame:
    """name, path, size, mtime of the files under a folder whose names fit a pattern, empty ones too; contents are not read.

    Folders are listed by tasks, level by level; links to folders are not followed."""
    folder = folder.rstrip("/")
    found = "path string, size long, mtime double"

    def listed(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with os.scandir(path) as entries:
                    rows = [(e.path, None, None) if e.is_dir(follow_symlinks=False) else (e.path, e.stat().st_size, e.stat().st_mtime) for e in entries if e.is_file() or e.is_dir(follow_symlinks=False)]
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64()))], names=["path", "size", "mtime"])

    level, files = spark.createDataFrame([(folder,)], "path string"), None
    while True:
        entries = materialised(level.mapInArrow(listed, found))
        own = entries.where("size is not null")
        files = own if files is None else files.unionByName(own)
        level = entries.where("size is null").select("path").repartition("path")
        if level.isEmpty():
            break
    rows = files.withColumn("name", F.substring("path", len(folder) + 2, 1 << 30))
    # a leading **/ matches files of the folder itself too
    return tar.matching(rows, [p for x in patterns for p in ([x, x[3:]] if x.startswith("**/") else [x])])


def digested(rows: DataFrame) -> DataFrame:
    """name, size, sha of the bytes at (path, offset, size) of each row, read in pieces of bounded size."""

    def run(batches):
        for batch in batches:
            out = []
            for path, offset, size in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                digest, left = hashlib.sha256(), size
                with open(path, "rb") as f:
                    f.seek(offset)
                    while left and (piece := f.read(min(CHUNK, left))):
                        digest.update(piece)
                        left -= len(piece)
                out.append(digest.hexdigest() if not left else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.string())], names=["name", "size", "sha"])

    return rows.select("name", "path", "offset", "size").mapInArrow(run, "name string, size long, sha string")


def packed_faults(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """name, problem for files (name, path, size) that the archives of a folder lack, hold twice or with other bytes, and members that are no file."""
    want = digested(files.select("name", "path", F.lit(0).cast("long").alias("offset"), "size").repartition(F.col("name")))
    index = spark.read.format("tarindex").load(folder).join(F.broadcast(archives_of(spark, folder).select("archive")), "archive")
    have = digested(index.select("name", F.col("archive").alias("path"), "offset", "size"))
    have = have.groupBy("name").agg(F.count("*").alias("n"), F.max("size").alias("has_size"), F.max("sha").alias("has_sha"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("size").isNull(), "unexpected").when(F.col("n") > 1, "twice").when(F.col("size") != F.col("has_size"), "size").when(~F.col("sha").eqNullSafe(F.col("has_sha")), "content")
    return want.join(have, "name", "full").select("name", problem.alias("problem")).where("problem is not null")


def pack_folder(spark: SparkSession, folder: str, into: str, patterns: tuple[str, ...] = ("**/*",), shards: int | None = None, most: int = 512 << 20, verify: bool = True, delete: bool = False) -> DataFrame:
    """Packs a folder's files that fit a pattern into archives under `into`, in natural order of their names within each; returns archives_of(into).

    Where archives are there already they are only held against the files: neither written nor is anything deleted then.
    A fault raises, and the files stay. No file that fits raises FileNotFoundError. shards: tasks, by default one for `most` bytes.
    """
    files = files_of(spark, folder, patterns)
    n, total = files.agg(F.count("*"), F.sum("size")).first()
    if not n:
        raise FileNotFoundError(f"no files in {folder} fit {patterns}")
    register(spark)
    fresh = not manifests(into)
    if fresh:
        os.makedirs(into, exist_ok=True)
        tasks = shards or max(1, -(-total // most))
        rows = files.withColumn("__order", tar.natural()).withColumn("__shard", F.pmod(F.xxhash64("name"), F.lit(tasks)).cast("int"))
        rows = rows.repartitionById(tasks, F.col("__shard")).sortWithinPartitions("__order", "name").select("name", "path", "mtime")
        rows.write.format("tarshards").mode("append").option("most", most).save(into)
    if verify and (faults := packed_faults(spark, files, into).limit(10).collect()):
        raise ValueError(f"archives in {into} are not the files of {folder}: {[tuple(x) for x in faults]}")
    if delete and fresh:
        files.select("path").repartition("path").foreachPartition(lambda rows: [os.unlink(r.path) for r in rows] and None)
    return archives_of(spark, into)
