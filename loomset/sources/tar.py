"""Tar archives: an index source, member reads, sharded writes and verification.

Archives are scanned where Spark can hand out their bytes (`binaryFile`, any store) or, for archives
too large for one value on a file system that all workers mount, by the `tarindex` Python data source,
which reads headers only and seeks over contents.
"""

from __future__ import annotations

import io
import os
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

INDEX = "archive string, position long, name string, offset long, size long, mtime double"
# Fixed values of the archive's owner and mode.
OWNER, GROUP_ID, MODE = "bigdata", 10999, 0o666
META = r"__[^/]*__($|/)"
#: Bytes of an archive that is held as one value, about: a task holds one at once, and a few copies of it.
ARCHIVE = 16 << 20
#: Bytes of an archive that one task reads, of contents in one batch, and members in one batch of an index, about.
SPLIT, FLUSH, ROWS = 256 << 20, 8 << 20, 10_000


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarIndexReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in self.paths]

    def read(self, partition: Archive) -> Iterator[tuple]:
        with tarfile.open(partition.path, "r:") as tar:
            n = 0
            for m in tar:
                if m.isfile():
                    yield partition.path, n, m.name, m.offset_data, m.size, float(m.mtime)
                    n += 1
                tar.members = []  # else all of them are kept


class TarIndex(DataSource):
    """spark.read.format("tarindex").load(folder or archive): one row for each regular member, one partition for each archive."""

    @classmethod
    def name(cls) -> str:
        return "tarindex"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> TarIndexReader:
        path = self.options["path"]
        if os.path.isfile(path):
            return TarIndexReader([path])
        return TarIndexReader(sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".tar")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarIndex)


def index_of(archives: DataFrame, archive: str = "archive", content: str = "content") -> DataFrame:
    """The index of archives held as bytes (archive, content)."""

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                with tarfile.open(fileobj=pa.BufferReader(body.as_buffer()), mode="r:") as tar:
                    yield from index_batches(name, tar)

    return archives.select(archive, content).mapInArrow(run, INDEX)


def index_batches(path: str, archive: tarfile.TarFile) -> Iterator[pa.RecordBatch]:
    """INDEX of an open archive, in batches of ROWS members."""
    rows, n = [], 0
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
    batch = lambda: pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[f.split()[0] for f in INDEX.split(", ")])
    for m in archive:
        if m.isfile():
            rows.append((path, n, m.name, m.offset_data, m.size, float(m.mtime)))
            n += 1
        archive.members = []  # else all of them are kept
        if len(rows) == ROWS:
            yield batch()
            rows = []
    if rows:
        yield batch()


def last_wins(index: DataFrame) -> DataFrame:
    """One row for each member name of an archive: the last with that name."""
    row = F.struct("position", "offset", "size", "mtime")
    return index.groupBy("archive", "name").agg(F.max_by(row, "position").alias("r")).select("archive", "r.position", "name", "r.offset", "r.size", "r.mtime")


def refreshed(stored: DataFrame, stat: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index after a scan: archives whose stat (archive, size, mtime) equals the stored one keep their rows, others are replaced.

    stored: INDEX with archive_size and archive_mtime; fresh: the index of the other archives.
    """
    same = stored.join(stat.withColumnRenamed("size", "s").withColumnRenamed("mtime", "m"), "archive").where(F.col("archive_size").eqNullSafe(F.col("s")) & F.col("archive_mtime").eqNullSafe(F.col("m"))).drop("s", "m")
    new = fresh.join(same.select("archive").distinct(), "archive", "left_anti").join(stat.select("archive", F.col("size").alias("archive_size"), F.col("mtime").alias("archive_mtime")), "archive")
    return same.unionByName(new)


def stale(stored: DataFrame, stat: DataFrame) -> DataFrame:
    """Archives of stat (archive, size, mtime) that have no stored index of that size and time."""
    known = stored.select("archive", F.col("archive_size").alias("size"), F.col("archive_mtime").alias("mtime")).distinct()
    return stat.join(known, (stat.archive == known.archive) & stat["size"].eqNullSafe(known["size"]) & stat["mtime"].eqNullSafe(known["mtime"]), "left_anti")


def read_members(index: DataFrame, split: int = SPLIT, flush: int = FLUSH) -> DataFrame:
    """index with `content`, read in order of offsets, each stretch of `split` bytes of an archive by one task.

    Filter the index first: only what is left is read. Archives are paths that workers can open. A task holds
    `flush` bytes of contents at once, or one member.
    """
    rows = index.withColumn("__part", F.floor(F.col("offset") / split)).repartition("archive", "__part").sortWithinPartitions("archive", "offset").select(index.columns)

    def run(batches):
        path, file = None, None
        try:
            for batch in batches:
                names = batch.schema.names
                out, at, held = [], 0, 0

                def full(to: int):
                    part = batch.slice(at, to - at)
                    return pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*names, "content"])

                for i, (archive, offset, size) in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in ("archive", "offset", "size")))):
                    if archive != path:
                        if file:
                            file.close()
                        path, file = archive, open(archive, "rb")
                    file.seek(offset)
                    out.append(file.read(size))
                    held += size
                    if held >= flush:
                        yield full(i + 1)
                        out, at, held = [], i + 1, 0
                if at < batch.num_rows:
                    yield full(batch.num_rows)
        finally:
            if file:
                file.close()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return rows.mapInArrow(run, f"{ddl}, content binary")


def members_of(archives: DataFrame, archive: str = "archive", content: str = "content") -> DataFrame:
    """archive, name, size, data of the members of archives held as bytes."""

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                with tarfile.open(fileobj=pa.BufferReader(body.as_buffer()), mode="r:") as tar:
                    yield from member_batches(name, tar)

    return archives.select(archive, content).mapInArrow(run, "archive string, name string, size long, data binary")


def member_batches(path: str, archive: tarfile.TarFile) -> Iterator[pa.RecordBatch]:
    """archive, name, size, data of an open archive's members, in batches of FLUSH bytes or one member."""
    rows, held = [], 0
    types = (pa.string(), pa.string(), pa.int64(), pa.binary())
    batch = lambda: pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["archive", "name", "size", "data"])
    for m in archive:
        if m.isfile():
            rows.append((path, m.name, m.size, archive.extractfile(m).read()))
            held += m.size
        archive.members = []
        if held >= FLUSH or len(rows) == ROWS:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def natural(name: str = "name"):
    """Order columns for natural sorting: digit runs padded with zeros."""
    return F.array_join(F.transform(F.regexp_extract_all(F.col(name), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def ordered(files: DataFrame, shards: int) -> DataFrame:
    """files (name, ...) with `shard`, dealt by name, each shard in natural order in a task of its own."""
    rows = files.withColumns({"shard": F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int"), "__order": natural()})
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "__order", "name").drop("__order")


def packed(files: DataFrame, shards: int, most: int | None = None) -> DataFrame:
    """archive, content: files (name, data) as tar archives with one owner and mode, in natural order.

    Files are dealt to shards by name (see `shards_for`); a shard that grows beyond `most` bytes (ARCHIVE by default)
    goes on in another archive. An archive is one value here; larger ones go to files by the tarshards sink.
    """
    dealt, most = ordered(files.select("name", "data"), shards), most or ARCHIVE

    def run(batches):
        now, part, buffer, tar = None, 0, None, None

        def close():
            tar.close()
            return pa.record_batch([pa.array([f"shard-{now:05d}-{part:03d}.tar"]), pa.array([buffer.getvalue()], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for name, data, shard in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if tar and (shard != now or buffer.tell() > most):
                    yield close()
                    part = part + 1 if shard == now else 0
                    tar = None
                if tar is None:
                    now, buffer = shard, io.BytesIO()
                    tar = tarfile.open(fileobj=buffer, mode="w:")
                body = data.as_py() or b""
                info = tarfile.TarInfo(name)
                info.size, info.mode, info.uid, info.gid, info.uname, info.gname = len(body), MODE, GROUP_ID, GROUP_ID, OWNER, OWNER
                tar.addfile(info, io.BytesIO(body))
        if tar:
            yield close()

    return dealt.mapInArrow(run, "archive string, content binary")


def shards_for(files: DataFrame, size: int | None = None) -> int:
    """How many shards of about `size` bytes (ARCHIVE by default) files (name, data) need: one pass over their lengths."""
    total = files.agg(F.sum(F.octet_length("data") + 1024)).first()[0] or 0  # a header, and what fills the last block
    return max(1, -(-total // (size or ARCHIVE)))


def matching(files: DataFrame, patterns: list[str]) -> DataFrame:
    """files whose names fit one of the shell patterns; a star stays within a folder, two cross folders."""

    def regex(pattern: str) -> str:
        out = ""
        for piece in re.split(r"(\*\*|\*|\?)", pattern):
            out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece, re.escape(piece))
        return f"^{out}$"

    return files.where(F.col("name").rlike("|".join(map(regex, patterns))))


def stat_of(spark: SparkSession, folder: str) -> DataFrame:
    """archive, size, mtime of the archives in a folder, as the file system lists them: contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("archive"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def verified(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name, problem for members that are missing, unexpected, twice there, or of other content. Both: name, data."""
    e = expected.select("name", F.octet_length("data").alias("es"), F.sha2("data", 256).alias("eh"))
    a = actual.groupBy("name").agg(F.count("*").alias("n"), F.max(F.octet_length("data")).alias("as"), F.max(F.sha2("data", 256)).alias("ah"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("es").isNull(), "unexpected").when(F.col("n") > 1, "twice").when(F.col("es") != F.col("as"), "size").when(F.col("eh") != F.col("ah"), "content")
    return e.join(a, "name", "full").select("name", problem.alias("problem")).where("problem is not null")


def written(archives: DataFrame, folder: str) -> None:
    """Writes archives (archive, content) as files under a folder that all workers mount; each by rename, so none is half there."""

    def save(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            path = os.path.join(folder, r["archive"])
            with open(f"{path}.part-{os.getpid()}", "wb") as f:
                f.write(r["content"])
            os.replace(f"{path}.part-{os.getpid()}", path)

    archives.foreachPartition(save)


# -- the index as relations -------------------------------------------------------------------------


def by_name(offsets: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """The first entry of a member name: offsets (file_id, file_name, offset, file_size) joined with files (file_id, file_name, mtime)."""
    f = files.select("file_id", F.col("file_name").alias("archive"), "mtime")
    return offsets.where(F.col("file_name") == name).join(f, "file_id").orderBy("file_id", "offset").limit(1)


def files_per_shard(offsets: DataFrame, files: DataFrame, suffix: str | None = None) -> DataFrame:
    """archive, names: the sorted member names of each archive, those with the suffix only if one is given."""
    rows = offsets.where(F.col("file_name").endswith(suffix)) if suffix else offsets
    f = files.select("file_id", F.col("file_name").alias("archive"))
    return rows.join(f, "file_id").groupBy("archive").agg(F.sort_array(F.collect_list("file_name")).alias("names"))
