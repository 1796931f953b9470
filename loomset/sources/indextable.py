"""The index of many archives as a table of versions.

A refresh opens only archives that are new or changed, writes their members as one new data folder, and then a manifest: one
row for each archive with its size, time and the version that holds its members. The version counts once a small
file names it. Readers of an older version go on reading it: its manifest and data stay until `vacuumed`. So a refresh
costs what has changed, and no reader meets half of one. One refresh at a time.
"""

from __future__ import annotations

import os
import shutil
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.sources import tar
from loomset.sources.archives import safely

MANIFEST = "archive string, archive_size long, archive_mtime timestamp, data int"


def version(table: str) -> int:
    """The version that readers get; 0: there is none."""
    try:
        with open(f"{table}/_current") as f:
            return int(f.read())
    except FileNotFoundError:
        return 0


def scanned(archives: DataFrame) -> DataFrame:
    """The index (tar.INDEX) of archives by path (archive); headers alone are read."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with tarfile.open(path, "r:") as members:
                    yield from tar.index_batches(path, members)

    return archives.select("archive").repartition("archive").mapInArrow(run, tar.INDEX)


def manifest(spark: SparkSession, table: str, of: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"file://{table}/manifest/{of}") if of else spark.createDataFrame([], MANIFEST)


def refreshed(spark: SparkSession, table: str, folder: str) -> int:
    """Brings the table up to the archives that are in a folder now, and returns its version: a new one if anything changed."""
    now = version(table)
    old = manifest(spark, table, now)
    stat = tar.stat_of(spark, folder).select("archive", F.col("size").alias("archive_size"), F.col("mtime").alias("archive_mtime"))
    same = old.join(stat, ["archive", "archive_size", "archive_mtime"], "left_semi")
    fresh = stat.join(old, ["archive", "archive_size", "archive_mtime"], "left_anti").withColumn("data", F.lit(now + 1))
    changed = not fresh.isEmpty()
    if not changed and same.count() == old.count():
        return now
    if changed:
        scanned(fresh).write.mode("overwrite").parquet(f"file://{table}/data/{now + 1}")
    same.unionByName(fresh).write.mode("overwrite").parquet(f"file://{table}/manifest/{now + 1}")
    with safely(f"{table}/_current", "w") as f:
        f.write(str(now + 1))
    return now + 1


def read(spark: SparkSession, table: str, of: int | None = None) -> DataFrame:
    """The index of a version (the current one by default): tar.INDEX."""
    known = manifest(spark, table, version(table) if of is None else of)
    parts = [r.data for r in known.select("data").distinct().collect()]  # as many as there are versions at most
    rows = [spark.read.parquet(f"file://{table}/data/{p}").withColumn("data", F.lit(p)) for p in parts]
    if not rows:
        return spark.createDataFrame([], tar.INDEX)
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.join(known.select("archive", "data"), ["archive", "data"], "left_semi").select(*(f.split()[0] for f in tar.INDEX.split(", ")))


def vacuumed(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Deletes all but the last `keep` versions and the data that none of them needs; returns what went."""
    now, gone = version(table), []
    stay = range(max(1, now - keep + 1), now + 1)
    needed = {r.data for v in stay for r in manifest(spark, table, v).select("data").distinct().collect()}
    for kind, kept in (("manifest", set(stay)), ("data", needed)):
        for name in os.listdir(f"{table}/{kind}") if os.path.isdir(f"{table}/{kind}") else []:
            if int(name) not in kept:
                shutil.rmtree(f"{table}/{kind}/{name}")
                gone.append(f"{kind}/{name}")
    return sorted(gone)
