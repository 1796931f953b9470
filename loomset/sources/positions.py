"""A sorted table whose rows are found by their place in it: one file is opened, not the table.

Rows are dealt into ranges of the order and each range is one file, or several where it is long. Beside the files stands a small
table: where each file's rows begin, and how many there are. A position leads to one file and, in it, to a row number,
by which Parquet skips what comes before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def written(df: DataFrame, order: list[str], folder: str, ranges: int | None = None) -> None:
    """Writes df in order under folder (any store). order: columns that place each row; nulls come first."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(f"{folder}/rows")
    files = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows").select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
    # one row for each file; names of files begin with their range's number
    before = F.coalesce(F.sum("rows").over(Window.orderBy(F.regexp_extract("file", "[^/]*$", 0)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.select("file", "rows", before.alias("start")).coalesce(1).write.parquet(f"{folder}/places")


def sliced(spark: SparkSession, folder: str, start: int, rows: int = 1, into: str = "position") -> DataFrame:
    """The rows at positions start to start + rows - 1, with their position. Positions beyond the table's end give nothing."""
    places = spark.read.parquet(f"{folder}/places")
    names = spark.read.parquet(f"{folder}/rows").schema
    hit = places.where((F.col("start") < start + rows) & (F.col("start") + F.col("rows") > start)).orderBy("start").collect() if rows > 0 and start + rows > 0 else []
    parts = []
    for r in hit:  # as many as the slice has files
        at = F.col("_metadata.row_index")
        part = spark.read.schema(names).parquet(r.file).where((at >= start - r.start) & (at < start + rows - r.start))
        parts.append(part.select("*", (at + r.start).alias(into)))
    if not parts:
        return spark.read.schema(names).parquet(f"{folder}/rows").limit(0).withColumn(into, F.lit(0).cast("long"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
