"""Typed tables: projections to a declared schema, inserts without duplicates, caches and the DDL around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructType

from loomset.functions.text import without_nul

SCALARS = {"str": StringType(), "int": LongType(), "float": DoubleType(), "bool": BooleanType()}


def column_types(schema: StructType) -> dict[str, str]:
    """name -> str, int, float, bool or [one of them]; any other type raises."""

    def name(t: DataType) -> str:
        if isinstance(t, ArrayType) and not isinstance(t.elementType, ArrayType):
            return f"[{name(t.elementType)}]"
        if isinstance(t, StringType):
            return "str"
        if isinstance(t, BooleanType):
            return "bool"
        kind = t.typeName()
        if kind in ("byte", "short", "integer", "long"):
            return "int"
        if kind in ("float", "double"):
            return "float"
        raise TypeError(f"type {t.simpleString()} is not supported")

    return {f.name: name(f.dataType) for f in schema}


def as_type(c: Column, source: DataType, target: DataType, strict: bool = True) -> Column:
    """c cast to target; null stays null, arrays go element by element, and a string is true if it is not empty."""
    if isinstance(target, ArrayType):
        return F.transform(c, lambda x: as_type(x, source.elementType, target.elementType, strict))
    if isinstance(target, BooleanType) and isinstance(source, StringType):
        return F.length(c) > 0
    return c.cast(target) if strict else c.try_cast(target)


def converted(df: DataFrame, schema: StructType, nul_to_space: bool = False, strict: bool = True) -> DataFrame:
    """df's columns cast to a declared schema. A column the schema lacks raises KeyError."""
    if extra := [c for c in df.columns if c not in schema.fieldNames()]:
        raise KeyError(f"not in the table: {extra}")
    out = []
    for f in schema:
        if f.name not in df.columns:
            continue
        c, source = F.col(f.name), df.schema[f.name].dataType
        if nul_to_space and isinstance(source, StringType):
            c = without_nul(c)
        out.append(as_type(c, source, f.dataType, strict).alias(f.name))
    return df.select(out)


def sorted_table(df: DataFrame, by: str, tiebreak: list[str], ascending: bool = True, index: str | None = None) -> DataFrame:
    """df in order of a column, nulls last in both directions; `index` numbers the rows from 0.

    Numbering by a global window takes one task; ask for it on tables that one task can sort.
    """
    order = [F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), *(F.col(c).asc() for c in tiebreak)]
    return df.orderBy(order) if index is None else df.withColumn(index, F.row_number().over(Window.orderBy(order)) - 1)


def visible(df: DataFrame) -> DataFrame:
    """Without columns whose names start with an underscore."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def distinct_by(df: DataFrame, keys: list[str], position: str, keep: str = "first") -> DataFrame:
    """One row for each key: the first or last by position. Partial maxima are taken before the shuffle."""
    whole = F.struct(F.col(position).alias("__p"), F.struct(*df.columns).alias("__row"))
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(*(F.col(k).alias(f"__key_{k}") for k in keys)).agg(pick(whole["__row"], whole["__p"]).alias("__row")).select("__row.*")


def inserted(target: DataFrame, rows: DataFrame, keys: list[str], position: str, keep: str = "first") -> DataFrame:
    """The rows that an insert which ignores duplicates would add: one for each key that the target lacks.

    keep: which of the input's own duplicates counts. Null keys equal nothing, as in a unique index.
    """
    return distinct_by(rows, keys, position, keep).join(target.select(keys).distinct(), keys, "left_anti").drop(position)


def upserted(target: DataFrame, rows: DataFrame, keys: list[str], position: str, keep: str = "first") -> DataFrame:
    return target.unionByName(inserted(target, rows, keys, position, keep))


def insert_report(target: DataFrame, rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """n_inserted, n_ignored: how many rows an insert that ignores duplicates adds, and how many it leaves out."""
    added = inserted(target, rows, keys, position).agg(F.count(F.lit(1)).alias("n_inserted"))
    return added.crossJoin(rows.agg(F.count(F.lit(1)).alias("__n"))).select("n_inserted", (F.col("__n") - F.col("n_inserted")).alias("n_ignored"))


def saved(df: DataFrame, folder: str) -> DataFrame:
    """df written as Parquet and read back."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def cache_get(cache: DataFrame, keys: DataFrame, key: str = "key", value: str = "value", position: str = "position") -> DataFrame:
    """The cached value of each asked key, null where there is none; positions keep the order of the request."""
    return keys.join(cache.select(key, value), key, "left").select(position, key, value)


def cache_put(cache: DataFrame, rows: DataFrame, key: str = "key", value: str = "value", position: str = "position") -> DataFrame:
    """The cache after writing rows; the last write of a key wins."""
    last = rows.groupBy(key).agg(F.max_by(value, position).alias(value))
    return cache.join(last.select(key), key, "left_anti").select(key, value).unionByName(last)


def cached_apply(rows: DataFrame, cache: DataFrame, text: str, compute) -> tuple[DataFrame, DataFrame]:
    """(rows with `value`, new cache): compute runs once for each distinct text that the cache (key, value) lacks."""
    asked = rows.select(F.col(text).alias("key")).where("key is not null").distinct()
    fresh = compute(asked.join(cache, "key", "left_anti"))
    known = cache.select("key", "value").unionByName(fresh.select("key", "value"))
    return rows.join(known.withColumnRenamed("key", text), text, "left"), known


def migrated(df: DataFrame, schema: StructType) -> DataFrame:
    """The projection of a migration between databases: declared types, NUL bytes made spaces."""
    return converted(df, schema, nul_to_space=True)


def creation_sql(name: str, schema: StructType) -> str:
    return f"CREATE TABLE {name} ({schema.toDDL()})"


def deletion_order(edges: DataFrame, most: int = 64) -> DataFrame:
    """table, depth: delete by descending depth, so that no table goes before those that refer to it.

    edges: child, parent (child refers to parent). A cycle's tables get the depth at which the search
    stopped. A schema's graph is small; each round is one join.
    """
    tables = edges.select(F.col("child").alias("table")).union(edges.select("parent")).where("table is not null").distinct()
    depth = tables.withColumn("depth", F.lit(0))
    links = edges.where("child <> parent and child is not null and parent is not null").distinct()
    for _ in range(min(most, max(1, tables.count()))):
        up = links.join(depth.select(F.col("table").alias("parent"), F.col("depth").alias("d")), "parent").groupBy("child").agg((F.max("d") + 1).alias("d"))
        after = depth.join(up, depth["table"] == up["child"], "left").select("table", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("moved"))
        rows = after.collect()  # the tables of a schema
        depth = edges.sparkSession.createDataFrame([(r["table"], r["depth"]) for r in rows], "table string, depth int")
        if not any(r["moved"] for r in rows):
            break
    return depth


def table_counts(spark: SparkSession, names: list[str], path: str) -> DataFrame:
    """table, n: row counts of a catalogue of Parquet tables; counts come from the files' footers."""
    out = None
    for name in names:
        one = spark.read.parquet(f"{path}/{name}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that hold no value at all; one pass counts all of them."""
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.select([c for c in df.columns if counts[c]])


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose keys occur more than once."""
    return df.join(df.groupBy(keys).count().where("count > 1").select(keys), keys, "left_semi")
