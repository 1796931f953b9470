"""Sharded archives as training samples: members meet their metadata before any content is read."""

from __future__ import annotations

import gzip
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.sources.tar import META


def chosen_members(index: DataFrame, suffix: str = ".jpg", select: Column | None = None, rename: Callable[[Column], Column] | None = None, skip: str | None = META) -> DataFrame:
    """Index rows that pass: no metadata names, renamed if asked, the suffix (as written), and a condition of choice."""
    rows = index
    if skip:
        rows = rows.where(~F.col("name").rlike(skip))
    if rename:
        rows = rows.withColumn("name", rename(F.col("name")))
    rows = rows.where(F.col("name").endswith(suffix))
    return rows.where(select) if select is not None else rows


def with_metadata(members: DataFrame, metadata: DataFrame, on: list[str], value: str = "metadata", suffix: int = 4, strict: bool = True) -> DataFrame:
    """members with the metadata of their key (the name without its suffix); strict: a missing one fails, else it drops the member."""
    keyed = members.withColumn("key", F.expr(f"substring(name, 1, length(name) - {suffix})"))
    joined = keyed.join(metadata.select(*on, value), on, "left" if strict else "inner")
    if strict:
        joined = joined.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit("no metadata for "), "key")).cast(joined.schema[value].dataType)))
    return joined


def base_and_suffix(name: Column) -> Column:
    """struct<key, suffix>: the path up to the base name's first point, and what follows it; null without a point or base."""
    pattern = r"^((?:.*/|)[^./]+)\.([^/]*)$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("key"), F.regexp_extract(name, pattern, 2).alias("suffix")))


def samples(members: DataFrame, content: str = "content", url: str = "archive") -> DataFrame:
    """__key__, __url__, metadata, jpg, error: members as samples; other suffixes than jpg, and empty keys, are errors."""
    parts = base_and_suffix(F.col("name"))
    error = F.when(parts.isNull(), "no key").when(parts["suffix"] != "jpg", "suffix")
    return members.select(parts["key"].alias("__key__"), F.col(url).alias("__url__"), "metadata", F.col(content).alias("jpg"), error.alias("error"))


def by_policy(df: DataFrame, policy: str = "raise", error: str = "error") -> DataFrame:
    """What happens to rows with an error: raise, skip, or keep."""
    if policy == "keep":
        return df
    if policy == "skip":
        return df.where(F.col(error).isNull()).drop(error)
    others = [c for c in df.columns if c != error]
    first = others[0]
    checked = F.when(F.col(error).isNotNull(), F.raise_error(F.col(error)).cast(df.schema[first].dataType)).otherwise(F.col(first))
    return df.select(checked.alias(first), *others[1:])


def unpacked_json(df: DataFrame, column: str, fields: str, strict: bool = True) -> DataFrame:
    """df with the keys of a JSON column as columns of their own; a missing key fails if strict, else it is null."""
    parsed = df.withColumn("__j", F.from_json(column, fields))
    names = parsed.schema["__j"].dataType.fieldNames()
    cells = []
    for n in names:
        c = F.col(f"__j.{n}")
        if strict:
            has = F.array_contains(F.json_object_keys(column), n)
            c = F.when(F.coalesce(has, F.lit(False)), c).otherwise(F.raise_error(F.lit(f"no key {n}")).cast(parsed.schema["__j"].dataType[n].dataType))
        cells.append(c.alias(n))
    return parsed.select(*(c for c in df.columns if c != column), *cells)


def decoded(df: DataFrame, name: Column, content: str, decoders: list[tuple[str, Callable[[Column], Column]]], into: str = "value") -> DataFrame:
    """df with `into`: the first decoder whose suffix pattern fits the name; null where none does."""
    out = F.lit(None)
    for pattern, decode in reversed(decoders):
        out = F.when(name.rlike(pattern), decode(F.col(content))).otherwise(out)
    return df.withColumn(into, out)


def gzipped(content: Column) -> Column:
    """Bytes as gzip; equal bytes give equal output."""

    @F.pandas_udf("binary")
    def run(column):
        return column.map(lambda x: None if x is None else gzip.compress(x, 6, mtime=0))

    return run(content)


def gunzipped(content: Column) -> Column:
    @F.pandas_udf("binary")
    def run(column):
        return column.map(lambda x: None if x is None else gzip.decompress(x))

    return run(content)


#: What fields hold by their suffix, as strings: texts, class numbers and JSON.
BASIC = [
    (r"\.(txt|text|transcript|json|jsn)$", lambda c: F.decode(c, "UTF-8")),
    (r"\.(cls|cls2|class|count|index|inx|id)$", lambda c: F.decode(c, "UTF-8").try_cast("long").cast("string")),
]


def decoded_chain(df: DataFrame, name: str, content: str, handlers: list, post: list | None = None, only: list[str] | None = None, into: str = "value") -> DataFrame:
    """df with `into`: what the first handler that knows a field's suffix makes of it.

    Before them, gzip is undone and the name goes on without .gz; after them come the basic ones. What none
    knows, and what is not in `only`, keeps its bytes in `content`; the rest has null there.
    """
    own = F.regexp_extract(name, r"^[^.]*\.(.*)$", 1)
    asked = own.isin(only) if only is not None else F.lit(True)
    zipped = asked & F.col(name).endswith(".gz")
    rows = df.withColumn("__zip", zipped)
    plain = rows.where(~F.col("__zip")).withColumn("__data", F.col(content))
    rows = plain.unionByName(rows.where("__zip").withColumn("__data", gunzipped(F.col(content))))
    bare = F.when(F.col("__zip"), F.regexp_replace(name, r"\.gz$", "")).otherwise(F.col(name))
    value = F.lit(None).cast("string")
    for pattern, decode in reversed([*handlers, *(BASIC if post is None else post)]):
        value = F.when(asked & bare.rlike(pattern), decode(F.col("__data"))).otherwise(value)
    rows = rows.withColumn(into, value)
    return rows.withColumn(content, F.when(F.col(into).isNull(), F.col("__data"))).drop("__zip", "__data")


def flat_tags(root: Column, blocks: Column) -> Column:
    """Tags of an image as one map: those of named blocks (map of maps) as block/tag, behind those at the root."""
    entries = F.flatten(F.transform(F.map_entries(blocks), lambda b: F.transform(F.map_entries(F.coalesce(b["value"], F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(b["key"], F.lit("/"), e["key"]).alias("key"), e["value"].alias("value")))))
    return F.map_from_entries(F.concat(F.map_entries(root), entries))


def parallel(df: DataFrame) -> DataFrame:
    """df with the partition that holds each row: the rank of a worker, as far as Spark has one."""
    return df.withColumn("rank", F.spark_partition_id())
