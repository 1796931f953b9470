"""Ranks, top-k over logits, positions, retention and deterministic shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.functions import arrays
from loomset.plans.lineage import materialised


def top_classes(df: DataFrame, key: str, logits: str, names: str, true_id: str | None = None, k: int = 5, temp: float = 1.0) -> DataFrame:
    """key, rank, class_index, prob, name: the k likeliest classes of each row, and the true class if it is not among them.

    Ties go to the smaller class index. Rows are ranked within their own array: there is no shuffle.
    """
    probs = arrays.softmax(F.col(logits), temp)
    ranked = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.alias("i"))))
    each = df.select(F.col(key), F.col(names).alias("__names"), (F.col(true_id) if true_id else F.lit(None)).cast("int").alias("__true"), F.posexplode(ranked).alias("__pos", "__r"))
    rank = F.col("__pos") + 1
    keep = (rank <= k) | (F.col("__r.i") == F.col("__true"))
    return each.where(keep).select(key, rank.alias("rank"), F.col("__r.i").alias("class_index"), (-F.col("__r.neg")).alias("prob"), F.element_at("__names", F.col("__r.i") + 1).alias("name"))


def positioned(df: DataFrame, order: list[str], into: str = "position") -> DataFrame:
    """Rows numbered from 0 in a global order, without a single-task window.

    Rows are dealt into ranges of the order, as many as the session's shuffles have partitions; each
    range is numbered, and starts where the counts of the ranges before it end.
    """
    # ranges are drawn from a sample: they are fixed before rows are counted and numbered
    dealt = materialised(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    edges = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = edges.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = dealt.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    return numbered.join(starts, "__part").withColumn(into, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")


def smoothed(df: DataFrame, key: str, order: list[str], value: str, decay: float = 0.9) -> DataFrame:
    """key, ema: the exponential moving average of each key's values in order, at its end; the first value seeds it.

    The average is a sum: each value counts by its place from the end. Places come from a global numbering,
    so a key of any size is summed in parts. Null values count as rows but add nothing.
    """
    rows = positioned(df.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.col(value).cast("double").alias("__v")), ["__key", *(f"__o{i}" for i in range(len(order)))], "__p")
    ends = rows.groupBy("__key").agg(F.min("__p").alias("__first"), F.max("__p").alias("__last"))
    both = rows.join(ends.withColumnRenamed("__key", "__of"), F.col("__key").eqNullSafe(F.col("__of")))
    weight = F.pow(F.lit(decay), F.col("__last") - F.col("__p")) * F.when(F.col("__p") == F.col("__first"), 1.0).otherwise(1.0 - decay)
    return both.groupBy(F.col("__key").alias(key)).agg(F.sum(weight * F.col("__v")).alias("ema"))


def retained(df: DataFrame, time: str, order: list[str], newest: int, seconds: float | None = None, now=None) -> DataFrame:
    """The newest rows, newest first, without those older than `seconds` before now (a timestamp literal)."""
    rows = df if not seconds else df.where(F.col(time) >= F.lit(now) - F.make_dt_interval(secs=F.lit(seconds)))
    return rows.orderBy(F.col(time).desc(), *(F.col(c).desc() for c in order)).limit(newest)


def shuffle_key(key: str, seed: int = 0, epoch: int = 0):
    """A hash that orders rows at random: equal for equal seed and epoch, whatever the partitions are."""
    return F.xxhash64(F.col(key), F.lit(seed + epoch))


def shuffled(df: DataFrame, key: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Rows in a random order that only key, seed and epoch decide."""
    return df.orderBy(shuffle_key(key, seed, epoch), key)


def batches(df: DataFrame, order: str, size: int, columns: list[str]) -> DataFrame:
    """batch, and an array of each column: rows in order, `size` to a batch."""
    rows = positioned(df.select(order, *[c for c in columns if c != order]), [order], "__p").withColumn("batch", F.floor(F.col("__p") / size))
    packed = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("__p", *columns))).alias("__rows"))
    return packed.select("batch", *(F.col(f"__rows.{c}").alias(c) for c in columns))
