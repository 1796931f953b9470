"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every source has a weight, and a target: its weight's share of all words, at most `most` times its own
words, the excess going to the other sources by weight. A target that holds whole epochs of its source
takes all of the source's documents that often; the rest of it is a weighted sample without
replacement: document i gets the key -ln(u_i) / q_i, with u_i uniform by hash of seed, id and text and
q_i the document's quality weight, and the documents of smallest keys are taken until their words fill
the rest. The document at the edge is taken if that brings the sum nearer to the target.

A source may hold a third of all rows: its n keys are dealt into about sqrt(n) buckets, summed before any
shuffle; only the bucket in which the target's edge falls is sorted, by distinct keys. What leaves is one
row per source: epochs, the edge's key and how many documents of just that key are taken.
These rows are sent to all tasks where they are few (`BROADCAST`, counted first), else dealt with a salt.

Rows of the same id and text have one key. They stand together in a source's order and are taken one by
one: where the edge falls among them, they are counted off by the partition they are in.

Null text: size 0. Null ids are ids like others. Null source: a source of its own, the last. An empty
table gives no rows. Extra columns are carried by `mixed` alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.cluster import cut

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    weights: tuple = (1, 2, 3)  # of the sources in code point order, repeating
    most: int = 3  # times its own size that a source, and so a document, is taken at most
    rows: int = 100  # documents in a bucket of keys at least, about; and as many as there are buckets
    seed: int = 8


#: Sources whose plan is sent to all tasks at most; more are dealt out with SALT.
BROADCAST, SALT = 20_000, 64


def quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: ordinary mean word lengths (6 characters with the space), words that begin with a letter,
    and enough of them to be prose (50 words have two thirds of the full weight)."""
    words = F.greatest(size, F.lit(1))
    length = 1.0 / (1.0 + F.abs(F.log(F.greatest(F.length(text) / words, F.lit(0.5)) / 6.0)))
    letters = F.regexp_count(text, F.lit(r"(?:^|[\x20\x09-\x0D])\p{L}")) / words
    return length * (0.1 + 0.9 * F.least(letters, F.lit(1.0))) * (1.05 - F.exp(-size / 50.0))


def sample_key(doc_id: Column, text: Column, weight: Column, mix: Mix) -> Column:
    """The exponential key: equal in every run and every partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), doc_id, text), 11)
    return -F.log((bits + 0.5) / float(1 << 53)) / weight


def measured(documents: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """documents with __loom_size, __loom_key and __loom_source."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = documents.withColumn("__loom_size", F.regexp_count(t, F.lit(WORD)).cast("long")).withColumn("__loom_source", F.col(source))
    return df.withColumn("__loom_key", sample_key(F.col(key), t, quality(t, F.col("__loom_size")), mix))


def of_sources(rows: DataFrame, of: DataFrame, source: str, few: bool) -> DataFrame:
    """rows joined with `of`, which has one row for each source in its column `of`; a large source's rows meet in no single task."""
    if few:
        return rows.join(F.broadcast(of), F.col(source).eqNullSafe(F.col("of"))).drop("of")
    salted = of.withColumn("__loom_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = rows.withColumn("__loom_deal", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    return dealt.join(salted, F.col(source).eqNullSafe(F.col("of")) & (F.col("__loom_deal") == F.col("__loom_salt"))).drop("of", "__loom_salt", "__loom_deal")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size, n, target. sources: source, source_size, n; one row for each source."""
    alone = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    df = sources.withColumn("weight", F.element_at(weights, (F.row_number().over(alone) - 1) % len(mix.weights) + 1)).withColumn("cap", (F.col("source_size") * mix.most).cast("double"))
    everything = Window.partitionBy()
    # a source is above its cap if the share of what sources of smaller cap per weight leave is
    tight = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(tight), F.lit(0.0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(tight), F.lit(0.0)))
    df = df.withColumn("share", share).withColumn("free", F.col("cap") >= F.col("share") * F.col("weight"))
    level = F.min_by(F.when(F.col("free"), F.col("share")), F.when(F.col("free"), F.col("cap") / F.col("weight"))).over(everything)
    return df.withColumn("level", level).select("source", "source_size", "n", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def plan(rows: DataFrame, mix: Mix) -> tuple[DataFrame, bool]:
    """One row for each source, and whether they are few: of (the source), source_size, target, epochs, and the edge of what is
    taken once more: documents of smaller (edge, edge_size), and `copies` of the edge_n of just that key and size. rows: source, size, key."""
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), mix))
    few = sources.count() <= BROADCAST
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    s = sources.where("rest > 0").select(F.col("source").alias("of"), F.ceil(F.least(F.col("n") / mix.rows, F.sqrt("n"))).alias("buckets"), "rest")
    bucket = F.floor(F.col("buckets") * (1 - F.exp(-F.col("key")))).cast("long")
    dealt = of_sources(rows, s, "source", few).select("source", "size", "key", "rest", bucket.alias("bucket"))
    sums = dealt.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    edge = cut(sums.where("words > 0 and before <= rest and rest < before + words").select(F.col("source").alias("of"), F.col("bucket").alias("at"), "before"))
    inside = of_sources(dealt, edge, "source", few).where("bucket = at").groupBy("source", "rest", "before", "key", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("ahead", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(w), F.lit(0)))
    edges = inside.where("ahead <= rest and rest < ahead + size * n").select(F.col("source").alias("edge_of"), F.col("key").alias("edge"), F.col("size").alias("edge_size"), "n", F.floor((F.col("rest") - F.col("ahead")) / F.col("size") + 0.5).alias("copies")).withColumnRenamed("n", "edge_n")
    out = sources.join(edges, F.col("source").eqNullSafe(F.col("edge_of")), "left")
    return cut(out.select(F.col("source").alias("of"), "source_size", "target", "epochs", F.coalesce("edge", F.lit(-1.0)).alias("edge"), F.coalesce("edge_size", F.lit(0)).alias("edge_size"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("edge_n", F.lit(0)).alias("edge_n"))), few


def timed(rows: DataFrame, of: DataFrame, few: bool, source: str, size: str, key: str) -> DataFrame:
    """rows with the columns of their source's plan and __loom_times: how often each is taken."""
    rows = of_sources(rows, of, source, few)
    tie = (F.col(key) == F.col("edge")) & (F.col(size) == F.col("edge_size"))
    less = (F.col(key) < F.col("edge")) | (F.col(key) == F.col("edge")) & (F.col(size) < F.col("edge_size"))
    if of.where("copies > 0 and copies < edge_n").isEmpty():  # of the rows at an edge, all or none are taken
        return rows.withColumn("__loom_times", F.col("epochs") + (less | tie & (F.col("copies") > 0)).cast("int"))
    out = rows.where(~tie).withColumn("__loom_times", F.col("epochs") + less.cast("int"))
    # rows at the edge are equal but for what is not mixed by: they are numbered within partitions, and partitions by their counts
    tied = cut(rows.where(tie)).withColumn("__loom_at", F.spark_partition_id())
    counts = tied.groupBy(F.col(source).alias("of"), F.col("__loom_at").alias("__loom_in")).agg(F.count("*").alias("__loom_n"))
    w = Window.partitionBy("of").orderBy("__loom_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("of", "__loom_in", F.coalesce(F.sum("__loom_n").over(w), F.lit(0)).alias("__loom_start"))
    number = F.row_number().over(Window.partitionBy(source, "__loom_at").orderBy(key))
    tied = tied.withColumn("__loom_number", number).join(starts, F.col(source).eqNullSafe(F.col("of")) & (F.col("__loom_at") == F.col("__loom_in")))
    tied = tied.withColumn("__loom_times", F.col("epochs") + (F.col("__loom_start") + F.col("__loom_number") <= F.col("copies")).cast("int"))
    return out.unionByName(tied.select(out.columns))


def report(documents: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs, key for each document."""
    rows = measured(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")), mix)
    rows = cut(rows.select("doc_id", "source", F.col("__loom_size").alias("size"), F.col("__loom_key").alias("key")))
    rows = timed(rows, *plan(rows, mix), "source", "size", "key")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("__loom_times")).cast("long").alias("taken"), "epochs", "key")


def mixed(documents: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken."""
    names = documents.columns
    own = [f"__loom_{i}" for i in range(len(names))]
    named = dict(zip(names, own))
    rows = measured(documents.select(*(F.col(n).alias(o) for n, o in zip(names, own))), mix, named[key], named[text], named[source])
    small = cut(rows.select(F.col("__loom_source").alias("source"), F.col("__loom_size").alias("size"), F.col("__loom_key").alias("key")))
    rows = timed(rows, *plan(small, mix), "__loom_source", "__loom_size", "__loom_key")
    return rows.where("__loom_times > 0").withColumn("__loom_copy", F.explode(F.sequence(F.lit(1), F.col("__loom_times")))).select(*(F.col(o).alias(n) for n, o in zip(names, own)))
