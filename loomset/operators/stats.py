"""Descriptive statistics, histograms and parameter reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.plans.lineage import materialised


def number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """column, quantiles: exact ones, interpolated between neighbours; null and NaN don't count.

    Values are counted, dealt into ranges, and ranks are counted on from range to range: no task holds
    more than a range of distinct values. A column without values has no row.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns))
    counts = df.select(F.inline(cells)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    # ranges are drawn from a sample: they are fixed before ranks are counted
    dealt = materialised(counts.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("column", "part").agg(F.sum("n").alias("m"))
    starts = starts.select("column", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), F.sum("m").over(Window.partitionBy("column")).alias("total"))
    inside = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("upto", F.sum("n").over(inside)).join(starts, ["column", "part"])
    stop = F.col("start") + F.col("upto")
    at = lambda k: F.max(F.when((stop - F.col("n") <= k) & (k < stop), F.col("value")))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    found = ranked.groupBy("column", "total").agg(*(f(place(p)).alias(f"{side}{i}") for i, p in enumerate(shares) for side, f in (("lo", lambda x: at(F.floor(x))), ("hi", lambda x: at(F.ceil(x))))))
    values = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (place(p) - F.floor(place(p))) for i, p in enumerate(shares)]
    return found.select("column", F.array(*values).alias("quantiles"))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std (sample), min, quartiles (exact, interpolated) and max; null and NaN don't count."""
    stats = []
    for c in columns:
        x = number(c)
        stats.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")))
    rows = df.agg(F.array(*stats).alias("s")).select(F.inline("s")).join(quantiles(df, columns, [0.25, 0.5, 0.75]), "column", "left")
    q = [F.col("quantiles")[i].alias(f"q{s}") for i, s in enumerate((25, 50, 75))]
    return rows.select("column", "count", "mean", "std", "min", *q, "max")


def chunked_mean(df: DataFrame, column: str, position: str, size: int = 10_000) -> DataFrame:
    """Mean from partial sums over chunks of positions; no rows give null."""
    parts = df.groupBy(F.floor(F.col(position) / size).alias("chunk")).agg(F.sum(column).alias("s"), F.count(column).alias("n"))
    return parts.agg((F.sum("s") / F.sum("n")).alias("mean"))


def tensor_stats(df: DataFrame, values: str = "values") -> DataFrame:
    """Mean and sample deviation over the elements of all tensors."""
    return df.select(F.explode(values).alias("v")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def elements(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda n, d: n * d)


def count_params(df: DataFrame, shape: str = "shape", flag: str = "requires_grad") -> DataFrame:
    """total, trainable and frozen element counts; each is 0 where there is none."""
    n = elements(F.col(shape))
    zero = F.lit(0).cast("long")
    return df.agg(F.coalesce(F.sum(n), zero).alias("total"), F.coalesce(F.sum(F.when(F.col(flag), n)), zero).alias("trainable"), F.coalesce(F.sum(F.when(~F.col(flag), n)), zero).alias("frozen"))


def grouped_params(df: DataFrame, name: str = "name", data: str = "data", position: str = "position", conflict: str | None = None) -> DataFrame:
    """label, data, n, first_position: parameters that differ only in the first number of their names, as one row `a[0-11].b`.

    Names without a number stay alone and come last; groups come in order of first appearance. With
    `conflict`, a column that must agree within a group: if it does not, the query fails.
    """
    n = F.col(name)
    pattern = r"(?s)^(\D*)(\d+)(.*)$"
    digits = n.rlike(r"\d")
    rows = df.select(F.when(digits, F.regexp_extract(n, pattern, 1)).otherwise(n).alias("prefix"), F.when(digits, F.regexp_extract(n, pattern, 2).cast("long")).alias("number"), F.when(digits, F.regexp_extract(n, pattern, 3)).otherwise("").alias("suffix"), F.when(~digits, F.col(position)).alias("alone"), F.col(data).alias("data"), F.col(position).alias("p"), (F.col(conflict) if conflict else F.lit(None)).alias("c"))
    agg = rows.groupBy("prefix", "suffix", "data", "alone").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("*").alias("n"), F.min("p").alias("first_position"), F.count_distinct("c").alias("kinds"))
    label = F.when(F.col("lo").isNull(), F.col("prefix")).when(F.col("n") > 1, F.concat("prefix", F.lit("["), F.col("lo"), F.lit("-"), F.col("hi"), F.lit("]"), "suffix")).otherwise(F.concat("prefix", F.col("lo"), "suffix"))
    checked = F.when(F.col("kinds") > 1, F.raise_error(F.concat(F.lit("data mismatch in "), label))).otherwise(label)
    return agg.select(checked.alias("label"), "data", "n", "first_position").orderBy(F.col("label").rlike(r"\d").desc(), "first_position")


def param_report(df: DataFrame, group: str = "group_name", shape: str = "shape") -> DataFrame:
    """group_name, n_params: a subtotal for each group and a grand total (null group)."""
    return df.rollup(group).agg(F.sum(elements(F.col(shape))).cast("long").alias("n_params"), F.grouping(group).alias("is_total"))


def checked_ratios(df: DataFrame, ratio: str) -> DataFrame:
    r = F.col(ratio).cast("double")
    bad = r.isNull() | F.isnan(r) | (r <= 0) | (r == float("inf"))
    return df.select(F.when(bad, F.raise_error(F.lit("ratios must be finite and positive"))).otherwise(r).alias("r"))


def ratio_histogram(df: DataFrame, ratio: str, bins: int = 50) -> DataFrame:
    """side (left, right, center), bin, n: a histogram mirrored around 1, empty bins included.

    Each side has bins // 2 equal bins, from 1 / bound to 1 and from 1 to bound; the last is closed.
    Ratios within tolerance of 1 count in the centre too. No rows at all fail.
    """
    side = max(bins // 2, 1)
    rows = checked_ratios(df, ratio)
    bound = rows.agg(F.greatest(F.max("r"), F.max(1 / F.col("r"))).alias("bound"))
    bound = bound.select(F.when(F.col("bound").isNull(), F.raise_error(F.lit("no ratios"))).when(F.abs(F.col("bound") - 1) <= 1e-8 + 1e-5, 1.001).otherwise(F.col("bound")).alias("bound"))
    r, b = F.col("r"), F.col("bound")
    place = lambda low, high: F.least(F.floor((r - low) / ((high - low) / side)), F.lit(side - 1)).cast("int")
    where = F.when(r < 1, F.struct(F.lit("left").alias("side"), place(1 / b, F.lit(1.0)).alias("bin"))).when(r > 1, F.struct(F.lit("right").alias("side"), place(F.lit(1.0), b).alias("bin")))
    centre = F.when(F.abs(r - 1) <= 1e-8 + 1e-5, F.struct(F.lit("center").alias("side"), F.lit(0).alias("bin")))
    counted = rows.join(F.broadcast(bound)).select(F.explode(F.array_compact(F.array(where, centre))).alias("w")).groupBy("w.side", "w.bin").agg(F.count("*").alias("n"))  # bound is one row
    grid = df.sparkSession.sql(f"SELECT s AS side, b AS bin FROM (SELECT explode(array('left', 'right')) AS s), (SELECT explode(sequence(0, {side - 1})) AS b) UNION ALL SELECT 'center', 0")
    return grid.join(counted, ["side", "bin"], "left").select("side", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, low, high, n, density: equal bins from minimum to maximum, the last closed; null and NaN don't count."""
    rows = df.select(number(column).alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "total")
    ends = ends.withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    bin_of = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counted = rows.join(F.broadcast(ends)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))  # ends is one row
    grid = ends.where("total > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return grid.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), n.alias("n"), (n / (F.col("total") * F.col("w"))).alias("density"))


def kernel_density(df: DataFrame, column: str, points: list[float], bandwidth: float) -> DataFrame:
    """point, density: a Gaussian kernel estimate at stated points, as one pass of sums."""
    x = number(column)
    norm = bandwidth * (2 * 3.141592653589793) ** 0.5
    sums = [F.struct(F.lit(p).alias("point"), (F.sum(F.exp(-0.5 * ((x - p) / bandwidth) * ((x - p) / bandwidth))) / (F.count(x) * norm)).alias("density")) for p in points]
    return df.agg(F.array(*sums).alias("s")).select(F.inline("s"))


def device_summary(df: DataFrame, memory: str, load: str, temperature: str) -> DataFrame:
    """Sum of memory and means of load and temperature over devices, with a summary line."""
    agg = df.agg(F.sum(memory).alias("memory"), F.avg(load).alias("load"), F.avg(temperature).alias("temperature"))
    return agg.select("*", F.format_string("mem %.1f load %.1f temp %.1f", "memory", "load", "temperature").alias("line"))
