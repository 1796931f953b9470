"""Differences between two tables or two sets of named tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def family(t) -> str:
    return "number" if isinstance(t, NumericType) else t.typeName()


def known(c: Column, t) -> Column:
    """c with NaN as null."""
    return F.when(~F.isnan(c), c) if t.typeName() in ("float", "double") else c


def differences(left: DataFrame, right: DataFrame, keys: list[str], rtol: float = 1e-5, atol: float = 1e-8, na_equal: bool = True, coerce_numeric: bool = False) -> DataFrame:
    """Rows (keys, column, left, right, kind) where two tables differ; none if they are equal.

    Kinds: `left only` and `right only` for keys of one side, `value` where cells differ, `na` where one
    is null. Numbers are equal within atol + rtol * abs(right). Null and NaN are one; two of them are equal
    if na_equal. Columns of different type families never are, unless coerce_numeric makes both numbers
    (what can't be parsed is null). Columns of one side alone are in `column_differences`.
    """
    common = [c for c in left.columns if c in right.columns and c not in keys]
    name = lambda c, side: f"__{side}_{c}"
    a = left.select(*keys, *(F.col(c).alias(name(c, "l")) for c in common), F.lit(True).alias("__in_l"))
    b = right.select(*keys, *(F.col(c).alias(name(c, "r")) for c in common), F.lit(True).alias("__in_r"))
    both = a.join(b, keys, "full")
    here, there = F.col("__in_l").isNotNull(), F.col("__in_r").isNotNull()
    none = F.lit(None).cast("string")
    alone = F.struct(none.alias("column"), none.alias("left"), none.alias("right"), F.when(~there, "left only").otherwise("right only").alias("kind"))
    cells = [F.when(~(here & there), alone)]
    for c in common:
        tl, tr = left.schema[c].dataType, right.schema[c].dataType
        x, y = F.col(name(c, "l")), F.col(name(c, "r"))
        if coerce_numeric:
            x, y = x.try_cast("double"), y.try_cast("double")
            numeric = True
            x, y = F.when(~F.isnan(x), x), F.when(~F.isnan(y), y)
        else:
            x, y = known(x, tl), known(y, tr)
            numeric = family(tl) == family(tr) == "number"
        if numeric:
            same = (F.abs(x.cast("double") - y.cast("double")) <= atol + rtol * F.abs(y.cast("double"))) | (x == y)
        elif family(tl) == family(tr):
            same = x == y
        else:
            same = F.lit(False)
        neither = x.isNull() & y.isNull()
        one = x.isNull() != y.isNull()
        kind = F.when(neither, F.lit(None if na_equal else "value")).when(one, "na").when(~same, "value")
        cells.append(F.when(here & there & kind.isNotNull(), F.struct(F.lit(c).alias("column"), F.col(name(c, "l")).cast("string").alias("left"), F.col(name(c, "r")).cast("string").alias("right"), kind.alias("kind"))))
    return both.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("__d")).select(*keys, "__d.*")


def reindexed(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with a row for each key of either table; what df lacks is null. Keys of df are expected to be unique."""
    union = df.select(keys).unionByName(other.select(keys)).distinct()
    return union.join(df, keys, "left")


def column_differences(left: DataFrame, right: DataFrame) -> list[tuple[str, str]]:
    """(column, what) for columns of one side alone and for differing types; schemas only, nothing is read."""
    l, r = dict(left.dtypes), dict(right.dtypes)
    out = [(c, "left only") for c in l if c not in r] + [(c, "right only") for c in r if c not in l]
    return out + [(c, f"type {l[c]} and {r[c]}") for c in l if c in r and l[c] != r[c]]


def state_differences(left: DataFrame, right: DataFrame, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """name, problem, max_diff for tensors (name, shape array<int>, values array) that differ.

    Both limits must hold: the largest difference within atol, and within rtol times the largest right value.
    """
    a = left.select("name", F.col("shape").alias("ls"), F.col("values").alias("lv"))
    b = right.select("name", F.col("shape").alias("rs"), F.col("values").alias("rv"))
    both = a.join(b, "name", "full")
    diff = F.array_max(F.filter(F.zip_with("lv", "rv", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: ~F.isnan(d)))
    big = F.array_max(F.filter(F.transform("rv", lambda y: F.abs(y.cast("double"))), lambda d: ~F.isnan(d)))
    rows = both.withColumn("max_diff", F.when(F.col("ls") == F.col("rs"), diff))
    problem = (
        F.when(F.col("rs").isNull(), "left only").when(F.col("ls").isNull(), "right only").when(F.col("ls") != F.col("rs"), "shape")
        .when((F.col("max_diff") > atol) & (F.col("max_diff") > rtol * big), "both").when(F.col("max_diff") > atol, "absolute").when(F.col("max_diff") > rtol * big, "relative")
    )
    return rows.select("name", problem.alias("problem"), "max_diff").where("problem is not null")


def set_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, n: distinct keys of the left alone, of both and of the right alone."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("r").isNull(), "left only").when(F.col("l").isNull(), "right only").otherwise("both")
    return a.join(b, key, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))
