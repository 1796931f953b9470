"""Similarities of all rows with a query set, by blocks."""

import math

import numpy as np
import pyarrow as pa
import pytest
from loomset.functions import arrays
from loomset.plans import catalog
from pyspark.sql import functions as F


def test_blocks_nulls_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK", 7)
    vectors = [[float((i * k) % 11 - 5) for k in range(1, 4)] for i in range(40)] + [None, [1.0, None, 2.0], [1.0, 2.0], [], [0.0, 0.0, 0.0], [math.nan, 1.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>")
    got = {(r.left_id, r.right_id): r.similarity for r in arrays.cosine_matrix(df, df.where("id % 3 <> 1"), "id", "id", "v").collect()}
    unit = df.select("id", arrays.unit(F.col("v")).alias("u"))
    want = unit.alias("a").crossJoin(unit.where("id % 3 <> 1").alias("b")).select(F.col("a.id"), F.col("b.id"), arrays.dot(F.col("a.u"), F.col("b.u"))).collect()
    assert len(got) == len(want) == 46 * 31
    for i, j, x in want:
        y = got[i, j]
        assert (x is None) == (y is None) and (x is None or math.isnan(x) and math.isnan(y) or abs(x - y) < 1e-12), (i, j, x, y)


def test_pairs_are_not_worked_out_one_by_one(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<float>")
    plan = arrays.cosine_matrix(df, df, "id", "id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert arrays.cosine_matrix(df.limit(0), df, "id", "id", "v").collect() == []


def test_query_holds_each_row_with_each(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    place = {r.vec_id: k for k, r in enumerate(e)}
    x = np.array([r.embedding for r in e], float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    got = catalog.QUERIES["math2_cosine"](spark, sf).toArrow()
    at = [[place[k] for k in got[c].to_pylist()] for c in ("left_id", "right_id")]
    assert got.num_rows == len(set(zip(*at, strict=True))) == len(e) ** 2
    assert np.abs(got["similarity"].to_numpy() - (x @ x.T)[at[0], at[1]]).max() < 5.1e-7


def test_rounded(spark):
    values = [(0.0078125, 0.007813), (-0.0078125, -0.007813), (0.1234564, 0.123456), (-0.9999999, -1.0), (1.0, 1.0), (-1e-9, 0.0), (None, None), (math.nan, math.nan)]
    for r in spark.createDataFrame(values, "x double, want double").withColumn("y", arrays.rounded(F.col("x"), 6)).collect():
        assert r.y == r.want if r.want is None else r.y == pytest.approx(r.want, abs=0, rel=0, nan_ok=True), r


def test_long_vectors_small_ones_and_infinities(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e-12, 0.0]), (3, [3.0, 4.0]), (4, [math.inf, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    unit = df.select("id", arrays.unit(F.col("v")).alias("u"))
    want = unit.alias("a").crossJoin(unit.alias("b")).select(F.col("a.id"), F.col("b.id"), arrays.dot(F.col("a.u"), F.col("b.u"))).collect()
    got = {(r.left_id, r.right_id): r.similarity for r in arrays.cosine_matrix(df, df, "id", "id", "v").collect()}
    assert len(got) == 16
    for i, j, x in want:
        assert got[i, j] == pytest.approx(x, nan_ok=True), (i, j, x)


def test_ids_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK", 7)
    df = spark.createDataFrame([(None if k % 2 else 5, [float(k % 13 - 6), float(k % 5 + 1)]) for k in range(50)], "id long, v array<float>")
    got = arrays.cosine_matrix(df, df, "id", "id", "v").groupBy("left_id", "right_id").agg(F.count("similarity").alias("n"), F.sum("similarity").alias("s")).collect()
    sums = {i: sum(np.array([r.v]) / np.linalg.norm(r.v) for r in df.collect() if r.id == i)[0] for i in (None, 5)}
    assert {(r.left_id, r.right_id): r.n for r in got} == {(i, j): 625 for i in sums for j in sums}
    for r in got:
        assert r.s == pytest.approx(sums[r.left_id] @ sums[r.right_id]), r


def test_vectors_are_written_once_and_not_shuffled_to_each_other(spark, monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK", 8)
    monkeypatch.setattr(arrays, "SIDE", 3)
    df = spark.range(100).repartition(9).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    out = arrays.cosine_matrix(df, df.where("id < 50"), "id", "id", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert len({(r.left_id, r.right_id) for r in out.collect()}) == out.count() == 5000
    sizes = [pa.ipc.open_stream(r.block).read_all().num_rows for r in arrays.blocks(df).collect()]
    assert sum(sizes) == 100 and max(sizes) <= 16
