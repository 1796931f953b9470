"""Buffered shuffles and throttled calls against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomset.operators import buffers, throttle
from loomset.operators.buffers import Buffer, shuffled_shards
from loomset.operators.throttle import throttled

CALLS = "key string, t timestamp, id long"
DAY = 1_700_000_000


def plain_runs(rows, seconds):
    last, out = {}, []
    for key, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] or "", r[1], r[2])):
        if key not in last or t - last[key] >= seconds:
            last[key] = t
            out.append(i)
    return sorted(out)


def frame(spark, rows, parts=4):
    import datetime

    stamp = lambda t: None if t is None else datetime.datetime.fromtimestamp(DAY + t, datetime.UTC)
    return spark.createDataFrame([(k, stamp(t), i) for k, t, i in rows], CALLS).repartition(parts)


@pytest.mark.parametrize("seconds", [1, 7, 60, 5000])
def test_throttle(spark, seconds):
    rnd = random.Random(seconds)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", "c", None]), rnd.choice([rnd.randrange(3000), rnd.randrange(100) * 30, None]), i) for i in range(1500)]
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert sorted(r.id for r in throttled(frame(spark, rows), "key", "t", "id", seconds).collect()) == plain_runs(rows, seconds)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", keep)


def test_throttle_edges(spark):
    assert throttled(frame(spark, []), "key", "t", "id", 5).collect() == []
    rows = [(None, 3, 1), (None, 3, 2), ("null", 3, 3), ("x", None, 4)]
    out = throttled(frame(spark, rows).selectExpr("key", "t", "id", "id as part", "key as head"), "key", "t", "id", 5)
    assert out.columns == ["key", "t", "id", "part", "head"] and sorted(r.id for r in out.collect()) == [1, 3]
    assert throttled(frame(spark, rows), "key", "t", "id", 0).count() == 3


def test_step_functions_compose():
    """A range's function gives the last run for every time at which its key may run again."""
    rnd = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        times = np.sort(rnd.integers(0, 1000, n))
        until, last = throttle.step_function(times, 60)
        for again in range(int(times[0]) - 5, int(times[0]) + 60):
            runs, _ = throttle.marked(times, again, 60)
            i = np.searchsorted(until, again)
            assert (i == len(last) and not runs) or times[runs[-1]] == last[i]


def plain_buffer(stream, buffer, worker):
    """The buffer as a list of rows."""
    seed, held, step, out, it = buffer.seed + buffer.epoch + 1000 * worker, [], 0, [], iter(stream)

    def give():
        nonlocal step
        at = buffers.drawn(seed, step, len(held))
        step += 1
        held[at], held[-1] = held[-1], held[at]
        out.append(held.pop())

    for row in it:
        held.append(row)
        if len(held) < buffer.full:
            held.extend(x for x in [next(it, None)] if x is not None)
        if len(held) >= buffer.initial:
            give()
    while held:
        give()
    return out


def plain_shuffle(rows, buffer):
    import hashlib

    shards = sorted({s for s, _, _ in rows}, key=lambda s: (hashlib.md5(f"{buffer.seed + buffer.epoch}:{s if s is not None else ''}".encode()).hexdigest(), s is not None, s or 0))
    out = {}
    for w in range(buffer.workers):
        stream = [r for s in shards[w :: buffer.workers] for r in sorted((x for x in rows if x[0] == s), key=lambda x: x[1])]
        if stream:
            out[w] = [x[2] for x in plain_buffer(stream, buffer, w)]
    return out


@pytest.mark.parametrize("buffer", [Buffer(3, 5, 20, 1, 2), Buffer(2, 1, 1), Buffer(1, 40, 1000, 9), Buffer(30, 3, 4, 0, 1)])
def test_buffer(spark, buffer):
    rows = [(s, i, 1000 * (s or 0) + i) for s in [*range(11), None] for i in range(0 if s == 4 else 17 * (s or 1))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "shard long, at long, value long, worker string").repartition(5)
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {}
            for r in shuffled_shards(df.drop("worker"), "shard", "at", buffer).collect():
                got.setdefault(r.worker, []).append((r.step, r.value))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
        assert {w: [v for _, v in x] for w, x in got.items()} == plain_shuffle(rows, buffer)
        assert all([s for s, _ in x] == list(range(len(x))) for x in got.values())


def test_buffer_is_bounded():
    held = []

    def batches():
        for i in range(50):
            held.append(pa.total_allocated_bytes())
            yield pa.record_batch([pa.array([0] * 1000), pa.array([b"x" * 1000] * 1000)], names=["worker", "data"])

    n = sum(b.num_rows for b in buffers.runner(Buffer(1, 100, 500))(batches()))
    assert n == 50_000 and max(held) < 8_000_000


def test_no_order(spark):
    df = spark.createDataFrame([], "shard long, at long")
    assert shuffled_shards(df, "shard", "at").collect() == []
    for bad in (Buffer(seed=-1), Buffer(initial=10, full=5)):
        with pytest.raises(ValueError):
            shuffled_shards(df, "shard", "at", bad)
