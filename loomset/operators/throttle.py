"""Calls of a task that may run at most every so often: which of them run.

A call runs if no run of its key was less than the interval before it, so each run decides on the next. Calls are
dealt into ranges of (key, time), whatever keys are large, and each range is one task:

1. A range's first key may go on from the range before. What it does to that key is a function: from the time at
   which the key may run again to the time of its last run here. The function is a step function with a step for
   each chain of runs that a call of the first interval can begin; links to the next call that may run are found by
   binary search, chains by pointer doubling.
2. The functions are followed from range to range: that is one row for each range.
3. Knowing when its first key may run again, each range marks its runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.plans.lineage import materialised

STEPS = "part int, head string, tail string, until array<long>, last array<long>, tail_again long"


def segments(keys: pa.Array) -> list[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    if not len(keys):
        return []
    edges = (np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()
    return list(zip([0, *edges], [*edges, len(keys)]))


def marked(times: np.ndarray, again: int | None, every: int) -> tuple[list[int], int]:
    """Positions of the runs among ascending times of one key that may run again at `again`, and when it may then."""
    runs, i = [], 0 if again is None else int(np.searchsorted(times, again))
    while i < len(times):
        runs.append(i)
        again = int(times[i]) + every
        i = int(np.searchsorted(times, again))
    return runs, again


def step_function(times: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """until, last: a key that may run again at a time of at most until[i] (and above until[i - 1]) runs last at last[i]."""
    n = len(times)
    link = np.searchsorted(times, times + every)
    first = min(n, int(link[0]) + 1)  # no later call can be the first to run
    link = np.where(link < n, link, np.arange(n))
    while True:
        further = link[link]
        if (further == link).all():
            break
        link = further
    last = times[link[:first]]
    ends = np.append(last[1:] != last[:-1], True)
    return times[:first][ends], last[ends]


def summary(every: int):
    """mapInArrow function: from a range's rows (part, key, time) in order the one row of STEPS."""

    def run(batches):
        part, head, tail, times, again = None, None, None, [], None
        for batch in batches:
            at = batch.column(2).to_numpy()
            for i, j in segments(batch.column(1)):
                key = batch.column(1)[i].as_py()
                part = batch.column(0)[0].as_py() if part is None else part
                head = key if head is None else head
                if key == head:
                    times.append(at[i:j])
                else:
                    again = marked(at[i:j], again if key == tail else None, every)[1]
                tail = key
        if part is not None:
            until, last = step_function(np.concatenate(times), every)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([head]), pa.array([tail]), pa.array([until.tolist()], pa.list_(pa.int64())), pa.array([last.tolist()], pa.list_(pa.int64())), pa.array([again], pa.int64())], names=[f.split()[0] for f in STEPS.split(", ")])

    return run


def followed(every: int):
    """mapInArrow function: from STEPS in order of parts (part, again): when each part's first key may run again, if it went before."""

    def run(batches):
        tail, again, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = again if row["head"] == tail else None
                out.append((row["part"], now))
                if row["tail"] != row["head"]:
                    again = row["tail_again"]
                else:
                    i = 0 if now is None else int(np.searchsorted(row["until"], now))
                    again = row["last"][i] + every if i < len(row["last"]) else now
                tail = row["tail"]
        yield pa.record_batch([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.int64())], names=["part", "again"])

    return run


def marker(every: int, columns: int):
    """mapInArrow function: from a range's rows (part, key, time, again, ...) in order those that run, without these columns."""

    def run(batches):
        tail, again = None, None
        for batch in batches:
            at, runs = batch.column(2).to_numpy(), []
            for i, j in segments(batch.column(1)):
                key = batch.column(1)[i].as_py()
                if tail is None:
                    again = batch.column(3)[0].as_py()
                elif key != tail:
                    again = None
                tail = key
                found, again = marked(at[i:j], again, every)
                runs += [i + x for x in found]
            yield pa.RecordBatch.from_arrays(batch.columns[4:], names=batch.schema.names[4:]).take(pa.array(runs, pa.int64()))

    return run


def throttled(df: DataFrame, key: str, time: str, order: str, seconds: float) -> DataFrame:
    """The rows of df that run: of each key's rows by time and order, those with no run of the key less than `seconds` before.

    A null key is a key; rows without a time don't run. Of rows equal in key, time and order one runs at most, if seconds are above 0.
    """
    every = round(seconds * 1_000_000)
    if every <= 0:
        return df.where(F.col(time).isNotNull())
    names = df.columns
    rows = df.where(F.col(time).isNotNull())
    named = F.when(F.col(key).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    rows = rows.select(named.alias("__key"), F.unix_micros(F.col(time).cast("timestamp")).alias("__time"), F.col(order).alias("__order"), *(F.col(f"`{n}`").alias(f"__{i}") for i, n in enumerate(names)))
    by = ["__key", "__time", "__order"]
    rows = materialised(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()))
    steps = materialised(rows.select("__part", "__key", "__time").mapInArrow(summary(every), STEPS))
    again = steps.coalesce(1).sortWithinPartitions("part").mapInArrow(followed(every), "part int, again long")  # one row for each range
    rows = rows.join(F.broadcast(again), F.col("__part") == F.col("part"))
    ddl = ", ".join(f"`__{i}` {df.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    out = rows.select("__part", "__key", "__time", "again", *(f"__{i}" for i in range(len(names)))).mapInArrow(marker(every, len(names)), ddl)
    return out.toDF(*names)
