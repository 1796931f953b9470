"""Shuffling streams of shards through bounded buffers, the same in every run.

Shards are put into a random order and dealt to workers in turn. A worker reads its shards one after another through
a buffer: it takes up to two rows for each that it gives away until the buffer is full, gives none away before
`initial` are in it, and empties it at the end. All that is random comes from seed, epoch and worker, so an epoch can
be repeated, and each epoch and worker has its own order.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.operators.ranking import positioned


@dataclass(frozen=True)
class Buffer:
    workers: int = 8
    initial: int = 1000
    full: int = 5000
    seed: int = 0
    epoch: int = 0


def drawn(seed: int, step: int, size: int) -> int:
    """The place in a buffer of `size` that a step draws."""
    return int(hashlib.md5(f"{seed}:{step}".encode()).hexdigest()[:8], 16) % size


class Order:
    """What a buffer of row numbers gives away as rows come."""

    def __init__(self, buffer: Buffer, worker: int):
        self.buffer, self.seed = buffer, buffer.seed + buffer.epoch + 1000 * worker
        self.held: list[int] = []
        self.step, self.second = 0, False

    def give(self) -> int:
        at = drawn(self.seed, self.step, len(self.held))
        self.step += 1
        self.held[at], self.held[-1] = self.held[-1], self.held[at]
        return self.held.pop()

    def put(self, row: int) -> list[int]:
        self.held.append(row)
        if not self.second and len(self.held) < self.buffer.full:
            self.second = True  # one more comes before one goes
            return []
        self.second = False
        return [self.give()] if len(self.held) >= self.buffer.initial else []

    def end(self) -> list[int]:
        return [self.give() for _ in range(len(self.held))]


def runner(buffer: Buffer):
    """mapInArrow function: from rows (worker, ...) sorted by worker the same rows with their step, through a buffer for each worker."""

    def run(batches):
        order, now, held = None, None, None  # held: the rows in the buffer, numbered as order.held says

        def given(table: pa.Table, numbers: list[int], first: int) -> pa.RecordBatch:
            rows = table.take(pa.array(numbers, pa.int64())).combine_chunks()
            columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
            return pa.RecordBatch.from_arrays([columns[0], pa.array(range(first, first + len(numbers)), pa.int64()), *columns[1:]], names=[rows.column_names[0], "step", *rows.column_names[1:]])

        for batch in batches:
            workers = batch.column(0).to_pylist()
            at = 0
            while at < len(workers):
                to = next((i for i in range(at, len(workers)) if workers[i] != workers[at]), len(workers))
                if workers[at] != now:
                    if order:
                        first = order.step
                        yield given(held, order.end(), first)
                    now, order, held = workers[at], Order(buffer, workers[at]), None
                part = pa.Table.from_batches([batch.slice(at, to - at)])
                have = held.num_rows if held else 0
                table, first = pa.concat_tables([held, part]) if held else part, order.step
                out = [x for i in range(to - at) for x in order.put(have + i)]
                yield given(table, out, first)
                held = table.take(pa.array(order.held, pa.int64()))  # copied, so that the batches can go
                order.held = list(range(len(order.held)))
                at = to
        if order:
            first = order.step
            yield given(held, order.end(), first)

    return run


def shuffled_shards(df: DataFrame, shard: str, order: str, buffer: Buffer = Buffer()) -> DataFrame:
    """worker, step and df's columns: df's rows as the workers give them away, in partitions sorted so.

    shard: the shard of each row (null is one too); order: the place of a row in its shard, unique there. A worker's task
    holds its buffer and an Arrow batch. There may be more workers than tasks. Raises for negative seeds and full < initial.
    """
    if buffer.seed < 0 or buffer.epoch < 0 or buffer.full < buffer.initial or buffer.workers < 1:
        raise ValueError(f"no order for {buffer}")
    random = F.md5(F.concat(F.lit(f"{buffer.seed + buffer.epoch}:"), F.coalesce(F.col("__shard").cast("string"), F.lit(""))))
    shards = df.select(F.col(shard).alias("__shard")).distinct().withColumn("__random", random)
    shards = positioned(shards, ["__random", "__shard"], "__rank").select("__shard", F.col("__rank") % buffer.workers, F.floor(F.col("__rank") / buffer.workers)).toDF("__shard", "worker", "__turn")
    names = df.columns
    rows = df.select(F.col(shard).alias("__of"), F.col(order).alias("__order"), *(F.col(f"`{n}`").alias(f"__{i}") for i, n in enumerate(names)))
    rows = rows.join(shards, F.col("__of").eqNullSafe(F.col("__shard"))).withColumn("worker", F.col("worker").cast("int"))
    rows = rows.repartitionById(buffer.workers, F.col("worker")).sortWithinPartitions("worker", "__turn", "__order")
    ddl = ", ".join(f"`__{i}` {df.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    out = rows.select("worker", *(f"__{i}" for i in range(len(names)))).mapInArrow(runner(buffer), f"worker int, step long, {ddl}")
    return out.toDF("worker", "step", *names)
