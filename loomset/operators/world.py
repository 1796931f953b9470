"""Work of several tasks that know each other: ranks, a common barrier and messages to all.

Tasks of one stage run in Spark's barrier mode: all start together, or none does, and all start again if one fails. The
session needs as many free cores as there are workers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame


class World:
    """What a worker knows: its rank from 0, how many there are, and where they are."""

    def __init__(self, context: BarrierTaskContext):
        self.context = context
        self.rank, self.size = context.partitionId(), len(context.getTaskInfos())

    @property
    def main(self) -> bool:
        return self.rank == 0

    def addresses(self) -> list[str]:
        return [x.address for x in self.context.getTaskInfos()]

    def barrier(self) -> None:
        """Returns once all workers are here."""
        self.context.barrier()

    def gathered(self, value) -> list:
        """What all workers give here, by rank; values that JSON holds, small ones."""
        return [json.loads(x) for x in self.context.allGather(json.dumps(value))]


def in_world(df: DataFrame, worker: Column, workers: int, fn: Callable[[World, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn(world, batches) for each worker's rows. worker: the rank that gets a row, from 0 to workers - 1."""
    return df.repartitionById(workers, worker).mapInArrow(lambda batches: fn(World(BarrierTaskContext.get()), batches), schema, barrier=True)


def ranked(df: DataFrame, worker: Column, workers: int) -> DataFrame:
    """df with the rank of the worker that holds each row, and how many workers there are: both as the workers know them."""

    def run(world: World, batches):
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([world.rank] * n, pa.int32()), pa.array([world.size] * n, pa.int32())], names=[*batch.schema.names, "rank", "size"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return in_world(df, worker, workers, run, f"{ddl}, rank int, size int")


def shares(df: DataFrame, value: str, worker: Column, workers: int) -> DataFrame:
    """One row for each worker: rank, size, main, rows (its own), before (of lower ranks), total (the sum of all workers' values, null: 0).

    Each worker counts its rows, then all tell each other; none goes on before all have."""

    def run(world: World, batches):
        rows, own = 0, 0
        for batch in batches:
            rows += batch.num_rows
            own += sum(x for x in batch.column(0).to_pylist() if x is not None)
        told = world.gathered([rows, own])
        world.barrier()
        out = (world.rank, world.size, world.main, rows, sum(n for n, _ in told[: world.rank]), sum(x for _, x in told))
        types = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array([x], t) for x, t in zip(out, types)], names=["rank", "size", "main", "rows", "before", "total"])

    rows = df.select(value, worker.alias("__worker"))
    rows = rows.withColumn(value, rows[value].cast("long"))
    return in_world(rows, rows["__worker"], workers, run, "rank int, size int, main boolean, rows long, before long, total long")
