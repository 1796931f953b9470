"""Documents dealt into parts of bounded size, and what numbers the parts have in common.

A part is the set of rows with one value of `part`; all rows of a part are in one task. `told` finds out which
of the numbers that describe a part's rows (hashes of strings or shingles) are described by two rows: parts
send no text for that, only their distinct numbers, sorted and packed, and are sent back those in common.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm import textbatch as tb

#: Partitions at most; a partition may hold several parts.
TASKS = 20_000


def pack(*columns: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(len(c).to_bytes(8, "little") + c.tobytes() for c in columns))


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for kind in kinds:
        size = int.from_bytes(raw[at : at + 8], "little") * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


def planes(x: np.ndarray, kind: str) -> np.ndarray:
    """The first bytes of all items, then the second, and so on: they compress better."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).ravel()


def items(x: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, -1).T).ravel().view(kind)


def ascending(x: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted numbers and a flag of each."""
    return pack(planes(np.diff(x, prepend=np.uint64(0)), "<u8"), np.packbits(flags))


def ascended(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, flags = unpack(raw, "u1", "u1")
    x = np.cumsum(items(steps, "<u8"), dtype=np.uint64)
    return x, np.unpackbits(flags, count=len(x)).astype(bool)


@dataclass(frozen=True)
class Plan:
    """What follows from the input's size."""

    parts: int
    buckets: int
    shift: int  # bits of a number that are not sent: enough are, that few unlike ones agree

    def marks(self, x: np.ndarray) -> np.ndarray:
        return x >> np.uint64(self.shift)


def planned(texts: DataFrame, part: int, bucket: int, spare: int = 8) -> Plan:
    """texts: text string. part and bucket: bytes of text for each. spare: bits of a mark beyond those that the text's bytes need."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return Plan(max(1, -(-total // part)), max(8, -(-total // bucket)), 64 - min(64, max(16, total.bit_length() + spare)))


def dealt(rows: DataFrame, part: Column, plan: Plan) -> DataFrame:
    """rows with the column `part`, in front, dealt by it."""
    return rows.select(F.pmod(part, F.lit(plan.parts)).cast("int").alias("part"), *rows.columns).repartition(min(plan.parts, TASKS), "part")


MARKS = "bucket int, body binary"
#: Marks that a task gathers from its parts before it sends them: the more, the more of a bucket's stand in one message.
GATHERED = 4_000_000


def packed_marks(part: np.ndarray, mark: np.ndarray, flags: np.ndarray) -> bytes:
    """Marks of several parts, ascending within each, with a flag of each mark."""
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return pack(planes(part[first], "<i4"), planes(np.diff(np.append(first, len(part))), "<u4"), planes(np.diff(mark, prepend=np.uint64(0)), "<u8"), np.packbits(flags))


def unpacked_marks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part, many, steps, flags = unpack(raw, "u1", "u1", "u1", "u1")
    mark = np.cumsum(items(steps, "<u8"), dtype=np.uint64)  # steps back to the next part's first mark wrap around
    return np.repeat(items(part, "<i4"), items(many, "<u4")), mark, np.unpackbits(flags, count=len(mark)).astype(bool)


def marker(find: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], plan: Plan, block: int):
    """mapInArrow function: from rows (part, ..., text) sorted by part, packed marks by bucket. find: row and number of all that describes a block."""

    def sent(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        part = np.repeat([p for p, _, _ in held], [len(m) for _, m, _ in held])
        mark, several = np.concatenate([m for _, m, _ in held]), np.concatenate([f for _, _, f in held])
        bucket = (mark % np.uint64(plan.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        part, mark, several, bucket = part[order], mark[order], several[order], bucket[order]
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(mark)]
        bodies = [packed_marks(part[i:j], mark[i:j], several[i:j]) for i, j in zip(edges, edges[1:])]
        return pa.record_batch([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    def run(batches):
        now, lows, held = None, [], []

        def close():
            mark, rows = np.unique(np.concatenate(lows), return_counts=True)
            held.append((now, mark, rows > 1))

        for rows in tb.blocks(batches, "text", block):
            part = rows.column(0).to_numpy()
            row, low = find(*tb.utf8(rows.column(rows.schema.get_field_index("text"))))
            low, owner = plan.marks(low), part[row]
            order = np.lexsort((row, low, owner))
            low, row, owner = low[order], row[order], owner[order]
            once = np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1]))[: len(low)]  # of each row once
            low, owner = low[once], owner[once]
            for p in np.unique(part).tolist():
                if p != now:
                    if lows:
                        close()
                    now, lows = p, []
                own = low[slice(*np.searchsorted(owner, [p, p + 1]))]
                if len(own):
                    lows.append(own)
            if sum(len(m) for _, m, _ in held) > GATHERED:
                yield sent(held)
                held = []
        if lows:
            close()
        if held:
            yield sent(held)
        tb.release()

    return run


def matcher(hot: int):
    """mapInArrow function: from MARKS sorted by bucket, for each part the marks that two rows hold; flagged where `hot` parts do."""

    def settle(held: list[bytes]):
        part, mark, several = (np.concatenate(x) for x in zip(*map(unpacked_marks, held)))
        _, back, parts = np.unique(mark, return_inverse=True, return_counts=True)  # a part has a mark once
        shared = parts > 1
        shared[back[several]] = True
        keep = np.flatnonzero(shared[back])
        keep = keep[np.lexsort((mark[keep], part[keep]))]
        part, mark, often = part[keep], mark[keep], parts[back[keep]] >= hot
        edges = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist(), len(part)]
        bodies = [ascending(mark[i:j], often[i:j]) for i, j in zip(edges, edges[1:])]
        yield pa.record_batch([pa.array(part[edges[:-1]].astype(np.int32)), pa.array(bodies, pa.binary())], names=["part", "body"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for b, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != now:
                    if held:
                        yield from settle(held)
                    now, held = b, []
                held.append(body.as_py())
        if held:
            yield from settle(held)
        tb.release()

    return run


def told(rows: DataFrame, plan: Plan, find, hot: int, block: int = 6 << 20) -> DataFrame:
    """part, body: the packed marks (see `ascended`) of a part that two rows or more hold. rows: of `dealt`, with text."""
    marks = rows.sortWithinPartitions("part").mapInArrow(marker(find, plan, block), MARKS)
    return marks.repartition(min(plan.buckets, TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(matcher(hot), "part int, body binary")


def known(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All marks told to a part, ascending, and their flags."""
    marks = [ascended(x) for x in told["body"].to_pylist() if x is not None]
    if not marks:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    mark, hot = (np.concatenate(x) for x in zip(*marks))
    order = np.argsort(mark)
    return mark[order], hot[order]


def among(x: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of x is among the ascending marks, and at which place."""
    if not len(mark):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(mark, x), len(mark) - 1)
    return mark[at] == x, at


def table_of(rows: list[tuple], ddl: str, types: tuple) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[f.split()[0] for f in ddl.split(", ")])
