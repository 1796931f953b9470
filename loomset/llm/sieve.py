"""Sets that can't be 80 % like any set of another group, told from their members alone: nothing is compared.

Each part of the sets sends its distinct members, with the smallest and the largest group that holds them, in
one message for each bucket of members; a bucket sends each part those that two groups hold, and how many sets
do. A set with fewer of these than a link needs is out. What stays can be gone through again, as members that
only sets now gone had in common are gone too. Messages grow with the members, whatever a member's or a
group's share of them is.

A link's sets also share one of their first members, in any order that all sets follow, if as many are taken as
leave fewer than a link needs. `prefixes` takes them from the rarest on, so sets with members of their own meet
few others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import parts
from loomset.llm import textbatch as tb
from loomset.llm.cluster import narrow

#: Bytes of members in a part and in a bucket at most, about; with fewer of them there are as many as tasks, if not too small.
PART, BUCKET, SMALL = 8 << 20, 4 << 20, 64 << 10
SETS = "id long, component long, need int, members binary"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All members of a block of sets, and the position of the set that each belongs to."""
    size = np.array([len(x) for x in column.to_pylist()], np.int64) // 4
    return np.frombuffer(b"".join(column.to_pylist()), "<u4"), np.repeat(np.arange(len(size)), size)


def sender(buckets: int):
    """mapInArrow function: from rows (part, SETS) sorted by part the messages (bucket, part, body)."""

    def summed(member, lo, hi, n):
        order = np.argsort(member, kind="stable")
        member, first = member[order], np.flatnonzero(np.append(True, np.diff(member[order]) != 0)[: len(member)])
        return member[first], np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first), np.add.reduceat(n[order], first)

    def sent(part: int, held: list):
        member, lo, hi, n = summed(*(np.concatenate(x) for x in zip(*held)))
        bucket = member % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(b, order[i:j]) for b, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
        bodies = [parts.pack(member[at].astype("<u4"), lo[at].astype("<i8"), hi[at].astype("<i8"), n[at].astype("<i8")) for _, at in rows]
        return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "part", "body"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            part = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist()
            for i, j in zip(edges, [*edges[1:], len(part)]):
                if part[i] != now:
                    if held:
                        yield sent(now, held)
                    now, held = int(part[i]), []
                member, owner = flat(batch.column(4).slice(i, j - i))
                if len(member):
                    group = batch.column(2).slice(i, j - i).to_numpy()[owner]
                    held.append(summed(member, group, group, np.ones(len(member), np.int64)))
        if held:
            yield sent(now, held)
        tb.release()

    return run


def settler():
    """mapInArrow function: from messages sorted by bucket, for each part (part, body) the members of two groups and their numbers of sets."""

    def settled(held: list[tuple[int, bytes]]):
        found = [parts.unpack(body, "<u4", "<i8", "<i8", "<i8") for _, body in held]
        part = np.repeat([p for p, _ in held], [len(x[0]) for x in found])
        member, lo, hi, n = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(member, kind="stable")
        member, part = member[order], part[order]
        first = np.flatnonzero(np.append(True, np.diff(member) != 0)[: len(member)])
        size = np.diff(np.append(first, len(member)))
        shared = np.repeat(np.minimum.reduceat(lo[order], first) < np.maximum.reduceat(hi[order], first), size)
        total = np.repeat(np.add.reduceat(n[order], first), size)
        keep = np.flatnonzero(shared)
        keep = keep[np.argsort(part[keep], kind="stable")]
        part, member, total = part[keep], member[keep], total[keep]
        edges = [*np.flatnonzero(np.append(True, np.diff(part) != 0)[: len(part)]).tolist(), len(part)]
        return pa.record_batch([pa.array(part[edges[:-1]].astype(np.int32)), pa.array([parts.pack(member[i:j].astype("<u4"), total[i:j].astype("<i8")) for i, j in zip(edges, edges[1:])], pa.binary())], names=["part", "body"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, part, body in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if held:
                        yield settled(held)
                    now, held = bucket, []
                held.append((part, body))
        if held:
            yield settled(held)
        tb.release()

    return run


KEPT = "id long, component long, need int, members binary, first array<long>"


def keeper():
    """mapInArrow function: from rows (part, kind, body) of replies and (part, kind, ..., SETS) of sets, sorted by part and kind, the sets that stay, as KEPT."""

    def kept(rows: pa.RecordBatch, member: np.ndarray, total: np.ndarray):
        own, owner = flat(rows.column(6))
        among, at = parts.among(own, member)
        own, owner, total = own[among], owner[among], total[at[among]]
        need = rows.column(5).to_numpy()
        many = np.bincount(owner, minlength=rows.num_rows)
        stays = np.flatnonzero(many >= np.maximum(need, 1))
        order = np.lexsort((own, total, owner))
        edges = np.concatenate([[0], np.cumsum(many)]).tolist()
        rarest = own[order].astype(np.int64)
        first = [rarest[edges[i] : edges[i] + int(many[i] - need[i]) + 1] for i in stays.tolist()]
        members = [own[edges[i] : edges[i + 1]].astype("<u4").tobytes() for i in stays.tolist()]
        return pa.record_batch([rows.column(3).take(pa.array(stays)), rows.column(4).take(pa.array(stays)), rows.column(5).take(pa.array(stays)), pa.array(members, pa.binary()), pa.array(first, pa.list_(pa.int64()))], names=["id", "component", "need", "members", "first"])

    def run(batches):
        now, told, known = None, [], None
        for batch in batches:
            part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]))[: len(part)]).tolist()
            for i, j in zip(edges, [*edges[1:], len(part)]):
                if part[i] != now:
                    now, told, known = int(part[i]), [], None
                if kind[i] == 0:
                    told += [parts.unpack(x.as_py(), "<u4", "<i8") for x in batch.column(2).slice(i, j - i)]
                    continue
                if known is None:
                    member, total = (np.concatenate(x) for x in zip(*told)) if told else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                    order = np.argsort(member)
                    known = member[order], total[order]
                yield kept(batch.slice(i, j - i), *known)
        tb.release()

    return run


def sieved(sets: DataFrame, rounds: int = 2) -> DataFrame:
    """KEPT: the sets that have `need` members or more in common with other groups, those members, and the first of them, rarest first.

    sets: id long (unique), component long, need int (members that a link needs), members binary (<u4; no loss if two have one number).
    """
    usual = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_by = lambda df, key, n: df.repartitionById(min(n, parts.TASKS), F.col(key) % min(n, parts.TASKS))
    rows = narrow(sets.select("id", "component", "need", "members"))
    for _ in range(rounds):
        total = rows.agg(F.sum(F.octet_length("members"))).first()[0] or 0
        tasks, buckets = (max(1, -(-total // x), min(usual, total // SMALL)) for x in (PART, BUCKET))
        dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int").alias("part"), *rows.columns)
        dealt = dealt_by(dealt, "part", tasks).sortWithinPartitions("part")
        told = dealt.mapInArrow(sender(buckets), "bucket int, part int, body binary")
        told = dealt_by(told, "bucket", buckets).sortWithinPartitions("bucket").mapInArrow(settler(), "part int, body binary")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        told = told.select("part", F.lit(0).alias("kind"), "body", none("long", "id"), none("long", "component"), none("int", "need"), none("binary", "members"))
        both = told.unionByName(dealt.select("part", F.lit(1).alias("kind"), none("binary", "body"), "id", "component", "need", "members"))
        both = dealt_by(both, "part", tasks).sortWithinPartitions("part", "kind")
        rows = narrow(both.mapInArrow(keeper(), KEPT))
    return rows
