"""Target-distribution importance resampling by bucket-partitioned inverted postings.

Features are all runs of one to three words; a feature's bucket is its crc32 modulo `buckets`. A bucket's gain
is the logarithm of its share of the target's features over its share of the documents'; a document's weight
is the sum of its features' gains, and documents are drawn without replacement by weight plus Gumbel noise.

1. A task counts buckets by document for a block of texts at a time, and sends postings (bucket, document,
   count), packed, one message for each block and group of buckets. A document is named by its block and place.
   When the task ends it also sends each group what it has counted by bucket in each corpus, summed.
2. A group's task first adds up those counts, of both corpora, has its buckets' gains, and then reads the
   postings one message after another: it keeps nothing but its buckets' counts. Of each message it sends the
   block's documents the sum of their contributions. A group with more postings than a task should read is
   dealt out by block (`salts`); its counts go to each of its tasks.
3. Contributions meet the block's documents and are added up. A block knows how many messages it is owed: one
   that lacks some is an error, not a smaller weight.
4. Ranks: scores are dealt into ranges and numbered range by range.

A bucket's postings are as many as there are documents, so a frequent word costs a group's share and no more.
Texts come in blocks, so a very long one costs its own counts: `buckets` of them at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm import parts
from loomset.llm import textbatch as tb
from loomset.llm.cluster import cut
from loomset.operators.ranking import positioned


@dataclass(frozen=True)
class Target:
    runs: int = 3  # words in a feature at most
    buckets: int = 10_000
    scale: int = 1000  # of gains and noise, which are rounded down
    seed: int = 42
    least: int = 20  # words of a document that may be drawn
    percent: int = 5  # of those that are drawn
    group: int = 24 << 20  # bytes of text for a group of buckets
    groups: int = 1000  # at most
    task: int = 1 << 30  # bytes of text whose postings of one group a task reads at most


@dataclass(frozen=True)
class Deal:
    groups: int
    salts: int


#: What separates words: all of ASCII but letters and digits. Texts are lower-cased first.
BLANKS = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else 32 for b in range(256))
DOCUMENTS, TARGET = 0, 1
MESSAGE = "grp int, salt int, kind int, block long, total long, body binary"
COUNTS, POSTINGS, OWED = 0, 1, 2


def features(texts: list[bytes], target: Target) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each feature of the texts, and the number of words of each text."""
    words, many = [], []
    for text in texts:
        own = text.lower().translate(BLANKS).split()
        words += own
        many.append(len(own))
    many = np.array(many, np.int64)
    row = np.repeat(np.arange(len(texts)), many)
    sums = list(map(crc32, words))
    after = list(map(b" ".__add__, words))
    rows, found = [row], [np.array(sums, np.int64)]
    for n in range(1, target.runs):  # a run's checksum goes on from the shorter run's
        sums = list(map(crc32, after[n:], sums))
        one_text = row[: len(sums)] == row[n:]
        rows.append(row[: len(sums)][one_text])
        found.append(np.array(sums, np.int64)[one_text])
    return np.concatenate(rows), np.concatenate(found) % target.buckets, many


def counted(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (below size) that occur, ascending, and how often."""
    if size > max(1 << 16, 16 * len(key)):
        return np.unique(key, return_counts=True)
    many = np.bincount(key, minlength=size)
    at = np.flatnonzero(many)
    return at, many[at]


def poster(target: Target, deal: Deal):
    """mapInArrow function: from rows (doc_id, corpus, text) the messages to groups of buckets and, as group -1, to blocks' documents."""

    def counts(totals: np.ndarray):
        rows = [(g, s, COUNTS, c, int(totals[c].sum()), parts.pack(totals[c][g :: deal.groups].astype("<i8"))) for g in range(deal.groups) for s in range(deal.salts) for c in (DOCUMENTS, TARGET) if totals[c].any()]
        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=[f.split()[0] for f in MESSAGE.split(", ")])

    def run(batches):
        totals = np.zeros((2, target.buckets), np.int64)
        task, block = TaskContext.get().partitionId(), 0
        for rows in tb.blocks(batches, "text"):
            ids, corpus = rows.column(0), rows.column(1).to_numpy()
            row, bucket, words = features([t.as_py() or b"" for t in rows.column(2).cast(pa.binary())], target)
            many = np.bincount(row, minlength=len(ids))
            for c in (DOCUMENTS, TARGET):
                totals[c] += np.bincount(bucket[corpus[row] == c], minlength=target.buckets)
            own = np.flatnonzero(corpus == DOCUMENTS)
            if not len(own):
                continue
            mine = np.full(len(ids), -1)
            mine[own] = np.arange(len(own))
            of_own = mine[row] >= 0
            # by group, then bucket, then document
            group, inner = bucket[of_own] % deal.groups, bucket[of_own] // deal.groups
            wide = -(-target.buckets // deal.groups)
            key, n = counted((group * wide + inner) * len(own) + mine[row[of_own]], deal.groups * wide * len(own))
            doc, cell = key % len(own), key // len(own)
            edges = np.searchsorted(cell, np.arange(deal.groups + 1) * wide)
            name, out = task << 32 | block, []
            for g in range(deal.groups):
                i, j = edges[g], edges[g + 1]
                if i < j:
                    inner = cell[i:j] - g * wide
                    body = parts.pack(np.bincount(inner, minlength=wide).astype("<u4"), parts.planes(doc[i:j], "<u4"), parts.planes(n[i:j], "<u4"))
                    out.append((g, (task + block) % deal.salts, POSTINGS, name, len(own), body))
            null = ids.is_null().to_numpy(zero_copy_only=False)[own]
            known = ids.fill_null(0).to_numpy()[own]
            out.append((-1, 0, OWED, name, len(out), parts.pack(known.astype("<i8"), null.astype("u1"), many[own].astype("<i8"), words[own].astype("<i8"))))
            yield batch(out)
            block += 1
            tb.release()
        yield from counts(totals)
        tb.release()

    return run


def gains(group: int, totals: np.ndarray, sizes: list[int], target: Target, deal: Deal) -> np.ndarray:
    """The gains of a group's buckets. totals: their features in documents and target; sizes: all features of each."""
    n = target.buckets
    return np.array([math.floor(target.scale * math.log((t + 1) * (sizes[DOCUMENTS] + n) / ((s + 1) * (sizes[TARGET] + n)))) for s, t in totals.T.tolist()])


def weigher(target: Target, deal: Deal):
    """mapInArrow function: from MESSAGE sorted by grp, salt, kind, for blocks: (block, kind, total, body) with contributions."""

    def run(batches):
        now, totals, sizes, gain = None, None, None, None
        for rows in batches:
            out = []
            for group, salt, kind, block, total, body in zip(*(c.to_pylist() for c in rows.columns)):
                if kind == OWED:
                    out.append((block, kind, total, body))
                    continue
                if (group, salt) != now:
                    now, sizes, gain = (group, salt), [0, 0], None
                    totals = np.zeros((2, len(range(group, target.buckets, deal.groups))), np.int64)
                if kind == COUNTS:
                    totals[block] += parts.unpack(body, "<i8")[0]
                    sizes[block] += total
                    continue
                if gain is None:
                    gain = gains(group, totals, sizes, target, deal)
                many, doc, n = parts.unpack(body, "<u4", "u1", "u1")
                doc, n = parts.items(doc, "<u4"), parts.items(n, "<u4").astype(np.int64)
                each = np.repeat(gain, many[: len(gain)]) * n
                add = np.zeros(total, np.int64)
                np.add.at(add, doc, each)
                some = np.flatnonzero(np.bincount(doc, minlength=total))
                out.append((block, POSTINGS, len(some), parts.pack(parts.planes(np.diff(some, prepend=0), "<u4"), parts.planes(add[some], "<i8"))))
            if out:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["block", "kind", "total", "body"])
        tb.release()

    return run


WEIGHT = "doc_id long, n_features long, n_words long, weight long"


def adder():
    """mapInArrow function: from contributions and documents sorted by block the documents' weights."""

    def closed(owed: tuple | None, got: int, sums: list[tuple[np.ndarray, np.ndarray]]):
        if owed is None or owed[0] != got:
            raise RuntimeError("a block's documents and postings come from different runs of its task: the documents' order is not stable, write them first")
        ids, null, many, words = parts.unpack(owed[1], "<i8", "u1", "<i8", "<i8")
        weight = np.zeros(len(ids), np.int64)
        for doc, add in sums:
            weight[doc] += add
        yield pa.record_batch([pa.array(ids, mask=null.astype(bool)), pa.array(many), pa.array(words), pa.array(weight)], names=[f.split()[0] for f in WEIGHT.split(", ")])

    def run(batches):
        now, owed, got, sums = None, None, 0, []
        for rows in batches:
            for block, kind, total, body in zip(*(c.to_pylist() for c in rows.columns)):
                if block != now:
                    if now is not None:
                        yield from closed(owed, got, sums)
                    now, owed, got, sums = block, None, 0, []
                if kind == OWED:
                    owed = (total, body)
                    continue
                steps, add = parts.unpack(body, "u1", "u1")
                sums.append((np.cumsum(parts.items(steps, "<u4"), dtype=np.int64), parts.items(add, "<i8")))
                got += 1
        if now is not None:
            yield from closed(owed, got, sums)
        tb.release()

    return run


def planned(documents: DataFrame, target: Target) -> Deal:
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = min(target.groups, max(8, -(-total // target.group)))
    return Deal(groups, max(1, -(-total // (groups * target.task))))


def weights(documents: DataFrame, wanted: DataFrame, target: Target) -> DataFrame:
    """doc_id, n_features, n_words, weight of each document. documents: doc_id, text; wanted: text."""
    deal = planned(documents, target)
    both = documents.select("doc_id", F.lit(DOCUMENTS).alias("corpus"), "text").unionByName(wanted.select(F.lit(None).cast("long").alias("doc_id"), F.lit(TARGET).alias("corpus"), "text"))
    posted = both.mapInArrow(poster(target, deal), MESSAGE)
    tasks = min(deal.groups * deal.salts, parts.TASKS)
    # a block's own message passes a group's task of its choice
    to = F.when(F.col("kind") == OWED, F.xxhash64("block")).otherwise(F.col("grp") * deal.salts + F.col("salt"))
    dealt = posted.repartitionById(tasks, F.pmod(to, F.lit(tasks)).cast("int"))
    given = dealt.sortWithinPartitions("grp", "salt", "kind").mapInArrow(weigher(target, deal), "block long, kind int, total long, body binary")
    return given.repartition("block").sortWithinPartitions("block").mapInArrow(adder(), WEIGHT)


def noise(doc_id: Column, target: Target) -> Column:
    """Gumbel noise, scaled and rounded down, by the document's id; a null id counts as no characters."""
    digest = F.sha2(F.concat(F.lit(f"{target.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-target.scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(documents: DataFrame, wanted: DataFrame, target: Target = Target(), key: str = "doc_id", text: str = "text", wanted_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document; rank counts from 1 among the drawn ones, and is null for the others.

    Null and empty texts have no features and weight 0. Repeated rows count as often as they stand, in the corpus
    and in what is drawn; rows of equal score and id are drawn in an order of no meaning, as they are equal but for
    their features. Null ids come last among equal scores. No documents: no rows; no target: its counts are 0.
    Other columns are not read.
    """
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = weights(docs, wanted.select(F.col(wanted_text).cast("string").alias("text")), target)
    rows = cut(rows.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), target)).cast("long")))
    enough = F.col("n_words") >= target.least
    drawn = target.percent * rows.where(enough).count() // 100
    order = rows.where(enough).select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("unnamed"))
    ranked = positioned(order, ["down", "unnamed", "doc_id"], "at")
    rank = (F.col("at") + 1).cast("long")
    ranked = ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(rows.where(~enough).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
