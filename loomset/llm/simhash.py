"""SimHash near-duplicates: a self-join of binary tries over the fingerprints.

A document's fingerprint has a bit set where over half of its 3-word shingles (repeats included) have it set
in their XXH64. Equal fingerprints are one class from the start, so copies cost one row. Between classes:

1. Of `budget` + 1 blocks of the 64 bits, two fingerprints that differ in at most `budget` bits have one equal.
   There is a trie for each block: it reads that block first, in which no bit may differ, then the others in
   turn, where `budget` bits may. The nodes below the first block are the tries' roots for the join.
2. A trie is joined with itself by pairs of nodes. A node meets itself, or another node from which it differs in
   some bits; a pair's children are its children's pairs, with the bits that differ added up, and no pair is
   followed whose budget is exceeded or one of whose nodes is empty. Pairs of more than `large` fingerprints,
   or more than a task's even share, are followed by Spark, `bits` levels at a time, each fingerprint going to its pairs' children; the others
   are followed inside tasks, level by level for all pairs at once, down to fingerprints.
3. A task returns the links that join what it found unjoined: one fewer than there are fingerprints at most.
   Components are drawn from them by hooking and pointer jumping.

The work for a fingerprint depends on how many are like it in a block, not on how many there are. A node that
a third of all fingerprints share is split by its own bits, with 1 + bits + bits * (bits - 1) / 2 copies a level.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm import textbatch as tb
from loomset.llm.chosenpath import components
from loomset.llm.cluster import cut


@dataclass(frozen=True)
class Trie:
    words: int = 3  # in a shingle
    budget: int = 2  # bits in which linked fingerprints differ at most
    large: int = 20_000  # fingerprints of a pair of nodes that one task follows at most
    small: int = 64  # and from how many on it gives up a pair that is more than its share of all
    bits: int = 4  # levels that Spark follows at once
    seed: int = 42
    chunk: int = 1 << 20  # pairs that a task follows at once


def hashes(text: bytes, trie: Trie) -> np.ndarray:
    """XXH64 of a text's shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z alone, and the white space of TAB to CR
    grams = zip(*(words[i:] for i in range(trie.words))) if len(words) >= trie.words else [words] if words else []
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, grams), repeat(trie.seed)), np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """The bits set in over half of the hashes (uint64); none: 0."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)].astype(">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(found)).tobytes(), "big")


def fingerprints(documents: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, print (the 64 bits as a long) of each document. documents: doc_id, text."""

    def run(block):
        out = [fingerprint(hashes(t.as_py() or b"", trie)) for t in block.column(1).cast(pa.binary())]
        yield pa.record_batch([block.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "print"])

    return tb.map_blocks(documents, run, "doc_id long, print long")


def blocks(trie: Trie) -> list[tuple[int, int]]:
    """First bit (from the highest) and length of each block."""
    edges = [64 * i // (trie.budget + 1) for i in range(trie.budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def turned(bits: Column, by: int) -> Column:
    """bits rotated to the left."""
    return F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, 64 - by)) if by else bits


#: A pair of nodes: block, the depth of its nodes, their prefixes (right-aligned, p <= q) and the bits that may still differ.
PAIR = ["block", "depth", "p", "q", "left"]


def roots(prints: DataFrame, trie: Trie) -> DataFrame:
    """(PAIR, bits) of each fingerprint in each trie's node below the first block, paired with itself."""
    each = [F.struct(F.lit(i).alias("block"), F.lit(n).alias("depth"), turned(F.col("print"), at).alias("bits")) for i, (at, n) in enumerate(blocks(trie))]
    rows = prints.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    prefix = F.expr("shiftrightunsigned(bits, 64 - depth)")
    return rows.select("block", "depth", prefix.alias("p"), prefix.alias("q"), F.lit(trie.budget).alias("left"), "bits")


def children(rows: DataFrame, trie: Trie) -> DataFrame:
    """The rows (PAIR, bits) of pairs `bits` levels further down."""
    n = trie.bits
    masks = sorted((m for m in range(1 << n) if m.bit_count() <= trie.budget), key=int.bit_count)
    levels = F.least(F.lit(n), 64 - F.col("depth"))
    own = F.expr("shiftrightunsigned(bits, 64 - depth - levels)")
    mask = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("differ")) for m in masks)))
    rows = rows.withColumn("levels", levels).withColumn("own", own).withColumn("is_p", F.expr("shiftrightunsigned(bits, 64 - depth) = p")).withColumn("mask", mask)
    rows = rows.where("mask.differ <= left and mask.m < shiftleft(1L, levels)")
    # the other node's child differs from this one in the mask's bits
    other = F.expr("(shiftleft(case when is_p then q else p end, levels) | (own & (shiftleft(1L, levels) - 1))) ^ mask.m")
    rows = rows.withColumn("other", other)
    return rows.select("block", (F.col("depth") + F.col("levels")).alias("depth"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("left") - F.col("mask.differ")).alias("left"), "bits")


def split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where, in sorted values, each range (of equal bits above) goes from unset to set in this bit."""
    mask = np.uint64(1) << np.uint64(bit)
    goal = values[np.minimum(lo, len(values) - 1)] >> np.uint64(bit + 1) << np.uint64(bit + 1) | mask
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        less = open_ & (values[np.minimum(mid, len(values) - 1)] < goal)
        lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def followed(values: np.ndarray, pairs: list[np.ndarray], depth: int, trie: Trie):
    """Positions a, b of values of linked fingerprints, in parts. pairs: ranges lo, hi and lo2, hi2 of sorted values, and left."""
    stack = [(depth, pairs)]
    while stack:
        depth, (lo, hi, lo2, hi2, left) = stack.pop()
        if not len(lo):
            continue
        if len(lo) > trie.chunk:
            half = len(lo) // 2
            stack += [(depth, [x[half:] for x in (lo, hi, lo2, hi2, left)]), (depth, [x[:half] for x in (lo, hi, lo2, hi2, left)])]
            continue
        if depth == 64:
            apart = lo != lo2
            yield lo[apart], lo2[apart]
            continue
        mid, mid2 = split(values, lo, hi, 63 - depth), split(values, lo2, hi2, 63 - depth)
        same = lo == lo2
        out = [(lo, mid, lo2, mid2, left), (mid, hi, mid2, hi2, left), (lo, mid, mid2, hi2, left - 1)]
        out.append(tuple(x[~same] for x in (mid, hi, lo2, mid2, left - 1)))  # of a node with itself that is the pair before
        out = [np.concatenate(x) for x in zip(*out)]
        keep = (out[0] < out[1]) & (out[2] < out[3]) & (out[4] >= 0)
        keep &= (out[0] != out[2]) | (out[1] - out[0] > 1)  # a fingerprint alone with itself
        out = [x[keep] for x in out]
        one = (out[1] - out[0] == 1) & (out[3] - out[2] == 1)
        a, b = out[0][one], out[2][one]
        near = np.bitwise_count(values[a] ^ values[b]) <= trie.budget
        yield a[near], b[near]
        stack.append((depth + 1, [x[~one] for x in out]))


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b); root: each item's label, the smallest of what it is joined with."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


LINK = "a long, b long"


def walker(trie: Trie):
    """mapInArrow function: from rows (PAIR, bits) sorted by PAIR the links that join them."""

    def links(table: pa.Table):
        block, depth, p, q, left, bits = (table[c].to_numpy() for c in [*PAIR, "bits"])
        change = np.zeros(len(bits), bool)
        for x in (block, depth, p, q, left):
            change[1:] |= x[1:] != x[:-1]
        edge = np.append(np.flatnonzero(np.append(True, change[1:])), len(bits))
        for at in np.unique(np.stack([block, depth]), axis=1).T:
            pairs = np.flatnonzero((block[edge[:-1]] == at[0]) & (depth[edge[:-1]] == at[1]))
            rows = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in pairs])
            values, where = np.unique(bits[rows].view(np.uint64), return_inverse=True)
            first = edge[pairs]
            span = lambda x: (np.searchsorted(values, x << up), np.searchsorted(values, (x << up) + ((np.uint64(1) << up) - np.uint64(1)), "right"))  # noqa: E731, B023
            up = np.uint64(64 - int(at[1]))
            lo, hi = span(p[first].view(np.uint64))
            lo2, hi2 = span(q[first].view(np.uint64))
            root = np.arange(len(values))
            for a, b in followed(values, [lo, hi, lo2, hi2, left[first].astype(np.int64)], int(at[1]), trie):
                root = joined(root, a, b)
            child = np.flatnonzero(root != np.arange(len(values)))
            back = np.uint64(blocks(trie)[int(at[0])][0])
            whole = values >> back | values << (np.uint64(64) - back) if back else values
            yield pa.record_batch([pa.array(whole[child].view(np.int64)), pa.array(whole[root[child]].view(np.int64))], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            if table.num_rows < trie.large:
                held = table.to_batches()
                continue
            same = np.ones(table.num_rows, bool)
            for c in PAIR:
                x = table[c].to_numpy()
                same &= x == x[-1]
            at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if at:
                yield from links(table.slice(0, at))
            held = table.slice(at).combine_chunks().to_batches()
        if held:
            yield from links(pa.Table.from_batches(held))
        tb.release()

    return run


def links(prints: DataFrame, trie: Trie) -> DataFrame:
    """a, b: links that join all fingerprints that a chain of links joins. prints: print long, each once."""
    rows, small, most = roots(prints, trie), [], None
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        is_p = (F.expr("shiftrightunsigned(bits, 64 - depth)") == F.col("p")).cast("int")
        sizes = rows.groupBy(PAIR).agg(F.count("*").alias("n"), F.min(is_p).alias("lo"), F.max(is_p).alias("hi"))
        # both of a pair's nodes have fingerprints, or its one node has two
        sizes = cut(sizes.where("n > 1 and (p = q or lo < hi)").drop("lo", "hi"))
        if most is None:
            total = sizes.agg(F.sum("n")).first()[0] or 0
            most = min(trie.large, max(trie.small, total // tasks))
        large = sizes.where(F.col("n") > most).drop("n")
        small.append(rows.join(sizes.where(F.col("n") <= most).drop("n"), PAIR, "left_semi"))
        if large.isEmpty():
            break
        rows = cut(children(rows.join(large, PAIR, "left_semi"), trie))
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    return rows.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(walker(trie), LINK)


def near_duplicates(documents: DataFrame, trie: Trie = Trie(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each document.

    Null and empty texts, and texts without words, have the fingerprint zero, which is linked like any other.
    Repeated rows have equal results. Rows that share an id are linked by their fingerprints alone, and each has its own
    component. A row of a null id has the component of its fingerprint, null if no id reaches it. Other columns are not read.
    """
    rows = cut(fingerprints(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), trie))
    firsts = rows.groupBy("print").agg(F.min("doc_id").alias("first"))
    found = components(links(firsts.select("print"), trie), most=64)
    named = firsts.join(found.withColumnRenamed("id", "print"), "print", "left").select("print", "first", F.coalesce("component", "print").alias("of"))
    least = named.groupBy("of").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "of").select("print", "component_id")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(labels, "print", "left").select("doc_id", digits.alias("fingerprint"), "component_id")
