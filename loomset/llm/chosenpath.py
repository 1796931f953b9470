"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Documents of equal sets are one class from the start (by
a 128-bit digest of the sorted set), so a group of exact copies costs one row. Between classes:

1. Each set is embedded as `size` minwise values, and `marks` two-bit minwise marks for comparison. A
   node of the join is a set of classes; at first all classes are one node. In each of `trees`
   independent trees every node draws coordinates, each with probability 1 / (threshold * size) (1.25
   of them on average, at least one), and its classes move to the child of their own value at each
   drawn coordinate.
2. A child of one class ends there. A child of at most `leaf` classes is compared. A larger one is
   branched again, on coordinates drawn for that child, down to `depth`. Classes that agree all the
   way down are near copies of each other, or pages of one template: they are dealt into blocks, each with
   the same few pivots of their node. Once the links found so far have been drawn together, classes that
   have too few shingles in common with other components are left out (`sieve`): they have no link left to
   find. Of the others, those outside a node's largest component are compared with all of the node where
   they are few; where they are many, with those that share one of their rarest shingles. So no pair of a
   node that may be a link goes uncompared, whatever its size.
3. A leaf is compared exhaustively by marks. At first each class names one partner: among those that
   are like it beyond doubt the one of smallest hash, so that a group of near copies draws together
   around a few of them; else the likeliest of a spanning forest. That is at most one pair a class.
4. Pairs are confirmed on the full sets. With the components of the confirmed links the leaves are
   compared again: one pair for each two components that may be linked. With those joined, the classes
   that may still be linked across components come to their leaves with their whole sets, and every such
   pair is compared there. So a pair is left out only where its classes are joined already, and what is
   sent grows with the classes in a leaf, not with its pairs.
5. Links give components: smallest label, by hooking and pointer jumping over Spark joins.

Two sets of similarity s meet in one tree's first level with probability 1 - exp(-s / threshold) or
more, so 10 trees leave e**-10 of the pairs at the threshold unmet at that level.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import textbatch as tb
from loomset.llm.cluster import SENT, counted, cut, few, narrow
from loomset.llm.sieve import sieved
from loomset.operators.ranking import positioned


@dataclass(frozen=True)
class Join:
    shingle: int = 5
    percent: int = 80  # links have 100 * intersection >= percent * union
    size: int = 64  # minwise values that branch
    marks: int = 512  # minwise marks that compare
    trees: int = 10
    leaf: int = 64  # classes in a node that is not branched again
    depth: int = 3
    slack: float = 0.085  # estimated similarity below the threshold from where pairs are confirmed (4 deviations)
    seed: int = 9


def coordinates(join: Join, tree: int, path: np.ndarray | int) -> list[int]:
    """The coordinates that a node draws; equal for every task, by the tree and the node's path."""
    rng = np.random.default_rng([join.seed, tree, int(path) & 0x7FFFFFFFFFFFFFFF])
    drawn = np.flatnonzero(rng.random(join.size) < 100 / (join.percent * join.size))
    return (drawn if len(drawn) else rng.integers(0, join.size, 1)).tolist()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within a row, and their offsets.

    Fewer than n words are one shingle; no word gives an empty set.
    """
    words = tb.Words(data, offsets, tb.LOWER)
    first, gram = words.grams(n)
    row = words.row[first]
    few = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(few):
        at = np.cumsum(words.count) - words.count
        short = np.zeros(len(few), np.uint64)
        for j in range(n - 1):
            has = words.count[few] > j
            short[has] += words.hash[at[few[has]] + j] * (tb.CODES[64 + j] | np.uint64(1))
        gram, row = np.concatenate([gram, tb.mix(short)]), np.concatenate([row, few])
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    gram, row = gram[new], row[new]
    return gram, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=words.rows))])


def embed(sets: np.ndarray, ends: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: `size` minwise values of 32 bits, and `marks` minwise marks of 2, four in a byte; zeros for empty sets."""
    rows = len(ends) - 1
    values, marks = np.zeros((rows, join.size), np.uint32), np.zeros((rows, join.marks // 4), np.uint8)
    full = np.flatnonzero(np.diff(ends))
    if not len(full):
        return values, marks
    rng = np.random.default_rng(join.seed)
    factors = rng.integers(1, 1 << 32, (2, join.size + join.marks), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    high, low = (sets >> np.uint64(32)).astype(np.uint32), sets.astype(np.uint32)
    starts = ends[:-1][full]
    part = np.empty_like(high)
    for j in range(join.size + join.marks):
        np.multiply(high, factors[0, j], out=part)
        part ^= low
        part *= factors[1, j]
        least = np.minimum.reduceat(part, starts)
        if j < join.size:
            values[full, j] = least
        else:
            at = j - join.size
            marks[full, at // 4] |= ((least * np.uint32(2654435761)) >> np.uint32(30) << np.uint32(2 * (at % 4))).astype(np.uint8)
    return values, marks


SKETCH = "doc_id long, n_shingles long, set_key binary, vals binary, marks binary"


def sketches(documents: DataFrame, join: Join) -> DataFrame:
    """doc_id, set size, digest of the set and embedding of each document."""

    def run(block):
        sets, ends = shingle_sets(*tb.utf8(block.column(1)), join.shingle)
        values, marks = embed(sets, ends, join)
        raw, at = sets.astype("<u8").tobytes(), (ends * 8).tolist()
        keys = [hashlib.blake2b(raw[a:b], digest_size=16).digest() if b > a else None for a, b in zip(at, at[1:])]
        binary = [pa.array([v.tobytes() for v in x], pa.binary()) for x in (values, marks)]
        yield pa.record_batch([block.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(keys, pa.binary()), *binary], names=["doc_id", "n_shingles", "set_key", "vals", "marks"])

    return tb.map_blocks(documents, run, SKETCH)


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), len(values[0]) // np.dtype(kind).itemsize if values else 0)


LOW_BITS = np.uint64(0x5555555555555555)


def likely(marks: np.ndarray, lead: np.ndarray, groups: np.ndarray | None, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (as positions) of a leaf's leads with all others that may be linked, across groups where there are some, and
    the similarity that their marks tell: one in four unlike marks agrees too."""
    order = np.concatenate([np.flatnonzero(lead), np.flatnonzero(~lead)])
    marks, least = marks[order], join.percent / 100 - join.slack
    apart = None if groups is None else groups[order]
    a, b, shares = [], [], []
    for i in range(min(int(lead.sum()), len(order) - 1)):
        differ = marks[i + 1 :] ^ marks[i]
        differ = np.bitwise_count((differ | differ >> np.uint64(1)) & LOW_BITS).sum(axis=1, dtype=np.int64)
        share = 1 - differ / (0.75 * join.marks)
        at = np.flatnonzero((share >= least) & (True if apart is None else apart[i + 1 :] != apart[i]))
        a.append(np.full(len(at), i))
        b.append(at + i + 1)
        shares.append(share[at])
    none = np.zeros(0, np.int64)
    a, b, share = np.concatenate([none, *a]), np.concatenate([none, *b]), np.concatenate([np.zeros(0), *shares])
    return order[a], order[b], share


def forest(a: list[int], b: list[int], root: list[int]) -> list[int]:
    """Which pairs, in order, join what the ones before them left apart; root: a parent for each item, changed here."""
    keep = []
    for k, (x, y) in enumerate(zip(a, b)):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[x] = y
            keep.append(k)
    return keep


def partners(ids: np.ndarray, marks: np.ndarray, lead: np.ndarray, groups: None, join: Join) -> tuple[np.ndarray, ...]:
    """For a leaf's classes a the partners b that they name, and how late these come (smallest first)."""
    a, b, share = likely(marks, lead, None, join)
    hashed = tb.mix(ids.view(np.uint64))
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(hashed, kind="stable")] = np.arange(len(ids))
    sure = share >= join.percent / 100 + join.slack
    child, parent = np.where(rank[a] > rank[b], a, b)[sure], np.where(rank[a] > rank[b], b, a)[sure]
    best = np.full(len(ids), len(ids))
    np.minimum.at(best, child, rank[parent])
    child = np.flatnonzero(best < len(ids))
    parent = np.argsort(rank)[best[child]]
    root = np.arange(len(ids))
    root[child] = parent
    unsure = np.flatnonzero(~sure)
    unsure = unsure[np.argsort(-share[unsure], kind="stable")]
    kept = unsure[forest(a[unsure].tolist(), b[unsure].tolist(), root.tolist())]
    one, other = np.concatenate([child, a[kept], b[kept]]), np.concatenate([parent, b[kept], a[kept]])
    late = np.concatenate([hashed[parent] / 2.0**64 - 2, -share[kept], -share[kept]])
    return ids[one], ids[other], late


def bridges(ids: np.ndarray, marks: np.ndarray, lead: np.ndarray, groups: np.ndarray, join: Join) -> tuple[np.ndarray, ...]:
    """Components x < y of a leaf that may be linked, and the likeliest pair (a, b) of each two that a spanning forest takes."""
    a, b, share = likely(marks, lead, groups, join)
    order = np.argsort(-share, kind="stable")
    a, b, share = a[order], b[order], share[order]
    _, where = np.unique(groups, return_inverse=True)
    kept = forest(where[a].tolist(), where[b].tolist(), list(range(int(where.max(initial=0)) + 1)))
    return ordered(ids, groups, a[kept], b[kept], share[kept])


def ordered(ids: np.ndarray, groups: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
    a, b = np.where(groups[a] < groups[b], a, b), np.where(groups[a] < groups[b], b, a)
    return groups[a], groups[b], ids[a], ids[b], share


def entangled(ids: np.ndarray, marks: np.ndarray, lead: np.ndarray, groups: np.ndarray, join: Join) -> tuple[np.ndarray, ...]:
    """The classes of a leaf that may be linked across components: id, lead, component."""
    a, b, _ = likely(marks, lead, groups, join)
    some = np.zeros(len(ids), bool)
    some[a] = some[b] = True
    return ids[some], lead[some], groups[some]


def verified(ids: np.ndarray, sets: list[np.ndarray], lead: np.ndarray, groups: np.ndarray, join: Join) -> tuple[np.ndarray, ...]:
    """As `bridges`, by the leaf's whole sets (of 32-bit hashes): pairs of leads with all others, exhaustively."""
    size = np.array([len(x) for x in sets])
    order = np.concatenate([np.flatnonzero(lead), np.flatnonzero(~lead)])
    flat, owner = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(len(order)), size[order])
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    n, leads = len(order), int(lead.sum())
    same = np.zeros((leads, n), np.float32)
    often = times[at] > 1  # a shingle of one set is in no intersection
    owner, at = owner[often], np.unique(at[often], return_inverse=True)[1]
    by = np.argsort(at, kind="stable")
    owner, at = owner[by], at[by]
    columns = int(at[-1]) + 1 if len(at) else 0
    width = min(max(256, (1 << 22) // n), columns)
    for lo in range(0, columns, max(width, 1)):
        i, j = np.searchsorted(at, [lo, lo + width])
        has = np.zeros((n, width), np.float32)
        has[owner[i:j], at[i:j] - lo] = 1
        same += has[:leads] @ has.T
    either = size[order][:leads, None] + size[order][None, :] - same
    # two shingles of a set may have one 32-bit hash; links are confirmed afterwards
    like = (100 * (same + 1) >= join.percent * (either - 1)) & (same > 0) & (groups[order][:leads, None] != groups[order][None, :])
    a, b = np.nonzero(like)
    share = (same[a, b] / either[a, b]).astype(float)
    a, b = order[a], order[b]
    best = np.argsort(-share, kind="stable")
    a, b, share = a[best], b[best], share[best]
    _, where = np.unique(groups, return_inverse=True)
    kept = forest(where[a].tolist(), where[b].tolist(), list(range(int(where.max()) + 1)))
    return ordered(ids, groups, a[kept], b[kept], share[kept])


#: Ids that are sent to all executors at most (16 MB of them).
BROADCAST = 2_000_000
PARTNER = "a long, b long, late double"
CROSSING = "x long, y long, a long, b long, share double"


def branch(join: Join):
    """mapInArrow function: from rows (id, tree, path, vals) the rows (id, tree, path) of the children; tree -1 is the root of all."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, values = batch.column(0).to_numpy(), matrix(batch.column(3), np.uint32)
            trees, paths = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            order = np.lexsort((paths, trees))
            change = (np.diff(trees[order]) != 0) | (np.diff(paths[order]) != 0)
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(order)]
            out = ([], [], [])
            for lo, hi in zip(bounds, bounds[1:]):
                at = order[lo:hi]
                tree, path = int(trees[at[0]]), int(paths[at[0]])
                for t in range(join.trees) if tree < 0 else [tree]:
                    for c in coordinates(join, t, path):
                        value = values[at, c].astype(np.uint64) | np.uint64((t * join.size + c + 1) << 32)
                        out[0].append(ids[at])
                        out[1].append(np.full(len(at), t, np.int32))
                        out[2].append(tb.mix(tb.mix(value) + np.uint64(path & 0xFFFFFFFFFFFFFFFF)).view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["id", "tree", "path"])

    return run


def leaves(join: Join, find, names: list[str]):
    """mapInArrow function: from rows (id, path, lead, what, component) sorted by path, what `find` gives for each leaf, and its path if asked.

    what: marks, or for `verified` sets."""

    def found(table: pa.Table):
        table = table.combine_chunks()
        paths, ids, lead, groups = (table[c].to_numpy() for c in ("path", "id", "lead", "component"))
        what = [np.frombuffer(x, "<u4") for x in table["what"].to_pylist()] if find is verified else matrix(table["what"], np.uint64)
        bounds = [0, *(np.flatnonzero(np.diff(paths)) + 1).tolist(), len(ids)]
        rows = []
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo > 1:
                got = find(ids[lo:hi], what[lo:hi], lead[lo:hi], groups[lo:hi], join)
                rows.append((*got, np.full(len(got[0]), paths[lo])) if "path" in names else got)
        if rows:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*rows)], names=names)

    def run(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch])
            paths = table["path"].to_numpy()
            before = np.flatnonzero(paths != paths[-1])
            at = int(before[-1]) + 1 if len(before) else 0
            if at:
                yield from found(table.slice(0, at))
            rest = table.slice(at).combine_chunks().to_batches()
        if rest:
            yield from found(pa.Table.from_batches(rest))
        tb.release()

    return run


def leaf_rows(classes: DataFrame, join: Join) -> tuple[DataFrame, DataFrame | None]:
    """(id, path) of the leaves with two classes or more, and (id, path, n) of nodes that stayed large, if any.

    classes: id long (unique), vals binary, marks binary."""
    child = "id long, tree int, path long"
    values = classes.select("id", "vals")
    nodes = values.select("id", F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("path"), "vals").mapInArrow(branch(join), child)
    small, large = [], None
    for level in range(join.depth):
        sizes = nodes.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        kept = narrow(nodes.join(sizes, "path"))
        small.append(kept.where(F.col("n") <= join.leaf).select("id", "path"))
        large = kept.where(F.col("n") > join.leaf)
        if large.isEmpty():
            large = None
            break
        if level + 1 < join.depth:
            nodes = large.join(values, "id").select("id", "tree", "path", "vals").mapInArrow(branch(join), child)
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    return rows, large


def compared(rows: DataFrame, what: DataFrame, join: Join, find, schema: str) -> DataFrame:
    """What `find` gives for the leaves of rows (id, path, lead, component). what: id, what."""
    rows = rows.join(what, "id").select("id", "path", "lead", "what", "component").repartition("path").sortWithinPartitions("path")
    return rows.mapInArrow(leaves(join, find, [f.split()[0] for f in schema.split(", ")]), schema)


def labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))


def sifted(large: DataFrame, groups: DataFrame, documents: DataFrame, join: Join) -> tuple[DataFrame, DataFrame] | None:
    """What is left to compare in large nodes (id, path), as leaves and as large nodes of few leads: (id, path) each; None: nothing.

    Pairs of nodes with many classes outside their largest component are taken to leaves by their rarest common shingles instead."""
    nodes = narrow(labelled(large.select("id", "path"), groups))
    several = nodes.groupBy("path").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("path")
    asked = narrow(nodes.join(several, "path", "left_semi").select("id", "component").distinct())
    if asked.isEmpty():
        return None
    sets = sets_of(asked.select(F.col("id").alias("doc_id")), documents, join, "<u4")
    need = F.ceil(F.octet_length("members") / 4 * join.percent / 100).cast("int")
    kept = sieved(sets.withColumnRenamed("doc_id", "id").join(asked, "id").select("id", "component", need.alias("need"), "members"))
    nodes = narrow(nodes.join(kept.select("id"), "id", "left_semi"))
    counts = nodes.groupBy("path", "component").agg(F.count("*").alias("n"))
    few = 8 * join.leaf
    heads = narrow(counts.groupBy("path").agg((F.sum("n") - F.max("n")).alias("others")).where("others > 0"))
    by_head = nodes.join(heads.where(F.col("others") <= few), "path", "left_semi").select("id", "path")
    spread = nodes.join(heads.where(F.col("others") > few), "path", "left_semi").select("id").distinct()
    shared = kept.join(spread, "id", "left_semi").select("id", "component", F.explode("first").alias("first")).select("id", "component", F.xxhash64("first", F.lit(2)).alias("path"))
    sizes = shared.groupBy("path").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    shared = narrow(shared.join(sizes.select("path", "n"), "path"))
    return shared.where(F.col("n") <= few).select("id", "path"), by_head.unionByName(shared.where(F.col("n") > few).select("id", "path"))


def mixed(rows: DataFrame, large: DataFrame | None, groups: DataFrame, join: Join) -> DataFrame:
    """(id, path, lead, component) of the leaves that hold several components, and of large nodes in parts.

    In a large node the classes outside its largest component are leads: blocks of 8 * leaf of them meet parts of
    about leaf * leaf of the node's other classes."""

    rows = labelled(rows, groups)
    several = rows.groupBy("path").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    out = rows.join(several.select("path"), "path", "left_semi").select("id", "path", F.lit(True).alias("lead"), "component")
    if large is None:
        return out
    nodes = narrow(labelled(large, groups).select("id", "path", "component"))
    counts = nodes.groupBy("path", "component").agg(F.count("*").alias("n"))
    heads = counts.groupBy("path").agg(F.max_by("component", "n").alias("head"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others"))
    heads = heads.where("others > 0").select("path", "head", F.ceil(F.col("others") / (8 * join.leaf)).cast("int").alias("blocks"), F.ceil(F.col("n") / join.leaf**2).cast("int").alias("parts"))
    rows = nodes.join(heads, "path").withColumn("lead", F.col("component") != F.col("head"))
    of = lambda n: F.pmod(F.xxhash64("id", "path"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cells = lambda xs, ys: F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("block"), y.alias("part")))))
    # a lead stands in its block's cells as a lead, and in its part's cells of the later blocks as one of the others
    leads = rows.where("lead").select("id", "path", "component", "lead", F.explode(cells(F.array(of("blocks")), every("parts"))).alias("cell"))
    later = rows.where("lead").select("id", "path", "component", F.lit(False).alias("lead"), F.explode(cells(F.filter(every("blocks"), lambda x: x < of("blocks")), F.array(of("parts")))).alias("cell"))
    rest = rows.where("not lead").select("id", "path", "component", "lead", F.explode(cells(every("blocks"), F.array(of("parts")))).alias("cell"))
    parts = leads.unionByName(later).unionByName(rest)
    return out.unionByName(parts.select("id", F.xxhash64("path", "cell.block", "cell.part", F.lit(1)).alias("path"), "lead", "component"))


def dealt(large: DataFrame, join: Join, pivots: int = 4) -> DataFrame:
    """Leaves (id, path) for nodes that stayed large: blocks of about `leaf` classes, each with the node's pivots."""
    heads = [F.min_by("id", F.hash("id", F.lit(i))).alias(f"head{i}") for i in range(pivots)]
    nodes = large.groupBy("path").agg(*heads, F.first("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / join.leaf).cast("int"))
    leaf = lambda block: F.xxhash64("path", block).alias("path")
    members = large.select("id", leaf(F.pmod(F.xxhash64("id", "path"), F.ceil(F.col("n") / join.leaf)).cast("int")))
    each = nodes.select(F.explode(F.array_distinct(F.array(*(f"head{i}" for i in range(pivots))))).alias("id"), "path", F.sequence(F.lit(0), F.col("blocks") - 1).alias("all"))
    return members.unionByName(each.select("id", "path", F.explode("all").alias("block")).select("id", leaf(F.col("block")))).distinct()


def sets_of(asked: DataFrame, documents: DataFrame, join: Join, kind: str) -> DataFrame:
    """doc_id, members: the sets of the documents asked for (doc_id), as hashes of shingles of 64 bits (<u8) or 32 (<u4)."""
    asked = narrow(asked.distinct())
    if asked.count() <= BROADCAST:  # else both sides are dealt out by id
        asked = F.broadcast(asked)

    def run(block):
        sets, ends = shingle_sets(*tb.utf8(block.column(1)), join.shingle)
        if kind == "<u4":
            sets = sets >> np.uint64(32)
        raw, at = sets.astype(kind).tobytes(), (ends * int(kind[-1])).tolist()
        yield pa.record_batch([block.column(0), pa.array([raw[x:y] for x, y in zip(at, at[1:])], pa.binary())], names=["doc_id", "members"])

    texts = documents.join(asked, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return tb.map_blocks(texts.select("doc_id", "text"), run, "doc_id long, members binary")


def confirm(pairs: DataFrame, documents: DataFrame, join: Join) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union.

    pairs: a, b and other columns. documents: doc_id long, text string. The sets of documents in pairs are
    moved, once for each side, as 64-bit hashes of their shingles.
    """
    names, n = pairs.columns, len(pairs.columns)
    sets = sets_of(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))), documents, join, "<u8")

    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(n), batch.column(n + 1))):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = same > 0 and 100 * same >= join.percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=names).filter(pa.array(keep))

    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("right"))
    return pairs.join(left, "a").join(right, "b").select(*names, "left", "right").mapInArrow(check, ", ".join(f"{c} long" for c in names))


def linked(classes: DataFrame, documents: DataFrame, join: Join) -> DataFrame:
    """id, component of the classes that confirmed links join. Cuts its steps into the shared folder."""
    rows, large = leaf_rows(classes, join)
    marks = classes.select("id", F.col("marks").alias("what"))
    first = rows if large is None else rows.unionByName(dealt(large, join))
    first = first.select("id", "path", F.lit(True).alias("lead"), F.lit(0).cast("long").alias("component"))
    named = compared(first, marks, join, partners, PARTNER).groupBy("a").agg(F.min(F.struct("late", "b")).alias("top"))
    pairs = narrow(named.select(F.least("a", "top.b").alias("a"), F.greatest("a", "top.b").alias("b")).distinct())
    groups = components(confirm(pairs, documents, join))
    if large is not None:
        more = sifted(large, groups, documents, join)
        large = None if more is None else more[1]
        rows = rows if more is None else rows.unionByName(more[0])

    def joined(crossing: DataFrame) -> DataFrame:
        best = crossing.groupBy("x", "y").agg(F.max(F.struct("share", "a", "b")).alias("top"))
        links = narrow(confirm(narrow(best.select("x", "y", "top.a", "top.b")), documents, join))
        return groups if links.isEmpty() else moved(groups, components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))

    groups = joined(compared(mixed(rows, large, groups, join), marks, join, bridges, CROSSING))
    open_rows = cut(compared(mixed(rows, large, groups, join), marks, join, entangled, "id long, lead boolean, component long, path long"))
    if open_rows.isEmpty():
        return groups
    sets = sets_of(open_rows.select(F.col("id").alias("doc_id")), documents, join, "<u4").select(F.col("doc_id").alias("id"), F.col("members").alias("what"))
    return joined(compared(open_rows, sets, join, verified, CROSSING))


def moved(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """groups (id, component) after their components were drawn together by parts (id: a component, component: its new one)."""
    every = groups.unionByName(parts.select("id", F.col("id").alias("component"))).distinct()
    to = parts.select(F.col("id").alias("component"), F.col("component").alias("next"))
    return few(every.join(to, "component", "left").select("id", F.coalesce("next", "component").alias("component")))


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """id, component: the smallest id that each id in a link can reach.

    Each round replaces an id's label by the smallest label among its neighbours and itself, then by its
    label's label; rounds end when nothing changes. Labels are cut into the shared folder each round.
    """
    x, y = F.col(a).alias("x"), F.col(b).alias("y")
    both = links.select(x, y).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y")))
    # an id is its own neighbour, so that a round's first join finds its label too
    both, n = counted(both.unionByName(both.select("x", F.col("x").alias("y"))).distinct())
    parts = both.rdd.getNumPartitions()
    told = (lambda df: F.broadcast(df)) if n <= SENT else (lambda df: df)  # there are fewer labels than rows of both
    labels = cut(both.groupBy("x").agg(F.min("y").alias("label")).select(F.col("x").alias("id"), "label").coalesce(parts))
    for _ in range(most):
        near = both.join(told(labels.select(F.col("id").alias("y"), "label")), "y").coalesce(parts).groupBy("x")
        hooked = near.agg(F.min("label").alias("next"), F.max(F.when(F.col("x") == F.col("y"), F.col("label"))).alias("label")).coalesce(parts)
        jump = told(labels.select(F.col("id").alias("next"), F.col("label").alias("further")))
        settled = cut(hooked.join(jump, "next").select(F.col("x").alias("id"), F.least("next", "further").alias("label"), (F.least("next", "further") < F.col("label")).alias("moved")).coalesce(parts))
        labels = settled.select("id", "label")
        if settled.where("moved").isEmpty():
            return told(labels.withColumnRenamed("label", "component"))
    raise RuntimeError(f"components did not settle in {most} rounds")


def told_apart(rows: DataFrame, source: DataFrame, join: Join) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """For ids of several texts an id for each text, above all others: rows and source so, and (doc_id, own) of the new ids; None: there are none.

    rows: of `sketches`. source: doc_id, text."""
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("set_key", F.lit(b""))).alias("lo"), F.max(F.coalesce("set_key", F.lit(b""))).alias("hi"))
    several = several.where("lo < hi").select("doc_id")
    if several.isEmpty():
        return None
    several = cut(several)
    above = rows.agg(F.max("doc_id")).first()[0] + 1
    texts = source.join(several, "doc_id", "left_semi").distinct().withColumnRenamed("doc_id", "own")
    texts = cut(positioned(texts, ["own", "text"], "at").select("own", (F.col("at") + above).alias("doc_id"), "text"))
    new = texts.select("doc_id", "text")
    rows = cut(rows.join(several, "doc_id", "left_anti").select(rows.columns).unionByName(sketches(new, join)))
    return rows, source.join(several, "doc_id", "left_anti").unionByName(new), texts


def near_duplicates(documents: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document.

    Null or empty text: an empty set, linked with nothing, its own component, kept. A repeated row has
    its copies' component; a document is kept if its id is the component's smallest, so rows that repeat
    that id are all kept here. Texts that share an id count as linked, each with its own set. Rows with a
    null key have a null component and are kept. Other columns are not read.
    """
    source = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    every = narrow(sketches(source, join))
    apart = told_apart(every, source, join)
    rows, source, texts = apart or (every, source, None)
    full = rows.where("set_key is not null and doc_id is not null")
    keys = full.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    classes = narrow(rows.select(F.col("doc_id").alias("id"), "set_key", "vals", "marks").join(keys, ["id", "set_key"], "left_semi").dropDuplicates(["id"]).drop("set_key"))
    found = linked(classes, source, join)
    of_class = keys.join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    component = F.coalesce("component", "doc_id")
    out = rows.drop("vals", "marks").join(of_class, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    if texts is not None:  # the components of an id's texts are one, whose smallest id is that or a smaller one
        out = cut(out)
        ties = out.join(texts.select("doc_id", "own"), "doc_id").select(F.col("component_id").alias("a"), F.col("own").alias("b"))
        drawn = components(ties).withColumnRenamed("id", "component_id")
        out = out.join(drawn, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
        own = out.join(texts, "doc_id").select("own", "text", "n_shingles", "component_id")
        again = source_rows(documents, key, text).join(own, F.col("doc_id").eqNullSafe(F.col("own")) & F.col("__text").eqNullSafe(F.col("text")))
        out = out.join(texts.select("doc_id"), "doc_id", "left_anti").unionByName(again.select("doc_id", "n_shingles", "component_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).alias("kept"))


def source_rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
