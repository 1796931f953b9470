"""Removal of repeated byte strings by suffix arrays, over documents of any number.

Documents are dealt once, into parts of bounded size; all that follows stays with these parts.

1. Every string of `length` bytes has a minimizer: the smallest hash among its pieces of `gram` bytes.
   Equal strings have equal minimizers, so a part sends no text at first, only its distinct minimizers as
   sorted, packed numbers. Where they meet, those that two rows hold are told back to their parts. A
   corpus is mostly text of its own: the rest goes on, be it a tenth or a third.
2. The strings with such a minimizer are cut into *stretches*: runs of string starts with one minimizer of
   shorter pieces (`route`), and the bytes their strings cover. Stretches are dealt out by it: whatever is
   equal meets in one bucket, and buckets know nothing of each other. Strings whose minimizer `hot` parts
   hold are dealt out one by one, by all of their bytes, so no phrase gathers its surroundings in one task.
3. Within a bucket the distinct stretches are laid end to end and their suffixes sorted in two stages:
   suffixes smaller than their successors are sorted directly; all others are induced from those by
   scanning the buckets of first characters in order. Common prefixes of neighbours in that order give the
   groups of equal strings, and with them the smallest document that each string starts in.

A part sends each distinct stretch once, with the smallest document it has there, and its occurrences
(stretch, row, place) behind them. A task keeps the distinct stretches of one bucket; occurrences only
stream through it. The numbers of parts and buckets follow the input's size.

Null or empty text: nothing to remove, the digest of no bytes. A document shorter than `length` keeps all
its bytes. Rows of one doc_id never remove each other's bytes. A null doc_id counts as larger than all.
Repeated rows give repeated results. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import parts
from loomset.llm import textbatch as tb
from loomset.llm.parts import Plan, items, pack, planes, unpack

LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Options:
    length: int = 50
    gram: int = 32  # bytes of the pieces by which strings are found that may be repeated
    route: int = 16  # and of those by which they are dealt out
    part: int = 4 << 20  # bytes of text in a part, about
    block: int = 2 << 20  # bytes of text that one task looks at together
    bucket: int = 8 << 20  # bytes of the input for each bucket
    hot: int = 4096  # parts that hold a minimizer, from where its strings are dealt out one by one


# -- two-stage suffix sorting ------------------------------------------------------------------------


def ranks_of_eight(text: np.ndarray) -> np.ndarray:
    """Dense ranks of the eight characters from each position on; text: uint8, zeros behind its end."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key |= wide[i : i + n]
    order = np.argsort(key)
    new = np.append(False, np.diff(key[order]) != 0)
    rank = np.empty(n, np.uint32)
    rank[order] = np.cumsum(new)
    return rank


def direct(start: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """The positions in `start` sorted by the `length` characters from there (whole eights)."""
    n = len(rank)
    order = np.argsort(rank[start], kind="stable")
    group = rank[start][order].astype(np.uint64)
    for at in range(8, length, 8):
        # only ties are sorted on
        same = np.append(group[1:] == group[:-1], False)
        tied = np.flatnonzero(same | np.append(False, same[:-1]))
        if not len(tied):
            break
        place = start[order[tied]] + at
        nearer = np.where(place < n, rank[np.minimum(place, n - 1)], 0).astype(np.uint64)
        own = np.cumsum(np.append(True, np.diff(group[tied]) != 0)).astype(np.uint64)
        key = own << np.uint64(32) | nearer
        inner = np.argsort(key, kind="stable")
        order[tied] = order[tied][inner]
        key = key[inner]
        # groups get new numbers: those tied split where the longer key changes
        fresh = np.append(True, group[1:] != group[:-1])
        fresh[tied] = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(fresh).astype(np.uint64)
    return start[order]


def two_stage(text: np.ndarray, length: int, rank: np.ndarray | None = None) -> np.ndarray:
    """All positions of text, sorted by `length` characters or more from there."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    rank = ranks_of_eight(text) if rank is None else rank
    # a suffix is smaller than its successor if its run of equal characters is followed by a larger one
    change = np.flatnonzero(text[1:] != text[:-1])
    nearest = np.searchsorted(change, np.arange(n))
    tail = np.append(change, n - 1)[nearest]  # last position of the run
    follows = np.append(text, 0)[tail + 1]
    smaller = (follows > text) & (tail < n - 1)
    out = np.full(n, -1, np.int64)
    count = np.bincount(text, minlength=256)
    low = np.cumsum(count) - count
    sorted_directly = direct(np.flatnonzero(smaller), rank, length)
    chars = text[sorted_directly]
    many = np.bincount(chars, minlength=256)
    begin = low + count - many  # those smaller than their successors stand last among their first character
    within = np.arange(len(chars)) - (np.cumsum(many) - many)[chars]
    out[begin[chars] + within] = sorted_directly
    head = low.copy()
    # the last suffix follows nothing: it comes first in its bucket
    if not smaller[n - 1]:
        out[head[text[n - 1]]] = n - 1
        head[text[n - 1]] += 1
    for c in np.flatnonzero(count):
        done = int(low[c])
        while done < head[c]:  # predecessors with the same character join this bucket while it is scanned
            here = out[done : head[c]]
            done = int(head[c])
            before = here[here > 0] - 1
            before = before[(text[before] == c) & ~smaller[before]]
            out[head[c] : head[c] + len(before)] = before
            head[c] += len(before)
        here = out[low[c] : low[c] + count[c]]
        before = here[here > 0] - 1
        before = before[~smaller[before] & (text[before] > c)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        many = np.bincount(first, minlength=256)
        out[head[first] + np.arange(len(first)) - (np.cumsum(many) - many)[first]] = before
        head += many
    return out


def common_prefixes(order: np.ndarray, text: np.ndarray, rank: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Of each suffix in order and the one before it: common characters, up to `length` and to either's end (left)."""
    n = len(text)
    a, b = order[:-1], order[1:]
    most = np.minimum(np.minimum(left[a], left[b]), length)
    at = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most >= 8)
    while len(live):
        step = at[live]
        live = live[rank[a[live] + step] == rank[b[live] + step]]
        at[live] += 8
        live = live[at[live] + 8 <= most[live]]
    live = np.flatnonzero(at < most)
    while len(live):
        step = at[live]
        live = live[text[a[live] + step] == text[b[live] + step]]
        at[live] += 1
        live = live[at[live] < most[live]]
    return np.concatenate([np.zeros(min(1, len(order)), np.int64), at])


def smallest_owner(flat: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each string start in stretches laid end to end, the smallest owner of an equal string; LAST elsewhere.

    Suffixes are sorted by their next `length` characters, wherever their own stretch ends. Those with
    fewer left are dropped from the order, which leaves equal strings side by side.
    """
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    rank = ranks_of_eight(flat)
    order = two_stage(flat, length, rank)
    order = order[left[order] >= length]
    first = np.flatnonzero(common_prefixes(order, flat, rank, left, length) < length)
    out = np.full(len(flat), LAST, np.int64)
    if len(first):
        least = np.minimum.reduceat(np.repeat(owner, sizes)[order], first)
        out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


# -- stretches -----------------------------------------------------------------------------------------


def minimizers(data: np.ndarray, gram: int, width: int) -> np.ndarray:
    """The smallest hash of the `width` pieces of `gram` bytes from each position on."""
    n = len(data)
    h = tb.CODES[data]
    size = 1
    parts = {1: h} if gram & 1 else {}
    while size * 2 <= gram:
        factor = np.uint64(pow(int(tb.BASE), size, 1 << 64))
        h = h[: len(h) - size] * factor + h[size:]
        size *= 2
        if gram & size:
            parts[size] = h
    done, whole = 0, np.zeros(n, np.uint64)
    for s in sorted(parts, reverse=True):
        if done + s <= gram and gram & s:
            factor = np.uint64(pow(int(tb.BASE), s, 1 << 64))
            m = n - done - s + 1
            whole = (whole[:m] * factor if done else np.zeros(m, np.uint64)) + parts[s][done : done + m]
            done += s
    low = tb.mix(whole)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def stretches_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, size in bytes and minimizer of each stretch of a block; only: which string starts count."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    low = minimizers(data, gram, length - gram + 1)[:n]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[1:][row]
    if only is not None:
        inside &= only[:n]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    return row[start], start, stop - start + length - 1, low[start]


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]


def names(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each byte range."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tb.CODES[data] * tb.powers("base", tb.BASE, len(data)), out=prefix[1:])
    return tb.mix((prefix[start + size] - prefix[start]) * tb.powers("back", tb.BASE_INV, len(data) + 1)[start] + size.astype(np.uint64))


# -- stretches and who has them ----------------------------------------------------------------------------------------

SENT = "bucket int, kind int, part int, piece long, body binary"


def sender(o: Options, plan: Plan):
    """applyInArrow function: from a part's rows and the minimizers told to it, packed stretches (kind 0) and occurrences (kind 1) by bucket."""

    def pieces(rows: pa.Table, told: pa.Table):
        part = rows["part"][0].as_py()
        mark, hot = parts.known(told)
        for number, block in enumerate(tb.blocks(rows.to_batches(), "text", o.block)):
            data, offsets = tb.utf8(block.column(3))
            row, start, size, low = stretches_of(data, offsets, o.length, o.gram)
            told_of, at = parts.among(plan.marks(low), mark)
            masks = []
            for which in (told_of & ~hot[at], told_of & hot[at]):
                mask = np.zeros(len(data) + 1, np.int32)
                mask[start[which]] += 1
                np.add.at(mask, start[which] + size[which] - o.length + 1, -1)
                masks.append(np.cumsum(mask[:-1]) > 0)
            row, start, size, low = stretches_of(data, offsets, o.length, o.route, masks[0])
            single = np.flatnonzero(masks[1])
            if len(single):
                size_1 = np.full(len(single), o.length)
                row = np.concatenate([row, np.searchsorted(offsets, single, "right") - 1])
                start, size, low = np.concatenate([start, single]), np.concatenate([size, size_1]), np.concatenate([low, names(data, single, size_1)])
            if len(row):
                yield from packed(part, number, block, data, offsets, row, start, size, low)

    def packed(part, number, block, data, offsets, row, start, size, low):
        keys, ids = block.column(1).to_numpy(), block.column(2).fill_null(LAST).to_numpy()
        name = names(data, start, size)
        bucket = (low % np.uint64(plan.buckets)).astype(np.int64)
        order = np.lexsort((ids[row], name, bucket))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (bucket[order][1:] != bucket[order][:-1]))
        first = order[new]  # the distinct stretches, each of its smallest document
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        # in text order within a bucket, they and their occurrences
        told = np.lexsort((start[first], bucket[first]))
        rank = np.empty(len(told), np.int64)
        rank[told] = np.arange(len(told))
        first, of = first[told], rank[of]
        seen = np.lexsort((start, bucket))
        for b in np.unique(bucket).tolist():
            lo, hi = np.searchsorted(bucket[first], [b, b + 1])
            f = first[lo:hi]
            yield b, 0, part, number, pack(planes(size[f], "<u4"), planes(ids[row[f]], "<i8"), gather(data, start[f], size[f]))
            s = seen[slice(*np.searchsorted(bucket[seen], [b, b + 1]))]
            own, which = np.unique(row[s], return_inverse=True)
            place = start[s] - offsets[:-1][row[s]]
            yield b, 1, part, number, pack(planes(np.diff(of[s], prepend=lo), "<i4"), planes(np.diff(which, prepend=0), "<i4"), planes(place, "<u4"), planes(keys[own], "<i8"), planes(ids[own], "<i8"))

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = list(pieces(rows, told)) if rows.num_rows and told.num_rows else []
        tb.release()
        return parts.table_of(out, SENT, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))

    return run


# -- buckets ------------------------------------------------------------------------------------------


class Bucket:
    """The distinct stretches of one bucket, and after `settle` the smallest owner of each of their strings."""

    def __init__(self, o: Options):
        self.o, self.parts, self.held, self.known, self.names = o, [], 0, None, {}

    def add(self, piece: tuple, body: bytes) -> None:
        size, owner, flat = unpack(body, "u1", "u1", "u1")
        size, owner = items(size, "<u4").astype(np.int64), items(owner, "<i8")
        name = names(flat, np.cumsum(size) - size, size)
        self.names[piece] = name
        self.parts.append([name, size, owner, flat])
        self.held += len(flat)
        if self.known is None and self.held > 64 << 20 or self.known and self.held > 2 * len(self.known[3]) + (64 << 20):
            self.merge()

    def merge(self) -> None:
        """Keeps each distinct stretch once, with its smallest document."""
        parts = ([self.known] if self.known else []) + self.parts
        name, size, owner, flat = (np.concatenate(x) for x in zip(*parts))
        begin = np.cumsum(size) - size
        order = np.lexsort((owner, name))
        keep = order[np.append(True, np.diff(name[order]) != 0)]
        self.known = [name[keep], size[keep], owner[keep], gather(flat, begin[keep], size[keep])]
        self.parts, self.held = [], len(self.known[3])

    def settle(self) -> None:
        self.merge()
        self.name, size, owner, flat = self.known
        self.windows = size - self.o.length + 1
        self.first = np.cumsum(size) - size
        self.strings = smallest_owner(flat, size, owner, self.o.length)
        self.known = None

    def removed(self, piece: tuple, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row_key, start and end of the bytes of these occurrences that smaller documents have."""
        of, which, place, keys, ids = unpack(body, *["u1"] * 5)
        own = np.searchsorted(self.name, self.names[piece])[np.cumsum(items(of, "<i4"))]
        which, place = np.cumsum(items(which, "<i4")), items(place, "<u4").astype(np.int64)
        key, doc = items(keys, "<i8")[which], items(ids, "<i8")[which]
        n = self.windows[own]
        first = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(first, n)
        gone = self.strings[np.repeat(self.first[own], n) + inner] < np.repeat(doc, n)
        edge = np.zeros(len(gone), bool)
        edge[first] = True
        opens = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])))
        shuts = np.flatnonzero(gone & np.append(edge[1:] | ~gone[1:], True))
        at = np.repeat(np.arange(len(n)), n)[opens]
        return key[at], place[at] + inner[opens], place[at] + inner[shuts] + self.o.length


SPAN = "part int, row_key long, start int, stop int"


def receiver(o: Options):
    """mapInArrow function: from rows sorted by bucket and kind, the removed byte ranges of rows."""

    def run(batches):
        now, bucket, settled = None, None, False
        for batch in batches:
            for b, kind, part, number, body in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if b != now:
                    now, bucket, settled = b, Bucket(o), False
                if kind == 0:
                    bucket.add((part, number), body.as_py())
                    continue
                if not settled:
                    bucket.settle()
                    settled = True
                key, start, stop = bucket.removed((part, number), body.as_py())
                if len(key):
                    yield pa.record_batch([pa.array(np.full(len(key), part, np.int32)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["part", "row_key", "start", "stop"])
        del bucket
        tb.release()

    return run


def source_of(documents: DataFrame, o: Options, key: str, text: str) -> tuple[DataFrame, Plan]:
    """(part, row_key, doc_id, text) in parts, and the plan. row_key is a hash of the key and the text; rows are told apart by it within a part only."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = documents.select(F.xxhash64(F.col(key), t).alias("row_key"), F.col(key).cast("long").alias("doc_id"), t.alias("text"))
    plan = parts.planned(source, o.part, o.bucket)
    return parts.dealt(source, F.xxhash64("row_key", F.spark_partition_id()), plan), plan


def repeated(rows: DataFrame, plan: Plan, o: Options = Options()) -> DataFrame:
    """part, row_key, start, stop: byte ranges that documents of smaller ids hold too. rows and plan: of `source_of`."""

    def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, _, _, low = stretches_of(data, offsets, o.length, o.gram)
        return row, low

    told = parts.told(rows, plan, find, o.hot, o.block)
    sent = rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(sender(o, plan), SENT)
    return sent.repartition(min(plan.buckets, parts.TASKS), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(receiver(o), SPAN)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def kept_bytes(documents: DataFrame, o: Options = Options(), key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes) and kept_sha256 of each document."""
    rows, plan = source_of(documents, o, key, text)

    def run(rows: pa.Table, spans: pa.Table) -> pa.Table:
        keys = spans["row_key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, starts, stops = keys[order], spans["start"].to_numpy()[order], spans["stop"].to_numpy()[order]
        out = []
        for batch in rows.to_batches():
            own = batch.column(1).to_numpy()
            bounds = zip(np.searchsorted(keys, own).tolist(), np.searchsorted(keys, own, "right").tolist())
            for doc, t, (lo, hi) in zip(batch.column(2).to_pylist(), batch.column(3), bounds):
                data = t.as_py().encode()
                removed = runs = 0
                kept = data
                if lo < hi:
                    delta = np.zeros(len(data) + 1, np.int32)
                    np.add.at(delta, starts[lo:hi], 1)
                    np.add.at(delta, stops[lo:hi], -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    removed, runs = int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc, len(data), removed, runs, kept if with_bytes else None, hashlib.sha256(kept).hexdigest()))
        tb.release()
        return parts.table_of(out, KEPT, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))

    return rows.groupBy("part").cogroup(repeated(rows, plan, o).groupBy("part")).applyInArrow(run, KEPT)
