"""SentencePiece segmentations sampled without replacement: Gumbel top-k over the lattice.

A text is encoded as SentencePiece does it: a space in front, each space a word mark, and characters
without a piece as their bytes. Its segmentations form a lattice; with piece scores as log weights, each
has a probability. If every segmentation's log probability is perturbed by an independent Gumbel value,
the k largest are a sample without replacement. They are found best first, as in A*: the agenda holds
sets of segmentations (a prefix, and what may not follow it) with the largest perturbed value in the set;
popping the largest set completes one segmentation from it, exactly, by the lattice's backward sums, and
splits what is left of the set into one set for each step of that path. A child's maximum is a Gumbel
value truncated at its parent's.

The lattice of a text is the chain of the lattices of its units (a run of white space and the word after
it), because no piece holds white space behind another character. Units repeat, so a block of rows builds
one lattice for each distinct unit and walks all their occurrences at once. Random numbers are hashes of
the row's key, the sample's number and the place in the text: a row gives the same samples wherever it runs.

BPE models have ranks for scores; a piece of rank r then weighs 1 / (r + 2), a byte 1 / (pieces + 2).

Null or empty text: one segmentation without tokens, of probability 1. A text with fewer than k
segmentations gives all that it has. U+2581 in a text is encoded as bytes, so that decoding restores it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import textbatch as tb

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
FIELDS = "sample int, n_tokens long, ids binary, log_prob double, perturbed double, log_inclusion double, decodes boolean"


@dataclass(frozen=True)
class Sampling:
    vocabulary: str = VOCABULARY
    k: int = 2
    theta: float = 1.0  # inverse temperature of the scores
    seed: int = 7
    block: int = 3 << 19  # bytes of text whose distinct units share lattices
    part: int = 1 << 19  # bytes of text that are walked at once


class Vocabulary:
    """Pieces by the hash of their bytes, and the bytes of each id."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        scores = np.array([m.get_score(i) for i in plain])
        ranked = len(plain) > 2 and (scores <= 0).all() and (scores == np.floor(scores)).all()
        self.log = np.full(n, -np.inf)
        self.log[plain] = theta * (-np.log(-scores + 2) if ranked else scores)
        self.byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_log = theta * (-np.log(n + 2) if ranked else scores.min() - 10)
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = m.id_to_piece(i).replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        known = {self.bytes[i]: i for i in reversed(plain) if self.bytes[i]}
        for piece in list(known):
            for size in range(1, len(piece)):
                known.setdefault(piece[:size], -1)  # what a longer piece begins with
        flat = np.frombuffer(b"".join(known), np.uint8)
        size = np.array([len(b) for b in known])
        self.longest = int(size.max())
        end = np.cumsum(size)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(tb.CODES[flat] * tb.powers("base", tb.BASE, len(flat)))])
        key = hashed(prefix, end - size, end)
        order = np.argsort(key)
        self.key, self.id = np.append(key[order], np.uint64((1 << 64) - 1)), np.append(np.array(list(known.values()), np.int32)[order], -2)
        self.slot = np.searchsorted(self.key[:-1], np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.cumsum(self.sizes) - self.sizes

    def find(self, key: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; -1 for the beginning of a piece, -2 for neither."""
        at = self.slot[(key >> np.uint64(46)).astype(np.int64)]
        live = np.flatnonzero(self.key[at] < key)
        while len(live):
            at[live] += 1
            live = live[self.key[at[live]] < key[live]]
        return np.where(self.key[at] == key, self.id[at], np.int32(-2))


def hashed(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    back = tb.powers("back", tb.BASE_INV, len(prefix))
    return tb.mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))


_vocabularies: dict[tuple, Vocabulary] = {}


def vocabulary_for(path: str, theta: float) -> Vocabulary:
    if (path, theta) not in _vocabularies:
        _vocabularies[path, theta] = Vocabulary(path, theta)
    return _vocabularies[path, theta]


def stream(seeds: np.ndarray, number: int) -> np.ndarray:
    """A start for each row's random numbers of one purpose."""
    return tb.mix(seeds + np.array(number, np.uint64) * tb.BASE)


def uniform(start: np.ndarray, place: np.ndarray | int = 0) -> np.ndarray:
    """Numbers in (0, 1) by hash of a stream's start and a place in it."""
    h = tb.mix(start + np.asarray(place, np.uint64) * tb.BASE)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Lattices:
    """The lattices of distinct units laid end to end: edges by start, with the probability of each given its start."""

    CHUNK = 1 << 19  # bytes that are worked on at once

    def __init__(self, data: np.ndarray, ends: np.ndarray, v: Vocabulary):
        self.data, self.ends, self.starts = data, ends, np.concatenate([np.zeros(1, np.int64), ends])[:-1]
        parts, at = [], 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, self.starts[at] + self.CHUNK, "right")))
            base = int(self.starts[at])
            start, size, ids, log = edges_of(data[base : ends[to - 1]], ends[at:to] - base, v)
            parts.append((start + np.int32(base), size, ids, log))
            at = to
        none = (np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.float32))
        self.start, self.size, self.id, self.log = (np.concatenate(x) for x in zip(none, *parts))
        many = np.bincount(self.start, minlength=len(data)) if len(self.start) else np.zeros(len(data), np.int64)
        self.lo = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        before = np.concatenate([[0.0], np.cumsum(np.exp(self.log, dtype=np.float64))])[:-1]
        self.below = (before - before[self.lo[self.start]]).astype(np.float32)  # of the edges before it with its start

    def pick(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge = self.lo[at + 1] - 1  # the longest piece, which is the likeliest most often
        live = np.flatnonzero(self.below[edge] > u)
        while len(live):
            edge[live] -= 1
            live = live[self.below[edge[live]] > u[live]]
        return edge


def edges_of(data: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size, id (-1: the character's bytes) and conditional log probability of the edges of units that end at `ends`."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(tb.CODES[data] * tb.powers("base", tb.BASE, n), out=prefix[1:])
    left = (np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)).astype(np.int32)
    head = (data & 0xC0) != 0x80
    here = np.flatnonzero(head).astype(np.int32)
    width = np.diff(here, append=np.int32(n))
    own = np.zeros(n, np.int32)
    own[here] = width
    has = np.zeros(n, bool)
    back, first, rest = tb.powers("back", tb.BASE_INV, n + 1)[here], prefix[here], left[here]
    start, size, ids = [], [], []
    for length in range(1, v.longest + 1):
        far = rest >= length
        if not far.all():
            here, back, first, rest = here[far], back[far], first[far], rest[far]
        if not len(here):
            break
        found = v.find(tb.mix((prefix[here + length] - first) * back + np.uint64(length)))
        hit, more = np.flatnonzero(found >= 0), found > -2
        start.append(here[hit])
        size.append(np.full(len(hit), length, np.uint8))
        ids.append(found[hit])
        has[here[hit][own[here[hit]] == length]] = True
        here, back, first, rest = here[more], back[more], first[more], rest[more]
    bare = np.flatnonzero(head & ~has).astype(np.int32)
    start = np.concatenate([*start, bare])
    size = np.concatenate([*size, own[bare].astype(np.uint8)])
    ids = np.concatenate([*ids, np.full(len(bare), -1, np.int32)])
    score = np.where(ids >= 0, v.log[ids], v.byte_log * size)
    order = np.argsort(start, kind="stable")
    start, size, ids, score = start[order], size[order], ids[order], score[order]
    # backward sums, all units at once, by distance from the unit's end
    away = left[start]
    order = np.argsort(away.astype(np.uint16) if len(away) and away.max() < 1 << 16 else away, kind="stable")
    s_o, away, x_o = start[order], away[order], score[order]
    end = s_o + size[order]
    beta = np.zeros(n + 1)
    inner = size[order] < away
    value = np.empty(len(start))
    new = np.append(True, s_o[1:] != s_o[:-1]) if len(s_o) else np.zeros(0, bool)
    bounds = np.append(np.flatnonzero(np.append(True, away[1:] != away[:-1])), len(away)) if len(away) else []
    for lo, hi in zip(bounds, bounds[1:]):
        x = x_o[lo:hi] + beta[end[lo:hi]] * inner[lo:hi]
        at = np.flatnonzero(new[lo:hi])
        which = np.cumsum(new[lo:hi]) - 1
        top = np.maximum.reduceat(x, at)
        total = top + np.log(np.add.reduceat(np.exp(x - top[which]), at))
        beta[s_o[lo:hi][at]] = total
        value[lo:hi] = x - total[which]
    log = np.empty(len(start), np.float32)
    log[order] = value
    return start, size, ids, log


@dataclass
class Path:
    """One segmentation of each row: its edges, and for each token the best of the set that leaves the path there."""

    edges: np.ndarray
    unit: np.ndarray  # occurrence that each token is in
    bounds: np.ndarray  # of the rows' tokens
    best: np.ndarray
    taken: list  # by row: {token: edges that were taken there}


class Units:
    """The units of a block's rows and the lattices of the distinct ones."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, v: Vocabulary):
        full = np.diff(offsets) > 0
        shift = np.concatenate([[0], np.cumsum(full)])
        self.offsets = offsets + shift
        text = np.full(int(self.offsets[-1]), 0x20, np.uint8)
        text[np.arange(len(data)) + np.repeat(shift[1:], np.diff(offsets))] = data
        white = tb.SPACE[text]
        first = white.copy()
        first[1:] &= ~white[:-1]
        first[self.offsets[:-1][full]] = True
        self.at = np.flatnonzero(first)
        end = np.append(self.at[1:], len(text))
        self.bounds = np.searchsorted(self.at, self.offsets)
        prefix = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(tb.CODES[text] * tb.powers("base", tb.BASE, len(text)), out=prefix[1:])
        _, where, back = np.unique(hashed(prefix, self.at, end), return_index=True, return_inverse=True)
        del prefix
        size = end[where] - self.at[where]
        ends = np.cumsum(size)
        self.lattice = Lattices(text[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[where] - (ends - size), size)], ends, v)
        self.start, self.end = self.lattice.starts[back].astype(np.int32), ends[back].astype(np.int32)


class Block:
    """The samples of some rows of a block."""

    def __init__(self, units: Units, lo: int, hi: int, seeds: np.ndarray, v: Vocabulary, options: Sampling):
        self.v, self.options, self.seeds, self.rows, self.lattice = v, options, seeds[lo:hi], hi - lo, units.lattice
        a, b = units.bounds[lo], units.bounds[hi]
        self.offsets, self.at = units.offsets[lo : hi + 1] - units.offsets[lo], units.at[a:b] - units.offsets[lo]
        self.unit_bounds = units.bounds[lo : hi + 1] - a
        self.row = np.repeat(np.arange(self.rows), np.diff(self.unit_bounds))
        self.unit_start, self.unit_end = units.start[a:b], units.end[a:b]

    def walk(self, units: np.ndarray, at: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Completes occurrences of units from lattice positions: edges in order of units, and how many each has."""
        place = np.empty(len(units), np.int64)  # in order of distinct units, so that neighbours look up neighbours
        rank = np.argsort(at, kind="stable")
        cur, unit = at[rank], units[rank]
        live = np.flatnonzero(cur < self.unit_end[unit])
        count = np.zeros(len(units), np.int64)
        steps = []
        lattice = self.lattice
        row = self.row[unit]
        # a stream for each occurrence, by its place in the row; places in it count from the unit's start
        begin = stream(self.seeds, sample)[row] + (self.at[unit] - self.offsets[row] - self.unit_start[unit]).astype(np.uint64) * tb.BASE
        while len(live):
            u_live, c_live = unit[live], cur[live]
            u = uniform(begin[live], c_live)
            e = lattice.pick(c_live, u)
            steps.append((live, e.astype(np.int32)))
            count[live] += 1
            c_live = c_live + lattice.size[e]
            cur[live] = c_live
            live = live[c_live < self.unit_end[u_live]]
        place[rank] = count
        offset = np.empty(len(units), np.int64)
        offset[rank] = (np.cumsum(place) - place)[rank]
        offset = offset[rank]
        out = np.empty(int(place.sum()), np.int32)
        for i, (live, e) in enumerate(steps):
            out[offset[live] + i] = e
        return out, place

    def leave(self, path: Path, sample: int, first: np.ndarray, top: np.ndarray) -> None:
        """Draws path.best for each token from `first` on: the largest perturbed value, below `top`, among what leaves there."""
        log = self.lattice.log[path.edges].astype(np.float64)
        row = np.repeat(np.arange(self.rows), np.diff(path.bounds))
        total = np.concatenate([[0.0], np.cumsum(log, dtype=np.float64)])
        token = np.arange(len(log))
        before = total[:-1] - total[path.bounds[:-1]][row]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            mass = before + np.log(np.maximum(-np.expm1(np.minimum(log, 0.0)), 0.0))
            u = uniform(stream(self.seeds, sample + 1000)[row], token - path.bounds[:-1][row])
            best = mass - np.log(np.exp(np.minimum(mass - top[row], 700.0)) - np.log(u))
        best[(log > -1e-7) | (token < first[row])] = -np.inf
        path.best = best

    def run(self) -> list[tuple]:
        """(row, sample, edges, log probability, perturbed value) of every sample, then the agenda's best left for each row."""
        rows, k = self.rows, self.options.k
        g = -np.log(-np.log(uniform(stream(self.seeds, 500))))
        edges, count = self.walk(np.arange(len(self.at)), self.unit_start.astype(np.int64), 0)
        unit = np.repeat(np.arange(len(self.at)), count)
        bounds = np.concatenate([[0], np.cumsum(count)])[self.unit_bounds]
        path = Path(edges, unit, bounds, np.zeros(0), [{} for _ in range(rows)])
        self.leave(path, 0, path.bounds[:-1], g)
        paths, values = [path], [g]
        alive = np.ones(rows, bool)
        for r in range(1, k):
            path, g, some = self.next(paths, r, alive)
            alive &= some
            paths.append(path)
            values.append(g)
            if not alive.any():
                break
        rest = np.full(rows, -np.inf)
        for path in paths:
            rest = np.maximum(rest, self.tops(path)[0])
        return paths, values, rest

    def tops(self, path: Path) -> tuple[np.ndarray, np.ndarray]:
        """Each row's best value on a path, and the token it is at."""
        best, at = np.full(self.rows, -np.inf), np.zeros(self.rows, np.int64)
        full = np.flatnonzero(np.diff(path.bounds))
        if len(full):
            best[full] = np.maximum.reduceat(path.best, path.bounds[:-1][full])
            hit = np.flatnonzero(path.best == np.repeat(best, np.diff(path.bounds)))
            row = np.searchsorted(path.bounds, hit, "right") - 1
            at[row[::-1]] = hit[::-1]
        return best, at

    def next(self, paths: list[Path], r: int, alive: np.ndarray) -> tuple[Path, np.ndarray, np.ndarray]:
        """Pops each row's best set and completes a path from it."""
        lattice = self.lattice
        best, at = (np.stack(x) for x in zip(*map(self.tops, paths)))
        which = best.argmax(axis=0)
        g = best.max(axis=0)
        some = alive & np.isfinite(g)
        base = np.array([p.bounds[:-1] for p in paths])
        heads, edge, units, starts = [], [], [], []
        for row in np.flatnonzero(some).tolist():
            path = paths[which[row]]
            t = int(at[which[row], row])
            old = int(path.edges[t])
            taken = path.taken[row].setdefault(t, [old])
            lo, hi = int(lattice.lo[int(lattice.start[old])]), int(lattice.lo[int(lattice.start[old]) + 1])
            p = np.exp(lattice.log[lo:hi])
            p[[e - lo for e in taken]] = 0
            p = np.cumsum(p)
            u = float(uniform(stream(self.seeds[row : row + 1], r + 2000), t - int(path.bounds[row]))[0])
            new = lo + min(int(np.searchsorted(p, u * p[-1], "right")), hi - lo - 1)
            taken.append(new)
            left = np.exp(lattice.log[lo:hi])
            left[[e - lo for e in taken]] = 0
            before = float(lattice.log[path.edges[path.bounds[row] : t]].sum(dtype=np.float64))
            if len(taken) < hi - lo and left.sum() > 0:
                mass = before + np.log(left.sum())
                u = float(uniform(stream(self.seeds[row : row + 1], r + 3000), t - int(path.bounds[row]))[0])
                path.best[t] = mass - np.log(np.exp(min(mass - g[row], 700.0)) - np.log(u))
            else:
                path.best[t] = -np.inf
            heads.append((row, t))
            edge.append(new)
            here = int(path.unit[t])
            units.append(np.arange(here, self.unit_bounds[row + 1]))
            begin = self.unit_start[here : self.unit_bounds[row + 1]].astype(np.int64)
            begin[0] = int(lattice.start[new]) + int(lattice.size[new])
            starts.append(begin)
        none = np.zeros(0, np.int64)
        suffix, count = self.walk(np.concatenate([none, *units]), np.concatenate([none, *starts]), r)
        tokens_unit = np.repeat(np.concatenate([none, *units]), count)
        size = np.array([len(x) for x in units], np.int64)
        cuts = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(size)])]
        edges, unit, lengths, first = [], [], np.zeros(self.rows, np.int64), np.zeros(self.rows, np.int64)
        for i, (row, t) in enumerate(heads):
            path = paths[which[row]]
            lo = int(path.bounds[row])
            edges += [path.edges[lo:t], np.array([edge[i]], np.int32), suffix[cuts[i] : cuts[i + 1]]]
            unit += [path.unit[lo : t + 1], tokens_unit[cuts[i] : cuts[i + 1]]]
            lengths[row] = t - lo + 1 + cuts[i + 1] - cuts[i]
            first[row] = t - lo + 1
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        path = Path(np.concatenate([np.zeros(0, np.int32), *edges]), np.concatenate([none, *unit]), bounds, np.zeros(0), [{} for _ in range(self.rows)])
        self.leave(path, r, bounds[:-1] + first, np.where(some, g, 0.0))
        return path, g, some

    def result(self) -> dict[str, list | np.ndarray]:
        """Columns of FIELDS, and `row`, ordered by sample."""
        lattice, v = self.lattice, self.v
        paths, values, rest = self.run()
        out: dict[str, list] = {k: [] for k in ("row", "sample", "n_tokens", "ids", "log_prob", "perturbed", "log_inclusion")}
        alive = np.ones(self.rows, bool)
        for r, (path, g) in enumerate(zip(paths, values)):
            if r:
                alive = alive & np.isfinite(g) & (np.diff(path.bounds) > 0)
            ids, ends = self.ids(path)
            total = np.concatenate([[0.0], np.cumsum(lattice.log[path.edges], dtype=np.float64)])[path.bounds]
            log = np.diff(total)
            with np.errstate(over="ignore", divide="ignore"):
                gap = log - rest
                inclusion = np.where(np.isneginf(rest), 0.0, np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700.0))))))
            raw, at = ids.astype("<u2" if len(v.bytes) <= 1 << 16 else "<u4"), ends
            keep = np.flatnonzero(alive)
            out["row"] += keep.tolist()
            out["sample"] += [r + 1] * len(keep)
            out["n_tokens"] += np.diff(at)[keep].tolist()
            out["ids"] += [raw[a:b].tobytes() for a, b in zip(at[keep].tolist(), at[keep + 1].tolist())]
            out["log_prob"] += log[keep].tolist()
            out["perturbed"] += g[keep].tolist()
            out["log_inclusion"] += inclusion[keep].tolist()
        return out

    def ids(self, path: Path) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a path, with characters' bytes written out, and the rows' bounds."""
        lattice = self.lattice
        ids = lattice.id[path.edges]
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, path.bounds
        many = np.ones(len(ids), np.int64)
        many[bare] = lattice.size[path.edges[bare]]
        ends = np.cumsum(many)
        out = np.repeat(ids, many)
        text = lattice.data
        for i in range(int(many.max())):
            of = bare[many[bare] > i]
            out[ends[of] - many[of] + i] = self.v.byte_ids[text[lattice.start[path.edges[of]] + i]]
        return out, np.concatenate([[0], ends])[path.bounds]


def decoding(ids: list[bytes], v: Vocabulary) -> list[bytes]:
    """The text of each row of packed ids."""
    flat = np.frombuffer(b"".join(ids), "<u2" if len(v.bytes) <= 1 << 16 else "<u4").astype(np.int64)
    sizes = v.sizes[flat]
    ends = np.cumsum(sizes)
    whole = v.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(v.at[flat] - (ends - sizes), sizes)].tobytes()
    width = 2 if len(v.bytes) <= 1 << 16 else 4
    tokens = np.cumsum([0, *(len(x) // width for x in ids)])
    bounds = np.append(0, ends)[tokens].tolist()
    return [whole[a:b][1:] for a, b in zip(bounds, bounds[1:])]  # the first piece begins with a space


def sample(documents: DataFrame, options: Sampling = Sampling(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document up to k rows: key, sample (1 is the largest perturbed value), n_tokens, ids
    (little-endian 16-bit numbers), log_prob, perturbed and log_inclusion: the log probability that a
    segmentation of this log_prob beats the first perturbed value left out (0 if none is left); decodes: whether
    the ids, decoded, are the text again."""
    kind = documents.schema[key].dataType.simpleString()
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(key), F.lit(options.seed)).alias("seed"))

    def run(block: pa.RecordBatch):
        data, offsets = tb.utf8(block.column(1))
        v, seeds = vocabulary_for(options.vocabulary, options.theta), block.column(2).to_numpy().view(np.uint64)
        units, raw = Units(data, offsets, v), data.tobytes()
        lo = 0
        while lo < block.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + options.part, "right")) - 1)
            got = Block(units, lo, hi, seeds, v, options).result()
            rows = got.pop("row")
            got["decodes"] = [t == raw[offsets[lo + r] : offsets[lo + r + 1]] for r, t in zip(rows, decoding(got["ids"], v))]
            row = pa.array(rows, pa.int64())
            types = [pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([block.column(0).slice(lo, hi - lo).take(row), *(pa.array(x, t) for x, t in zip(got.values(), types))], names=["key", *got])
            lo = hi

    return tb.map_blocks(source, run, f"key {kind}, {FIELDS}", most=options.block).withColumnRenamed("key", key)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """tokens with the text of packed ids in column `into`; null ids give null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text_of(column):
        v = vocabulary_for(vocabulary, 1.0)
        kind = "<u2" if len(v.bytes) <= 1 << 16 else "<u4"

        def one(raw):
            return None if raw is None else b"".join(v.bytes[i] for i in np.frombuffer(raw, kind).tolist())[1:].decode()

        return column.map(one)

    return tokens.withColumn(into, text_of(F.col(ids)))
