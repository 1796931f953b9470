"""MPEG transport streams as a media column: packing bytes, and parsing what is packed.

`mux` puts a payload into one program: access units of `unit` bytes become PES packets with time stamps,
cut into 188-byte packets. Every `group` units a random-access point stands, with program tables before
it, the random-access flag and a clock reference. `demux` reads any such stream: it parses the program
association and map tables (with their CRCs), checks each PID's continuity counters, reassembles the
elementary stream of the first program's first stream, and lists time stamps with random-access points.
Streams with lost sync, gaps or bad tables are parsed as far as they go, and the faults are counted.

Null text counts as empty; its payload is one block of fill. Equal texts give equal streams. A null
media value is parsed as an empty stream. Each row is parsed alone: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import textbatch as tb

PACKET = 188
PMT_PID, STREAM_PID = 0x1000, 0x0100
TICKS = 3600  # of the 90 kHz clock between units


@dataclass(frozen=True)
class Layout:
    block: int = 576  # payloads are filled up to a positive multiple of this
    unit: int = 2304  # payload bytes in an access unit
    group: int = 8  # units from one random-access point to the next


def padded(text: bytes, layout: Layout = Layout()) -> bytes:
    return text + b"\xff" * (-len(text) % layout.block if text else layout.block)


def crc_mpeg(data: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, start FFFFFFFF, no reflection."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        crc &= 0xFFFFFFFF
    return crc


def section(table: int, body: bytes) -> bytes:
    """A program table's section, with pointer field and CRC."""
    head = bytes([table]) + (0xB000 | (len(body) + 4)).to_bytes(2, "big") + body
    return b"\0" + head + crc_mpeg(head).to_bytes(4, "big")


PAT = section(0x00, (1).to_bytes(2, "big") + b"\xc1\0\0" + (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section(0x02, (1).to_bytes(2, "big") + b"\xc1\0\0" + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0" + b"\x06" + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0")


def stamp(ticks: np.ndarray, mark: int) -> np.ndarray:
    """33-bit time stamps in their five-byte form."""
    t = np.asarray(ticks, np.int64) & 0x1FFFFFFFF
    out = np.empty((len(t), 5), np.uint8)
    out[:, 0] = mark << 4 | (t >> 30 & 7) << 1 | 1
    out[:, 1] = t >> 22 & 0xFF
    out[:, 2] = (t >> 15 & 0x7F) << 1 | 1
    out[:, 3] = t >> 7 & 0xFF
    out[:, 4] = (t & 0x7F) << 1 | 1
    return out


def mux(payload: bytes, layout: Layout = Layout()) -> bytes:
    """The payload as a transport stream."""
    data = np.frombuffer(payload, np.uint8)
    units = -(-len(data) // layout.unit)
    size = np.full(units, layout.unit)
    if units:
        size[-1] = len(data) - layout.unit * (units - 1)
    number = np.arange(units)
    key = number % layout.group == 0
    pts = number * TICKS
    # PES packets end to end
    heads = np.zeros((units, 14), np.uint8)
    heads[:, 2], heads[:, 3], heads[:, 6], heads[:, 7], heads[:, 8] = 1, 0xBD, 0x84, 0x80, 5
    heads[:, 4], heads[:, 5] = (size + 8) >> 8, (size + 8) & 0xFF
    heads[:, 9:] = stamp(pts, 2)
    full = size + 14
    begin = np.cumsum(full) - full
    pes = np.empty(int(full.sum()), np.uint8)
    place = np.ones(len(pes), bool)
    at = (begin[:, None] + np.arange(14)).ravel()
    place[at] = False
    pes[at] = heads.ravel()
    pes[place] = data
    # packets of each unit
    room = np.where(key, 176, 184)
    packets = 1 + np.maximum(0, -(-(full - room) // 184))
    lead = 2 * key  # program tables before a random-access point
    first = np.cumsum(packets + lead) - packets
    total = int((packets + lead).sum())
    out = np.full((total, PACKET), 0xFF, np.uint8)
    out[:, 0] = 0x47
    media = np.repeat(np.arange(units), packets)
    row = np.arange(len(media)) - np.repeat(np.cumsum(packets) - packets, packets)  # of the packet in its unit
    where = first[media] + row
    done = np.where(row > 0, room[media] + 184 * (row - 1), 0)
    left = full[media] - done
    space = np.where(row > 0, 184, room[media])
    take = np.minimum(left, space)
    field_len = 184 - take  # bytes of adaptation field
    out[where, 1] = np.where(row == 0, 0x40, 0) | STREAM_PID >> 8
    out[where, 2] = STREAM_PID & 0xFF
    out[where, 3] = np.where(field_len > 0, 0x30, 0x10) | np.arange(len(media)) & 15
    has = np.flatnonzero(field_len > 0)
    out[where[has], 4] = field_len[has] - 1
    flags = has[field_len[has] > 1]
    opens = key[media[flags]] & (row[flags] == 0)
    out[where[flags], 5] = np.where(opens, 0x50, 0)
    clocks = flags[opens]
    base = pts[media[clocks]]
    out[where[clocks], 6], out[where[clocks], 7], out[where[clocks], 8], out[where[clocks], 9] = base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF
    out[where[clocks], 10], out[where[clocks], 11] = (base & 1) << 7 | 0x7E, 0
    # payload bytes, in order, fill the ends of the packets
    holds = np.zeros((total, PACKET), bool)
    holds[where] = np.arange(PACKET) >= (PACKET - take)[:, None]
    out[holds] = pes
    for k, (pid, table) in enumerate(((0, PAT), (PMT_PID, PMT))):
        at = first[key] - 2 + k
        out[at, 1], out[at, 2] = 0x40 | pid >> 8, pid & 0xFF
        out[at, 3] = 0x10 | np.arange(len(at)) & 15
        out[at, 4 : 4 + len(table)] = np.frombuffer(table, np.uint8)
    return out.tobytes()


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    lost_sync: int = 0
    gaps: int = 0  # continuity counters that don't follow
    repeats: int = 0  # packets sent twice
    bad_tables: int = 0
    programs: dict = field(default_factory=dict)  # program number -> PID of its map
    streams: dict = field(default_factory=dict)  # PID -> stream type
    pid: int | None = None
    pts: list = field(default_factory=list)  # of each access unit; None where it has none
    units: list = field(default_factory=list)  # payload offset of each access unit
    access: list = field(default_factory=list)  # (unit, time stamp, byte offset in the stream)


def table_of(packet: np.ndarray, start: int, kind: int) -> bytes | None:
    """The body of the section that begins in this packet, None if it is not whole or its CRC is wrong."""
    raw = packet[start:].tobytes()
    raw = raw[1 + raw[0] :] if raw else b""
    if len(raw) < 3 or raw[0] != kind:
        return None
    length = int.from_bytes(raw[1:3], "big") & 0xFFF
    if len(raw) < 3 + length or length < 9 or sound(raw[: 3 + length]) is False:
        return None
    return raw[3 : 3 + length - 4]


_sound: dict[bytes, bool] = {}


def sound(whole: bytes) -> bool:
    if whole not in _sound:
        if len(_sound) > 1000:
            _sound.clear()
        _sound[whole] = crc_mpeg(whole[:-4]) == int.from_bytes(whole[-4:], "big")
    return _sound[whole]


def demux(media: bytes | None) -> Stream:
    """What a transport stream holds."""
    s = Stream()
    raw = np.frombuffer(media or b"", np.uint8)
    n = len(raw) // PACKET
    p = raw[: n * PACKET].reshape(n, PACKET)
    good = p[:, 0] == 0x47
    s.packets, s.lost_sync = n, int(n - good.sum()) + (len(raw) % PACKET > 0)
    offset = np.flatnonzero(good) * PACKET
    p = p[good]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    opens = p[:, 1] & 0x40 > 0
    control = p[:, 3] >> 4 & 3
    field_len = np.where(control & 2, p[:, 4].astype(np.int32) + 1, 0)
    start = np.minimum(4 + field_len, PACKET)
    start[(control & 1) == 0] = PACKET
    for at in np.flatnonzero((pid == 0) & opens):
        body = table_of(p[at], int(start[at]), 0x00)
        if body is None:
            s.bad_tables += 1
        else:
            for i in range(5, len(body) - 3, 4):
                if number := int.from_bytes(body[i : i + 2], "big"):
                    s.programs[number] = int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF
    maps = set(s.programs.values())
    for at in np.flatnonzero(np.isin(pid, list(maps)) & opens) if maps else []:
        body = table_of(p[at], int(start[at]), 0x02)
        if body is None:
            s.bad_tables += 1
            continue
        i = 9 + (int.from_bytes(body[7:9], "big") & 0xFFF)
        while i + 5 <= len(body):
            s.streams.setdefault(int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF, body[i])
            i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0xFFF)
    # continuity of each PID's packets that carry payload
    carry = np.flatnonzero((control & 1) & (pid != 0x1FFF))
    order = carry[np.argsort(pid[carry], kind="stable")]
    count = p[order, 3] & 15
    same = pid[order][1:] == pid[order][:-1]
    step = (count[1:].astype(int) - count[:-1]) % 16
    s.repeats, s.gaps = int((same & (step == 0)).sum()), int((same & (step > 1)).sum())
    twice = order[1:][same & (step == 0)]
    s.pid = next(iter(s.streams), None)
    if s.pid is None:
        return s
    mine = np.flatnonzero((pid == s.pid) & (control & 1 > 0))
    if len(twice):
        mine = mine[~np.isin(mine, twice)]
    if not opens[mine].any():
        return s
    mine = mine[np.argmax(opens[mine]) :]  # a unit's rest before the first start can't be placed
    q, begin = p[mine], start[mine]
    holds = np.arange(PACKET) >= begin[:, None]
    data = q[holds]
    ends = np.cumsum(PACKET - begin)
    heads = (ends - (PACKET - begin))[opens[mine]]
    flagged = (control[mine] & 2 > 0) & (q[:, 4] > 0) & (q[:, 5] & 0x40 > 0)
    # PES headers
    edge = np.append(heads, len(data))
    whole = np.flatnonzero((np.diff(edge) >= 9))
    whole = whole[(data[heads[whole]] == 0) & (data[heads[whole] + 1] == 0) & (data[heads[whole] + 2] == 1)]
    h = heads[whole]
    header = 9 + data[h + 8].astype(np.int64)
    length = data[h + 4].astype(np.int64) << 8 | data[h + 5]
    stop = np.where(length > 0, np.minimum(h + 6 + length, edge[whole + 1]), edge[whole + 1])
    first = np.minimum(h + header, stop)
    timed = (data[h + 7] & 0x80 > 0) & (header >= 14)
    t = np.zeros(len(h), np.int64)
    k = h[timed]
    b = [data[k + i].astype(np.int64) for i in range(9, 14)]
    t[timed] = (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1
    s.pts = [int(x) if ok else None for x, ok in zip(t, timed)]
    delta = np.zeros(len(data) + 1, np.int32)
    np.add.at(delta, first, 1)
    np.add.at(delta, stop, -1)
    s.payload = data[np.cumsum(delta[:-1]) > 0].tobytes()
    sizes = stop - first
    s.units = (np.cumsum(sizes) - sizes).tolist()
    at = np.flatnonzero(opens[mine])[whole]
    for i in np.flatnonzero(flagged[at]).tolist():
        s.access.append((i, s.pts[i], int(offset[mine[at[i]]])))
    return s


def feature(s: Stream) -> str:
    times = [t for t in s.pts if t is not None]
    span = f"{times[0]}-{times[-1]}" if times else "none"
    return f"packets={s.packets};programs={len(s.programs)};streams={len(s.streams)};units={len(s.units)};access={len(s.access)};pts={span};gaps={s.gaps};repeats={s.repeats};lost={s.lost_sync};bad_tables={s.bad_tables}"


def pack(documents: DataFrame, layout: Layout = Layout(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and `media`: each text's padded payload as a transport stream."""
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(block: pa.RecordBatch):
        media = [mux(padded((t or "").encode(), layout), layout) for t in block.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(media, pa.binary())], names=["key", "media"])

    return tb.map_blocks(source, run, f"key {documents.schema[key].dataType.simpleString()}, media binary").withColumnRenamed("key", key)


def access_points(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, unit, pts, byte_offset: one row for each random-access point of each stream, for seeking."""

    def run(batches):
        for batch in batches:
            rows = [(k, *a) for k, m in zip(batch.column(0).to_pylist(), batch.column(1)) for a in demux(m.as_py()).access]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], batch.column(0).type if i == 0 else pa.int64()) for i in range(4)], names=["key", "unit", "pts", "byte_offset"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key).alias("key"), column).mapInArrow(run, f"key {kind}, unit long, pts long, byte_offset long").withColumnRenamed("key", key)


REPORT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, unit_pts array<long>, access_points array<struct<unit: long, pts: long, byte_offset: long>>"
REPORT_TYPES = {
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
    "unit_pts": pa.list_(pa.int64()), "access_points": pa.list_(pa.struct([("unit", pa.int64()), ("pts", pa.int64()), ("byte_offset", pa.int64())])),
}


def report(documents: DataFrame, layout: Layout = Layout(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs each text, reads the stream back and gives digests of both, the time stamp of each access unit and the
    random-access points with the bytes where they begin, all within the row's task."""
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(block: pa.RecordBatch):
        rows = []
        for t in block.column(1):
            raw = (t.as_py() or "").encode()
            media = mux(padded(raw, layout), layout)
            s = demux(media)
            got = s.payload
            rows.append((len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s.pts, [dict(zip(("unit", "pts", "byte_offset"), a)) for a in s.access]))
        yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), REPORT_TYPES.values()))], names=["key", *REPORT_TYPES])

    return tb.map_blocks(source, run, f"key {documents.schema[key].dataType.simpleString()}, {REPORT}").withColumnRenamed("key", key)
