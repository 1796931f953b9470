"""Transport streams: exact round trips, faults and the query's columns."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomset.llm import transport as T


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_round_trip(raw):
    payload = T.padded(raw)
    assert len(payload) % 576 == 0 and payload and payload.startswith(raw) and set(payload[len(raw) :]) <= {255}
    media = T.mux(payload)
    s = T.demux(media)
    assert s.payload == payload and len(media) % 188 == 0
    assert (s.gaps, s.repeats, s.lost_sync, s.bad_tables, s.programs, s.streams) == (0, 0, 0, 0, {1: T.PMT_PID}, {T.STREAM_PID: 6})
    assert s.pts == [i * T.TICKS for i in range(len(s.units))] and s.units == list(range(0, len(payload), 2304))
    assert [a[0] for a in s.access] == list(range(0, len(s.units), 8))
    for _, _, at in s.access:  # a stream can be read from any access point on, tables first
        part = T.demux(media[at - 2 * 188 :])
        assert part.gaps == 0 and payload.endswith(part.payload)


def test_faults_are_counted():
    media = T.mux(bytes(range(256)) * 90)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    rnd = random.Random(1)
    data = [i for i, p in enumerate(packets) if p[1] & 0x1F == 1 and p[2] == 0]
    drop = rnd.choice(data[5:-5])
    assert T.demux(b"".join(p for i, p in enumerate(packets) if i != drop)).gaps == 1
    twice = T.demux(b"".join(p * (2 if i == drop else 1) for i, p in enumerate(packets)))
    assert twice.repeats == 1 and twice.payload == bytes(range(256)) * 90
    broken = bytearray(media)
    broken[0] = 0
    assert T.demux(bytes(broken)).lost_sync == 1
    bad = bytearray(media)
    bad[10] ^= 1
    assert T.demux(bytes(bad)).bad_tables == 1
    assert T.demux(media[:100]).lost_sync == 1
    for junk in (b"", None, b"\x47" * 188, np.random.default_rng(0).bytes(188 * 20)):
        assert T.demux(junk).payload == b""


def test_crc():
    assert T.crc_mpeg(b"123456789") == 0x0376E6E7


def test_report(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.limit(50).collect()
    more = spark.createDataFrame([(10**6, None, 1), (10**6 + 1, "", 2), (10**6 + 2, "é" * 300_000, 3), (None, "x", 4)], "doc_id long, text string, media int")
    texts = {r.doc_id: r.text for r in rows} | {r.doc_id: r.text for r in more.collect()}
    got = T.report(docs.limit(50)).collect() + T.report(more).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        p = T.padded(raw)
        m = T.mux(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    media = T.pack(more)
    points = T.access_points(media).collect()
    assert {p.unit % 8 for p in points} == {0} and {p.doc_id for p in points} == {10**6, 10**6 + 1, 10**6 + 2, None}
    assert T.report(more.limit(0)).collect() == []


def by_hand(media):
    """A plain reading of a stream, packet by packet: payload, (unit, time stamp, byte offset) of access points, and all time stamps."""
    programs, stream, units, access, counters = {}, None, [], [], {}
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert len(p) == 188 and p[0] == 0x47
        pid, start = int.from_bytes(p[1:3], "big") & 0x1FFF, bool(p[1] & 0x40)
        body, random_access = 4, False
        if p[3] & 0x20:
            random_access = p[4] > 0 and bool(p[5] & 0x40)
            body = 5 + p[4]
        assert counters.setdefault(pid, p[3] & 15) == p[3] & 15
        counters[pid] = (counters[pid] + 1) % 16
        data = p[body:]
        if pid == 0:
            table = data[1 + data[0] :]
            length = int.from_bytes(table[1:3], "big") & 0xFFF
            assert table[0] == 0 and T.crc_mpeg(table[: 3 + length]) == 0  # a section with its CRC leaves nothing
            programs[int.from_bytes(table[8:10], "big")] = int.from_bytes(table[10:12], "big") & 0x1FFF
        elif pid in programs.values():
            table = data[1 + data[0] :]
            assert table[0] == 2
            stream = int.from_bytes(table[13:15], "big") & 0x1FFF
        elif pid == stream:
            if start:
                assert data[:3] == b"\0\0\1"
                units.append(b"")
                if random_access:
                    access.append((len(units) - 1, at))
            units[-1] += data
    times, payload = [], b""
    for u in units:
        size, header = int.from_bytes(u[4:6], "big"), u[8]
        b = u[9:14]
        times.append((b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1)
        payload += u[9 + header : 6 + size]
    return payload, [(i, times[i], at) for i, at in access], times


def test_a_plain_reader_finds_the_same(spark):
    rnd = random.Random(3)
    texts = ["", "x", "é" * 4000, "".join(rnd.choice("abc \n") for _ in range(70_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.report(df).collect():
        payload, access, times = by_hand(T.mux(T.padded(texts[r.doc_id].encode())))
        assert payload == T.padded(texts[r.doc_id].encode()) and hashlib.sha256(payload).hexdigest() == r.payload_sha256
        assert [tuple(a) for a in r.access_points] == access and r.unit_pts == times


def test_fixed_bytes():
    """One program, one packet of four bytes, written out."""
    pat = bytes.fromhex("474000100000b00d0001c100000001f0002ab104b2")
    assert T.PAT == pat[4:]
    pes = bytes.fromhex("000001bd000c848005") + bytes.fromhex("2100016119") + b"abcd"  # PTS 12428 / 2 ticks apart from zero
    head = bytes.fromhex("47410030") + bytes([183 - len(pes), 0x40])
    packet = head + b"\xff" * (188 - len(head) - len(pes)) + pes
    pmt = (b"\x47\x50\x00\x10" + T.PMT).ljust(188, b"\xff")
    s = T.demux(pat.ljust(188, b"\xff") + pmt + packet)
    assert (s.payload, s.programs, s.streams, s.gaps, s.bad_tables) == (b"abcd", {1: 0x1000}, {0x100: 6}, 0, 0)
    assert s.pts == [(0x21 >> 1 & 7) << 30 | 0 << 22 | (1 >> 1) << 15 | 0x61 << 7 | 0x19 >> 1] == [12428] and s.access == [(0, 12428, 376)]
