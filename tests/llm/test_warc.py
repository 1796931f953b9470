"""WARC bundles: round trips, seeking and revisits."""

import base64
import hashlib
import uuid

import pytest
import zstandard

from loomset.llm import warc


@pytest.fixture
def folder(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"


ROWS = [(1, "http://a/\r\nX: y", "<p>x</p>"), (2, "u", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 50_000), (6, "u", "only"), (7, "u", "<p>x</p>"), (7, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (None, "u", "alone")]


def test_round_trip_and_revisits(spark, folder):
    df = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    options = warc.Options(frame=200, bundle=400)
    bundles = warc.write(df, folder, options)
    rows = warc.read(bundles).collect()
    assert len(rows) == len(ROWS)
    html = {(r[0], r[2] or "") for r in ROWS}
    top = {}
    for p, _, h in ROWS:
        top[h or ""] = max(top.get(h or "", -1), -1 if p is None else p)
    for r in rows:
        mine = [h for p, h in html if p == r.page_id and base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() == r.payload_digest]
        assert len(mine) == 1 and r.payload_bytes == len(mine[0].encode())
        first = top[mine[0]]
        if first == -1 or r.page_id == first:
            assert (r.record_type, r.refers_to) == ("response", None) and r.payload.decode() == mine[0]
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first, None)


def test_any_record_is_found_by_the_index_alone(spark, folder):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(300)], "page_id long, url string, html string")
    bundles = warc.write(df, folder, warc.Options(frame=2000, bundle=3000))
    archives = {r.bundle_id: bytes(r.archive) for r in bundles.collect()}
    index = warc.index(bundles).collect()
    assert len(index) == 300 and len({r.frame for r in index}) > 1
    for r in index:
        headers, block = warc.read_record(archives[r.bundle_id], r.frame, r.offset)
        assert headers["warc-record-id"] == f"<{r.record_id}>"
    for a in archives.values():  # a plain reader sees one stream
        whole = b"".join(iter(lambda s=zstandard.ZstdDecompressor().stream_reader(a, read_across_frames=True): s.read(1 << 20), b""))
        assert len(whole) == sum(x[2] for x in warc.frames_of(a)) and whole.startswith(b"WARC/1.1\r\n")


def test_damage_and_nothing(spark, folder):
    with pytest.raises(ValueError):
        warc.frames_of(b"x" * 40)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.report(empty, folder).collect() == []


def test_least_payload(spark, folder):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.report(df, folder, warc.Options(least=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_many_repeated_payloads(spark, folder, monkeypatch):
    """Where the repeated digests are not sent to all tasks, one payload of a third of all pages is dealt to several."""
    rows = [(i, "u", "hot" if i % 3 == 0 else f"page {i // 2}") for i in range(300)] + [(None, None, "hot")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, warc.report(df, f"{folder}-a").collect()))
    monkeypatch.setattr(warc, "BROADCAST", -1)
    assert sorted(map(str, warc.report(df, f"{folder}-b").collect())) == want and len(want) == 301
