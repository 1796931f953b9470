"""Index versions, image headers and pixels, and workers that know each other."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import world
from loomset.sources import archives, images, indextable, tar


def shard(spark, folder, name, members):
    os.makedirs(folder, exist_ok=True)
    rows = spark.createDataFrame(list(members.items()), "name string, data binary")
    (row,) = tar.packed(rows, 1).collect()
    with archives.safely(f"{folder}/{name}.tar") as f:
        f.write(row.content)


def test_index_versions(spark, tmp_path, monkeypatch):
    folder, table = str(tmp_path / "archives"), str(tmp_path / "table")
    for i in range(5):
        shard(spark, folder, f"s{i}", {f"{i}/{j}": b"x" * (i + j) for j in range(3)})
    assert indextable.version(table) == 0 and indextable.read(spark, table).count() == 0
    assert indextable.refreshed(spark, table, folder) == 1
    first = sorted(map(tuple, indextable.read(spark, table).select("name", "size").collect()))
    assert first == sorted((f"{i}/{j}", i + j) for i in range(5) for j in range(3))
    assert indextable.refreshed(spark, table, folder) == 1  # nothing has changed
    opened = []
    real = indextable.scanned
    monkeypatch.setattr(indextable, "scanned", lambda df: (opened.append(sorted(os.path.basename(r.archive) for r in df.collect())), real(df))[1])
    before = {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(f"{table}/data/1") for p in names}
    shard(spark, folder, "s3", {"3/0": b"longer than before", "3/new": b""})
    assert indextable.refreshed(spark, table, folder) == 2 and opened == [["s3.tar"]]
    assert before == {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(f"{table}/data/1") for p in names}
    now = {r.name: r.size for r in indextable.read(spark, table).collect()}
    assert now == {n: s for n, s in first if not n.startswith("3/")} | {"3/0": 18, "3/new": 0}
    assert sorted(map(tuple, indextable.read(spark, table, 1).select("name", "size").collect())) == first  # readers of the old version go on
    os.unlink(f"{folder}/s0.tar")
    os.makedirs(f"{table}/data/3")  # what a refresh that died has left
    assert indextable.refreshed(spark, table, folder) == 3 and len(opened) == 1
    assert indextable.vacuumed(spark, table, keep=1) == ["data/3", "manifest/1", "manifest/2"]
    assert {r.name: r.size for r in indextable.read(spark, table).collect()} == {n: s for n, s in now.items() if not n.startswith("0/")}


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def cases():
    """(bytes, format, mode, width, height) written by hand, by the formats' own layouts."""
    out = []
    for color, mode in ((0, "L"), (2, "RGB"), (3, "P"), (4, "LA"), (6, "RGBA")):
        out.append((images.PNG_SIGN + chunk(b"IHDR", struct.pack(">2I5B", 70_000, 3, 8, color, 0, 0, 0)), "PNG", mode, 70_000, 3))
    out.append((images.PNG_SIGN + chunk(b"IHDR", struct.pack(">2I5B", 9, 8, 1, 0, 0, 0, 0)), "PNG", "1", 9, 8))
    out.append((images.PNG_SIGN + chunk(b"IHDR", struct.pack(">2I5B", 9, 8, 16, 0, 0, 0, 0)), "PNG", "I;16", 9, 8))
    out += [(sign + struct.pack("<2H", 640, 480) + b"\0\0\0", "GIF", "P", 640, 480) for sign in (b"GIF87a", b"GIF89a")]
    for parts, mode in ((1, "L"), (3, "RGB"), (4, "CMYK")):
        exif = b"\xff\xe1" + struct.pack(">H", 60_002) + b"\xff\xc0" * 30_000  # what looks like a frame inside a segment
        frame = b"\xff\xff\xff\xc2" + struct.pack(">HB2HB", 8 + 3 * parts, 8, 200, 100, parts)
        out.append((b"\xff\xd8" + exif + b"\xff\xc4\x00\x04ab" + frame, "JPEG", mode, 100, 200))
    riff = b"RIFF\0\0\0\0WEBP"
    out.append((riff + b"VP8X" + struct.pack("<I", 10) + bytes([16, 0, 0, 0]) + (4000 - 1).to_bytes(3, "little") + (2 - 1).to_bytes(3, "little"), "WEBP", "RGBA", 4000, 2))
    out.append((riff + b"VP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 99 | 49 << 14 | 1 << 28), "WEBP", "RGBA", 100, 50))
    out.append((riff + b"VP8 " + struct.pack("<I", 10) + b"abc\x9d\x01\x2a" + struct.pack("<2H", 320 | 1 << 14, 240), "WEBP", "RGB", 320, 240))
    return out


def test_headers(spark):
    rows = [(i, c[0]) for i, c in enumerate(cases())]
    bad = [b"", b"\xff", b"\xff\xd8", b"hello, world, this is no image", b"\xff\xd8\xff\xe0\x00\x01" + b"x" * 20, b"\xff\xd8\xff\xda" + b"x" * 20, b"\xff\xd8ab" + b"x" * 20, images.PNG_SIGN + b"\0" * 30, None]
    df = spark.createDataFrame(rows + [(100 + i, b) for i, b in enumerate(bad)], "id long, content binary")
    got = {r.id: r.image and tuple(r.image) for r in images.with_properties(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases())} | {100 + i: None for i in range(len(bad))}
    for raw, *_ in cases():  # cut anywhere, or with any byte changed, a header is told or null, never an error
        for n in range(0, len(raw), max(1, len(raw) // 60)):
            images.header(lambda at, size, n=n, raw=raw: raw[:n][at : at + size])
    rnd = random.Random(4)
    for _ in range(3000):
        raw = bytearray(rnd.choice(cases())[0][:200])
        raw[rnd.randrange(len(raw))] = rnd.randrange(256)
        images.header(lambda at, size, raw=raw: bytes(raw[at : at + size]))


def test_only_headers_are_read():
    asked = []
    raw = cases()[9][0] + b"x" * 10_000_000

    def read(at, n):
        asked.append(n)
        return raw[at : at + n]

    assert images.header(read)["format"] == "JPEG" and sum(asked) < 100


def test_modes(spark):
    df = spark.createDataFrame([(0, cases()[0][0]), (3, cases()[3][0])], "id long, content binary")
    with_mode = images.with_properties(df).select("id", images.supported(F.col("image")).alias("image"))
    assert with_mode.where("id = 0").first().image.mode == "L"
    with pytest.raises(Exception, match="unsupported image mode: LA"):
        with_mode.where("id = 3").collect()


def test_pixels(spark, tmp_path):
    rnd = np.random.default_rng(1)
    made = {}
    for n in (1, 3, 4):
        made[n] = rnd.integers(0, 256, (5, 7, n), dtype=np.uint8)
    df = spark.createDataFrame([(n, p.ravel().tolist(), 7, n) for n, p in made.items()], "id int, pixels array<int>, width int, channels int")
    for r in images.png_bytes(df, "pixels", "width", "channels").collect():
        (tmp_path / f"{r.id}.png").write_bytes(r.png)
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = {os.path.basename(r.path): r for r in images.decoded(spark, f"file://{tmp_path}").collect()}
    assert got["bad.png"].error and got["bad.png"].rgb is None
    assert (got["3.png"].width, got["3.png"].height, bytes(got["3.png"].rgb), got["3.png"].alpha) == (7, 5, made[3].tobytes(), None)
    assert bytes(got["1.png"].rgb) == np.repeat(made[1], 3, axis=2).tobytes()
    a = made[4][:, :, 3].astype(float)
    assert bytes(got["4.png"].alpha) == made[4][:, :, 3].tobytes()
    want = np.rint(made[4][:, :, :3] * a[:, :, None] / 255 + 255 - a[:, :, None])
    assert np.abs(np.frombuffer(got["4.png"].rgb, np.uint8).reshape(5, 7, 3) - want).max() <= 1


def test_world(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("int").alias("w"), F.lit(1).alias("rank_of"))
    rows = world.ranked(df, F.col("w"), 3).collect()
    assert len(rows) == 1000 and all(r.rank == r.w and r.size == 3 for r in rows)
    got = [tuple(r) for r in world.shares(df, "id", F.col("w"), 4).orderBy("rank").collect()]
    assert got == [(0, 4, True, 334, 0, 499500), (1, 4, False, 333, 334, 499500), (2, 4, False, 333, 667, 499500), (3, 4, False, 0, 1000, 499500)]

    def run(w, batches):
        import pyarrow as pa

        list(batches)
        w.barrier()
        seen = w.gathered({"rank": w.rank, "at": len(w.addresses())})
        yield pa.record_batch([pa.array([[x["rank"] for x in seen]], pa.list_(pa.int32()))], names=["ranks"])

    assert [r.ranks for r in world.in_world(df, F.col("w"), 3, run, "ranks array<int>").collect()] == [[0, 1, 2]] * 3


def test_a_large_keys_tensors(spark):
    """A key that holds most rows has several files, and no tensor is lost."""
    from loomset.sources import files

    rows = [("hot" if i % 10 else None, f"t{i:03d}", [2, 4], [float(i + j) for j in range(8)]) for i in range(200)] + [("empty", "e", [0], [])]
    df = spark.createDataFrame(rows, "k string, name string, shape array<int>, values array<float>").repartition(4)
    packed = files.tensors_packed(df, "k", most=1000)
    counts = {r.k: r.n for r in packed.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert counts["hot"] >= 4 and counts["empty"] == 1
    got = sorted((r.k or "", r.name, list(r.shape), list(r.values)) for r in files.tensors_unpacked(packed, "k").collect())
    assert got == sorted((k or "", n, s, v) for k, n, s, v in rows)
