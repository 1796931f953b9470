"""Images: format, mode and size from their first bytes, pixels and alpha by Spark's image source, and PNG bytes.

`properties` reads headers only, by byte ranges: of bytes in a column, or of members of archives at their offsets, so
that images are never read whole. Modes are L, RGB, RGBA, and the others that headers tell (P, LA, CMYK, 1, I;16);
`supported` keeps the first three. Pixels come from `spark.read.format("image")`, which decodes in the JVM.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Read = Callable[[int, int], bytes]
PROPERTIES = "struct<format: string, mode: string, width: int, height: int>"
MODES = ("L", "RGB", "RGBA")
# Fixed values of the formats: PNG's colour types, JPEG's frame markers (all SOF but DHT, JPG and DAC), its numbers of components.
PNG_SIGN = b"\x89PNG\r\n\x1a\n"
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}


class Short(Exception):
    """The bytes end within the header."""


def exactly(read: Read, at: int, n: int) -> bytes:
    got = read(at, n)
    if len(got) < n:
        raise Short
    return got


def png(read: Read) -> tuple | None:
    kind, width, height, depth, color = struct.unpack(">4x4s2I2B", exactly(read, 8, 18))
    if kind != b"IHDR" or color not in PNG_MODES:
        return None
    return "PNG", {1: "1", 16: "I;16"}.get(depth, "L") if color == 0 else PNG_MODES[color], width, height


def gif(read: Read) -> tuple:
    width, height = struct.unpack("<2H", exactly(read, 6, 4))
    return "GIF", "P", width, height


def jpeg(read: Read) -> tuple | None:
    """Segments are skipped by their lengths, whatever they hold, until the frame's."""
    at = 2
    while True:
        mark, kind = exactly(read, at, 2)
        if mark != 0xFF:
            return None
        if kind == 0xFF:  # a fill byte
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 2
        elif kind in FRAMES:
            height, width, parts = struct.unpack(">2HB", exactly(read, at + 5, 5))
            return ("JPEG", JPEG_MODES[parts], width, height) if parts in JPEG_MODES else None
        elif kind in (0xD8, 0xD9, 0xDA):
            return None
        else:
            size = int.from_bytes(exactly(read, at + 2, 2), "big")
            if size < 2:
                return None
            at += 2 + size


def webp(read: Read) -> tuple | None:
    kind = exactly(read, 12, 4)
    if kind == b"VP8X":
        head = exactly(read, 20, 10)
        return "WEBP", "RGBA" if head[0] & 16 else "RGB", int.from_bytes(head[4:7], "little") + 1, int.from_bytes(head[7:10], "little") + 1
    if kind == b"VP8L":
        head = exactly(read, 20, 5)
        bits = int.from_bytes(head[1:], "little")
        return ("WEBP", "RGBA" if bits >> 28 & 1 else "RGB", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1) if head[0] == 0x2F else None
    if kind == b"VP8 ":
        head = exactly(read, 20, 10)
        width, height = struct.unpack("<2H", head[6:])
        return ("WEBP", "RGB", width & 0x3FFF, height & 0x3FFF) if head[3:6] == b"\x9d\x01\x2a" else None
    return None


def header(read: Read) -> dict | None:
    """format, mode, width, height; None for other formats, damaged headers, and bytes that end within the header."""
    start = read(0, 12)
    try:
        found = None
        if start[:8] == PNG_SIGN:
            found = png(read)
        elif start[:2] == b"\xff\xd8":
            found = jpeg(read)
        elif start[:6] in (b"GIF87a", b"GIF89a"):
            found = gif(read)
        elif start[:4] == b"RIFF" and start[8:12] == b"WEBP":
            found = webp(read)
    except Short:
        return None
    return None if found is None or not found[2] or not found[3] else dict(zip(("format", "mode", "width", "height"), found))


ARROW = pa.struct([("format", pa.string()), ("mode", pa.string()), ("width", pa.int32()), ("height", pa.int32())])


def with_properties(df: DataFrame, content: str = "content", into: str = "image") -> DataFrame:
    """df with the properties of the image in a binary column; null where there are none."""
    at, names = df.columns.index(content), [*df.columns, into]

    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column(at):
                raw = value.as_buffer() if value.is_valid else None  # not copied: headers are slices of it
                view = memoryview(raw) if raw is not None else None
                out.append(None if view is None else header(lambda i, n, view=view: bytes(view[i : i + n])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, ARROW)], names=names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{ddl}, `{into}` {PROPERTIES}")


def properties_of_members(index: DataFrame, split: int = 256 << 20) -> DataFrame:
    """index (archive, offset, size, ...) with `image`: the properties of members of archives, of which headers alone are read."""
    rows = index.withColumn("__part", F.floor(F.col("offset") / split)).repartition("archive", "__part").sortWithinPartitions("archive", "offset").select(index.columns)
    places = [index.columns.index(c) for c in ("archive", "offset", "size")]

    def run(batches):
        path, file = None, None
        try:
            for batch in batches:
                out = []
                for archive, offset, size in zip(*(batch.column(i).to_pylist() for i in places)):
                    if archive != path:
                        if file:
                            file.close()
                        path, file = archive, open(archive, "rb")

                    def read(at: int, n: int, offset=offset, size=size, file=file) -> bytes:
                        file.seek(offset + at)
                        return file.read(max(0, min(n, size - at)))

                    out.append(header(read))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, ARROW)], names=[*batch.schema.names, "image"])
        finally:
            if file:
                file.close()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return rows.mapInArrow(run, f"{ddl}, image {PROPERTIES}")


def supported(image: Column) -> Column:
    """The properties if the mode is grey, RGB or RGBA; another mode is an error, as is what is no image."""
    told = F.concat(F.lit("unsupported image mode: "), F.coalesce(image["mode"], F.lit("none")))
    return F.when(image["mode"].isin(*MODES), image).otherwise(F.raise_error(told))


def png_bytes(df: DataFrame, pixels: str, width: str, channels: str, into: str = "png") -> DataFrame:
    """df with PNG bytes of rows of pixels: array of 0 to 255, row by row, of 1, 2, 3 or 4 channels (L, LA, RGB, RGBA)."""
    at = [df.columns.index(c) for c in (pixels, width, channels)]
    colors = {1: 0, 2: 4, 3: 2, 4: 6}

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    def encoded(values: list, wide: int, n: int) -> bytes:
        rows = np.array(values, np.uint8).reshape(-1, wide * n)
        body = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()  # filter 0
        return PNG_SIGN + chunk(b"IHDR", struct.pack(">2I5B", wide, len(rows), 8, colors[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")

    def run(batches):
        for batch in batches:
            out = [None if None in row else encoded(*row) for row in zip(*(batch.column(i).to_pylist() for i in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, into])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{ddl}, `{into}` binary")


def on_white(color: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Colours over white by alpha, in rounded 255ths."""
    mixed = color.astype(np.uint32) * alpha + 255 * (255 - alpha.astype(np.uint32)) + 128
    return ((mixed >> 8) + mixed >> 8).astype(np.uint8)


DECODED = "path string, width int, height int, rgb binary, alpha binary, error string"


def decoded(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, width, height, rgb, alpha, error of image files: RGB bytes row by row, over white where there is alpha, and the
    alpha channel if there is one. What can't be decoded has an error instead."""
    images = spark.read.format("image").option("dropInvalid", False).load(paths)
    rows = images.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def run(batches):
        for batch in batches:
            out = []
            for path, width, height, n, data in zip(*(batch.column(i) for i in range(5))):
                path, width, height, n = (x.as_py() for x in (path, width, height, n))
                if n not in (1, 3, 4):
                    out.append((path, None, None, None, None, "not an image that can be decoded"))
                    continue
                pixels = np.frombuffer(data.as_buffer(), np.uint8).reshape(height, width, n)
                rgb = np.repeat(pixels, 3, axis=2) if n == 1 else pixels[:, :, 2::-1]  # kept as BGR
                alpha = pixels[:, :, 3] if n == 4 else None
                if alpha is not None:
                    rgb = on_white(rgb, alpha[:, :, None])
                out.append((path, width, height, rgb.tobytes(), None if alpha is None else alpha.tobytes(), None))
            types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[f.split()[0] for f in DECODED.split(", ")])

    return rows.mapInArrow(run, DECODED)
