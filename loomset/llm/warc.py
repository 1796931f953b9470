"""WARC archives in seekable Zstandard bundles.

A page is one WARC record. Records are grouped into frames of some `frame` bytes, each an independent
Zstandard frame; frames into bundles of some `bundle` bytes; and a bundle ends in a seek table (a
skippable frame with the sizes of all frames), so a reader can find any frame from the bundle's end and
decompress it alone. The index maps each record id to its bundle, its frame and its offset in the frame.

Of pages with equal payloads of at least `least` bytes, the one with the largest page_id is a response;
the others are revisits that refer to it and carry no payload. Payload groups may be of any size: they
are counted by digest with partial sums, and only digests that occur twice are joined back; these are
counted first and sent to all tasks where they are few, so that no payload is shuffled.

Bundles are rows of a Parquet table (bundle_id, archive, and the index columns) in the shared folder, so
that any store Spark can write to will do and a lost task is simply run again; `archive` alone is a
valid .warc.zst file.

Null html: an empty payload. A null page_id ranks below all others. Rows that repeat the response's
page_id and payload are responses too. An empty table gives no bundle. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.cluster import cut

#: Digests (some 100 bytes each) that are sent to all tasks at most.
BROADCAST = 300_000
#: Tasks that the pages of one payload are dealt to, where there are more.
SALT = 32
SEEK_FRAME, SEEK_END = 0x184D2A5E, 0x8F92EAB1
BUNDLE = "bundle_id string, archive binary, record_ids array<string>, frames array<int>, offsets array<long>, lengths array<long>"


@dataclass(frozen=True)
class Options:
    frame: int = 64 << 10  # bytes of records in a frame, at least
    bundle: int = 8 << 20  # compressed bytes in a bundle, at least
    level: int = 3
    least: int = 0  # payload bytes from which equal payloads are revisits
    date: str = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit's block is the HTTP header alone, which still tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", " ").replace("\n", " ")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers by lower-cased name, block and end of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    begin = stop + 4
    end = begin + int(headers["content-length"])
    return headers, data[begin:end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, decompressed) sizes of the frames before it."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_END)
    return struct.pack("<II", SEEK_FRAME, len(body)) + body


def frames_of(archive: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, read from the archive's end."""
    count, flags, magic = struct.unpack("<IBI", archive[-9:])
    each = 12 if flags & 0x80 else 8
    start = len(archive) - 9 - each * count - 8
    if magic != SEEK_END or start < 0 or struct.unpack("<I", archive[start : start + 4])[0] != SEEK_FRAME:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", archive, start + 8 + each * i)
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(archive: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: only its frame is decompressed."""
    import zstandard

    at, packed, plain = frames_of(archive)[frame]
    headers, block, _ = parse(zstandard.ZstdDecompressor().decompress(archive[at : at + packed], max_output_size=plain), offset)
    return headers, block


def decided(pages: DataFrame, options: Options = Options(), key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, payload, digest (hex), revisit, refers_to for each page."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), (F.col(url) if url in pages.columns else F.lit(None)).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    small = rows.select("page_id", "digest").where(F.octet_length("payload") >= options.least)
    groups = small.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    groups = cut(groups.select("digest", "top"))
    if groups.count() <= BROADCAST:
        joined = rows.join(F.broadcast(groups), "digest", "left")
    else:  # payloads are dealt out by digest and page, as one payload may be that of a third of all pages
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
        joined = dealt.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["digest", "salt"], "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"), "digest", revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to"))


def write(pages: DataFrame, folder: str, options: Options = Options(), **names: str) -> DataFrame:
    """Writes the pages' records as bundles into a new folder and returns the table of bundles, as read back."""

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=options.level)
        archive, sizes, frame = [], [], bytearray()
        index = ([], [], [], [])

        def close_frame():
            packed = packer.compress(bytes(frame))
            archive.append(packed)
            sizes.append((len(packed), len(frame)))
            frame.clear()

        def close_bundle():
            whole = b"".join(archive) + seek_table(sizes)
            name = hashlib.sha1(whole).hexdigest()
            out = pa.record_batch([pa.array([name]), pa.array([whole], pa.binary()), *(pa.array([x], pa.list_(t)) for x, t in zip(index, (pa.string(), pa.int32(), pa.int64(), pa.int64())))], names=["bundle_id", "archive", "record_ids", "frames", "offsets", "lengths"])
            archive.clear()
            sizes.clear()
            for x in index:
                x.clear()
            return out

        for batch in batches:
            for page, url, payload, size, digest, revisit, refers_to in zip(*(batch.column(i) for i in range(7))):
                page, revisit = page.as_py(), revisit.as_py()
                raw = record(page, url.as_py(), payload.as_py(), size.as_py(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers_to.as_py(), revisit, options.date)
                for x, y in zip(index, (f"urn:page:{'' if page is None else page}", len(sizes), len(frame), len(raw))):
                    x.append(y)
                frame += raw
                if len(frame) >= options.frame:
                    close_frame()
                    if sum(s[0] for s in sizes) >= options.bundle:
                        yield close_bundle()
        if frame:
            close_frame()
        if sizes:
            yield close_bundle()

    decided(pages, options, **names).mapInArrow(run, BUNDLE).write.option("compression", "none").parquet(folder)
    return pages.sparkSession.read.schema(BUNDLE).parquet(folder)


def index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset (in the frame), length: one row for each record."""
    each = F.explode(F.arrays_zip("record_ids", "frames", "offsets", "lengths")).alias("r")
    return bundles.select("bundle_id", each).select(F.col("r.record_ids").alias("record_id"), "bundle_id", F.col("r.frames").alias("frame"), F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length"))


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def page_of(name: str | None) -> int | None:
    number = (name or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def read(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of bundles: every frame is found by the seek table, every record by the index.

    payload_bytes and payload_digest of a response are taken from the payload read; those of a revisit,
    which has none, from its headers. A response whose payload does not have its recorded digest fails.
    """

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for archive, ids, frames, offsets in zip(*(batch.column(i) for i in (1, 2, 3, 4))):
                archive = archive.as_py()
                places, rows, now, plain = frames_of(archive), [], -1, b""
                for name, frame, offset in zip(ids.as_py(), frames.as_py(), offsets.as_py()):
                    if frame != now:
                        at, packed, size = places[frame]
                        now, plain = frame, unpack.decompress(archive[at : at + packed], max_output_size=size)
                    headers, block, _ = parse(plain, offset)
                    if headers["warc-record-id"] != f"<{name}>":
                        raise ValueError(f"the index leads to {headers['warc-record-id']} for {name}")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = headers["warc-type"]
                    if kind == "revisit":
                        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    else:
                        size, found = len(payload), base32_sha1(payload)
                        if found != digest:
                            raise ValueError(f"{name} has payload digest {found}, not {digest}")
                    rows.append((page_of(name), size, digest, kind, page_of(headers.get("warc-refers-to")), headers["warc-target-uri"], payload if payloads and kind != "revisit" else None))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))], names=[f.split()[0] for f in RECORD.split(", ")])

    return bundles.select("bundle_id", "archive", "record_ids", "frames", "offsets").mapInArrow(run, RECORD)


def report(pages: DataFrame, folder: str, options: Options = Options(), **names: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each page, from the archives written and read back."""
    return read(write(pages, folder, options, **names), payloads=False).drop("url", "payload")
