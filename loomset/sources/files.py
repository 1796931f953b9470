"""Readers and writers for JSON objects, tensors, audio, CSV exports and SQLite."""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import wave

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def json_rows(text: Column, fields: str) -> Column:
    """array<struct<key, value>> of a JSON object of objects; fields is the inner struct's schema."""
    return F.map_entries(F.from_json(text, f"map<string, struct<{fields}>>"))


def load_json(spark: SparkSession, path: str, fields: str, key: str = "key") -> DataFrame:
    """One row for each outer key of a JSON object of objects; missing cells are null."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(json_rows(F.col("value"), fields)).alias("e"))
    return rows.select(F.col("e.key").alias(key), "e.value.*")


def dump_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def load_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Columns and rows are chosen in the scan: both reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(columns) if columns else df


def export_csv(spark: SparkSession, names: list[str], folder: str) -> None:
    """Each table of the catalogue as CSV files with a header."""
    for name in names:
        spark.table(name).write.option("header", True).csv(f"{folder}/{name}")


class SqliteTable(DataSource):
    """spark.read.format("sqlite").option("path", file).option("table", name): a table in row-id ranges."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "BIGINT": "bigint", "REAL": "double", "FLOAT": "double", "BOOLEAN": "boolean", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], [(f.name, f.dataType.typeName()) for f in schema], int(self.options.get("chunk", 50_000)))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[tuple[str, str]], chunk: int):
        self.path, self.table, self.columns, self.chunk = path, table, columns, chunk

    def connect(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Range]:
        with self.connect() as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        return [] if low is None else [Range(a, min(a + self.chunk, high + 1)) for a in range(low, high + 1, self.chunk)]

    def read(self, partition: Range):
        names = ", ".join(quoted(n) for n, _ in self.columns)
        with self.connect() as db:
            for row in db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(bool(v) if k == "boolean" and v is not None else v for v, (_, k) in zip(row, self.columns))


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


AUDIO = "rate int, channels int, samples array<array<double>>"


def wave_samples(files: DataFrame, content: str = "content") -> DataFrame:
    """files with `audio`: rate, channels and samples of 16-bit PCM WAVE bytes; what can't be read gives null."""

    @F.pandas_udf(f"struct<{AUDIO.replace(' int', ':int').replace('samples ', 'samples:').replace(', ', ',')}>")
    def decode(column):
        import pandas as pd

        def one(raw):
            try:
                with wave.open(io.BytesIO(raw)) as w:
                    data = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
                    return {"rate": w.getframerate(), "channels": w.getnchannels(), "samples": data.astype(float).tolist()}
            except (wave.Error, EOFError, TypeError, ValueError):
                return {"rate": None, "channels": None, "samples": None}

        return pd.DataFrame([one(x) for x in column], columns=["rate", "channels", "samples"])

    return files.withColumn("audio", decode(F.col(content)))


def wave_bytes(codes: Column, rate: int, channels: int) -> Column:
    """16-bit PCM WAVE bytes of interleaved samples (array<int>); a part of a frame at the end is left out."""

    @F.pandas_udf("binary")
    def encode(column):
        def one(x):
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(channels)
                w.setsampwidth(2)
                w.setframerate(rate)
                w.writeframes(np.asarray(x[: len(x) // channels * channels], "<i2").tobytes())
            return out.getvalue()

        return column.map(lambda x: None if x is None else one(x))

    return encode(codes)


def has_high_band(rate: Column, samples: Column, low: float = 19_000.0, high: float = 21_000.0, eps: float = 1e-6) -> Column:
    """Whether any bin of the min-max normalised spectrogram between low and high Hz exceeds eps (256 samples, steps of 128)."""

    @F.pandas_udf("boolean")
    def check(rates, columns):
        import pandas as pd

        def one(r, x):
            if x is None or len(x) < 256:
                return None
            x = np.asarray(x, float)
            frames = np.lib.stride_tricks.sliding_window_view(x, 256)[::128] * np.hanning(256)
            power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
            power = (power - power.min()) / max(power.max() - power.min(), 1e-300)
            hz = np.fft.rfftfreq(256, 1 / r)
            return bool((power[:, (hz >= low) & (hz <= high)] > eps).any())

        return pd.Series([one(r, x) for r, x in zip(rates, columns)])

    return check(rate, samples)


#: Element types of tensor files; bf16 is the upper half of a float.
DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1"}


def elements(raw: bytes, dtype: str) -> np.ndarray:
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    if dtype not in DTYPES:
        raise ValueError(f"tensor type {dtype} is not supported")
    return np.frombuffer(raw, DTYPES[dtype]).astype(np.float32)


TENSORS = "name string, shape array<int>, dtype string, values array<float>"


#: Bytes of tensors in a file, which a task holds a few times, and of values in a batch that was unpacked, about.
TENSOR_FILE, UNPACKED = 16 << 20, 8 << 20


def tensors_packed(df: DataFrame, key: str, dtype: str = "F32", most: int = TENSOR_FILE) -> DataFrame:
    """key, part, content: each key's tensors (name, shape, values) as zstd-compressed safetensors files of one element type.

    A key of more than `most` bytes has several files, dealt by tensors' names, so that no key is one task."""

    def pack(table: pa.Table) -> pa.Table:
        import zstandard

        header, body, at = {}, [], 0
        order = pc.sort_indices(table["name"]).to_pylist()
        for i in order:
            raw = table["values"][i].values.to_numpy(zero_copy_only=False).astype(DTYPES[dtype]).tobytes()
            header[table["name"][i].as_py()] = {"dtype": dtype, "shape": table["shape"][i].as_py(), "data_offsets": [at, at + len(raw)]}
            body.append(raw)
            at += len(raw)
        head = json.dumps(header, separators=(",", ":")).encode()
        head += b" " * (-len(head) % 8)
        whole = zstandard.ZstdCompressor(level=3).compress(struct.pack("<Q", len(head)) + head + b"".join(body))
        return pa.table({key: table[key].slice(0, 1), "part": table["__part"].slice(0, 1), "content": pa.array([whole], pa.binary())})

    sizes = df.groupBy(F.col(key).alias("__of")).agg(F.ceil(F.sum(F.size("values")) * np.dtype(DTYPES[dtype]).itemsize / most).alias("__parts"))
    dealt = df.join(sizes, F.col(key).eqNullSafe(F.col("__of"))).withColumn("__part", F.pmod(F.xxhash64("name"), F.greatest("__parts", F.lit(1))).cast("int"))
    return dealt.select(key, "name", "shape", "values", "__part").groupBy(key, "__part").applyInArrow(pack, f"{key} {df.schema[key].dataType.simpleString()}, part int, content binary")


def tensors_unpacked(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, name, shape, dtype, values of the tensors in zstd-compressed safetensors bytes."""

    def run(batches):
        import zstandard

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = zstandard.ZstdDecompressor().decompressobj().decompress(raw.as_buffer())
                yield from tensor_batches(key, k, batch.column(0).type, data)

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, {TENSORS}")


def tensor_batches(key: str, of, kind: pa.DataType, data: bytes):
    """key, name, shape, dtype, values of the tensors in safetensors bytes, in batches of UNPACKED bytes or one tensor."""
    size = struct.unpack("<Q", data[:8])[0]
    body, rows, held = memoryview(data)[8 + size :], [], 0

    def batch() -> pa.RecordBatch:
        names, shapes, dtypes, values = zip(*rows)
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array([of] * len(rows), kind), pa.array(names, pa.string()), pa.array(shapes, pa.list_(pa.int32())), pa.array(dtypes, pa.string()), lists], names=[key, "name", "shape", "dtype", "values"])

    for name, t in json.loads(data[8 : 8 + size]).items():
        if name != "__metadata__":
            a, b = t["data_offsets"]
            rows.append((name, t["shape"], t["dtype"], elements(body[a:b], t["dtype"])))
            held += 4 * len(rows[-1][3]) + 256
            if held >= UNPACKED:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)
