"""Vector functions over array columns, computed by the JVM; products of all pairs by Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.plans.lineage import materialised


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once a row: what a lambda refers to is computed again for each of its elements."""
    return F.transform(F.array(value), fn)[0]


def softmax(logits: Column, temp: float = 1.0) -> Column:
    """Softmax of logits / temp, shifted by the maximum so that no exponential overflows."""
    powers = lambda x, most: F.transform(x, lambda v: F.exp((v.cast("double") - most) / temp))
    shares = lambda p: bound(total(p), lambda t: F.transform(p, lambda e: e / t))
    return bound(F.array_max(logits).cast("double"), lambda most: bound(powers(logits, most), shares))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def unit(x: Column, eps: float = 1e-8) -> Column:
    """x over its Euclidean norm, or over eps if that is larger."""
    return bound(F.greatest(F.sqrt(dot(x, x)), F.lit(eps)), lambda norm: F.transform(x, lambda v: v.cast("double") / norm))


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals, halves away from zero, NaN and null as they are; |x| * 10 ** digits must fit a long.

    F.round makes a decimal of each value, which took more time than the products of all pairs.
    """
    y = x * 10.0**digits
    return F.when(F.isnan(x), x).otherwise(F.when(y < 0, F.ceil(y - 0.5)).otherwise(F.floor(y + 0.5)) / 10.0**digits)


#: Vectors in a block, about; two blocks are multiplied at a time.
BLOCK = 1024
#: Partitions of a side, each of which meets each of the other in a task: of four blocks, but FEW at least, if there are as many blocks, and SIDE at most.
FEW, SIDE = 12, 250


def blocks(rows: DataFrame) -> DataFrame:
    """block: about BLOCK rows each as an Arrow stream, written once to the shared folder."""

    def packed(batches):
        held = pa.Table.from_batches(batches := list(batches)) if batches else None
        for at in range(0, held.num_rows if held else 0, 2 * BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema) as stream:
                stream.write_table(held.slice(at, 2 * BLOCK).combine_chunks())
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

    n = max(1, -(-rows.count() // BLOCK))
    return materialised(rows.repartition(n).mapInArrow(packed, "block binary")).coalesce(min(n, max(FEW, -(-n // 4)), SIDE))


def cosine_matrix(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str, eps: float = 1e-8) -> DataFrame:
    """left_id, right_id, similarity of every row of left with every row of right; null where a value is null or lengths differ.

    The result has len(left) * len(right) rows by definition. Both sides are written once, as blocks; each block of one
    meets each of the other where a task reads both, without a shuffle, and is multiplied with it as matrices. So the disk
    that this takes grows with the rows, not with their square. Vectors are kept as they are given and normalised there.
    """
    a = left.select(F.col(left_id).alias("left_id"), F.col(vector).alias("u"))
    b = right.select(F.col(right_id).alias("right_id"), F.col(vector).alias("v"))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((a, "left_id"), (b, "right_id")))
    pairs = blocks(a).rdd.cartesian(blocks(b).rdd).map(lambda p: (bytes(p[0].block), bytes(p[1].block)))

    def run(batches):
        read = lambda x: pa.ipc.open_stream(x.as_py()).read_all()
        for batch in batches:
            for x, y in zip(*batch.columns):
                yield from multiplied(read(x), read(y), eps).to_batches()

    return left.sparkSession.createDataFrame(pairs, "a binary, b binary", verifySchema=False).mapInArrow(run, f"{kinds}, similarity double")


def matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the rows of vectors without nulls and these as a matrix."""
    vectors = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()  # null vectors have no values there
    end = np.cumsum(np.maximum(size, 0))
    holes = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
    whole = (size >= 0) & (holes[end] == holes[end - np.maximum(size, 0)])
    values = flat.to_numpy(zero_copy_only=False)
    rows = {n: np.flatnonzero(whole & (size == n)) for n in np.unique(size[whole]).tolist()}
    return {n: (r, values[(end[r] - n)[:, None] + np.arange(n)].astype(float)) for n, r in rows.items()}


def multiplied(a: pa.Table, b: pa.Table, eps: float) -> pa.Table:
    """The products of two blocks (left_id, u) and (right_id, v), each vector over its norm as in unit()."""
    units = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), eps)
    out = np.zeros((a.num_rows, b.num_rows))
    known = np.zeros(out.shape, bool)
    if out.size:
        left, right = matrices(a["u"]), matrices(b["v"])
        for n in left.keys() & right.keys():
            at = np.ix_(left[n][0], right[n][0])
            out[at], known[at] = units(left[n][1]) @ units(right[n][1]).T, True
    i, j = np.repeat(np.arange(a.num_rows), b.num_rows), np.tile(np.arange(b.num_rows), a.num_rows)
    return pa.table({"left_id": a["left_id"].take(pa.array(i)), "right_id": b["right_id"].take(pa.array(j)), "similarity": pa.array(out.ravel(), mask=~known.ravel())})


def frame_indices(n: Column, t: Column) -> Column:
    """t evenly spread indices of n frames: the middle of each of t equal parts."""
    step = n.cast("double") / t.cast("double")
    return F.transform(F.sequence(F.lit(0), (t - 1).cast("int")), lambda i: F.floor(i * step + step / 2).cast("int"))


def jittered_indices(n: Column, t: Column, key: Column, seed: int = 0) -> Column:
    """Training indices: whole strides of n over t parts in an order drawn for the row, each index uniform in its stride.

    Draws are hashes of key, seed and place, so a row gives the same indices in every run.
    """
    part = (n / t).cast("int")
    extra = (n % t).cast("int")
    places = F.sequence(F.lit(0), (t - 1).cast("int"))
    # the parts of part + 1 frames are drawn by rank of a hash
    ranked = F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(key, F.lit(seed), i).alias("h"), i.alias("i"))))
    long = F.transform(F.slice(ranked, 1, extra), lambda r: r["i"])
    size = F.transform(places, lambda i: part + F.when(F.array_contains(long, i), 1).otherwise(0))
    begin = F.transform(places, lambda i: F.aggregate(F.slice(size, 1, i), F.lit(0), lambda s, x: s + x))
    return F.zip_with(begin, size, lambda b, s: b + F.when(s > 0, F.pmod(F.xxhash64(key, F.lit(seed + 1), b), s)).otherwise(0).cast("int"))


def distributed(num: Column, chunks: Column) -> Column:
    """num split into that many parts, the first num mod chunks one larger."""
    return F.transform(F.sequence(F.lit(0), (chunks - 1).cast("int")), lambda i: F.floor(num / chunks).cast("int") + F.when(i < num % chunks, 1).otherwise(0))


def quantised(feat: Column) -> Column:
    """struct<codes array<smallint>, min, max>: affine codes from 0 to 255, half to even; a constant vector has codes 0."""
    ends = F.struct(F.array_min(feat).cast("double").alias("min"), F.array_max(feat).cast("double").alias("max"))

    def codes(e: Column) -> Column:
        code = lambda x: F.when(e["max"] > e["min"], F.rint((x.cast("double") - e["min"]) * 255.0 / (e["max"] - e["min"]))).otherwise(F.lit(0.0)).cast("smallint")
        return F.struct(F.transform(feat, code).alias("codes"), e["min"].alias("min"), e["max"].alias("max"))

    return bound(ends, codes)


def dequantised(codes: Column, low: Column, high: Column) -> Column:
    return F.transform(codes, lambda q: q / F.lit(255.0) * (high - low) + low)


def half_checked(feat: Column, limit: float = 65500.0) -> Column:
    """feat as array<float>; a value beyond half precision's range raises."""
    over = F.array_max(F.transform(feat, lambda x: F.abs(x.cast("double")))) > limit
    return F.when(over, F.raise_error(F.lit("value out of half precision's range"))).otherwise(F.transform(feat, lambda x: x.cast("float")))


def denormalised(channels: Column, mean: list[float], std: list[float]) -> Column:
    """x * std + mean for each channel of array<array<double>>."""
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.transform(channels, lambda c, i: F.transform(c, lambda x: x * F.element_at(s, i + 1) + F.element_at(m, i + 1)))


def ema(values: Column, decay: float = 0.9) -> Column:
    """Exponential moving average of an ordered array; the first value seeds it."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1).cast("double"), lambda v, x: v * decay + x * (1 - decay))


def mono(samples: Column) -> Column:
    """Mean over channels of array<array<double>> (samples of channels)."""
    return F.transform(samples, lambda s: total(s) / F.size(s))


def stereo(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.array(x, x))
