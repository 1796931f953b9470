"""Edge cases on small tables: nulls, NaN, blanks, overflow, conflicts, and the helpers of archives and files."""

import math

import pytest
from pyspark.sql import functions as F

from loomset.functions import arrays, geometry, text
from loomset.operators import compare, stats, tables
from loomset.plans import samples
from loomset.sources import files, tar


def column(df):
    return [r[0] for r in df.collect()]


def numbered(spark, values, kind):
    return spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").coalesce(1).sortWithinPartitions("i")


BLANKS = ["hello", "", "   ", None, None, "a", "ab", "  world  ", "\t\n"]


@pytest.mark.parametrize("least, more", [(1, set()), (2, {5}), (3, {5, 6})])
def test_blank_by_length(spark, least, more):
    df = numbered(spark, BLANKS, "string")
    want = [i in {1, 2, 3, 4, 8} | more for i in range(9)]
    assert column(df.select(text.is_blank(F.col("v"), least))) == want


def test_blank_by_words(spark):
    df = numbered(spark, ["hello", "nan", "NaN", "  NAN  ", "valid", None], "string")
    assert column(df.select(text.is_blank(F.col("v")))) == [False, True, True, True, False, True]
    assert column(df.select(text.is_blank(F.col("v"), nan_words=None))) == [False] * 5 + [True]
    df = numbered(spark, ["N/A", "na", "  Unknown  ", "valid", "n/a", None], "string")
    assert column(df.select(text.is_blank(F.col("v"), nan_words={"n/a", "na", "unknown"}))) == [True, True, True, False, True, True]
    assert column(numbered(spark, ["  "], "string").select(text.is_blank(F.col("v")))) == [True]


def frame(spark, b=(10.0, 20.0, 30.0), a=(1, 2, 3), c=("x", "y", "z"), idx=(0, 1, 2), a_type="long"):
    return spark.createDataFrame(list(zip(idx, [float(x) if a_type == "double" else x for x in a], b, c)), f"idx long, a {a_type}, b double, c string")


def test_comparison_of_frames(spark):
    base = frame(spark)
    diff = lambda other, **o: sorted((r.idx, r.column, r.kind) for r in compare.differences(base, other, ["idx"], **o).collect())
    assert diff(frame(spark)) == []
    assert len(diff(frame(spark, (-1.0, -2.0, -3.0), (100, 200, 300), ("u", "v", "w")))) == 9
    assert diff(frame(spark, (10.0, 20.0 + 1e-12, 30.0))) == []
    assert diff(frame(spark, (10.0, 20.01, 30.0))) == [(1, "b", "value")]
    assert diff(frame(spark, (10.0, 20.01, 30.0)), atol=0.1) == []
    assert diff(frame(spark, idx=(10, 11, 12))) == [(i, None, "left only") for i in (0, 1, 2)] + [(i, None, "right only") for i in (10, 11, 12)]
    assert diff(frame(spark, a_type="double")) == []
    assert compare.column_differences(base, frame(spark, a_type="double")) == [("a", "type bigint and double")]
    assert compare.column_differences(base, base.withColumn("new_col", F.lit(1)).drop("c")) == [("c", "left only"), ("new_col", "right only")]
    nan = frame(spark, (10.0, math.nan, 30.0))
    assert diff(nan) == [(1, "b", "na")]
    both = lambda x, y, **o: [r.kind for r in compare.differences(x, y, ["idx"], **o).collect()]
    assert both(nan, nan) == [] and both(nan, nan, na_equal=False) == ["value"]
    assert both(nan, frame(spark, (10.0, 999.0, 30.0))) == ["na"]
    empty = base.limit(0)
    assert both(empty, empty) == []


def test_numbers_as_text(spark):
    left = spark.createDataFrame([(0, "1", "10.0"), (1, "2", "x")], "idx int, a string, b string")
    right = spark.createDataFrame([(0, 1, 10.0), (1, 2, 20.0)], "idx int, a long, b double")
    assert len(compare.differences(left, right, ["idx"]).collect()) == 4
    got = [(r.idx, r.column, r.kind) for r in compare.differences(left, right, ["idx"], coerce_numeric=True).collect()]
    assert got == [(1, "b", "na")]


def test_softmax_of_small_large_and_negative_values(spark):
    cases = [([1.0, 2.0, 3.0], 1.0, [0.09003057, 0.24472847, 0.66524096]), ([1.0, 2.0, 3.0], 2.0, [0.186324, 0.307196, 0.50648]), ([1000.0, 2000.0, 3000.0], 1.0, [0, 0, 1]), ([-1.0, -2.0, -3.0], 1.0, [0.66524096, 0.24472847, 0.09003057])]
    for logits, temp, want in cases:
        (got,) = column(numbered(spark, [logits], "array<double>").select(arrays.softmax(F.col("v"), temp)))
        assert got == pytest.approx(want, abs=1e-6)
    assert column(numbered(spark, [None], "array<double>").select(arrays.softmax(F.col("v")))) == [None]


def test_quantisation_error_is_small_and_constants_stay(spark):
    vectors = [[math.log(0.5 + i / 500) for i in range(1000)], [-10 + i / 50 for i in range(1001)], [math.sin(i) for i in range(1000)], [3.5] * 10]
    df = numbered(spark, vectors, "array<double>").select("i", "v", arrays.quantised(F.col("v")).alias("q"))
    for r in df.select("i", "v", arrays.dequantised(F.col("q.codes"), F.col("q.min"), F.col("q.max")).alias("d")).collect():
        assert sum((x - y) ** 2 for x, y in zip(r.v, r.d)) / len(r.v) < 1e-2


def test_half_precision_bounds(spark):
    assert column(numbered(spark, [[65499.0, -65499.0, 0.0]], "array<double>").select(arrays.half_checked(F.col("v")))) == [[65499.0, -65499.0, 0.0]]
    with pytest.raises(Exception, match="half precision"):
        numbered(spark, [[70000.0, 1.0, -70000.0]], "array<double>").select(arrays.half_checked(F.col("v"))).collect()


def parameters():
    """Blocks of two towers: 47 names that make 20 groups."""
    tail = [("attn.in_proj_bias", 3), ("attn.out_proj.bias", 1), ("ln_1.bias", 1), ("ln_1.weight", 1), ("ln_2.bias", 1), ("ln_2.weight", 1), ("mlp.c_fc.bias", 4), ("mlp.c_proj.bias", 1)]
    block = lambda tower, i, width, parts: [((width * k,), f"{tower}transformer.resblocks.{i}.{n}") for n, k in parts]
    rows = block("", 10, 512, tail[6:]) + block("", 11, 512, tail)
    rows += [((768,), f"visual.ln_{x}.{y}") for x in ("post", "pre") for y in ("bias", "weight")]
    for i in range(4):
        rows += block("visual.", i, 768, tail)
    return rows + block("visual.", 4, 768, tail[:1])


def test_grouped_parameter_names(spark):
    rows = parameters()
    assert len(rows) == 47
    make = lambda rows: spark.createDataFrame([(n, list(s), i, str(s)) for i, (s, n) in enumerate(rows)], "name string, data array<int>, position int, c string")
    labels = [r.label for r in stats.grouped_params(make(rows)).collect()]
    assert len(labels) == 20
    assert labels[0] == "transformer.resblocks.[10-11].mlp.c_fc.bias" and labels[8] == "visual.transformer.resblocks.[0-4].attn.in_proj_bias"
    assert labels[-4:] == ["visual.ln_post.bias", "visual.ln_post.weight", "visual.ln_pre.bias", "visual.ln_pre.weight"]
    rows[23] = ((4321,), rows[23][1])  # another shape is a group of its own
    assert rows[23][1] in [r.label for r in stats.grouped_params(make(rows)).collect()]


def test_conflicting_data_in_a_group_fails(spark):
    df = spark.createDataFrame([("block.0.weight", 0, "float 0.001"), ("block.1.weight", 1, "string 0.001")], "name string, position int, lr string").withColumn("data", F.lit("0.001"))
    with pytest.raises(Exception, match="mismatch"):
        stats.grouped_params(df, conflict="lr").collect()


@pytest.mark.parametrize(
    "options, want",
    [
        (["key=value"], {"key": "value"}), (["k1=a", "k2=b"], {"k1": "a", "k2": "b"}), (["parent.child=value"], {"parent": {"child": "value"}}), (["key=a,b,c"], {"key": ["a", "b", "c"]}), (["key=1,2,3"], {"key": [1, 2, 3]}),
        (["key=1,value,3"], {"key": [1, "value", 3]}), (["key=a,b,"], {"key": ["a", "b"]}), (["key="], {"key": None}), (["a=true", "b=False"], {"a": True, "b": False}), (["a=1.5", "b=-3.14", "c=1e-10"], {"a": 1.5, "b": -3.14, "c": 1e-10}), (None, {}),
        (["p.x=a,b", "p.y=1,2", "p.z=v"], {"p": {"x": ["a", "b"], "y": [1, 2], "z": "v"}}),
    ],
)
def test_option_lists(options, want):
    assert text.parse_dotlist(options) == want


def test_sizes(spark):
    one = spark.createDataFrame([(200, 100)], "w int, h int")
    size = lambda c: tuple(one.select(c.alias("s")).first().s)
    w, h = F.col("w"), F.col("h")
    assert size(geometry.smaller_side(w, h, 50)) == (100, 50) and size(geometry.bigger_side(w, h, 250)) == (250, 125)
    assert size(geometry.to_width(w, h, 50)) == (50, 25) and size(geometry.to_height(w, h, 50)) == (100, 50)
    assert one.select(geometry.scale_filter(w, h, F.lit(50), F.lit(25)), geometry.scale_filter(w, h, F.lit(300), F.lit(50))).first()[:] == ("area", "bicubic")


def test_tokens_and_connectors(spark):
    cases = {
        "skiing on a mountain slope.": ["skiing", "on", "a", "mountain", "slope", "."],
        "I can't say; it's $3.50, isn't it?": ["I", "ca", "n't", "say", ";", "it", "'s", "$", "3.50", ",", "is", "n't", "it", "?"],
        'He said "cannot" (twice). They\'ll go...': ["He", "said", '"', "can", "not", '"', "(", "twice", ")", ".", "They", "'ll", "go", "..."],
        "": [], "One. Two": ["One", ".", "Two"], "é -- ü": ["é", "--", "ü"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", text.treebank_words(F.col("t")).alias("w"), text.sentences_and_connectors(F.col("t")).alias("s")).collect():
        assert [p.word for p in r.w] == cases[r.t], r.t
        assert "".join(p.word + p.conn for p in r.w) == r.t == "".join(p.word + p.conn for p in r.s)
    (whole,) = column(spark.createDataFrame([("A b!  C d.",)], "t string").select(text.sentences_and_connectors(F.col("t"))))
    assert [tuple(p) for p in whole] == [("A b!", "  "), ("C d.", "")]
    assert column(numbered(spark, [None], "string").select(text.treebank_words(F.col("v")))) == [None]


def test_members_by_offset_and_patterns(spark, tmp_path):
    data = [("a/x.jpg", b"1" * 700), ("a/b/y.jpg", b""), ("a/z.json", b'{"name": "n", "value": 1}'), ("w.jpg", b"2")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in data], "name string, data binary")
    tar.written(tar.packed(df, tar.shards_for(df)), str(tmp_path))
    tar.register(spark)
    index = spark.read.format("tarindex").load(str(tmp_path))
    assert {(r.name, bytes(r.content)) for r in tar.read_members(index).collect()} == set(data)
    names = lambda *p: {r.name for r in tar.matching(df, list(p)).collect()}
    assert names("*.jpg") == {"w.jpg"} and names("**.jpg") == {"a/x.jpg", "a/b/y.jpg", "w.jpg"} and names("a/*", "?.jpg") == {"a/x.jpg", "a/z.json", "w.jpg"}


def test_element_types_of_tensors(spark):
    df = spark.createDataFrame([("k", "t", [2, 2], [1.0, -2.0, 3.0, 0.0])], "k string, name string, shape array<int>, values array<float>")
    for dtype in ("F64", "F32", "F16", "I64", "I8"):
        (r,) = files.tensors_unpacked(files.tensors_packed(df, "k", dtype), "k").collect()
        assert (r.dtype, r.shape, r["values"]) == (dtype, [2, 2], [1.0, -2.0, 3.0, 0.0])
    assert files.elements(b"\x80\x3f\x00\xc0", "BF16").tolist() == [1.0, -2.0]
    with pytest.raises(ValueError, match="F4"):
        files.elements(b"", "F4")


def test_decoders(spark):
    rows = [("1.txt.gz", b"zip"), ("2.cls", b"7"), ("3.json", b'{"a": 1}'), ("4.bin", b"\xff"), ("5.txt", None), ("6.cls", b"x")]
    df = spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in rows], "name string, content binary")
    df = df.withColumn("content", F.when(F.col("name") == "1.txt.gz", samples.gzipped(F.col("content"))).otherwise(F.col("content")))
    got = {r.name: (r.value, r.content and bytes(r.content)) for r in samples.decoded_chain(df, "name", "content", []).collect()}
    assert got == {"1.txt.gz": ("zip", None), "2.cls": ("7", None), "3.json": ('{"a": 1}', None), "4.bin": (None, b"\xff"), "5.txt": (None, None), "6.cls": (None, b"x")}
    only = {r.name: r.value for r in samples.decoded_chain(df, "name", "content", [], only=["cls"]).collect()}
    assert only["2.cls"] == "7" and only["3.json"] is None


def test_tags_without_blocks(spark):
    df = spark.createDataFrame([({"Make": "m"}, {"GPS": {"Lat": "1"}, "Exif": None})], "root map<string,string>, blocks map<string,map<string,string>>")
    assert column(df.select(samples.flat_tags(F.col("root"), F.col("blocks")))) == [{"Make": "m", "GPS/Lat": "1"}]


def test_inserts_with_nulls_and_reindexing(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    rows = spark.createDataFrame([(1, "b", 0), (2, "c", 1), (2, "d", 2), (None, "e", 3)], "k int, v string, p int")
    assert sorted(map(tuple, tables.upserted(target, rows, ["k"], "p").collect()), key=str) == [(1, "a"), (2, "c"), (None, "e")]
    assert tables.insert_report(target, rows, ["k"], "p").first()[:] == (2, 2)
    assert sorted(map(tuple, compare.reindexed(target, rows.where("k is not null"), ["k"]).collect())) == [(1, "a"), (2, None)]


def test_audio_that_is_none(spark):
    df = spark.createDataFrame([(0, None), (1, bytearray(b"RIFF"))], "i int, content binary")
    assert [r.audio.samples for r in files.wave_samples(df).collect()] == [None, None]
