"""Queries that go through files: archives and their sidecars, SQLite, CSV, JSON, audio, and the decoders of samples."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import arrays, geometry, text
from loomset.operators import compare, tables
from loomset.plans import samples
from loomset.plans.catalog import query, t
from loomset.plans.lineage import mounted, own_folder
from loomset.sources import archives, files, tar

# -- archives ------------------------------------------------------------------------------------------

MEMBER = "CASE WHEN doc_id % 10 = 0 THEN '__meta__/' || doc_id || '.jpg' WHEN doc_id % 3 = 0 THEN 'a/' || doc_id || '.png' ELSE 'a/' || doc_id || '.jpg' END"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.when(d % 10 == 0, F.concat(F.lit("__meta__/"), d, F.lit(".jpg"))).when(d % 3 == 0, F.concat(F.lit("a/"), d, F.lit(".png"))).otherwise(F.concat(F.lit("a/"), d, F.lit(".jpg")))
    return t(spark, sf, "documents").select("doc_id", "lang", name.alias("name"), F.encode("text", "UTF-8").alias("data"))


def shards(spark: SparkSession, docs: DataFrame, folder: str) -> None:
    """docs (name, data) streamed into the archives of a folder, in place of those that are there."""
    archives.register(spark)
    tar.ordered(docs.select("name", "data"), tar.shards_for(docs)).select("name", "data").write.format("tarshards").mode("overwrite").save(mounted(folder))


@query("flow1_archive_samples", f"SELECT left(name, length(name) - 4) AS __key__, lang AS metadata, CAST(octet_length(encode(text)) AS BIGINT) AS n, sha256(text) AS sha FROM (SELECT *, {MEMBER} AS name FROM documents) WHERE name LIKE 'a/%.jpg'")
def _(spark, sf):
    """Shards are written and indexed; members meet their sidecar metadata; what is left is read by offset."""
    docs, folder = documents(spark, sf), own_folder(spark, "samples")
    shards(spark, docs, f"{folder}/shards")
    docs.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("key"), F.col("lang").alias("metadata")).write.json(f"{folder}/sidecar")
    index = spark.read.format("tarindex").load(mounted(f"{folder}/shards"))
    meta = spark.read.schema("key string, metadata string").json(f"{folder}/sidecar")
    rows = tar.read_members(samples.with_metadata(samples.chosen_members(index), meta, ["key"]))
    got = samples.by_policy(samples.samples(rows))
    return got.select("__key__", "metadata", F.octet_length("jpg").cast("long").alias("n"), F.sha2("jpg", 256).alias("sha"))


@query("join1_read_member", "SELECT 'a/' || doc_id || '.jpg' AS name, sha256(text) AS sha FROM documents WHERE doc_id = 101")
def _(spark, sf):
    folder = own_folder(spark, "member")
    shards(spark, documents(spark, sf), folder)
    index = spark.read.format("tarindex").load(mounted(folder))
    return tar.read_members(index.where("name = 'a/101.jpg'")).select("name", F.sha2("content", 256).alias("sha"))


@query("src7_refreshed_index", f"SELECT {MEMBER} AS name, CAST(octet_length(encode(text)) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size, doc_id % 2 = 0 AS again FROM documents")
def _(spark, sf):
    """Two folders of shards are indexed; one is written again with longer members; only its archives are indexed anew."""
    docs, folder = documents(spark, sf), own_folder(spark, "refresh")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0")
    shards(spark, even, f"{folder}/even")
    shards(spark, odd, f"{folder}/odd")
    path = mounted(folder)
    index = lambda: spark.read.format("tarindex").load(path)
    stored = tables.saved(index().join(tar.stat_of(spark, path).select("archive", F.col("size").alias("archive_size"), F.col("mtime").alias("archive_mtime")), "archive"), f"{folder}-index")
    shards(spark, even.withColumn("data", F.concat("data", F.encode(F.lit("+"), "UTF-8"))), f"{folder}/even")
    now = tar.stat_of(spark, path)
    gone = tar.stale(stored, now)
    fresh = index().join(gone.select("archive"), "archive", "left_semi")
    return tar.refreshed(stored, now, fresh).select("name", "size", F.col("archive").contains("/even/").alias("again"))


@query("snk2_packed_by_pattern", f"SELECT {MEMBER} AS name, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 3 <> 0")
def _(spark, sf):
    """Files of a folder that match a pattern, packed into shards; the shards are files that Spark reads back."""
    folder = own_folder(spark, "pack")
    docs = documents(spark, sf)
    shards(spark, docs, f"{folder}/all")
    loose = tar.members_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(f"{folder}/all").select(F.col("path").alias("archive"), "content"))
    chosen = tar.matching(loose, ["a/*.jpg"])
    shards(spark, chosen.select("name", "data"), f"{folder}/chosen")
    again = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(f"{folder}/chosen").select(F.col("path").alias("archive"), "content")
    return tar.members_of(again).select("name", "size")


# -- other files -----------------------------------------------------------------------------------------


@query("src2_load_json", "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS balance FROM supplier")
def _(spark, sf):
    folder = own_folder(spark, "json")
    cell = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))).otherwise(F.to_json(F.struct(F.col("s_name").alias("name"))))
    row = F.concat(F.lit('"'), F.col("s_suppkey"), F.lit('":'), cell)
    t(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 4).alias("file")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(row), ","), F.lit("}")).alias("value")).write.partitionBy("file").text(folder)
    return files.load_json(spark, folder, "name string, balance double")


@query("src4_sqlite", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def _(spark, sf):
    """A SQLite table (of a table that one machine writes), read in ranges of row ids and migrated to declared types."""
    import os

    from pyspark.sql.types import StructType

    path = mounted(own_folder(spark, "sqlite"))
    os.makedirs(path)
    with sqlite3.connect(f"{path}/db") as db:
        db.execute("CREATE TABLE supplier (s_suppkey INTEGER, s_name TEXT, s_acctbal REAL)")
        rows = t(spark, sf, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")))
        db.executemany("INSERT INTO supplier VALUES (?, ?, ?)", map(tuple, rows.toLocalIterator()))
    files.register(spark)
    (name,) = files.sqlite_tables(f"{path}/db")
    read = spark.read.format("sqlite").option("path", f"{path}/db").option("table", name).option("chunk", 64).load()
    return tables.migrated(read, StructType.fromDDL("s_suppkey bigint, s_name string, s_acctbal double"))


@query("src5_export_csv", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def _(spark, sf):
    folder = own_folder(spark, "csv")
    for name in ("nation", "region"):
        t(spark, sf, name).createOrReplaceTempView(f"export_{name}")
    files.export_csv(spark, ["export_nation", "export_region"], folder)
    read = lambda name, schema: spark.read.option("header", True).schema(schema).csv(f"{folder}/export_{name}")
    nation, region = read("nation", "k int, name string, r int"), read("region", "k int, name string")
    return nation.select("k", "name").unionByName(region.withColumn("k", F.col("k") + 100))


@query("snk1_dump_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def _(spark, sf):
    folder = own_folder(spark, "dump")
    files.dump_parquet(t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), folder)
    return files.load_parquet(spark, folder, ["o_orderkey", "o_totalprice"], "o_orderstatus = 'O'")


def sounds(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 16-bit WAVE bytes of two channels at 48 kHz: values in thousandths."""
    codes = F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000).cast("int"))
    return t(spark, sf, "embeddings").select("vec_id", files.wave_bytes(codes, 48_000, 2).alias("content"))


@query("src14_audio", "SELECT vec_id, 48000 AS rate, 2 AS channels, CAST(list_sum(list_transform(embedding, lambda x: CAST(round_even(CAST(x AS DOUBLE) * 1000, 0) AS BIGINT))) AS DOUBLE) / 2 AS s, CAST(len(embedding) // 2 AS INT) AS n FROM embeddings")
def _(spark, sf):
    a = files.wave_samples(sounds(spark, sf)).select("vec_id", "audio.rate", "audio.channels", arrays.mono(F.col("audio.samples")).alias("m"))
    return a.select("vec_id", "rate", "channels", arrays.total(F.col("m")).alias("s"), F.size("m").alias("n"))


@query("math15_high_band", "SELECT r_regionkey, r_regionkey % 2 = 1 AS high FROM region")
def _(spark, sf):
    """A tone of 440 Hz has nothing at 19 to 21 kHz, one of 20 kHz has."""
    hz = F.when(F.col("r_regionkey") % 2 == 1, 20_000).otherwise(440)
    wave = F.transform(F.sequence(F.lit(0), F.lit(9599)), lambda i: F.sin(i * hz * (6.283185307179586 / 48_000)))
    return t(spark, sf, "region").select("r_regionkey", files.has_high_band(F.lit(48_000), wave).alias("high"))


# -- decoders ----------------------------------------------------------------------------------------------


@query("flow5_decoder_chain", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN upper(lang) ELSE NULL END AS value, doc_id % 4 = 3 AS raw FROM documents")
def _(spark, sf):
    """Gzipped text, a class number, a field with a handler of its own, and one that is not asked for."""
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.col("text")).when(k == 1, F.col("doc_id").cast("string")).otherwise(F.col("lang"))
    suffix = F.when(k == 0, "txt.gz").when(k == 1, "cls").when(k == 2, "tag").otherwise("bin")
    rows = t(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("."), suffix).alias("name"), F.encode(raw, "UTF-8").alias("content"))
    rows = rows.withColumn("content", F.when(k == 0, samples.gzipped(F.col("content"))).otherwise(F.col("content")))
    own = [(r"\.tag$", lambda c: F.upper(F.decode(c, "UTF-8")))]
    got = samples.decoded_chain(rows, "name", "content", own, only=["txt", "txt.gz", "cls", "tag"])
    return got.select("doc_id", "value", F.col("content").isNotNull().alias("raw"))


@query("flow6_first_of_shard", "SELECT doc_id % 16 AS shard, min(doc_id) AS first FROM documents GROUP BY 1")
def _(spark, sf):
    d = t(spark, sf, "documents").select((F.col("doc_id") % 16).alias("shard"), F.col("doc_id").alias("first"))
    return tables.distinct_by(d, ["shard"], "first").select("shard", "first")


@query("flow7_parallel", "SELECT doc_id, true AS ranked FROM documents")
def _(spark, sf):
    rows = samples.parallel(t(spark, sf, "documents").select("doc_id").repartition(4, "doc_id"))
    return rows.select("doc_id", F.col("rank").between(0, 3).alias("ranked"))


@query("udf5_flat_exif", "SELECT c_custkey, 'Make' AS tag, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'GPSInfo/GPSLatitude', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'Exif/37121', c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def _(spark, sf):
    none = F.lit(None).cast("map<string,string>")
    c = t(spark, sf, "customer").select(
        "c_custkey",
        F.create_map(F.lit("Make"), F.col("c_name")).alias("root"),
        F.create_map(F.lit("GPSInfo"), F.create_map(F.lit("GPSLatitude"), F.col("c_nationkey").cast("string")), F.lit("Exif"), F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("37121"), F.col("c_mktsegment"))).otherwise(none)).alias("blocks"),
    )
    return c.select("c_custkey", F.explode(samples.flat_tags(F.col("root"), F.col("blocks"))).alias("tag", "value"))


@query("udf6_all_candidates", "SELECT page_id, unnest(CASE WHEN page_id % 2 = 0 THEN [url] ELSE ['https://' || bare, 'http://' || bare] END) AS url FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '^https?', ''), '^[/:.]+', '') AS bare FROM pages)")
def _(spark, sf):
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?", ""))
    return t(spark, sf, "pages").select("page_id", F.explode(text.url_candidates(u)).alias("url"))


@query("out2_image_tag", "SELECT n_nationkey, '<img src=\"data:image/png;base64,' || base64(encode(n_name)) || '\" />' AS html FROM nation")
def _(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", text.image_tag(F.encode("n_name", "UTF-8")).alias("html"))


# -- tokens, frames, tables -----------------------------------------------------------------------------------


def nested_sql(column: str, rules) -> str:
    out = column
    for pattern, to in rules:
        out = "regexp_replace(" + out + ", '" + pattern.replace("'", "''") + "', '" + to + "', 'g')"
    return out


CUT_SQL = nested_sql("text", [(text.SENTENCE, f"\\1{text.END}\\2"), *((p, text.replacement(g, "\\")) for p, g in text.TREEBANK)])


@query("str2_treebank", f"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array({CUT_SQL}, '[\\s{text.CUT}{text.END}]+'), lambda x: x <> ''), '|')) AS tokens FROM documents")
def _(spark, sf):
    words = F.transform(text.treebank_words(F.col("text")), lambda p: p["word"])
    docs = t(spark, sf, "documents").select("doc_id", "text")
    return docs.repartition(text.tasks_for(docs, "text"), "doc_id").select("doc_id", F.md5(F.array_join(words, "|")).alias("tokens"))


@query("str2_rebuilt", "SELECT doc_id, ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS words, ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sentences FROM documents")
def _(spark, sf):
    """Tokens with their connectors, of words and of sentences, make the text again."""
    rebuilt = lambda f: text.rebuilt(f(F.col("text")))
    docs = t(spark, sf, "documents").select("doc_id", "text")
    docs = docs.repartition(text.tasks_for(docs, "text"), "doc_id")
    return docs.select("doc_id", rebuilt(text.treebank_words).alias("words"), rebuilt(text.sentences_and_connectors).alias("sentences"))


@query("str4_lemmas_of_texts", "SELECT item_id, string_agg(CASE w WHEN 'dogs' THEN 'dog' WHEN 'are' THEN 'be' WHEN 'was' THEN 'be' ELSE w END, ' ' ORDER BY i) AS lemmas FROM (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark)) GROUP BY 1")
def _(spark, sf):
    from loomset.operators.lemmas import lemmas_by_table

    table = spark.createDataFrame([("dogs", "dog"), ("are", "be"), ("was", "be")], "word string, lemma string")
    b = t(spark, sf, "benchmark").select("item_id", F.lower("text").alias("text"))
    return lemmas_by_table(b, table, "item_id", "text").select("item_id", F.array_join("lemmas", " ").alias("lemmas"))


@query("math3_training_frames", "SELECT doc_id, 8 AS n, true AS ascending, true AS inside, true AS spread FROM documents")
def _(spark, sf):
    """Indices drawn for training: one for each of 8 strides, ascending, inside the video, none further from its neighbour than two strides."""
    f = arrays.jittered_indices(F.col("n_chars").cast("int") + 8, F.lit(8), F.col("doc_id"), 3)
    rows = t(spark, sf, "documents").select("doc_id", (F.col("n_chars") + 8).alias("frames"), f.alias("f"))
    pairs = F.zip_with(F.slice("f", 1, 7), F.slice("f", 2, 7), lambda a, b: b - a)
    return rows.select(
        "doc_id", F.size("f").alias("n"), F.forall(pairs, lambda d: d >= 0).alias("ascending"), F.forall("f", lambda i: (i >= 0) & (i < F.col("frames"))).alias("inside"),
        F.forall(pairs, lambda d: d <= 2 * F.ceil(F.col("frames") / 8)).alias("spread"),
    )


@query("math12_rules", "SELECT p_partkey, CAST(trunc(h * 64.0 / w) AS INT) AS height, CAST(trunc(w * 48.0 / h) AS INT) AS width, CASE WHEN w >= 64 AND h >= CAST(trunc(h * 64.0 / w) AS INT) THEN 'area' ELSE 'bicubic' END AS filter FROM (SELECT p_partkey, p_size * 7 AS w, p_partkey % 90 + 10 AS h FROM part)")
def _(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 7).alias("w"), (F.col("p_partkey") % 90 + 10).alias("h"))
    p = p.withColumn("a", geometry.to_width(F.col("w"), F.col("h"), 64)).withColumn("b", geometry.to_height(F.col("w"), F.col("h"), 48))
    return p.select("p_partkey", F.col("a.h").alias("height"), F.col("b.w").alias("width"), geometry.scale_filter(F.col("w"), F.col("h"), F.col("a.w"), F.col("a.h")).alias("filter"))


@query("math1_whole_softmax", "WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / 2) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS p FROM d), s AS (SELECT vec_id, p, list_sum(p) AS t FROM p) SELECT vec_id, unnest(list_transform(p, lambda x: round(x / t, 8))) AS p, unnest(range(0, len(p))) AS i FROM s")
def _(spark, sf):
    p = t(spark, sf, "embeddings").select("vec_id", arrays.softmax(F.col("embedding"), 2.0).alias("p"))
    return p.select("vec_id", F.posexplode("p").alias("i", "p")).select("vec_id", F.round("p", 8).alias("p"), F.col("i").cast("long").alias("i"))


@query("math9_all_channels", "SELECT vec_id, unnest(list_transform(embedding, lambda x, i: round(CAST(x AS DOUBLE) * CASE WHEN i <= 32 THEN 0.5 ELSE 0.25 END + CASE WHEN i <= 32 THEN 0.1 ELSE 0.2 END, 6))) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings")
def _(spark, sf):
    channels = F.transform(F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), lambda c: F.transform(c, lambda x: x.cast("double")))
    e = t(spark, sf, "embeddings").select("vec_id", F.posexplode(F.flatten(arrays.denormalised(channels, [0.1, 0.2], [0.5, 0.25]))).alias("i", "v"))
    return e.select("vec_id", F.round("v", 6).alias("v"), F.col("i").cast("long").alias("i"))


@query("src14_all_samples", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 2, 5) AS s, CAST(len(embedding) // 2 AS INT) AS n FROM embeddings")
def _(spark, sf):
    pairs = F.transform(F.sequence(F.lit(1), F.size("embedding") - 1, F.lit(2)), lambda i: F.slice("embedding", i, 2))
    m = t(spark, sf, "embeddings").select("vec_id", arrays.mono(pairs).alias("m"))
    return m.select("vec_id", F.round(arrays.total(F.col("m")), 5).alias("s"), F.size("m").alias("n"))


@query("topk1_all_classes", "WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), d AS (SELECT vec_id, label, i, CAST(x AS DOUBLE) / 0.5 AS x FROM e), s AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS p FROM d), r AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rank FROM s) SELECT vec_id, CAST(rank AS INT) AS rank, CAST(i AS INT) AS class_index, round(prob, 6) AS prob, 'class ' || i AS name FROM r WHERE rank <= 5 OR i = label")
def _(spark, sf):
    from loomset.operators import ranking

    e = t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("logits"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.concat(F.lit("class "), i)).alias("names"))
    return ranking.top_classes(e, "vec_id", "logits", "names", "label", 5, 0.5).withColumn("prob", F.round("prob", 6))


@query("pd9_reindexed", "SELECT k AS key, c_name AS name FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION SELECT o_custkey FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = k")
def _(spark, sf):
    left = t(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    right = t(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return compare.reindexed(left, right, ["key"])


@query("pd10_coerced", "SELECT p_partkey, 'a' AS \"column\", CASE WHEN p_partkey % 7 = 0 THEN 'na' ELSE 'value' END AS kind FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0")
def _(spark, sf):
    k = F.col("p_partkey")
    p = t(spark, sf, "part")
    left = p.select(k, F.when(k % 7 == 0, "none").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("a"))
    right = p.select(k, F.when(k % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("a"))
    return compare.differences(left, right, ["p_partkey"], coerce_numeric=True).select("p_partkey", "column", "kind")


@query("join4_inserted_count", "SELECT count(*) AS n_inserted, (SELECT count(*) FROM orders) - count(*) AS n_ignored FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))")
def _(spark, sf):
    target = t(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("p"))
    return tables.insert_report(target, rows, ["k"], "p")


@query("sql5_upserted", "SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def _(spark, sf):
    target = t(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("p"))
    return tables.upserted(target, rows, ["k"], "p")
