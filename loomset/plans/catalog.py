"""Every operator as a query over the provided tables, with SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomset.functions import arrays, geometry, text
from loomset.operators import compare, ranking, stats, tables, throttle
from loomset.plans import samples
from loomset.sources import files, tar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- sources and sinks -------------------------------------------------------------------------------


@query("src1_load_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(spark, sf):
    return files.load_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"], "l_quantity > 45")


@query("src2_json_objects", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def _(spark, sf):
    cell = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    whole = t(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), cell)))).alias("value"))
    rows = whole.select(F.explode(files.json_rows(F.col("value"), "name string, region bigint")).alias("e"))
    return rows.select(F.col("e.key").alias("key"), "e.value.*")


@query("src3_sorted_table", "SELECT row_number() OVER (ORDER BY o_totalprice ASC NULLS LAST, o_orderkey) - 1 AS idx, CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def _(spark, sf):
    df = tables.converted(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), StructType.fromDDL("o_orderkey bigint, o_totalprice double"))
    return ranking.positioned(df, ["o_totalprice", "o_orderkey"], "idx")


@query("src4_migrate", "SELECT c_custkey, replace(c_name || chr(0) || 'x', chr(0), ' ') AS c_name, c_acctbal FROM customer")
def _(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit("\0x")).alias("c_name"), "c_acctbal")
    return tables.migrated(df, StructType.fromDDL("c_custkey bigint, c_name string, c_acctbal double"))


NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("src5_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {n}" for n in NAMES))
def _(spark, sf):
    return tables.table_counts(spark, NAMES, sf)


@query("src5_preview", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(5)


def member_files(spark, sf):
    return t(spark, sf, "documents").select(F.format_string("doc_%d.txt", "doc_id").alias("name"), F.encode("text", "UTF-8").alias("data"))


def archives(spark, sf):
    docs = member_files(spark, sf)
    return tar.packed(docs, tar.shards_for(docs))


@query("src6_tar_index", "SELECT 'doc_' || doc_id || '.txt' AS name, octet_length(encode(text)) AS size FROM documents")
def _(spark, sf):
    return tar.index_of(archives(spark, sf)).select("name", "size")


@query("src8_last_member_wins", "SELECT o_custkey % 50 AS archive, 'm' || o_custkey AS name, max(o_orderkey) AS position FROM orders GROUP BY ALL")
def _(spark, sf):
    idx = t(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("archive"), F.concat(F.lit("m"), F.col("o_custkey")).alias("name"), F.col("o_orderkey").alias("position"), F.lit(0).alias("offset"), F.lit(0).alias("size"), F.lit(0.0).alias("mtime"))
    return tar.last_wins(idx).select("archive", "name", "position")


@query("src6_stale_archives", "SELECT s_suppkey AS archive FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0")
def _(spark, sf):
    s = t(spark, sf, "supplier")
    stored = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("archive"), F.lit(1).alias("archive_size"), F.lit(1.0).alias("archive_mtime"))
    stat = s.select(F.col("s_suppkey").alias("archive"), F.when(F.col("s_suppkey") % 5 == 0, 2).otherwise(1).alias("size"), F.lit(1.0).alias("mtime"))
    return tar.stale(stored, stat).select("archive")


@query("src9_tar_members", "SELECT 'doc_' || doc_id || '.txt' AS name, octet_length(encode(text)) AS size, sha256(text) AS sha FROM documents")
def _(spark, sf):
    return tar.members_of(archives(spark, sf)).select("name", "size", F.sha2("data", 256).alias("sha"))


@query("snk3_verify_tar", "SELECT 'doc_' || doc_id || '.txt' AS name, CASE WHEN doc_id % 100 = 0 THEN 'missing' ELSE 'size' END AS problem FROM documents WHERE doc_id % 100 = 0 OR doc_id % 77 = 0")
def _(spark, sf):
    docs = member_files(spark, sf)
    number = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    changed = docs.where(number % 100 != 0).withColumn("data", F.when(number % 77 == 0, F.concat("data", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("data")))
    actual = tar.members_of(tar.packed(changed, tar.shards_for(changed)))
    return tar.verified(docs, actual)


@query("snk4_tensors", "SELECT label, 'v' || vec_id AS name, len(embedding) AS n FROM embeddings")
def _(spark, sf):
    e = t(spark, sf, "embeddings").select("label", F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.array(F.size("embedding")).alias("shape"), F.col("embedding").alias("values"))
    return files.tensors_unpacked(files.tensors_packed(e, "label"), "label").select("label", "name", F.size("values").cast("long").alias("n"))


@query("snk6_html", "SELECT '<table>' || string_agg('<tr><' || tag || '>' || r_regionkey || '</' || tag || '><' || tag || '>' || r_name || '</' || tag || '></tr>', '' ORDER BY r_regionkey) || '</table>' AS html FROM (SELECT *, CASE WHEN r_regionkey = 0 THEN 'th' ELSE 'td' END AS tag FROM region)")
def _(spark, sf):
    r = t(spark, sf, "region").select(F.array(F.col("r_regionkey").cast("string"), "r_name").alias("cells"), "r_regionkey")
    return text.html_table(r, "cells", "r_regionkey")


@query("src10_cache_get", "SELECT o_orderkey AS position, o_custkey AS key, c_name AS value FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def _(spark, sf):
    cache = t(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return tables.cache_get(cache, t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("position")))


@query("src10_cache_put", "SELECT c_custkey AS key, coalesce(v, 'old') AS value FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(spark, sf):
    cache = t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("old").alias("value"))
    return tables.cache_put(cache, t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("position")))


@query("src14_mono", "SELECT vec_id, round((embedding[1] + embedding[2]) / 2, 6) AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)")
def _(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", arrays.mono(F.array(F.slice("embedding", 1, 2))).alias("m"))
    return e.select("vec_id", F.round(F.element_at("m", 1), 6).alias("m"))


# -- projections and filters -------------------------------------------------------------------------


@query("fil1_by_name", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 77")
def _(spark, sf):
    return t(spark, sf, "part").where("p_partkey = 77").select("p_partkey", "p_name")


@query("fil2_is_blank", "SELECT event_id, event_type IS NULL OR len(trim(event_type)) < 5 OR lower(trim(event_type)) IN ('click') AS blank FROM events")
def _(spark, sf):
    return t(spark, sf, "events").select("event_id", text.is_blank(F.col("event_type"), 5, ["Click"]).alias("blank"))


@query("fil3_visible", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    return tables.visible(t(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("_state")))


@query("prj1_convert", "SELECT CAST(l_orderkey AS VARCHAR) AS k, CAST(l_linenumber AS DOUBLE) AS n, length(l_returnflag) > 0 AS flag FROM lineitem")
def _(spark, sf):
    df = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))
    return tables.converted(df, StructType.fromDDL("k string, n double, flag boolean"))


@query("prj2_replace_nul", "SELECT p_partkey, replace(p_name || chr(0), chr(0), ' ') AS p_name FROM part")
def _(spark, sf):
    return text.replace_nul(t(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit("\0")).alias("p_name")))


@query("prj3_unpack_json", "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events")
def _(spark, sf):
    return samples.unpacked_json(t(spark, sf, "events").select("event_id", "props"), "props", "k bigint")


INDEX = "SELECT doc_id, 'shard-' || (doc_id % 16) || '.tar' AS archive, CASE WHEN doc_id % 10 = 0 THEN '__meta__/' || doc_id || '.jpg' WHEN doc_id % 3 = 0 THEN 'a/' || doc_id || '.png' ELSE 'a/' || doc_id || '.jpg' END AS name, n_chars AS size FROM documents"


def member_index(spark, sf):
    d = F.col("doc_id")
    name = F.when(d % 10 == 0, F.concat(F.lit("__meta__/"), d, F.lit(".jpg"))).when(d % 3 == 0, F.concat(F.lit("a/"), d, F.lit(".png"))).otherwise(F.concat(F.lit("a/"), d, F.lit(".jpg")))
    return t(spark, sf, "documents").select("doc_id", F.concat(F.lit("shard-"), d % 16, F.lit(".tar")).alias("archive"), name.alias("name"), F.col("n_chars").alias("size"))


@query("prj4_chosen_members", f"SELECT archive, name FROM ({INDEX}) WHERE NOT regexp_matches(name, '__[^/]*__($|/)') AND name LIKE '%.jpg' AND size > 500")
def _(spark, sf):
    return samples.chosen_members(member_index(spark, sf), select=F.col("size") > 500).select("archive", "name")


@query("prj5_samples", f"SELECT left(name, length(name) - 4) AS __key__, archive AS __url__, CASE WHEN name LIKE '%.png' THEN 'suffix' END AS error FROM ({INDEX})")
def _(spark, sf):
    rows = member_index(spark, sf).withColumn("metadata", F.lit(None).cast("string")).withColumn("content", F.lit(None).cast("binary"))
    return samples.samples(rows).select("__key__", "__url__", "error")


# -- joins ---------------------------------------------------------------------------------------------

OFFSETS = "SELECT doc_id % 8 AS file_id, 'doc_' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.json' ELSE '.txt' END AS file_name, doc_id * 512 AS \"offset\", n_chars AS file_size FROM documents"


def relations(spark, sf):
    d = F.col("doc_id")
    offsets = t(spark, sf, "documents").select((d % 8).alias("file_id"), F.concat(F.lit("doc_"), d, F.when(d % 4 == 0, ".json").otherwise(".txt")).alias("file_name"), (d * 512).alias("offset"), F.col("n_chars").alias("file_size"))
    shards = spark.range(8).select(F.col("id").alias("file_id"), F.concat(F.lit("shard-"), F.col("id"), F.lit(".tar")).alias("file_name"), F.lit(1.0).alias("mtime"))
    return offsets, shards


@query("join1_member_by_name", f"SELECT file_id, file_name, 'shard-' || file_id || '.tar' AS archive, \"offset\", file_size FROM ({OFFSETS}) WHERE file_name = 'doc_101.txt'")
def _(spark, sf):
    return tar.by_name(*relations(spark, sf), "doc_101.txt").select("file_id", "file_name", "archive", "offset", "file_size")


@query("join2_members_with_metadata", f"SELECT m.name, d.lang AS metadata FROM (SELECT * FROM ({INDEX}) WHERE name LIKE 'a/%.jpg') m JOIN documents d ON m.name = 'a/' || d.doc_id || '.jpg'")
def _(spark, sf):
    meta = t(spark, sf, "documents").select(F.concat(F.lit("a/"), F.col("doc_id")).alias("key"), F.col("lang").alias("metadata"))
    return samples.with_metadata(samples.chosen_members(member_index(spark, sf)), meta, ["key"]).select("name", "metadata")


@query("join3_insert_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1")
def _(spark, sf):
    target = t(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("pos"))
    return tables.inserted(target, rows, ["o_custkey"], "pos", "first")


@query("join4_insert_keep_last", "SELECT l_partkey, l_suppkey, max_by(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity) AS q FROM lineitem WHERE l_partkey % 2 = 1 GROUP BY 1, 2")
def _(spark, sf):
    li = t(spark, sf, "lineitem")
    rows = li.select("l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity")).alias("pos"))
    return tables.inserted(li.where("l_partkey % 2 = 0").select("l_partkey", "l_suppkey"), rows, ["l_partkey", "l_suppkey"], "pos", "last")


@query(
    "join5_compare_frames",
    """SELECT c_custkey, 'c_acctbal' AS "column", 'value' AS kind FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 11 <> 0 AND NOT abs(c_acctbal - (c_acctbal + 1)) <= 1e-8 + 1e-5 * abs(c_acctbal + 1)
    UNION ALL SELECT c_custkey, 'c_name', 'na' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 11 <> 0 UNION ALL SELECT c_custkey, NULL, 'left only' FROM customer WHERE c_custkey % 11 = 0""",
)
def _(spark, sf):
    left = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    right = left.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal") + 1e-12)).withColumn("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")))
    return compare.differences(left, right, ["c_custkey"]).select("c_custkey", "column", "kind")


LEMMAS = [("the", "the"), ("ing", "ing"), ("of", "of")]


@query("join6_cached_apply", "SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN 'known' ELSE upper(event_type) END AS value FROM events")
def _(spark, sf):
    cache = spark.createDataFrame([("click", "known")], "key string, value string")
    return tables.cached_apply(t(spark, sf, "events").select("event_id", "event_type"), cache, "event_type", lambda miss: miss.withColumn("value", F.upper("key")))[0]


# -- aggregations --------------------------------------------------------------------------------------


@query("agg1_files_per_shard", f"SELECT 'shard-' || file_id || '.tar' AS archive, array_to_string(list_sort(list(file_name)), ',') AS names FROM ({OFFSETS}) WHERE file_name LIKE '%.json' GROUP BY 1")
def _(spark, sf):
    return tar.files_per_shard(*relations(spark, sf), ".json").select("archive", F.array_join("names", ",").alias("names"))


@query(
    "agg2_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, .25), 6) AS q25, round(quantile_cont({c}, .5), 6) AS q50, round(quantile_cont({c}, .75), 6) AS q75, max({c}) AS max FROM lineitem"
        for c in ("l_quantity", "l_discount")
    ),
)
def _(spark, sf):
    d = stats.described(t(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    return d.select("column", "count", *(F.round(c, 6).alias(c) if c not in ("min", "max") else c for c in ("mean", "std", "min", "q25", "q50", "q75", "max")))


@query("agg3_chunked_mean", "SELECT round(avg(o_totalprice), 4) AS mean FROM orders")
def _(spark, sf):
    return stats.chunked_mean(t(spark, sf, "orders"), "o_totalprice", "o_orderkey", 1000).select(F.round("mean", 4).alias("mean"))


@query("agg4_tensor_stats", "SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)")
def _(spark, sf):
    e = t(spark, sf, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    return stats.tensor_stats(e).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def params(spark, sf):
    p = F.col("p_partkey")
    name = F.when(p % 10 == 0, F.concat(F.lit("head.w"), F.chr(F.lit(97) + (p / 10 % 26).cast("int")))).otherwise(F.concat(F.lit("blocks."), (p / 4).cast("int"), F.lit(".part"), F.chr((F.lit(97) + p % 4).cast("int"))))
    return t(spark, sf, "part").select(name.alias("name"), F.array(F.lit(4), (p % 3 + 1).cast("int")).alias("shape"), (p % 2 == 0).alias("requires_grad"), p.alias("position"), F.col("p_brand").alias("group_name"))


@query("agg5_count_params", "SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN p % 2 = 0 THEN n ELSE 0 END) AS BIGINT) AS trainable, CAST(sum(CASE WHEN p % 2 = 1 THEN n ELSE 0 END) AS BIGINT) AS frozen FROM (SELECT p_partkey AS p, 4 * (p_partkey % 3 + 1) AS n FROM part)")
def _(spark, sf):
    return stats.count_params(params(spark, sf))


@query("agg6_compare_states", "SELECT vec_id AS name, 'both' AS problem FROM embeddings WHERE vec_id % 4 = 1 UNION ALL SELECT vec_id, 'shape' FROM embeddings WHERE vec_id % 4 = 2 UNION ALL SELECT vec_id, 'left only' FROM embeddings WHERE vec_id % 4 = 3")
def _(spark, sf):
    left = t(spark, sf, "embeddings").select(F.col("vec_id").alias("name"), F.array(F.size("embedding")).alias("shape"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    k = F.col("name") % 4
    right = left.where("name % 4 <> 3").withColumn("values", F.when(k == 1, F.transform("values", lambda x, i: x + F.when(i == 3, 1.0).otherwise(0.0))).when(k == 2, F.slice("values", 1, 3)).otherwise(F.col("values"))).withColumn("shape", F.array(F.size("values")))
    return compare.state_differences(left, right).select("name", "problem")


@query(
    "agg7_group_params",
    """WITH p AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 10 = 0 THEN 'head.w' || chr(CAST(97 + floor((p_partkey / 10) % 26) AS INT)) ELSE 'blocks.' || (p_partkey // 4) || '.part' || chr(CAST(97 + p_partkey % 4 AS INT)) END AS name, '4x' || (p_partkey % 3 + 1) AS data FROM part),
    g AS (SELECT regexp_extract(name, '^(\\D*)(\\d+)(.*)$', 1) AS a, CAST(regexp_extract(name, '^(\\D*)(\\d+)(.*)$', 2) AS BIGINT) AS k, regexp_extract(name, '^(\\D*)(\\d+)(.*)$', 3) AS z, data, p FROM p WHERE name LIKE 'blocks%')
    SELECT CASE WHEN count(*) > 1 THEN a || '[' || min(k) || '-' || max(k) || ']' || z ELSE a || min(k) || z END AS label, data, count(*) AS n, min(p) AS first_position FROM g GROUP BY a, z, data
    UNION ALL SELECT name, data, 1, p FROM p WHERE name LIKE 'head%'""",
)
def _(spark, sf):
    p = params(spark, sf).withColumn("data", F.array_join(F.transform("shape", lambda x: x.cast("string")), "x"))
    return stats.grouped_params(p)


@query("agg8_param_report", "SELECT p_brand AS group_name, CAST(sum(4 * (p_partkey % 3 + 1)) AS BIGINT) AS n_params, grouping(p_brand) AS is_total FROM part GROUP BY ROLLUP (p_brand)")
def _(spark, sf):
    return stats.param_report(params(spark, sf)).withColumn("is_total", F.col("is_total").cast("long"))


@query(
    "agg9_ratio_histogram",
    """WITH r AS (SELECT (n_chars % 97 + 1.0) / (doc_id % 89 + 1.0) AS r FROM documents), b AS (SELECT greatest(max(r), max(1 / r)) AS b FROM r),
    h AS (SELECT CASE WHEN r < 1 THEN 'left' ELSE 'right' END AS side, CAST(least(floor(CASE WHEN r < 1 THEN (r - 1 / b) / ((1 - 1 / b) / 10) ELSE (r - 1) / ((b - 1) / 10) END), 9) AS INT) AS bin FROM r, b WHERE r <> 1
      UNION ALL SELECT 'center', 0 FROM r WHERE abs(r - 1) <= 1e-8 + 1e-5),
    g AS (SELECT unnest(['left', 'right']) AS side, unnest(range(10)) AS bin), gg AS (SELECT s AS side, b AS bin FROM (SELECT unnest(['left', 'right']) AS s), (SELECT CAST(unnest(range(10)) AS INT) AS b) UNION ALL SELECT 'center', 0)
    SELECT gg.side, gg.bin, count(h.side) AS n FROM gg LEFT JOIN h ON gg.side = h.side AND gg.bin = h.bin GROUP BY ALL""",
)
def _(spark, sf):
    r = t(spark, sf, "documents").select(((F.col("n_chars") % 97 + 1.0) / (F.col("doc_id") % 89 + 1.0)).alias("r"))
    return stats.ratio_histogram(r, "r", 20)


@query(
    "agg10_histogram",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS c, (max(value) - min(value)) / 10 AS w FROM events), g AS (SELECT CAST(unnest(range(10)) AS INT) AS bin),
    h AS (SELECT CAST(least(floor((value - lo) / w), 9) AS INT) AS bin, count(*) AS n FROM events, e GROUP BY 1)
    SELECT bin, round(lo + bin * w, 6) AS low, coalesce(n, 0) AS n, round(coalesce(n, 0) / (c * w), 9) AS density FROM g LEFT JOIN h USING (bin), e""",
)
def _(spark, sf):
    return stats.histogram(t(spark, sf, "events"), "value").select("bin", F.round("low", 6).alias("low"), "n", F.round("density", 9).alias("density"))


@query("agg10_kernel_density", "SELECT p AS point, round(sum(exp(-0.5 * ((value - p) / 5) ** 2)) / (count(*) * 5 * sqrt(2 * pi())), 9) AS density FROM events, (SELECT CAST(unnest([0, 25, 50, 100]) AS DOUBLE) AS p) GROUP BY p")
def _(spark, sf):
    return stats.kernel_density(t(spark, sf, "events"), "value", [0.0, 25.0, 50.0, 100.0], 5.0).select("point", F.round("density", 9).alias("density"))


@query("agg11_device_summary", "SELECT round(sum(l_quantity), 4) AS memory, round(avg(l_discount), 6) AS load, round(avg(l_tax), 6) AS temperature FROM lineitem")
def _(spark, sf):
    d = stats.device_summary(t(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_tax")
    return d.select(F.round("memory", 4).alias("memory"), F.round("load", 6).alias("load"), F.round("temperature", 6).alias("temperature"))


# -- windows, sorts, top-k -----------------------------------------------------------------------------


@query("sort1_position", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS position FROM part")
def _(spark, sf):
    return ranking.positioned(t(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"])


@query(
    "topk1_logits",
    """WITH e AS (SELECT vec_id, label, unnest(list_slice(embedding, 1, 10)) AS x, generate_subscripts(list_slice(embedding, 1, 10), 1) - 1 AS i FROM embeddings), d AS (SELECT vec_id, label, i, CAST(x AS DOUBLE) / 0.5 AS x FROM e),
    s AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS p FROM d), r AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rank FROM s)
    SELECT vec_id, CAST(rank AS INT) AS rank, CAST(i AS INT) AS class_index, round(prob, 6) AS prob, 'class ' || i AS name FROM r WHERE rank <= 5 OR i = label""",
)
def _(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 10).alias("logits"), F.array(*(F.lit(f"class {i}") for i in range(10))).alias("names"))
    return ranking.top_classes(e, "vec_id", "logits", "names", "label", 5, 0.5).withColumn("prob", F.round("prob", 6))


@query("win1_ema", "SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda v, x: v * 0.9 + x * 0.1), 6) AS ema FROM events GROUP BY 1")
def _(spark, sf):
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return ranking.smoothed(e, "user_id", ["ts", "event_id"], "value").select("user_id", F.round("ema", 6).alias("ema"))


@query("win2_retained", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 86400 SECOND ORDER BY ts DESC, event_id DESC LIMIT 10")
def _(spark, sf):
    import datetime

    return ranking.retained(t(spark, sf, "events"), "ts", ["event_id"], 10, 86400.0, datetime.datetime(2024, 1, 20)).select("event_id")


@query(
    "win3_throttle",
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, i, ts AS last, event_id, true AS run FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN e.ts >= r.last + INTERVAL 1 HOUR THEN e.ts ELSE r.last END, e.event_id, e.ts >= r.last + INTERVAL 1 HOUR FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, count(*) FILTER (run) AS n, CAST(sum(CASE WHEN run THEN event_id END) AS BIGINT) AS s FROM r GROUP BY 1""",
)
def _(spark, sf):
    runs = throttle.throttled(t(spark, sf, "events"), "user_id", "ts", "event_id", 3600)
    return runs.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


# -- text ----------------------------------------------------------------------------------------------


@query("str1_simple", "SELECT item_id, trim(regexp_replace(lower(regexp_replace(text, '[^a-zA-Z0-9 ]+', ' ', 'g')), ' +', ' ', 'g')) AS s FROM benchmark")
def _(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", text.simple(F.col("text")).alias("s"))


@query("str2_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '(\S+)(\s*)')) AS n FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(text.words_and_connectors(F.col("text"))).cast("long").alias("n"))


@query("str3_rebuild", "SELECT doc_id, ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.rebuilt(text.words_and_connectors(F.col("text"))).alias("text"))


@query("str4_lemmas", "SELECT event_type AS word, CASE event_type WHEN 'clicks' THEN 'click' ELSE event_type END AS lemma FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, sf):
    from loomset.operators.lemmas import lemmatised

    table = spark.createDataFrame([("clicks", "click")], "word string, lemma string")
    return lemmatised(t(spark, sf, "events").select(F.col("event_type").alias("word")).distinct(), table, "word")


@query("str5_uri", "SELECT 'u' || s_suppkey AS \"user\", CAST(5000 + s_suppkey AS VARCHAR) AS port, 'db' || s_nationkey AS dbname FROM supplier")
def _(spark, sf):
    uri = F.concat(F.lit("postgresql+psycopg2://u"), F.col("s_suppkey"), F.lit(":pw@host:"), F.col("s_suppkey") + 5000, F.lit("/db"), F.col("s_nationkey"))
    return t(spark, sf, "supplier").select(text.split_uri(uri).alias("p")).select("p.user", "p.port", "p.dbname")


@query("str6_colored", "SELECT n_nationkey, '<span style=\"color:#' || repeat(lpad(lower(to_hex(n_nationkey)), 2, '0'), 3) || ';\">' || n_name || '</span>' AS html FROM nation")
def _(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", text.colored_html(F.array("n_nationkey"), F.col("n_name")).alias("html"))


@query("str7_row", "SELECT n_nationkey, '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' AS html FROM nation")
def _(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", text.table_row(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("html"))


@query("str8_dot_values", "SELECT p_partkey, len(list_filter(string_split(p_name || ',x,', ','), lambda v: v <> '')) AS n FROM part")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.size(text.dot_values(F.concat("p_name", F.lit(",x,")))).cast("long").alias("n"))


@query("udf6_url_candidates", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://' || regexp_replace(regexp_replace(url, '^https?', ''), '^[/:.]+', '') END AS first FROM pages")
def _(spark, sf):
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?", ""))
    return t(spark, sf, "pages").select("page_id", F.element_at(text.url_candidates(u), 1).alias("first"))


# -- vectors and geometry ------------------------------------------------------------------------------


@query("math1_softmax", "WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / 2) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS p FROM d) SELECT vec_id, round(p[1] / list_sum(p), 8) AS p1, round(list_max(p) / list_sum(p), 8) AS top FROM p")
def _(spark, sf):
    p = t(spark, sf, "embeddings").select("vec_id", arrays.softmax(F.col("embedding"), 2.0).alias("p"))
    return p.select("vec_id", F.round(F.element_at("p", 1), 8).alias("p1"), F.round(F.array_max("p"), 8).alias("top"))


@query("math2_cosine", "WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_dot_product(a.e, b.e) / (greatest(sqrt(list_dot_product(a.e, a.e)), 1e-8) * greatest(sqrt(list_dot_product(b.e, b.e)), 1e-8)), 6) AS similarity FROM d a, d b")
def _(spark, sf):
    e = t(spark, sf, "embeddings")
    return arrays.cosine_matrix(e, e, "vec_id", "vec_id", "embedding").withColumn("similarity", arrays.rounded(F.col("similarity"), 6))


@query("math3_frames", "SELECT doc_id, array_to_string(list_transform(range(0, 8), lambda i: CAST(floor(i * (n_chars / 8.0) + n_chars / 8.0 / 2) AS BIGINT)), ',') AS frames FROM documents")
def _(spark, sf):
    f = arrays.frame_indices(F.col("n_chars"), F.lit(8))
    return t(spark, sf, "documents").select("doc_id", F.array_join(F.transform(f, lambda x: x.cast("string")), ",").alias("frames"))


@query("math4_segment", "WITH s AS (SELECT doc_id, n_chars + 20 AS n, doc_id % 20 AS s, doc_id % 20 + 1 + doc_id % 7 AS e, doc_id % 40 AS m FROM documents), d AS (SELECT *, greatest(least(m, n) - (e - s), 0) AS d FROM s), l AS (SELECT *, CASE WHEN s < ceil(d / 2) THEN s WHEN n - e < floor(d / 2) THEN d - (n - e) ELSE ceil(d / 2) END AS l FROM d) SELECT doc_id, CAST(s - l AS INT) AS start, CAST(e + d - l AS INT) AS stop, d > 0 AS changed FROM l")
def _(spark, sf):
    d = F.col("doc_id")
    seg = geometry.grown_segment(F.col("n_chars") + 20, d % 40, d % 20, d % 20 + 1 + d % 7)
    return t(spark, sf, "documents").select("doc_id", seg.alias("g")).select("doc_id", "g.*")


@query("math5_distribute", "SELECT p_partkey, array_to_string(list_transform(range(0, 7), lambda i: p_size // 7 + CASE WHEN i < p_size % 7 THEN 1 ELSE 0 END), ',') AS parts FROM part")
def _(spark, sf):
    parts = arrays.distributed(F.col("p_size"), F.lit(7))
    return t(spark, sf, "part").select("p_partkey", F.array_join(F.transform(parts, lambda x: x.cast("string")), ",").alias("parts"))


QUANT = "WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT vec_id, e, list_min(e) AS lo, list_max(e) AS hi, list_transform(e, lambda x: round_even((x - list_min(e)) * 255.0 / (list_max(e) - list_min(e)), 0)) AS c FROM d)"


@query("math6_quantise", f"{QUANT} SELECT vec_id, CAST(list_sum(c) AS BIGINT) AS total, lo, hi FROM q")
def _(spark, sf):
    q = t(spark, sf, "embeddings").select("vec_id", arrays.quantised(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q.codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("q.min").alias("lo"), F.col("q.max").alias("hi"))


@query("math7_dequantise", f"{QUANT} SELECT vec_id, round(list_sum(list_transform(c, lambda x: x / 255.0 * (hi - lo) + lo)), 6) AS s FROM q")
def _(spark, sf):
    q = t(spark, sf, "embeddings").select("vec_id", arrays.quantised(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round(arrays.total(arrays.dequantised(F.col("q.codes"), F.col("q.min"), F.col("q.max"))), 6).alias("s"))


@query("math8_half", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS s FROM embeddings")
def _(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", F.round(arrays.total(arrays.half_checked(F.col("embedding"))), 6).alias("s"))


@query("math9_denormalise", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 0.5 + 0.1, 6) AS r, round(CAST(embedding[3] AS DOUBLE) * 0.25 + 0.2, 6) AS g FROM embeddings")
def _(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    d = arrays.denormalised(F.array(F.slice(e, 1, 2), F.slice(e, 3, 2)), [0.1, 0.2], [0.5, 0.25])
    return t(spark, sf, "embeddings").select("vec_id", F.round(d[0][0], 6).alias("r"), F.round(d[1][0], 6).alias("g"))


def boxes(spark, sf):
    d = F.col("l_orderkey")
    return t(spark, sf, "lineitem").select(d.alias("k"), F.col("l_linenumber").alias("n"), (d % 300).cast("double").alias("x"), (d % 190).cast("double").alias("y"), (F.col("l_quantity") * 2).alias("w"), F.col("l_quantity").alias("h"))


BOXES = "(SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_orderkey % 300 AS DOUBLE) AS x, CAST(l_orderkey % 190 AS DOUBLE) AS y, l_quantity * 2 AS w, l_quantity AS h FROM lineitem)"


@query("math10_boxes", f"SELECT k, n, round(x / 320, 8) AS rx, round(h / 200, 8) AS rh, round(x / 320 * 320, 6) AS ax FROM {BOXES}")
def _(spark, sf):
    w, h = F.lit(320), F.lit(200)
    b = boxes(spark, sf).withColumn("r", geometry.relative(F.col("x"), F.col("y"), F.col("w"), F.col("h"), w, h))
    a = geometry.absolute(F.col("r.x"), F.col("r.y"), F.col("r.w"), F.col("r.h"), w, h)
    return b.select("k", "n", F.round("r.x", 8).alias("rx"), F.round("r.h", 8).alias("rh"), F.round(a["x"], 6).alias("ax"))


@query("math11_bounds", f"SELECT k, n, CAST(trunc(greatest(x + w / 2 - greatest(w, 32) / 2, 0)) AS INT) AS x1, CAST(trunc(greatest(y + h / 2 - greatest(h, 32) / 2, 0)) AS INT) AS y1, CAST(trunc(least(greatest(x + w / 2 - greatest(w, 32) / 2, 0) + greatest(w, 32), 320)) AS INT) AS x2, CAST(trunc(least(greatest(y + h / 2 - greatest(h, 32) / 2, 0) + greatest(h, 32), 200)) AS INT) AS y2 FROM {BOXES}")
def _(spark, sf):
    b = geometry.bounds(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(320), F.lit(200))
    return boxes(spark, sf).select("k", "n", b.alias("b")).select("k", "n", "b.*")


@query("math12_sizes", "SELECT p_partkey, CASE WHEN w <= h THEN 50 ELSE CAST(round_even(w * 50.0 / h, 0) AS INT) END AS sw, CASE WHEN w >= h THEN 250 ELSE CAST(trunc(w * 250.0 / h) AS INT) END AS bw, CAST(floor((w - least(w, h)) / 2) AS INT) AS cx FROM (SELECT p_partkey, p_size * 7 AS w, p_partkey % 90 + 10 AS h FROM part)")
def _(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 7).alias("w"), (F.col("p_partkey") % 90 + 10).alias("h"))
    w, h = F.col("w"), F.col("h")
    return p.select("p_partkey", geometry.smaller_side(w, h, 50)["w"].alias("sw"), geometry.bigger_side(w, h, 250)["w"].alias("bw"), geometry.centre_square(w, h)["x"].alias("cx"))


@query("math13_colors", "SELECT n_nationkey, list_extract(['red', 'green', 'blue'], n_nationkey % 3 + 1) AS c, round(CASE WHEN t <= 1 THEN t * 0.4 ELSE (t - 1) * 0.6 + 0.4 END, 8) AS r FROM (SELECT n_nationkey, 2.0::DOUBLE * n_nationkey / 24 AS t FROM nation)")
def _(spark, sf):
    n = F.col("n_nationkey")
    return t(spark, sf, "nation").select("n_nationkey", geometry.cycle_color(n, ["red", "green", "blue"]).alias("c"), F.round(geometry.transition_color(n, F.lit(25))["r"], 8).alias("r"))


@query("math14_color_map", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <= 0.05 THEN l_discount / 0.05 ELSE 1 - (l_discount - 0.05) / 0.05 END, 6) AS g FROM lineitem")
def _(spark, sf):
    m = geometry.color_map(F.col("l_discount"), [(0.0, 1.0, 0.0, 0.0), (0.05, 1.0, 1.0, 0.0), (0.1, 0.0, 0.0, 0.0)], 0.0, 1.0)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(m["g"], 6).alias("g"))


# -- dataflow ------------------------------------------------------------------------------------------


@query("flow1_samples", f"SELECT left(m.name, length(m.name) - 4) AS __key__, m.archive AS __url__, d.lang AS metadata FROM (SELECT * FROM ({INDEX}) WHERE name LIKE 'a/%.jpg') m JOIN documents d ON m.name = 'a/' || d.doc_id || '.jpg'")
def _(spark, sf):
    meta = t(spark, sf, "documents").select(F.concat(F.lit("a/"), F.col("doc_id")).alias("key"), F.col("lang").alias("metadata"))
    rows = samples.with_metadata(samples.chosen_members(member_index(spark, sf)), meta, ["key"]).withColumn("content", F.lit(None).cast("binary"))
    return samples.by_policy(samples.samples(rows)).select("__key__", "__url__", "metadata")


@query("flow2_shuffle", "SELECT o_orderkey FROM orders")
def _(spark, sf):
    return ranking.shuffled(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 3, 1)


@query("flow3_batches", "SELECT i // 100 AS batch, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY 1")
def _(spark, sf):
    b = ranking.batches(t(spark, sf, "orders"), "o_orderkey", 100, ["o_orderkey", "o_totalprice"])
    return b.select("batch", F.size("o_orderkey").cast("long").alias("n"), F.array_min("o_orderkey").alias("first"))


@query("flow4_skip_errors", f"SELECT left(name, length(name) - 4) AS __key__ FROM ({INDEX}) WHERE name NOT LIKE '%.png'")
def _(spark, sf):
    rows = member_index(spark, sf).withColumn("metadata", F.lit(None).cast("string")).withColumn("content", F.lit(None).cast("binary"))
    return samples.by_policy(samples.samples(rows), "skip").select("__key__")


@query("flow5_decode", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) END AS value FROM documents")
def _(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".bin")).alias("name"), F.encode("lang", "UTF-8").alias("content"))
    return samples.decoded(d, F.col("name"), "content", [(r"\.txt$", lambda c: F.upper(F.decode(c, "UTF-8")))]).select("doc_id", "value")


@query("flow6_shard_numbers", "SELECT DISTINCT doc_id % 16 AS shard FROM documents")
def _(spark, sf):
    return member_index(spark, sf).select(text.shard_number(F.col("archive")).alias("shard")).distinct()


# -- schema and set operations ---------------------------------------------------------------------------


@query("ddl1_types", "SELECT * FROM (VALUES ('doc_id', 'int'), ('text', 'str'), ('lang', 'str'), ('source', 'str'), ('n_chars', 'int')) AS v(name, type)")
def _(spark, sf):
    return spark.createDataFrame(list(tables.column_types(t(spark, sf, "documents").schema).items()), "name string, type string")


@query("ddl2_create", "SELECT 'CREATE TABLE nation (n_nationkey INT,n_name STRING,n_regionkey INT)' AS sql")
def _(spark, sf):
    return spark.createDataFrame([(tables.creation_sql("nation", t(spark, sf, "nation").schema),)], "sql string")


EDGES = [("lineitem", "orders"), ("orders", "customer"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region"), ("lineitem", "part"), ("lineitem", "supplier")]


@query("ddl3_deletion_order", "SELECT * FROM (VALUES ('lineitem', 4), ('orders', 3), ('customer', 2), ('supplier', 2), ('nation', 1), ('region', 0), ('part', 0)) AS v(\"table\", depth)")
def _(spark, sf):
    return tables.deletion_order(spark.createDataFrame(EDGES, "child string, parent string"))


@query("pd1_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark, sf):
    return t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("pd3_drop_empty_columns", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    return tables.without_empty_columns(t(spark, sf, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("gone")))


@query("pd5_duplicated", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def _(spark, sf):
    return tables.duplicated(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


@query("pd6_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, sf):
    return tables.distinct_by(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("pd7_sets", "SELECT CASE WHEN o_custkey IS NULL THEN 'left only' WHEN c_custkey IS NULL THEN 'right only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey GROUP BY 1")
def _(spark, sf):
    return compare.set_report(t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), t(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("sql8_next_id", "SELECT max(o_orderkey) + 1 AS next_id FROM orders")
def _(spark, sf):
    return t(spark, sf, "orders").agg((F.max("o_orderkey") + 1).alias("next_id"))


@query("udf7_only_once", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def _(spark, sf):
    done = t(spark, sf, "pages").where("page_id % 3 = 0").select("page_id", F.lit("ok").alias("status"))
    return t(spark, sf, "pages").select("page_id").join(done, "page_id", "left_anti")


from loomset.plans import endtoend, lookup, ordered, sentences, storage  # noqa: E402, F401  they add their queries
