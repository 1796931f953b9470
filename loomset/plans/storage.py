"""Queries of what is written and read again: packed folders, committed shards, versions of an index, images; and of workers that know each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators.world import ranked, shares
from loomset.plans.catalog import query, t
from loomset.plans.endtoend import MEMBER, documents, shards
from loomset.plans.lineage import mounted, own_folder
from loomset.sources import archives, files, images, indextable, tar


def loose(spark: SparkSession, files: DataFrame, folder: str) -> None:
    """Files (name, data) under a mounted folder."""

    def save(rows):
        import os

        for r in rows:
            path = f"{folder}/{r['name']}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with archives.safely(path, sync=False) as f:
                f.write(r["data"])

    files.select("name", "data").foreachPartition(save)


@query("snk2_packed_folder", f"SELECT {MEMBER} AS name, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 3 <> 0")
def _(spark, sf):
    """A folder's files that match a pattern, packed, held against the files, deleted, and read back by the manifest."""
    folder = mounted(own_folder(spark, "folder"))
    loose(spark, documents(spark, sf), f"{folder}/files")
    done = archives.pack_folder(spark, f"{folder}/files", f"{folder}/packed", ("a/*.jpg",), most=archives.PACK, delete=True)
    index = spark.read.format("tarindex").load(f"{folder}/packed").join(done.select("archive"), "archive", "left_semi")
    return tar.read_members(index).select("name", F.sha2("content", 256).alias("sha"))


@query("snk5_committed_shards", "SELECT CAST(count(*) AS BIGINT) AS members, 2 AS jobs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents")
def _(spark, sf):
    """Two jobs' archives in one folder, as their manifests name them."""
    folder = mounted(own_folder(spark, "shards"))
    archives.register(spark)
    docs = documents(spark, sf).select("doc_id", "name", "data")
    for i in range(2):
        docs.where(F.col("doc_id") % 2 == i).select("name", "data").write.format("tarshards").mode("append").option("most", 1 << 20).save(folder)
    named = archives.archives_of(spark, folder)
    members = spark.read.format("tarindex").load(folder).join(named.select("archive"), "archive", "left_semi")
    jobs = named.select(F.size(F.collect_set(F.regexp_extract("archive", r"-([0-9a-f]+)\.tar$", 1))).alias("jobs"))
    return members.agg(F.count("*").alias("members"), F.sum("size").cast("long").alias("bytes")).join(F.broadcast(jobs)).select("members", "jobs", "bytes")


@query(
    "sql7_index_versions",
    f"""SELECT 1 AS version, {MEMBER} AS name, CAST(octet_length(encode(text)) AS BIGINT) AS size, 1 AS data FROM documents
    UNION ALL SELECT 2, {MEMBER}, CAST(octet_length(encode(text)) + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS BIGINT), CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END FROM documents WHERE doc_id % 4 <> 2""",
)
def _(spark, sf):
    """Archives in four folders are indexed; then one folder's are written again and one's deleted: the new version scans the new ones, and the old one can still be read."""
    import shutil

    folder = mounted(own_folder(spark, "index"))
    docs = documents(spark, sf)
    for i in range(4):
        shards(spark, docs.where(F.col("doc_id") % 4 == i), f"{folder}/archives/{i}")
    indextable.refreshed(spark, f"{folder}/table", f"{folder}/archives")
    shards(spark, docs.where("doc_id % 4 = 1").withColumn("data", F.concat("data", F.encode(F.lit("+"), "UTF-8"))), f"{folder}/archives/1")
    shutil.rmtree(f"{folder}/archives/2")
    indextable.refreshed(spark, f"{folder}/table", f"{folder}/archives")

    def of(version: int) -> DataFrame:
        data = indextable.manifest(spark, f"{folder}/table", version).select("archive", "data")
        return indextable.read(spark, f"{folder}/table", version).join(data, "archive").select(F.lit(version).alias("version"), "name", "size", "data")

    return of(1).unionByName(of(2))


def be(n, size: int):
    """A number's bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def le(n, size: int):
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n.cast("long")), 2 * size, "0"), F.lit("(..)"), F.lit(1))), ""))


def hexed(digits: str):
    return F.unhex(F.lit(digits))


def headed(docs: DataFrame) -> DataFrame:
    """doc_id, content: headers of images of sizes and modes that the id tells, in four formats; texts stand in JPEG comments. Every 11th is cut short."""
    d = F.col("doc_id")
    w, h, kind = d % 1999 + 1, d % 1499 + 1, (d / 4).cast("long") % 4
    text = F.encode(F.substring(F.coalesce("text", F.lit("")), 1, 15_000), "UTF-8")
    png = F.concat(hexed("89504E470D0A1A0A0000000D49484452"), be(w, 4), be(h, 4), hexed("08"), be(F.element_at(F.array(*map(F.lit, (0, 2, 6, 3))), (kind + 1).cast("int")), 1))
    gif = F.concat(F.encode(F.lit("GIF89a"), "UTF-8"), le(w, 2), le(h, 2))
    parts = F.element_at(F.array(*map(F.lit, (1, 3, 4, 3))), (kind + 1).cast("int"))
    jpeg = F.concat(hexed("FFD8FFE000104A46494600010100000100010000FFFE"), be(F.octet_length(text) + 2, 2), text, hexed("FFC2001108"), be(h, 2), be(w, 2), be(parts, 1))
    webp = F.concat(F.encode(F.lit("RIFF"), "UTF-8"), hexed("00000000"), F.encode(F.lit("WEBPVP8X"), "UTF-8"), hexed("0A000000"), F.when(kind % 2 == 0, hexed("10")).otherwise(hexed("00")), hexed("000000"), le(w - 1, 3), le(h - 1, 3))
    whole = F.when(d % 4 == 0, png).when(d % 4 == 1, gif).when(d % 4 == 2, jpeg).otherwise(webp)
    return docs.select("doc_id", F.when(d % 11 == 0, F.substring(whole, 1, F.octet_length(whole) - 1)).otherwise(whole).alias("content"))


PROPERTIES = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE ['PNG', 'GIF', 'JPEG', 'WEBP'][doc_id % 4 + 1] END AS format,
CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN ['L', 'RGB', 'RGBA', 'P'][(doc_id // 4) % 4 + 1] WHEN doc_id % 4 = 1 THEN 'P' WHEN doc_id % 4 = 2 THEN ['L', 'RGB', 'CMYK', 'RGB'][(doc_id // 4) % 4 + 1] WHEN (doc_id // 4) % 2 = 0 THEN 'RGBA' ELSE 'RGB' END AS mode,
CASE WHEN doc_id % 11 > 0 THEN CAST(doc_id % 1999 + 1 AS INT) END AS width, CASE WHEN doc_id % 11 > 0 THEN CAST(doc_id % 1499 + 1 AS INT) END AS height FROM documents"""


@query("udf3_image_properties", PROPERTIES)
def _(spark, sf):
    return images.with_properties(headed(t(spark, sf, "documents"))).select("doc_id", "image.*")


@query("udf3_properties_of_members", PROPERTIES)
def _(spark, sf):
    """Of members of archives, by byte ranges."""
    folder = mounted(own_folder(spark, "images"))
    archives.register(spark)
    headed(t(spark, sf, "documents")).select(F.col("doc_id").cast("string").alias("name"), F.col("content").alias("data")).write.format("tarshards").mode("append").save(folder)
    return images.properties_of_members(spark.read.format("tarindex").load(folder)).select(F.col("name").cast("long").alias("doc_id"), "image.*")


PIXEL = "CAST(abs(round_even(CAST(x AS DOUBLE) * 1000, 0)) AS BIGINT) % 256"


@query(
    "udf4_rgb_and_alpha",
    f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: {PIXEL}) AS p FROM embeddings), c AS (SELECT vec_id, p, unnest(range(16)) AS i FROM p),
    k AS (SELECT vec_id, i, unnest([0, 1, 2]) AS k, p FROM c), m AS (SELECT vec_id, i, k, p[4 * i + 4] AS a, p[4 * i + k + 1] * p[4 * i + 4] + 255 * (255 - p[4 * i + 4]) + 128 AS v FROM k)
    SELECT vec_id, 8 AS width, 2 AS height, string_agg(printf('%02X', ((v >> 8) + v) >> 8), '' ORDER BY i, k) AS rgb, string_agg(CASE WHEN k = 0 THEN printf('%02X', a) ELSE '' END, '' ORDER BY i, k) AS alpha FROM m GROUP BY 1""",
)
def _(spark, sf):
    """PNG images with an alpha channel, of the embeddings' values, written as files and decoded."""
    folder = mounted(own_folder(spark, "alpha"))
    pixels = F.transform("embedding", lambda x: (F.abs(F.rint(x.cast("double") * 1000)).cast("long") % 256).cast("int"))
    rows = t(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id"), F.lit(".png")).alias("name"), pixels.alias("pixels"), F.lit(8).alias("width"), F.lit(4).alias("channels"))
    loose(spark, images.png_bytes(rows, "pixels", "width", "channels", "data"), folder)
    got = images.decoded(spark, f"file://{folder}")
    return got.select(F.regexp_extract("path", r"v(\d+)\.png$", 1).cast("long").alias("vec_id"), "width", "height", F.hex("rgb").alias("rgb"), F.hex("alpha").alias("alpha"))


@query("flow7_ranked_rows", "SELECT o_orderkey, CAST(o_orderkey % 2 AS INT) AS rank, 2 AS size FROM orders")
def _(spark, sf):
    return ranked(t(spark, sf, "orders").select("o_orderkey"), (F.col("o_orderkey") % 2).cast("int"), 2)


@query(
    "flow7_shares",
    """WITH w AS (SELECT CAST(o_orderkey % 2 AS INT) AS rank, count(*) AS rows FROM orders GROUP BY 1)
    SELECT rank, 2 AS size, rank = 0 AS main, rows, CAST(coalesce(sum(rows) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, (SELECT CAST(sum(o_custkey) AS BIGINT) FROM orders) AS total FROM w""",
)
def _(spark, sf):
    return shares(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", (F.col("o_orderkey") % 2).cast("int"), 2)


@query(
    "snk4_tensor_values",
    "SELECT CAST(label % 2 AS INT) AS side, 'v' || vec_id AS name, CAST(len(embedding) AS INT) AS n, array_to_string(list_transform(embedding, lambda x: CAST(round_even(CAST(x AS DOUBLE) * 1000000, 0) AS BIGINT)), ',') AS values FROM embeddings",
)
def _(spark, sf):
    """Tensors of two keys, each in several files, with all their values."""
    e = t(spark, sf, "embeddings").select((F.col("label") % 2).alias("side"), F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.array(F.size("embedding")).alias("shape"), F.col("embedding").alias("values"))
    got = files.tensors_unpacked(files.tensors_packed(e, "side", most=16 << 10), "side")
    millionths = F.transform("values", lambda x: F.rint(x.cast("double") * 1_000_000).cast("long").cast("string"))
    return got.select("side", "name", F.element_at("shape", 1).alias("n"), F.array_join(millionths, ",").alias("values"))
