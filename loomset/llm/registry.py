"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomset.llm import chaining, chosenpath, fertility, importance, mixing, oracles, pieces, pii, secrets, simhash, suffixes, transport, turns, warc
from loomset.llm.cluster import shared


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.report(documents(spark, sf_dir))


def op2_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.kept_bytes(documents(spark, sf_dir), with_bytes=False).drop("kept")


def op5_bootstrap_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(documents(spark, sf_dir))


def op7_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample(documents(spark, sf_dir))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(documents(spark, sf_dir), chosenpath.Join(shingle=4))


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.report(pages, f"{shared(spark)}/warc-{uuid.uuid4().hex}")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_transport_stream, op2_chained_passages, op3_secret_scan, op4_suffix_dedup, op5_bootstrap_pii, op6_tokeniser_fertility, op7_gumbel_pieces, op8_mix_sources, op9_chosen_path, op10_warc_bundles, op11_importance_resampling, op12_conversation_repair, op13_simhash_trie)}

ORACLES = {
    "op11_importance_resampling": oracles.importance(),
    "op12_conversation_repair": oracles.turns(),
    "op4_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100),
w AS (SELECT n.doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM n JOIN d USING (doc_id)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY 1),
k AS (SELECT doc_id, i, first FROM w JOIN m USING (s)),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM k WHERE first < doc_id),
r AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY ALL),
p AS (SELECT d.doc_id, s.a, substr(d.h, 2 * coalesce(lag(s.b) OVER (PARTITION BY d.doc_id ORDER BY s.a), 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY d.doc_id ORDER BY s.a), 0))) AS piece, s.b - s.a AS gone, s.b FROM d JOIN s USING (doc_id)),
o AS (SELECT doc_id, sum(gone) AS gone, count(*) AS runs, string_agg(piece, '' ORDER BY a) AS kept, max(b) AS last FROM p GROUP BY 1)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(o.gone, 0) AS BIGINT) AS n_removed, coalesce(o.runs, 0) AS n_spans,
  sha256(unhex(CASE WHEN o.gone IS NULL THEN d.h ELSE o.kept || substr(d.h, 2 * o.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
""",
    "op10_warc_bundles": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, octet_length(encode(h)) AS n, unhex(sha1(h)) AS d, sha1(h) AS k FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 20), lambda i: lpad(bin(strpos('0123456789abcdef', substr(k, 2 * i + 1, 1)) * 16 + strpos('0123456789abcdef', substr(k, 2 * i + 2, 1)) - 17), 8, '0')), '') AS bits FROM x),
c AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS digest,
  max(page_id) OVER (PARTITION BY k) AS top FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM c
""",
    "op9_chosen_path": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS far FROM documents UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.far),
c AS (SELECT id, min(far) AS c FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept FROM s JOIN c ON c.id = s.doc_id
""",
}
