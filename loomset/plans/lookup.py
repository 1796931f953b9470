"""Queries that fetch, look up and learn: URLs with retries, rows by position, lemmas by learned rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators import lemmas, tables
from loomset.plans.catalog import query, t
from loomset.plans.lineage import materialised, mounted, own_folder
from loomset.plans.storage import loose
from loomset.sources import fetch, positions


@query("udf6_fetched", "SELECT page_id, CASE WHEN page_id % 7 > 0 THEN sha256(html) END AS sha, CASE WHEN page_id % 7 > 0 THEN 1 ELSE 3 END AS attempts, page_id % 7 = 0 AS given_up FROM pages")
def _(spark, sf):
    """Pages as files of URLs; every seventh is gone, and given up after three attempts."""
    folder = mounted(own_folder(spark, "fetch"))
    pages = t(spark, sf, "pages").select("page_id", "html")
    loose(spark, pages.where("page_id % 7 > 0").select(F.col("page_id").cast("string").alias("name"), F.encode("html", "UTF-8").alias("data")), folder)
    urls = pages.select("page_id", F.concat(F.lit(f"file://{folder}/"), "page_id").alias("url"))
    got = fetch.fetched(urls, "url", "page_id", fetch.Policy(rate=1e6, burst=10**6, tries=3, base=0.001))
    return got.select("page_id", F.sha2("content", 256).alias("sha"), "attempts", F.col("error").isNotNull().alias("given_up"))


@query("sort1_slice", "SELECT position, o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders) WHERE position BETWEEN 700 AND 1299")
def _(spark, sf):
    """A slice of the table in order of price: the files that hold it are opened, no others."""
    folder = own_folder(spark, "sorted")
    positions.written(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], folder, 16)
    return positions.sliced(spark, folder, 700, 600).select("position", "o_orderkey", "o_totalprice")


ENDINGS = ("s", "e", "en", "er", "es", "ed", "ing", "ment", "tion", "heit", "keit")
WORDS = "w AS MATERIALIZED (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{L}]+'))) AS word FROM documents)"
LISTED = ", ".join(f"'{e}'" for e in ENDINGS)
PAIRS = f"""v AS MATERIALIZED (SELECT word, left(word, length(word) - length(e)) AS base FROM (SELECT word, unnest([{LISTED}]) AS e FROM w) WHERE ends_with(word, e)),
p AS MATERIALIZED (SELECT v.word, max_by(b.word, length(b.word)) AS lemma FROM v JOIN w b ON b.word = v.base WHERE length(b.word) >= 3 GROUP BY 1)"""


def rules_sql(pairs: str) -> str:
    return f"""c AS (SELECT word, length(word) - same AS cut, substr(lemma, same + 1) AS add FROM (SELECT *, len(list_filter(range(1, least(length(word), length(lemma)) + 1), lambda i: word[1:i] = lemma[1:i])) AS same FROM {pairs})),
k AS (SELECT right(word, k) AS suffix, cut, add FROM (SELECT *, unnest(range(cut, least(length(word), 6) + 1)) AS k FROM c WHERE cut <= 6)),
n AS (SELECT suffix, CAST(cut AS INT) AS cut, add, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT suffix, cut, add, n, total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY suffix) AS BIGINT) AS total, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, add) AS place FROM n) WHERE place = 1 AND n >= 2)"""


def changed_sql(words: str) -> str:
    return f"SELECT word, max_by(left(word, length(word) - cut) || add, k) AS lemma FROM (SELECT word, unnest(range(0, least(length(word), 6) + 1)) AS k FROM {words}) JOIN r ON r.suffix = right(word, k) WHERE cut < length(word) GROUP BY 1"


def inflected(spark: SparkSession, sf: str) -> DataFrame:
    """word, lemma: words of the documents that are another one with an ending; the longest such other one."""
    words = t(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()
    bases = words.select(F.col("word").alias("lemma")).where("length(lemma) >= 3")
    ends = words.select("word", F.explode(F.array(*map(F.lit, ENDINGS))).alias("e")).where("endswith(word, e)")
    pairs = ends.withColumn("lemma", F.expr("left(word, length(word) - length(e))")).join(bases, "lemma")
    return pairs.groupBy("word").agg(F.max_by("lemma", F.length("lemma")).alias("lemma"))


@query("str4_rules", f"WITH {WORDS}, {PAIRS}, {rules_sql('p')} SELECT * FROM r")
def _(spark, sf):
    return lemmas.learned(inflected(spark, sf))


HELD = "substr(md5(word), 1, 1) < '4'"


@query("str4_held_out", f"WITH {WORDS}, {PAIRS}, t AS (SELECT * FROM p WHERE NOT {HELD}), h AS (SELECT * FROM p WHERE {HELD}), {rules_sql('t')}, g AS ({changed_sql('h')}) SELECT h.word, coalesce(g.lemma, h.word) AS lemma, coalesce(g.lemma, h.word) = h.lemma AS found FROM h LEFT JOIN g ON g.word = h.word")
def _(spark, sf):
    """Rules learned from three quarters of the words, tried on the rest."""
    pairs = inflected(spark, sf)
    held = pairs.where(HELD)
    got = lemmas.by_rules(held, lemmas.learned(pairs.where(f"not {HELD}")))
    return got.join(held.withColumnRenamed("lemma", "known"), "word").select("word", "lemma", (F.col("lemma") == F.col("known")).alias("found"))


@query(
    "str4_texts",
    f"""WITH {WORDS}, {PAIRS}, {rules_sql('p')}, x AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS v FROM benchmark),
    y AS (SELECT item_id, unnest(v) AS word, generate_subscripts(v, 1) AS i FROM x), u AS (SELECT DISTINCT word FROM y), g AS ({changed_sql('u')})
    SELECT item_id, string_agg(coalesce(g.lemma, y.word), ' ' ORDER BY i) AS lemmas FROM y LEFT JOIN g ON g.word = y.word GROUP BY 1""",
)
def _(spark, sf):
    rules = lemmas.learned(inflected(spark, sf))
    b = t(spark, sf, "benchmark").select("item_id", F.lower("text").alias("text"))
    return lemmas.lemmatised_texts(b, "text", rules).select("item_id", F.array_join("lemmas", " ").alias("lemmas"))


#: Columns that may refer to another table's key; the last one does not.
REFERENCES = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("part", "p_size", "region", "r_regionkey"),
]
EDGES = " UNION ALL ".join(f"SELECT '{c}' AS child, '{p}' AS parent WHERE NOT EXISTS (SELECT 1 FROM {c} WHERE {k} NOT IN (SELECT {q} FROM {p}))" for c, k, p, q in REFERENCES)
NAMED = ", ".join(f"'{x}'" for x in sorted({x for c, _, p, _ in REFERENCES for x in (c, p)}))


@query("ddl3_inferred_order", f"WITH RECURSIVE e AS ({EDGES}), d AS (SELECT unnest([{NAMED}]) AS \"table\", 0 AS depth UNION SELECT child, depth + 1 FROM e JOIN d ON d.\"table\" = e.parent) SELECT \"table\", max(depth) AS depth FROM d GROUP BY 1")
def _(spark, sf):
    """In which order tables can be emptied, by the references that hold in their rows."""
    held = None
    for child, key, parent, of in REFERENCES:
        lost = t(spark, sf, child).select(F.col(key).alias("k")).where("k is not null").distinct().join(t(spark, sf, parent).select(F.col(of).alias("k")), "k", "left_anti")
        edge = lost.agg((F.count("*") == 0).alias("held")).select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), "held")
        held = edge if held is None else held.unionByName(edge)
    return tables.deletion_order(materialised(held.where("held").drop("held")))
