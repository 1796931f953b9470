"""A training-data pipeline: quality rules, near-dedup, secret scans, mixing and SentencePiece encoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import chosenpath, fertility, mixing, pieces, secrets
from loomset.llm.cluster import cut, few, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the fertility rules reject."""
    return fertility.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Rows of one id are one group, of which the smallest row by its columns stays; rows of null ids stay.
    """
    gone = few(chosenpath.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__loom_gone")).distinct())
    left = docs.join(gone, docs.doc_id == F.col("__loom_gone"), "left_anti").select(docs.columns)
    twice = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__loom_n")).where("__loom_n > 1").select(F.col("doc_id").alias("__loom_twice")))
    if twice.isEmpty():
        return left
    is_twice = left.doc_id == F.col("__loom_twice")
    return left.join(twice, is_twice, "left_anti").unionByName(left.join(twice, is_twice, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*left.columns)).alias("__loom_row")).select("__loom_row.*"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by their kind in brackets."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or samples documents so that sources reach their target weights."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document; the blocks' size changes memory, not results."""
    return pieces.sample(docs, pieces.Sampling(block=3 << 18, part=1 << 18))


STAGES = [("quality rules", quality), ("minhash near-dedup", near_dedup), ("secret scan", secret_scan), ("mix sources", mix), ("sentencepiece", encode)]

#: No SQL: the tokeniser and the sampled segmentations can't be expressed. tests/llm/test_pipeline.py holds all stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
