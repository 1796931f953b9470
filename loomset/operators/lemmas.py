"""Lemmas of words by a lookup table or by rules learned from one, and of texts by either or by any batch function behind a cache.

A rule says what to cut from a word's end and what to add, and holds for the words of one ending. Rules are
counted over pairs of words and lemmas for all endings up to a length; the longest ending that has a rule decides. Each distinct
word is looked up once, whatever its share of the texts is, and meets its places in a join that Spark broadcasts or splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lemmatised(df: DataFrame, table: DataFrame, word: str, into: str = "lemma") -> DataFrame:
    """df with the lemma of each word; words that the table (word, lemma) lacks keep their surface form."""
    known = table.select(F.col("word").alias("__word"), F.col("lemma").alias("__lemma"))
    return df.join(known, F.col(word) == F.col("__word"), "left").withColumn(into, F.coalesce("__lemma", word)).drop("__word", "__lemma")


def lemmas_by_table(df: DataFrame, table: DataFrame, key: str, text: str, into: str = "lemmas") -> DataFrame:
    """key, array<string> lemmas of a text's white-space words, in order, by a lookup table (word, lemma).

    Each distinct word is looked up once; words that the table lacks keep their surface form.
    """
    words = df.select(key, F.posexplode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("__at", "__w"))
    known = lemmatised(words.select("__w").distinct(), table, "__w", "__lemma_of")
    rows = words.join(known, "__w")
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__lemma_of"))), lambda r: r["__lemma_of"]).alias(into))


def lemmas_of_texts(df: DataFrame, text: str, model: Callable[[], Callable[[str], list[str]]], into: str = "lemmas") -> DataFrame:
    """df with array<string> lemmas: the model is loaded once for each worker, and each distinct text goes through it once."""

    @F.pandas_udf("array<string>")
    def run(texts):
        nlp = model()
        return texts.map(lambda x: None if x is None else list(nlp(x)))

    once = df.select(text).distinct().withColumn(into, run(F.col(text)))
    return df.join(once, df[text].eqNullSafe(once[text]), "left").drop(once[text])


RULES = "suffix string, cut int, add string, n long, total long"


def learned(pairs: DataFrame, longest: int = 6, least: int = 2) -> DataFrame:
    """RULES: for each ending of up to `longest` letters the change that most of its words (n of total) have; ties: the shortest cut, then the first addition.

    pairs: word, lemma. Rules of fewer than `least` words are left out; repeated pairs count once, null ones not at all.
    """
    rows = pairs.where("length(word) > 0 and length(lemma) > 0").select("word", "lemma").distinct()
    both = F.least(F.length("word"), F.length("lemma"))
    same = F.size(F.filter(F.sequence(F.lit(1), both), lambda i: F.substring("word", F.lit(1), i) == F.substring("lemma", F.lit(1), i)))
    rows = rows.withColumn("cut", F.length("word") - same).withColumn("add", F.expr("substring(lemma, length(word) - cut + 1)"))
    ends = F.when(F.col("cut") <= longest, F.sequence("cut", F.least(F.length("word"), F.lit(longest))))
    each = rows.select("word", "cut", "add", F.explode(ends).alias("k")).select(F.right("word", F.col("k")).alias("suffix"), "cut", "add")
    counts = each.groupBy("suffix", "cut", "add").agg(F.count("*").alias("n"))
    best = counts.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("n"), "cut", "add")).alias("r"), F.sum("n").alias("total"))
    return best.where(-F.col("r.n") >= least).select("suffix", "r.cut", "r.add", (-F.col("r.n")).alias("n"), "total")


def by_rules(words: DataFrame, rules: DataFrame, table: DataFrame | None = None, longest: int = 6) -> DataFrame:
    """word, lemma of each distinct word (not null): as the table (word, lemma; one row a word) says, else by the longest ending's rule, else as it is."""
    once = words.select("word").where("word is not null").distinct()
    ends = once.select("word", F.explode(F.sequence(F.lit(0), F.least(F.length("word"), F.lit(longest)))).alias("k"))
    met = ends.withColumn("suffix", F.right("word", F.col("k"))).join(rules, "suffix").where("cut < length(word)")
    changed = met.groupBy("word").agg(F.max_by(F.struct("cut", "add"), "k").alias("r"))
    changed = changed.select("word", F.expr("concat(left(word, length(word) - r.cut), r.add)").alias("lemma"))
    if table is not None:
        known = table.select("word", "lemma").where("lemma is not null")
        changed = known.unionByName(changed.join(known, "word", "left_anti"))
    return once.join(changed, "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))


def lemmatised_texts(df: DataFrame, text: str, rules: DataFrame, table: DataFrame | None = None, into: str = "lemmas", longest: int = 6) -> DataFrame:
    """df with array<string> lemmas of a text's white-space words in order. Null texts have null; texts without words an empty array."""
    digest = F.sha2(F.col(text), 256)
    each = F.posexplode(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("at", "word")
    places = df.select(digest.alias("digest"), text).distinct().select("digest", each)
    lemmas = places.join(by_rules(places, rules, table, longest), "word")
    lists = lemmas.groupBy("digest").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "lemma"))), lambda r: r["lemma"]).alias("__lemmas"))
    out = df.join(lists, digest == F.col("digest"), "left").drop("digest")
    return out.withColumn(into, F.when(F.col(text).isNotNull(), F.coalesce("__lemmas", F.array().cast("array<string>")))).drop("__lemmas")
