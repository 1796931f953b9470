"""Fertility figures against direct computation."""

import base64
import math
import random
import re
from collections import Counter

import sentencepiece
import tiktoken

from loomset.llm import fertility

with open(fertility.BYTE_VOCABULARY, "rb") as f:
    BYTES = tiktoken.Encoding("test", pat_str=fertility.BYTE_PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
FIXED = [None, "", "   \n\t", "one", "a b c d e f g h " * 20, "x\ny\nx\n\nx \nx\r\nx", "#*$ | <> %&", "é" * 5000, "日本 " * 40, "ελλάδα και " * 30, "мир и дом " * 30, "שלום עולם " * 9, "한국어 문장 " * 9, "हिन्दी में " * 9, "ein zwei drei vier fünf sechs sieben acht neun zehn " * 3, "w" * 150_000]


def expected(text, sp):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    tokens = [t for w in words for t in sp.encode(w)]
    n, count = len(tokens), Counter(tokens)
    bits = -sum(c / n * math.log2(c / n) for c in count.values()) if n else 0.0
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), n, bits, sum(sp.is_byte(t) for t in tokens) / n if n else 0.0


def byte_tokens(text):
    return sum(len(BYTES.encode_ordinary(f" {w}")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def script_of(text):
    n = dict.fromkeys(["latin", *fertility.SCRIPTS], 0)
    for c in text or "":
        first = c.encode()[0]
        n["latin"] += c.isascii() and c.isalpha() or 0xC3 <= first <= 0xC9
        for name, (lo, hi) in fertility.SCRIPTS.items():
            n[name] += lo <= first <= hi
    return max(n, key=n.get)


def test_figures_equal_direct_computation(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    texts = FIXED + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in fertility.fertility(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, want = rows[i], expected(t, sp)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens) == want[:6], (i, r, want)
        assert abs(r.token_entropy - want[6]) < 1e-6 and abs(r.byte_share - want[7]) < 1e-9
        assert (r.n_byte_tokens, r.script) == (byte_tokens(t), script_of(t))
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.reason is None) and not (r.base_failed and r.kept)


def test_labelled_good_documents_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    rows = fertility.fertility(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    n, lost = rows.count(), rows.where("not kept").count()
    assert n > 100 and lost <= 0.01 * n


def test_labelled_junk_is_rejected(spark):
    sf = "/root/testdata/sf0.1"
    rows = fertility.fertility(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good, bad = rows.where("quality = 1"), rows.where("quality = 0")
    assert good.where("not kept").count() <= 0.005 * good.count()
    assert bad.where("not kept").count() >= 0.4 * bad.count()


def test_filter_keeps_columns_whatever_their_names(spark):
    df = spark.createDataFrame([("d", 1, "few words", None), ("d", 2, " ".join(f"word{i}" for i in range(60)), "x")], "n_words string, doc_id long, text string, kept string")
    got = fertility.filter_documents(df)
    assert got.columns == df.columns and [r.doc_id for r in got.collect()] == [2]
    assert fertility.filter_documents(df.limit(0)).collect() == []


def test_short_and_long_junk_is_rejected_and_short_prose_is_kept(spark):
    rnd = random.Random(4)
    junk = lambda n: " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(5)) for _ in range(n))
    prose = "The river was quiet that morning and the people of the village walked along the bank to see the first boats of the year come in."
    rows = [(1, junk(22), "en"), (2, junk(300), "en"), (3, prose, "en")]
    got = {r.doc_id: r for r in fertility.fertility(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1].n_tokens < 100 and not got[1].base_failed and got[1].reason == "characters per token, low"
    assert got[2].n_tokens > 1000 and got[2].reason == "characters per token, low"
    assert got[3].n_tokens < 100 and got[3].kept
