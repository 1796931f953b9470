"""The pipeline's stages against plain Python on a small table with planted cases, and run() on tables of odd shapes."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from loomset.llm import fertility, pieces
from tests.llm.test_chosenpath import brute
from tests.llm.test_spans import base_secrets, expected_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, sample string, ids string, component_id string, __loom_size int"


def row(i, text, lang="en", source="s1"):
    return (i, text, lang, source, None if text is None else len(text), "x", i and i % 3, "y", "z", None, 7)


def rows_of(spark, sf):
    rnd = random.Random(5)
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 6000]
    rows = [row(r.doc_id, r.text, r.lang, r.source) for r in docs]
    long = [r for r in rows if len(r[1].split()) > 120]
    for k, r in enumerate(long[:12]):
        rows.append(row(10_000 + k, r[1], r[2], "s2"))  # exact copies
        words = r[1].split(" ")
        words[rnd.randrange(40, len(words) - 40)] = "changed"
        rows.append(row(20_000 + k, " ".join(words), r[2], "s3"))  # near copies
        other = long[-1 - k][1]  # half of two documents each: near none
        rows.append(row(30_000 + k, r[1][: len(r[1]) // 2] + f' token = "{rnd.randbytes(20).hex()}" ' + other[len(other) // 2 :], r[2], None))
    return rows + [row(40_000, None), row(40_001, ""), row(40_002, "too few words"), row(40_003, "la " * 300), row(None, long[0][1])]


def stages(spark, docs, folder):
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def test_each_stage_and_run_against_plain_python(spark, sf, tmp_path):
    rows = rows_of(spark, sf)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    quality, near, secret, mixed, encoded = stages(spark, docs, str(tmp_path / "stages"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "secret scan", "mix sources", "sentencepiece"]
    for df in (quality, near, secret, mixed):
        assert df.columns == docs.columns
    key = lambda r: (r.doc_id is None, r.doc_id, r.text)

    # quality: what the rules keep stays unchanged, and what the base rules reject is gone
    verdict = {r.doc_id: r.kept for r in fertility.fertility(docs).collect()}
    kept = sorted((r for r in quality.collect()), key=key)
    assert [tuple(r) for r in kept] == [tuple(r) for r in sorted(docs.collect(), key=key) if verdict[r.doc_id]]
    assert not {40_000, 40_001, 40_002, 40_003} & {r.doc_id for r in kept} and len(kept) > 50

    # near copies: one of each group of five-word shingles at 0.8 stays, the smallest id; null ids stay
    groups = {i: c for i, _, c, _ in brute([(r.doc_id, r.text) for r in kept if r.doc_id is not None], 5, 80)}
    alone = sorted((r for r in near.collect()), key=key)
    assert [tuple(r) for r in alone] == [tuple(r) for r in kept if r.doc_id is None or groups[r.doc_id] == r.doc_id]
    assert {r.doc_id for r in kept} - {r.doc_id for r in alone}

    # secrets: base spans are masked, the rest of the text stays
    clean = {r.doc_id: r for r in secret.collect()}
    assert len(clean) == len(alone)
    masked = 0
    for r in alone:
        spans, out, at = base_secrets(r.text), "", 0
        for s, k, e in spans:
            if s >= at:
                out += r.text[at:s] + f"[{('assign', 'access', 'hex')[k]}]"
            at = max(at, e)
        assert clean[r.doc_id].text == out + r.text[at:] and clean[r.doc_id].n_chars == len(clean[r.doc_id].text)
        masked += bool(spans)
    assert masked

    # mixing: whole documents, each source near its target
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in clean.values()}
    source, total, taken = {r.doc_id: r.source for r in clean.values()}, Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
    drawn = mixed.collect()
    for r in drawn:
        assert tuple(r) == tuple(clean[r.doc_id])
        taken[r.source] += size[r.doc_id]
    want = expected_targets(dict(total), (1, 2, 3), 3)
    assert max(Counter(r.doc_id for r in drawn).values()) <= 3
    for s, n in want.items():
        assert abs(taken[s] - n) <= max(v for i, v in size.items() if source[i] == s)

    # segmentations: distinct ones of each text, that decode to it
    v = pieces.vocabulary_for(pieces.VOCABULARY, 1.0)
    got = pieces.decode(encoded).collect()
    texts = {r.doc_id: r.text for r in drawn}
    assert v and {r.doc_id for r in got} == set(texts)
    assert all(r.decoded == texts[r.doc_id] for r in got)
    assert max(r.sample for r in got) == 2

    # run() reads the table, goes through the same stages and gives the same rows
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == encoded.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, encoded.collect()))


def test_one_row_of_an_id_stays(spark, sf):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [row(7, text), row(7, text), row(7, text), row(8, text), row(9, "other " + " ".join(f"w{i}" for i in range(50))), row(None, text), row(None, text)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(2), "")
    assert got.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sorted((r.doc_id for r in got.collect()), key=str) == [7, 9, None, None]


@pytest.mark.parametrize("rows", [[], [row(None, None, None, None)], [row(1, None), row(1, ""), row(2, " ")]])
def test_tables_of_which_nothing_is_left(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
