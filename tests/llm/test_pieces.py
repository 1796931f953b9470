"""Sampled segmentations: round trips, distinctness, and frequencies against all segmentations."""

import math
from collections import Counter

import numpy as np

from loomset.llm import pieces

TEXTS = [None, "", "a", " ", "hello world", "  two  spaces\n\nnew\tlines  ", "▁ mark ▁▁", "日本語テキスト 😀 é", "x" * 3000, "word " * 2000]


def segmentations(text, v):
    """All segmentations of ' ' + text as tuples of edges (bytes, ids), with their weights."""
    data = (" " + text).encode()
    ids = {b: i for i, b in enumerate(v.bytes) if b and np.isfinite(v.log[i])}

    def go(at):
        if at == len(data):
            yield (), 0.0
            return
        for end in range(at + 1, min(len(data), at + v.longest) + 1):
            i = ids.get(data[at:end])
            if i is not None:
                for rest, w in go(end):
                    yield (i, *rest), w + v.log[i]
        size = 1
        while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
            size += 1
        if data[at : at + size] not in ids:
            for rest, w in go(at + size):
                yield (*(int(v.byte_ids[b]) for b in data[at : at + size]), *rest), w + v.byte_log * size

    return dict(go(0))


def test_round_trip_and_distinct(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, sample int")
    got = pieces.decode(pieces.sample(df, pieces.Sampling(k=4))).collect()
    seen = {}
    for r in got:
        assert r.decoded == (texts[r.doc_id] or ""), r.doc_id
        assert r.n_tokens == len(r.ids) // 2 and r.log_inclusion <= 1e-9
        seen.setdefault(r.doc_id, []).append(r)
    for i, rows in seen.items():
        rows.sort(key=lambda r: r.sample)
        assert [r.sample for r in rows] == list(range(1, len(rows) + 1))
        assert len({bytes(r.ids) for r in rows}) == len(rows)
        assert all(a.perturbed >= b.perturbed for a, b in zip(rows, rows[1:]))
    assert len(seen) == len(texts) and len(seen[0]) == len(seen[1]) == 1
    assert all(len(seen[i]) == 4 for i in range(len(TEXTS), len(texts)))
    again = pieces.sample(df.repartition(5), pieces.Sampling(k=4, block=3000, part=500)).collect()
    assert sorted((r.doc_id, r.sample, bytes(r.ids)) for r in again) == sorted((r.doc_id, r.sample, bytes(r.ids)) for r in got)
    assert pieces.sample(df.limit(0)).collect() == []


def test_samples_follow_the_lattice(spark):
    v = pieces.vocabulary_for(pieces.VOCABULARY, 1.0)
    text, n = "the é", 6000
    every = segmentations(text, v)
    total = math.log(sum(math.exp(w) for w in every.values()))
    p = {s: math.exp(w - total) for s, w in every.items()}
    rows = pieces.sample(spark.range(n).selectExpr("id AS doc_id", f"'{text}' AS text"), pieces.Sampling(k=2)).collect()
    first, both = Counter(), Counter()
    for r in rows:
        s = tuple(np.frombuffer(r.ids, "<u2").tolist())
        assert abs(r.log_prob - math.log(p[s])) < 1e-4
        both[s] += 1
        if r.sample == 1:
            first[s] += 1
    for s in sorted(p, key=p.get)[-6:]:
        assert abs(first[s] / n - p[s]) < 5 * math.sqrt(p[s] / n)
        # without replacement: first, or second after another
        q = p[s] + sum(p[x] * p[s] / (1 - p[x]) for x in p if x != s)
        assert abs(both[s] / n - q) < 5 * math.sqrt(q / n)
    # inclusion scores make sums over samples unbiased: the weights p / q of the probability itself sum to 1
    mean = sum(math.exp(r.log_prob - r.log_inclusion) for r in rows) / n
    assert abs(mean - 1) < 0.1


def test_all_segmentations_of_a_short_text(spark):
    v = pieces.vocabulary_for(pieces.VOCABULARY, 1.0)
    every = segmentations("ab", v)
    rows = pieces.sample(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), pieces.Sampling(k=50)).collect()
    assert {tuple(np.frombuffer(r.ids, "<u2").tolist()) for r in rows} == set(every)
    assert len(rows) == len(every) and abs(sum(math.exp(r.log_prob) for r in rows) - 1) < 1e-5
