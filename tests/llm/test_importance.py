"""Importance weights and draws against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomset.llm import importance, parts

SCHEMA = "doc_id long, text string"


def buckets(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, wanted, least=20, percent=5):
    found = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for _, _, x in found for b in x), Counter(b for x in wanted for b in buckets(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, words, x in found:
        weight = sum(map(gain, x))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["the", "der", "Ünï", "x1", "of"]) if rnd.random() < 0.5 else "".join(rnd.choice("abcdeF") for _ in range(4))
    text = lambda: "".join(word() + rnd.choice([" ", "-", "\n", ", ", "_", "—"]) for _ in range(rnd.randrange(0, 120)))
    docs = [(i, text()) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, " \n—"), (1003, "One"), (1004, "one two"), (5, docs[5][1]), (None, text())]
    docs += [(2000 + i, "the same words " * 10) for i in range(300)]  # a third are copies
    docs.append((3000, "the der of " * 40_000))
    rnd.shuffle(docs)
    return docs, [text() for _ in range(30)] + [None, "x1 x1"]


def frames(spark, docs, wanted):
    return spark.createDataFrame([(*d, 1, "w") for d in docs], SCHEMA + ", score int, rank string").repartition(5), spark.createDataFrame([(w,) for w in wanted], "text string")


@pytest.mark.parametrize("target", [importance.Target(), importance.Target(group=2000, task=200_000), importance.Target(group=40, groups=1000)])
def test_equals_plain_counts(spark, target):
    docs, wanted = corpus()
    got = importance.resampled(*frames(spark, docs, wanted), target)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, wanted)


def test_salted_groups(spark):
    docs, wanted = corpus()
    left, right = frames(spark, docs, wanted)
    target = importance.Target(group=100_000, task=20_000)
    assert importance.planned(left, target).salts > 1
    assert sorted((tuple(r) for r in importance.resampled(left, right, target).collect()), key=str) == brute(docs, wanted)


def test_nothing(spark):
    left, right = frames(spark, [], [])
    assert importance.resampled(left, right).collect() == []
    docs = [(1, "a b c"), (2, None), (3, "a b")]
    left, right = frames(spark, docs, [])
    assert sorted((tuple(r) for r in importance.resampled(left, right).collect()), key=str) == brute(docs, [])
    left, right = frames(spark, [], ["a b"])
    assert importance.resampled(left, right).collect() == []


def test_torn_blocks_are_an_error():
    with pytest.raises(RuntimeError, match="order is not stable"):
        body = parts.pack(*(np.zeros(1, t) for t in ("<i8", "u1", "<i8", "<i8")))
        rows = pa.record_batch([pa.array([4]), pa.array([importance.OWED], pa.int32()), pa.array([1]), pa.array([body])], names=["block", "kind", "total", "body"])
        list(importance.adder()([rows]))
