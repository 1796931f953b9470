"""Ties, repeated rows and the order of the weighted sample."""

import random
from collections import defaultdict

import pytest

from loomset.llm import mixing


def documents(spark, rows, schema="doc_id long, text string, source string, size string, edge int"):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], schema).repartition(5)


@pytest.mark.parametrize("few", [mixing.BROADCAST, 0])
def test_equal_rows_come_near_the_target(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST", few)
    words = " ".join("abcdefghij")
    rows = [(1, words, "a")] * 400 + [(None, words, "b")] * 300 + [(1000 + i, words, "c") for i in range(500)]
    df = documents(spark, rows)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in mixing.report(df).collect():
        s = {1: "a", None: "b"}.get(r.doc_id, "c")
        taken[s] += r.taken
        target[s], size[s] = r.target, r.source_size
    assert size == {"a": 4000, "b": 3000, "c": 5000}
    assert sum(target.values()) == pytest.approx(12000)
    for s in target:
        assert abs(taken[s] - target[s]) <= 10, (s, taken[s], target[s])
    drawn = mixing.mixed(df)
    assert drawn.columns == df.columns
    amount = defaultdict(int)
    for r in drawn.collect():
        amount[r.source] += 10
    assert amount == taken


def test_the_smallest_keys_are_taken(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["word"] * rnd.randrange(0, 40)) or None, rnd.choice("abcd") if i % 9 else None) for i in range(900)]
    by = defaultdict(list)
    source = {i: s for i, _, s in rows}
    for r in mixing.report(documents(spark, rows), mixing.Mix(rows=50)).collect():
        by[source[r.doc_id]].append(r)
    for s, group in by.items():
        rest = group[0].target - group[0].epochs * group[0].source_size
        done = 0
        for r in sorted(group, key=lambda r: (r.key, r.size)):
            more = rest > 0 and done + r.size / 2 <= rest
            if r.size:
                assert r.taken == r.size * (r.epochs + more), (s, r)
            done += r.size


def test_heavier_documents_come_first(spark):
    good, bad = " ".join(["sample"] * 60), " ".join(["#=1"] * 60)
    rows = [(i, good if i % 2 else bad, "a") for i in range(2000)] + [(5000 + i, good, "b") for i in range(500)]
    got = [r for r in mixing.report(documents(spark, rows)).collect() if r.doc_id < 5000]
    assert {r.epochs for r in got} == {0}
    chosen = [sum(r.taken > 0 for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert chosen[1] > 1.5 * chosen[0]
