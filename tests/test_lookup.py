"""Learned lemma rules and rows by position."""

import random

from pyspark.sql import functions as F

from loomset.operators import lemmas
from loomset.sources import positions

PAIRS = "word string, lemma string"


def regular(rnd, n):
    stems = {"".join(rnd.choice("bcdfghklmnprtvz") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 4))) + rnd.choice("nlrt") for _ in range(n)}
    rows = []
    for s in sorted(stems):
        rows += [(s + "s", s), (s + "ing", s + "e"), (s[:-1] + "ies", s[:-1] + "y"), (s, s)]
    return rows


def plain_rules(pairs, longest=6, least=2):
    found = {}
    for word, lemma in set(pairs):
        same = next((i for i, (a, b) in enumerate(zip(word, lemma)) if a != b), min(len(word), len(lemma)))
        cut, add = len(word) - same, lemma[same:]
        for k in range(cut, min(len(word), longest) + 1):
            by = found.setdefault(word[len(word) - k :], {})
            by[cut, add] = by.get((cut, add), 0) + 1
    best = {s: min((-n, c, a) for (c, a), n in by.items()) for s, by in found.items()}
    return {s: (c, a, -n, sum(found[s].values())) for s, (n, c, a) in best.items() if -n >= least}


def plain_lemma(word, rules, longest=6):
    for k in range(min(len(word), longest), -1, -1):
        rule = rules.get(word[len(word) - k :])
        if rule and rule[0] < len(word):
            return word[: len(word) - rule[0]] + rule[1]
    return word


def test_learned_rules(spark):
    rnd = random.Random(7)
    pairs = regular(rnd, 150)
    rnd.shuffle(pairs)
    cut = len(pairs) * 3 // 4
    seen, held = pairs[:cut], dict(pairs[cut:])
    rules = lemmas.learned(spark.createDataFrame([*seen, *seen[:5], (None, "x"), ("x", None), ("", "")], PAIRS).repartition(3))
    got = {r.suffix: (r.cut, r.add, r.n, r.total) for r in rules.collect()}
    assert got == plain_rules(seen)
    words = spark.createDataFrame([(w,) for w in [*held, *list(held)[:9], None, "", "q"]], "word string")
    out = {r.word: r.lemma for r in lemmas.by_rules(words, rules).collect()}
    assert out == {w: plain_lemma(w, got) for w in [*held, "", "q"]}
    assert sum(out[w] == v for w, v in held.items()) > 0.9 * len(held)  # words that no pair had
    table = spark.createDataFrame([("q", "quit"), (next(iter(held)), "special")], PAIRS)
    known = {r.word: r.lemma for r in lemmas.by_rules(words, rules, table).collect()}
    assert known["q"] == "quit" and known[next(iter(held))] == "special" and len(known) == len(out)


def test_texts_of_a_hot_word(spark):
    pairs = [("cats", "cat"), ("dogs", "dog"), ("rats", "rat"), ("is", "be"), ("was", "be")]
    rules = lemmas.learned(spark.createDataFrame(pairs, PAIRS))
    table = spark.createDataFrame(pairs[3:], PAIRS)
    texts = [(1, "the cats  saw\nbirds"), (1, "the cats  saw\nbirds"), (2, None), (3, ""), (4, " is  was ")] + [(10 + i, "the " * 50) for i in range(300)]
    df = spark.createDataFrame([(*t, "x") for t in texts], "id long, text string, lemma string").repartition(4)
    out = lemmas.lemmatised_texts(df, "text", rules, table)
    assert out.columns == ["id", "text", "lemma", "lemmas"] and out.count() == len(texts)
    got = {r.id: r.lemmas for r in out.collect()}
    assert got[1] == ["the", "cat", "saw", "bird"] and got[2] is None and got[3] == [] and got[4] == ["be", "be"] and got[10] == ["the"] * 50


def test_any_model_once_for_each_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, text string")

    def model():
        return lambda x: [w.upper() for w in x.split()]

    assert {r.id: r.lemmas for r in lemmas.lemmas_of_texts(df, "text", model).collect()} == {1: ["A", "B"], 2: ["A", "B"], 3: None}


def test_rows_by_position(spark, tmp_path):
    rnd = random.Random(3)
    values = [rnd.choice([None, *range(40)]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(3)
    folder = f"file://{tmp_path}/sorted"
    positions.written(df, ["v", "id"], folder, 7)
    want = sorted(enumerate(values), key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    for start, n in ((0, 1), (0, 500), (499, 1), (123, 77), (490, 100), (500, 5), (-3, 5), (7, 0)):
        got = positions.sliced(spark, folder, start, n)
        assert got.columns == ["id", "v", "position"]
        assert [tuple(r) for r in got.orderBy("position").collect()] == [(*want[i], i) for i in range(max(start, 0), min(start + n, 500))]
    one = positions.sliced(spark, folder, 250)
    assert len(one.inputFiles()) == 1 and one.rdd.getNumPartitions() == 1
    assert spark.read.parquet(f"{folder}/places").agg(F.sum("rows")).first()[0] == 500
    positions.written(df.limit(0), ["v"], f"{folder}-none", 3)
    assert positions.sliced(spark, f"{folder}-none", 0, 5).collect() == []
