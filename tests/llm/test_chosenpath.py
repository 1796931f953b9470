"""The similarity join against all pairs."""

import random
import re

import pyarrow as pa
import pytest

from loomset.llm import chosenpath


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rnd.randrange(10, 150))]
        for _ in range(rnd.randrange(1, 12)):
            rows.append((n, " ".join(w if rnd.random() > 0.02 else word() for w in base)))
            n += 1
    hub = [word() for _ in range(200)]
    for _ in range(150):  # one large group, many of whose pairs are near the threshold
        rows.append((n, " ".join(w if rnd.random() > 0.015 else word() for w in hub)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE  two"), (n + 4, "two one"), (n + 5, " \n"), (n + 6, rows[0][1].upper())]
    rnd.shuffle(rows)
    return rows


def test_components_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int").repartition(3)
    for join in (chosenpath.Join(shingle=4), chosenpath.Join(leaf=16, depth=2)):
        got = sorted(tuple(r) for r in chosenpath.near_duplicates(df, join).collect())
        assert got == brute(rows, join.shingle, 80)


def test_nothing_and_repeats(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert chosenpath.near_duplicates(df.limit(0)).collect() == []
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in chosenpath.near_duplicates(df).collect())
    assert got[1:] == [(3, 3, True), (5, 3, False), (5, 3, False)] and got[0][0] == -1


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.id: r.component for r in chosenpath.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_one_leaf_in_a_task(spark, adaptive):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "64" if adaptive == "false" else "4")
    try:
        words = " ".join(f"w{i}" for i in range(60))
        rows = [(1, words), (2, words + " more"), (3, "less " + words)]
        got = sorted(tuple(r) for r in chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == brute(rows, 5, 80)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_a_leaf_across_batches():
    ids = list(range(40))
    rows = pa.record_batch([pa.array(ids), pa.array([7] * 25 + [8] * 15), pa.array([True] * 40), pa.array([bytes(128)] * 40, pa.binary()), pa.array([0] * 40)], names=["id", "path", "lead", "what", "component"])
    run = chosenpath.leaves(chosenpath.Join(), chosenpath.partners, ["a", "b", "late"])
    whole = pa.Table.from_batches(list(run([rows]))).sort_by("a").to_pydict()
    for size in (1, 7, 24, 25, 26):
        parts = [rows.slice(i, size) for i in range(0, 40, size)]
        assert pa.Table.from_batches(list(run([parts[0].slice(0, 0), *parts]))).sort_by("a").to_pydict() == whole
    assert list(run([rows.slice(0, 0)])) == []


def templated(n, planted, seed=4):
    """Pages of one template, pairwise unlike, and `planted` pairs of near copies among them."""
    rnd = random.Random(seed)
    frame = [f"t{i}" for i in range(90)]
    word = lambda: f"u{rnd.randrange(10**9)}"
    rows = []
    for i in range(n):
        rows.append((i, frame[:60] + [word() for _ in range(40)] + frame[60:]))
    for k in range(planted):
        of = rows[k * (n // planted)][1]
        rows.append((n + k, [w if i != 70 else word() for i, w in enumerate(of)]))
    return [(i, " ".join(w)) for i, w in rows]


def test_templated_pages(spark, monkeypatch):
    made = []
    real = chosenpath.mixed

    def counted(*args):
        out = chosenpath.cut(real(*args))
        made.append(out.count())
        return out

    monkeypatch.setattr(chosenpath, "mixed", counted)
    sizes = []
    for n in (500, 1000):
        rows = templated(n, 25)
        made.clear()
        got = {r.doc_id: r.component_id for r in chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: i for i in range(n)} | {n + k: k * (n // 25) for k in range(25)}
        sizes.append(max(made))
    assert sizes[1] < 2.5 * sizes[0] + 100, sizes


def test_sieve_keeps_links(spark):
    from loomset.llm import sieve

    rnd = random.Random(6)
    sets = []
    for i in range(120):
        base = set(rnd.sample(range(400 if i % 2 else 10**6), 30))
        sets += [(base, i), (set(list(base)[:28]) | {rnd.randrange(10**6)}, i if i % 3 == 0 else 1000 + i)]
    rows = [(i, g, -(-len(x) * 80 // 100), b"".join(v.to_bytes(4, "little") for v in sorted(x))) for i, (x, g) in enumerate(sets)]
    got = {r.id: list(r.first) for r in sieve.sieved(spark.createDataFrame(rows, sieve.SETS).repartition(3)).collect()}
    linked = 0
    for a, (x, g) in enumerate(sets):
        for b, (y, h) in enumerate(sets[:a]):
            if g != h and 100 * len(x & y) >= 80 * len(x | y):
                linked += 1
                assert set(got[a]) & set(got[b])
    assert linked >= 30 and len(got) < len(sets)


def test_ids_with_several_texts(spark):
    rnd = random.Random(8)
    words = lambda: [f"v{rnd.randrange(10**6)}" for _ in range(60)]
    a, b, c = words(), words(), words()
    near = lambda w: " ".join(w[:30] + ["other"] + w[30:])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, None), (9, near(b)), (11, near(a)), (3, near(c)), (4, " ".join(c)), (4, "short text")]
    want = [(3, 3), (4, 3), (4, 3), (5, 5), (5, 5), (5, 5), (9, 5), (11, 5)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = chosenpath.near_duplicates(df).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == want
        assert sorted(r.n_shingles for r in got) == [0, 1, 56, 56, 56, 57, 57, 57]


def test_few_labels_settle_without_an_exchange_for_each_join(spark):
    made = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    before = made()
    got = {r.id: r.component for r in chosenpath.components(links).collect()}
    assert got == dict.fromkeys(range(41), 0)
    assert made() - before < 50  # 13 in each round when every join was a shuffle: they fill the driver
