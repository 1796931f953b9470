"""Fingerprints and components against all pairs."""

import random
import re

import numpy as np
import xxhash

from loomset.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    own = list(range(len(rows)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                own[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def corpus():
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    rows = []
    for _ in range(15):
        base = [word() for _ in range(rnd.randrange(1, 200))]
        for _ in range(rnd.randrange(1, 15)):
            rows.append(" ".join(w if rnd.random() > 0.01 else word().upper() for w in base))
    rows += [None, "", " \n\t", "one", "one two", "ONE  two", "one two three", "ünï çÖde Ünï", "x " * 3, "a b c d e f g"]
    rows += [rows[0]] * 4
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_equals_all_pairs(spark):
    rows = [*corpus(), (None, "one two"), (None, "alone it is"), (3, "the same id again"), (7, None)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA + ", fingerprint string, component_id int").repartition(3)
    for trie in (simhash.Trie(), simhash.Trie(large=4, small=1, bits=3, chunk=16)):
        got = sorted((tuple(r) for r in simhash.near_duplicates(df, trie).collect()), key=str)
        assert got == brute(rows)


def clustered(rnd, n):
    """Fingerprints many of which are alike, all of one half."""
    high = rnd.getrandbits(40) << 24
    out = {high | rnd.getrandbits(9) << rnd.choice([0, 5, 15]) for _ in range(n)}
    out |= {rnd.getrandbits(64) for _ in range(n)} | {0, 1, 3, 7, 15, 1 << 63, (1 << 64) - 1, (1 << 64) - 8}
    out |= {x ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for x in list(out)[::3]}
    return sorted(out)


def plain_components(prints):
    x = np.array(prints, np.uint64)
    own = list(range(len(x)))

    def find(i):
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 2).tolist():
            own[find(i)] = find(j)
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(find(i), set()).add(p)
    return sorted(map(sorted, groups.values()))


def test_hot_nodes_are_split(spark):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = clustered(random.Random(2), 300)
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long").repartition(5)
    for trie in (simhash.Trie(), simhash.Trie(large=8, small=1), simhash.Trie(large=2, small=1, bits=5, chunk=64)):
        own = {p: p for p in prints}

        def find(x, own=own):
            while own[x] != x:
                x = own[x]
            return x

        found = simhash.links(df, trie).collect()
        for r in found:
            a, b = r.a % (1 << 64), r.b % (1 << 64)
            assert (a ^ b).bit_count() >= 1
            own[find(a)] = find(b)
        groups = {}
        for p in prints:
            groups.setdefault(find(p), set()).add(p)
        assert sorted(map(sorted, groups.values())) == plain_components(prints)


def test_nothing_and_long_texts(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    got = simhash.near_duplicates(spark.createDataFrame([(4, text), (2, text.upper())], SCHEMA)).collect()
    assert {r.component_id for r in got} == {2} and got[0].fingerprint == got[1].fingerprint == f"{plain_print(text):016x}"
