"""Two-stage suffix sorting and the removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np

from loomset.llm import suffixes as S


def test_two_stage_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(150):
        n, length = int(rng.integers(1, 300)), int(rng.integers(1, 60))
        a = rng.integers(1, 3 if trial % 2 else 250, n).astype(np.uint8)
        order, raw = S.two_stage(a, length), a.tobytes()
        assert sorted(order.tolist()) == list(range(n))
        lcp = S.common_prefixes(order, a, S.ranks_of_eight(a), n - np.arange(n), length)
        for k in range(1, n):
            x, y = int(order[k - 1]), int(order[k])
            assert raw[x : x + length] <= raw[y : y + length]
            same = 0
            while same < length and max(x, y) + same < n and raw[x + same] == raw[y + same]:
                same += 1
            assert lcp[k] == same


def brute(rows, length):
    first = {}
    for i, t in rows:
        d = (t or "").encode()
        key = S.LAST if i is None else i
        for j in range(len(d) - length + 1):
            w = d[j : j + length]
            first[w] = min(first.get(w, S.LAST), key)
    out = []
    for i, t in rows:
        d = (t or "").encode()
        key = S.LAST if i is None else i
        gone = [False] * len(d)
        for j in range(len(d) - length + 1):
            if first[d[j : j + length]] < key:
                gone[j : j + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_kept_bytes_equal_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    pool = [" ".join(word() for _ in range(rnd.randrange(5, 60))) for _ in range(12)]
    rows = [(i, " ".join([rnd.choice(pool) if rnd.random() < 0.5 else word() for _ in range(rnd.randrange(1, 12))])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "a" * 400), (203, "a" * 399), (204, "ab" * 200), (205, rows[3][1]), (205, rows[3][1]), (206, "b" + "ab" * 150), (None, rows[5][1]), (207, rows[5][1][:49]), (-3, rows[7][1])]
    rows = [rows[k] for k in rnd.sample(range(len(rows)), len(rows))]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, kept string").repartition(5)
    for options in (S.Options(), S.Options(part=5000, block=4000, bucket=3000), S.Options(part=3000, bucket=9000, hot=2), S.Options(length=30, gram=12, route=9, hot=1)):
        got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.kept_bytes(df, options).collect()], key=lambda r: (r[0] is None, r))
        assert got == brute(rows, options.length)
    assert S.kept_bytes(df.limit(0)).collect() == []
