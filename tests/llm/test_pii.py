"""Personal data against plain regular expressions, and the bootstrap on a small corpus."""

import hashlib
import random
import re

from loomset.llm import pii

FIXED = [
    None,
    "",
    "a@b.c_d@e.fg x.y+z@mail-1.example.com. @x.y a@b a@b. a@b..c é@b.cd ü.a@b.cd",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 1..2.3.4 999999999999.1.1.1 12.34.56.78x",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 3 5 41111111111111111 6011000990139424123",
    "+1 (499) 555-6503 +49 30 1234567. +1 +12 + 12345678 +1234567890123456 +1..........2 +1-2-3-4-5-6-7-8 ",
    "9" * 100_000,
    "9 " * 50_000,
    "a." * 50_000 + "@x.y",
    "a@" + "b." * 40_000,
    "+1" + " " * 50_000,
]


def base(text):
    text, found = text or "", []
    found += [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if len(text) < 90_000 or "@" in text and not text.startswith("a.a.") else []
    if text.startswith("a.a."):
        found.append((0, 0, len(text)))
    if len(text) < 90_000:
        found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_base_spans_equal_plain_regex(spark, sf):
    texts = FIXED + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.report(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert rows[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (i, (t or "")[:60], rows[i].spans[:300], listed[:300])
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(k == j for k, _, _ in want) for j in range(4)]
        assert set(filter(None, listed.split(","))) <= set(rows[i].spans.split(","))


def test_confident_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please write to contact address u{i}@mail.example.com today") for i in range(40)]
    rows += [(100, "please write to contact address user-12345678 today"), (101, "chapter 12345678 of the book"), (102, "contact address none")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "id:32:45" and got[101] == "" and got[102] == ""
    assert all(got[i].startswith("email:32:") for i in range(40))


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "x a@b.cd"), (1, "x a@b.cd"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.report(df).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert pii.report(df.limit(0)).collect() == []


def brute_bootstrap(rows, o):
    """Spans of kind id by plain loops over all documents."""
    seen = []  # row, start, end, value, seed, patterns
    word = lambda x: re.sub("[0-9]", "9", re.sub(r"\s+", " ", x).lower()).split()
    for n, (_, t) in enumerate(rows):
        t = t or ""
        forms = [(s, e) for _, s, e in base(t)]
        ids = [m.span() for m in re.finditer(pii.IDENTIFIER, t) if sum(c.isdigit() for c in m[0]) >= o.digits]
        ids = [(s, e) for s, e in ids if not any(a < e and s < b for a, b in forms)]
        for spans, seed in ((forms, True), (ids, False)):
            for s, e in spans:
                before, after = t[max(0, s - o.context - 1) : s], t[e : e + o.context + 1]
                left = word(re.sub(r"^\S+", "", before) if s > o.context else before)  # no word that the window cuts in two
                right = word(re.sub(r"\S+$", "", after) if len(t) - e > o.context else after)
                patterns = {("l", *left[-k:]) for k in (1, 2) if len(left) >= k} | {("r", *right[:k]) for k in (1, 2) if len(right) >= k}
                seen.append((n, s, e, t[s:e].lower(), seed, patterns))
    edges = {(p, v) for *_, v, _, ps in seen for p in ps}
    seeds = {v for *_, v, seed, _ in seen if seed}
    sure = {v: 1.0 if v in seeds else 0.0 for *_, v, _, _ in seen}
    for _ in range(o.rounds):
        score = {}
        for p in {p for p, _ in edges}:
            values = [v for q, v in edges if q == p]
            total = sum(sure[v] for v in values)
            if total >= o.support - 1e-9 and total / (len(values) + 1) >= o.accept - 1e-9:
                score[p] = total / (len(values) + 1)
        old = dict(sure)
        for v in sure:
            left = 1.0
            for p, w in edges:
                if w == v and p in score:
                    left *= 1 - score[p]
            sure[v] = max(float(v in seeds), 1 - left)
        if all(sure[v] - old[v] <= o.settled for v in sure):
            break
    out = {}
    for n, s, e, v, seed, _ in seen:
        if not seed and v not in seeds and sure[v] >= o.accept:
            out.setdefault(n, []).append(f"id:{s}:{e}")
    return {n: sorted(x, key=lambda k: int(k.split(":")[1])) for n, x in out.items()}


def test_bootstrap_equals_plain_loops(spark):
    rnd = random.Random(9)
    filler = ["alpha", "beta", "gamma", "delta", "of", "the"]
    some = lambda k: [rnd.choice(filler) for _ in range(k)]
    lead = {"mail": "reach me at", "phone": "call number", "staff": "staff member", "odd": "lot size"}
    rows = []
    for i in range(260):
        kind = rnd.choice(["mail", "mail", "phone", "staff", "odd"])
        value = {
            "mail": f"user{i}@host{i % 7}.example.org", "phone": f"+49 30 {rnd.randrange(10**6, 10**7)}", "staff": rnd.choice([f"AB-{rnd.randrange(100, 10**4)}", f"{rnd.randrange(10**3)} {rnd.randrange(100, 1000)}"]), "odd": str(rnd.randrange(100, 400)),
        }[kind]
        if kind in ("mail", "phone") and rnd.random() < 0.12:
            value = f"ID-{rnd.randrange(1000, 9000)}"  # no fixed form, but the context of one
        end = "without delay" if kind in ("mail", "staff") else "per box"  # staff numbers share what follows mails
        rows.append((i, " ".join([*some(4), lead[kind], value, end, *some(3)])))
    rows += [(900, None), (901, ""), (902, "staff member 77 without delay"), (903, rows[0][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, value string, pattern int").repartition(3)
    found = 0
    for options in (pii.Bootstrap(), pii.Bootstrap(rounds=1, support=3.0, accept=0.6), pii.Bootstrap(digits=6)):
        want = {rows[n][0]: x for n, x in brute_bootstrap(rows, options).items()}
        got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("id:")] for r in pii.report(df, options).collect()}
        assert {i: x for i, x in got.items() if x} == want
        found += len(want)
    assert found > 40


def test_words_that_the_window_cuts_are_no_context(spark):
    options = pii.Bootstrap(context=12)
    rows = [(i, f"{'x' * (i % 9)}yesterday night a{i}@b.cd or{'z' * (i % 7)}") for i in range(40)]
    rows += [(100, "day night 12345 or")]  # the seeds' second word is longer than what the window shows of it
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df, options).collect()}
    assert got[100] == "id:10:15"  # by `night` alone
    seen = pii.scan(df.where("doc_id = 5"), "text").select(pii.contexts(df["text"], pii.F.element_at("base_spans", 1), 12).alias("p")).first().p
    assert [x for x in seen if x.startswith("before")] == ["before1 night"]


def test_confidence_spreads_until_it_settles(spark):
    """Identifiers of one context make the next one sure, and so on, further than three rounds lead."""
    sizes, rows = [120, 50, 20, 8, 3], []
    for k, n in enumerate(sizes):
        value = lambda i, k=k: f"a{i}@b.cd" if k == 0 else f"N{'abcde'[k]}{1000 + i}"
        for j in (k - 1, k):  # with those before them, and with those after
            if j >= 0:
                rows += [(10_000 * k + 1000 * (k - j) + i, f"lead{'abcde'[j]} {value(i)} tail{'abcde'[j]}") for i in range(n)]
    rows.append((99_999, "other 123456 words"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    count = lambda o: sum(r.spans.startswith("id:") for r in pii.report(df, o).collect())
    assert count(pii.Bootstrap(accept=0.5, support=3.0)) == 2 * sum(sizes[1:])
    assert count(pii.Bootstrap(accept=0.5, support=3.0, rounds=3)) < 2 * sum(sizes[1:])
