"""Repaired conversations against every sequence of edits."""

import hashlib
import itertools
import random
import re
import zlib

from loomset.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
BLACK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3])):
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    found, seen = [], set()
    for _, role, text in rows:
        black = BLACK.findall(text)
        found.append("blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def best(rows, found):
    """Dynamic programming over (row, repaired roles' state) with whole scripts, no four structs: all scripts of up to two insertions in a gap."""
    ways = {"": (0, "", ())}  # by the repaired initials' end: "", s, u, a
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def better(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, out) in list(ways.items()):
                for initial in follows[state].replace("s", ""):
                    better(ways, initial, (cost + 2, audit + "I", (*out, (full[initial], ""))))
        return ways

    for (_, role, text), fault in zip(rows, found):
        after = {}
        for state, (cost, audit, out) in inserted(ways).items():
            better(after, state, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] and role[:1] in follows[state]:
                better(after, role[:1], (cost + more, audit + "K", (*out, (role, text))))
            for initial in follows[state].replace("s", ""):
                better(after, initial, (cost + 2 + more, audit + "R", (*out, (full[initial], text))))
        ways = after
    ways = inserted(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def every(rows, found):
    """All scripts with at most two insertions in a gap."""
    follows = re.compile(r"(s?(ua)+)?")
    full = {"u": "user", "a": "assistant"}
    gaps = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    choices = [[("D", None)] + ([] if f in ("blank", "duplicate") else [("K", None), ("R", "u"), ("R", "a")]) for f in found]
    best = None
    for put in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(*choices):
            out, audit, cost = [], "", 0
            for i in range(len(rows) + 1):
                for x in put[i]:
                    out.append((full[x], ""))
                    audit, cost = audit + "I", cost + 2
                if i < len(rows):
                    letter, to = edits[i]
                    audit += letter
                    if letter == "D":
                        cost += 3
                    else:
                        cost += (letter == "R") * 2 + (found[i] == "truncated")
                        out.append((full[to] if to else rows[i][1], rows[i][2]))
            if follows.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best = min(best or (cost, audit, tuple(out)), (cost, audit, tuple(out)))
    return best


def expected(conv, rows):
    rows = damage(rows)
    found = faults(rows)
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    cost, audit, out = best(rows, found)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def corpus():
    rnd = random.Random(12)
    texts = ["Yes.", "No!", "Why?", "and then", "Well. ", "", " \n", "Ünï. x", None, "a.b!c?"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ua"]
    rows = []
    for conv in [*range(400), None]:
        size, at = rnd.randrange(1, 9), rnd.randrange(3)
        for _ in range(size):
            rows.append((conv, rnd.choice([at, at, at, None]), rnd.choice(roles), rnd.choice(texts)))
            at += rnd.choice([1, 1, 1, 0, 3])
    rows += [(1000, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(300)]
    rows += [(1001, 0, "user", "x" * 300_000), (1001, 0, "user", "x" * 300_000)]
    return rows


def test_equals_plain_python(spark):
    rows = corpus()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", gaps int, audit string").repartition(3)
    got = {r.conv_id: tuple(r) for r in turns.report(df).collect()}
    assert got == {c: expected(c, x) for c, x in by.items()}


def test_fold_equals_all_scripts(spark):
    rnd = random.Random(5)
    for conv in range(60):
        rows = [(i, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["A.", "B!", "cut", "", "D?"])) for i in range(rnd.randrange(0, 4))]
        found = faults(rows)
        assert best(rows, found) == every(rows, found), (conv, rows)


def test_conversations_without_rows(spark):
    assert turns.report(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = turns.report(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    rows = [(1, i, r, t, False) for i, (r, t) in enumerate([("assistant", "Hi."), ("user", "Yes?"), ("user", "no end")])]
    df = spark.createDataFrame(rows, SCHEMA + ", gone boolean").selectExpr("*", "struct(role, text, 0 as copy) as place")
    r = turns.repaired(df).first()
    assert r.audit == "IKKR" and [tuple(x) for x in r.repaired] == [("user", ""), ("assistant", "Hi."), ("user", "Yes?"), ("assistant", "no end")]
    assert r.cost == 5 and r.truncated == 1
