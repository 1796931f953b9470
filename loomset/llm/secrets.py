"""Secret scans with DataFrame functions only.

Three fixed forms (assignments, access keys, long hex) give the base spans. Beyond them, candidate
strings (long runs of key characters that hold a letter and a digit) fall into character classes by the
smallest alphabet that holds them: hex, letters of one case with digits, letters with digits, base64. A
window slides over each: a step takes one character out of the window's counts and one in, and with them
sum(c * log2 c), from which the window's Shannon entropy follows. The counts of an alphabet are packed,
twelve to a number, so a step changes two numbers of six at most, whatever the window is. A candidate whose
best window reaches its class's limit is a secret of kind `entropy`, unless the allow-list names it or a
base span covers part of it. Base spans are never suppressed, and no option of the method changes them.

Null or empty text has no spans. Repeated rows give repeated results. Extra columns are carried by `scan` and
`redact`, whatever their names. No shuffle: each row alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm import spans

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"  # the runs of [0-9a-f]+ with 32 or more
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


@dataclass(frozen=True)
class Scan:
    window: int = 20  # 31 at most
    least: int = 20  # length of a candidate, and of a window at least
    bits: tuple = (3.2, 3.7, 3.9, 3.95)  # limits of CLASSES
    allow: tuple = (
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
        r"(?i)example|sample|placeholder|changeme|dummy|xxxx|your[-_]?",
        r"(?i)0123456789|123456789|abcdefgh",
        r"^[A-Za-z]+([-_/][A-Za-z]+)+[-_/]?[0-9]{0,4}$",  # slugs and paths of words
    )


DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Character classes: what a candidate of the class looks like, and its alphabet; letters of one case count in lower case.
CLASSES = (
    ("^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", True),
    ("^(?:[0-9a-z]+|[0-9A-Z]+)$", DIGITS + LETTERS, True),
    ("^[0-9A-Za-z]+$", DIGITS + LETTERS + LETTERS.upper(), False),
    ("", DIGITS + LETTERS + LETTERS.upper() + "+/_=-", False),
)
#: Bits of a count, and counts in one number.
WIDTH, EACH = 5, 12


def entropy(token: Column, alphabet: str, window: int) -> Column:
    """The largest Shannon entropy, in bits, of any `window` characters in a row of a string over the alphabet, of at least as many."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    f = lambda c: F.element_at(weight, c + 1)
    place = lambda i: F.position(F.substr(token, i, F.lit(1)), F.lit(alphabet)) - 1
    shift = lambda x, code: F.call_function(x[0], x[1], (code % EACH * WIDTH).cast("int"))
    cell = lambda code: F.floor(code / EACH).cast("int")
    count = lambda n, code: shift(("shiftright", F.element_at(n, cell(code) + 1)), code).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")).cast("int")
    one = lambda code: shift(("shiftleft", F.lit(1).cast("long")), code)
    zeros = F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // EACH))
    start = F.struct(zeros.alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        came, went = x["came"], x["went"]
        gone, out = went >= 0, F.greatest(went, F.lit(0))
        c_in, c_out = count(acc["n"], came), F.greatest(count(acc["n"], out), F.lit(1))
        change = F.when(came == went, 0.0).otherwise(f(c_in + 1) - f(c_in) + F.when(gone, f(c_out - 1) - f(c_out)).otherwise(0.0))
        s = acc["s"] + change
        n = F.transform(acc["n"], lambda c, i: c + F.when(i == cell(came), one(came)).otherwise(0) - F.when(gone & (i == cell(out)), one(out)).otherwise(0))
        full = F.when(x["i"] >= window, F.lit(math.log2(window)) - s / window).otherwise(0.0)
        return F.struct(n.alias("n"), s.alias("s"), F.greatest(acc["best"], full).alias("best"))

    steps = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.struct(i.alias("i"), place(i).alias("came"), F.when(i > window, place(i - window)).otherwise(-1).alias("went")))
    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def is_dense(value: Column, options: Scan) -> Column:
    """Whether a candidate's best window reaches the limit of its class."""
    out = None
    for (pattern, alphabet, folded), bits in zip(CLASSES, options.bits):
        dense = entropy(F.lower(value) if folded else value, alphabet, options.window) >= bits
        out = F.when(value.rlike(pattern), dense) if out is None else out.when(value.rlike(pattern), dense)
    return out


def unlike(pattern: str, span: Column) -> Column:
    return ~span["value"].rlike(pattern)


def scan(documents: DataFrame, options: Scan = Scan(), text: str = "text", base: str = "base_spans", more: str = "added_spans") -> DataFrame:
    """documents with the columns `base` and `more`, spans sorted by start, in place of columns of those names."""
    named = lambda x: f"__loom_{x}"
    t = F.col(named("text"))
    low = F.col(named("low"))
    key = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{max(options.least, options.window)},}}"
    df = documents.withColumn(named("text"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(named("low"), F.lower(t))
    says = low.contains(WORDS[0])
    for w in WORDS[1:]:
        says = says | low.contains(w)
    df = df.withColumn(named("keys"), spans.matches(t, key)).withColumn(named("assign"), spans.matches(t, ASSIGN, says)).withColumn(named("access"), spans.matches(t, ACCESS, t.contains("AKIA")))
    df = df.withColumn(named("hex"), spans.matches(t, HEX, t.rlike("[0-9a-f]{32}")))
    good = F.filter(spans.located(t, F.col(named("assign")), ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    access = F.filter(spans.located(t, F.col(named("access")), ACCESS, 1), lambda s: F.length(s["value"]) >= 16)
    df = df.withColumn(base, spans.by_start(F.concat(good, access, spans.located(t, F.col(named("hex")), HEX, 2))))
    # candidates: a letter and a digit at least
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    some = F.when(F.exists(named("keys"), mixed), F.col(named("keys"))).otherwise(F.expr("cast(array() as array<string>)"))
    added = F.filter(spans.located(t, some, key, 3), lambda s: mixed(s["value"]))
    added = spans.apart(added, F.col(base))
    for pattern in options.allow:
        added = F.filter(added, partial(unlike, pattern))
    df = df.withColumn(named("more"), added)
    df = df.withColumn(more, F.when(F.size(named("more")) > 0, F.filter(named("more"), lambda s: is_dense(s["value"], options))).otherwise(F.col(named("more"))))
    return df.drop(*(named(x) for x in ("text", "low", "keys", "assign", "access", "hex", "more")))


def report(documents: DataFrame, options: Scan = Scan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, and all spans as text."""
    found = scan(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), options)
    base = F.col("base_spans")
    return found.select(
        "doc_id",
        *(spans.of_kind(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(spans.written(base, KINDS), 256).alias("base_sha256"),
        spans.written(spans.by_start(F.concat(base, F.col("added_spans"))), KINDS).alias("spans"),
    )


def redact(documents: DataFrame, options: Scan = Scan(), text: str = "text") -> DataFrame:
    """documents with each secret in `text` replaced by its kind in brackets; null stays null."""
    found = scan(documents, options, text, "__loom_base", "__loom_added")
    both = F.concat("__loom_base", "__loom_added")
    clean = F.when(F.size(both) > 0, spans.masked(F.col(text), both, KINDS)).otherwise(F.col(text))
    return found.withColumn(text, clean).select(documents.columns)
