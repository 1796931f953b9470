"""Personal data with DataFrame functions only: fixed forms, and bootstrapped contextual extraction.

Four fixed forms (e-mail, IPv4, payment card with its check digit, international phone number) give the
base spans; they are always kept. They are also the seeds of a bootstrap: the one and two words before an
entity, and after it, are its lexical patterns. Patterns and instances (the seeds, and tokens with some
digits, also in groups that single spaces part) form a bipartite graph. Each round scores a pattern by the
confidence of its distinct instances, seeds counting 1, and an instance by its patterns: 1 - product of
(1 - score), until confidences settle. Instances that no form knows but that confident patterns lead to are the spans of kind `id`:
what they look like beside their digits is left to the patterns.

Counts are taken over distinct (pattern, value) pairs with partial sums before any shuffle, so a value or
a pattern that a third of all rows share costs one pair. A pattern needs `support` confident values.
Confident patterns and found values are counted, and sent to all tasks where they are few.

Null or empty text has no spans. Repeated rows give repeated results. An empty table gives no rows. Columns
beside key and text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm import spans
from loomset.llm.cluster import cut

KINDS = ["email", "ip", "card", "phone", "id"]
# The possessive forms match as the plain ones do, without recursion; a start that the lookbehind skips
# could only repeat a failure, and \G lets a match begin where the last one ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Runs of letters and digits that inner marks join, and further groups of digits behind single spaces.
IDENTIFIER = r"(?<![A-Za-z0-9._/()+:@-])(?=[A-Za-z._/()+:-]*+[0-9])[A-Za-z0-9]++(?:[._/()+:-]++[A-Za-z0-9]++)*+(?:\x20[0-9][A-Za-z0-9]*+(?:[._/()+:-]++[A-Za-z0-9]++)*+)*+"
#: Rows of patterns or values that are sent to all tasks at most.
BROADCAST = 500_000


@dataclass(frozen=True)
class Bootstrap:
    settled: float = 1e-6  # rounds end when no confidence has grown by more
    rounds: int = 100  # at most: confidences only grow, to 1 at most
    digits: int = 3  # that an instance has at least
    support: float = 5.0  # confident distinct values that a pattern needs
    accept: float = 0.8  # confidence of a pattern, and of an instance, from where they count
    context: int = 60  # code points before and after an entity in which two words of context stand


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def is_card(value: Column) -> Column:
    number = digits(value)
    return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(F.lit(False))


def scan(documents: DataFrame, text: str = "text", base: str = "base_spans", loose: str | None = None, least_digits: int = 3) -> DataFrame:
    """documents with the column `base`: spans of the fixed forms by kind, then start; and with `loose`, if named: identifiers beside them."""
    named = lambda x: f"__loom_{x}"
    t = F.col(named("text"))
    df = documents.withColumn(named("text"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(named("digit"), t.rlike("[0-9]"))
    some = F.col(named("digit"))
    for name, pattern, guard in (("email", EMAIL, t.contains("@")), ("ip", IP, some & t.rlike(r"[0-9]\.[0-9]")), ("card", CARD, some & t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), ("phone", PHONE, some & t.contains("+"))):
        df = df.withColumn(named(name), spans.matches(t, pattern, guard))
    found = [spans.located(t, F.col(named(k)), p, i) for i, (k, p) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)))]
    found[1] = F.filter(found[1], lambda s: s["value"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
    found[2] = F.filter(found[2], lambda s: is_card(s["value"]))
    found[3] = F.filter(found[3], lambda s: F.length(digits(s["value"])).between(8, 15))
    df = df.withColumn(base, spans.by_kind(F.concat(*found)))
    if loose:
        df = df.withColumn(named("id"), spans.matches(t, IDENTIFIER, some))
        ids = F.filter(spans.located(t, F.col(named("id")), IDENTIFIER, 4), lambda s: F.length(digits(s["value"])) >= least_digits)
        df = df.withColumn(loose, spans.apart(ids, F.col(base)))
    return df.drop(*(named(x) for x in ("text", "digit", "email", "ip", "card", "phone", "id")))


def worded(text: Column) -> Column:
    """Words, lower-cased, digits as 9."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.regexp_replace(text, r"\s+", " ")), "[0-9]", "9"), " ", -1), lambda w: F.length(w) > 0)


def contexts(text: Column, span: Column, size: int) -> Column:
    """The patterns of a span: one and two words before it, one and two after it, as far as there are some."""
    # a word that the window cuts in two is no word of the context
    before = F.substr(text, F.greatest(span["start"] - size - 1, F.lit(0)) + 1, F.least(span["start"], F.lit(size + 1)))
    after = F.substr(text, span["end"] + 1, F.lit(size + 1))
    left = worded(F.when(span["start"] > size, F.regexp_replace(before, r"^\S+", "")).otherwise(before))
    right = worded(F.when(F.length(text) - span["end"] > size, F.regexp_replace(after, r"\S+$", "")).otherwise(after))
    side = lambda name, w, one, two: F.array(F.when(F.size(w) >= 1, F.concat(F.lit(f"{name}1 "), one(w))), F.when(F.size(w) >= 2, F.concat(F.lit(f"{name}2 "), two(w))))
    before = spans.let(left, lambda w: side("before", w, lambda w: F.element_at(w, -1), lambda w: F.concat_ws(" ", F.element_at(w, -2), F.element_at(w, -1))))
    after = spans.let(right, lambda w: side("after", w, lambda w: F.element_at(w, 1), lambda w: F.concat_ws(" ", F.element_at(w, 1), F.element_at(w, 2))))
    return F.array_compact(F.concat(before, after))


def few(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks if it has few rows. df is cut already."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def confidences(edges: DataFrame, options: Bootstrap) -> DataFrame:
    """value, confidence of the values beside the seeds that confident patterns lead to. edges: pattern, value, seed boolean; any repeats."""
    edges = cut(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    known = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("seed"))
    values = known.where("seed > 0").select("value", "seed", F.col("seed").alias("confidence"))
    for _ in range(options.rounds):
        total = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        sure = edges.join(values, "value").groupBy("pattern").agg(F.sum("confidence").alias("sure")).where(F.col("sure") >= options.support)
        scored = cut(sure.join(total, "pattern").select("pattern", (F.col("sure") / (F.col("n") + 1)).alias("score")).where(F.col("score") >= options.accept))
        if scored.isEmpty():
            break
        led = edges.join(few(scored), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("led"))
        old = values
        values = cut(known.join(led, "value", "left").select("value", "seed", F.greatest("seed", F.coalesce("led", F.lit(0.0))).alias("confidence")).where("confidence > 0"))
        grown = values.join(old.select("value", F.col("confidence").alias("old")), "value", "left").where(F.col("confidence") - F.coalesce("old", F.lit(0.0)) > options.settled)
        if grown.isEmpty():
            break
    return values.where((F.col("confidence") >= options.accept) & (F.col("seed") == 0)).select("value", "confidence")


def report(documents: DataFrame, options: Bootstrap = Bootstrap(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, and all spans as text."""
    source = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = scan(source, "text", "base_spans", "loose", options.digits)
    each = lambda column, seed: F.transform(column, lambda s: F.struct(contexts(F.col("text"), s, options.context).alias("patterns"), F.lower(s["value"]).alias("value"), F.lit(seed).alias("seed"), s.alias("span")))
    rows = found.select("doc_id", F.monotonically_increasing_id().alias("row"), "base_spans", F.concat(each(F.col("base_spans"), True), each(F.col("loose"), False)).alias("seen"))
    rows = cut(rows)
    seen = rows.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    good = confidences(seen.select(F.explode("patterns").alias("pattern"), "value", "seed"), options)
    # patterns' own confidence is in a value's: an instance is taken where its value is
    more = seen.where("not seed").join(few(cut(good)), "value").groupBy("row").agg(F.collect_list("span").alias("more"))
    out = rows.join(more, "row", "left")
    base = F.col("base_spans")
    both = F.concat(base, F.coalesce(F.col("more"), F.expr(spans.NONE)))
    return out.select(
        "doc_id",
        *(spans.of_kind(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
        F.sha2(spans.written(base, KINDS), 256).alias("base_sha256"),
        spans.written(spans.by_kind(both), KINDS).alias("spans"),
    )
