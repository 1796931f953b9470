"""Spans of regular expressions as column expressions: no Python runs on the executors.

A span is struct<start int, kind int, end int, value string>; start and end count code points, end
exclusive; kind is the position in the caller's list of kinds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,kind:int,end:int,value:string>"
#: Spans that are laid out together.
RUN = 128
NONE = f"cast(array() as array<{SPAN}>)"


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All leftmost non-overlapping matches; none where the cheap guard says that there can be none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if guard is None else F.when(guard, found).otherwise(F.expr("cast(array() as array<string>)"))


def located(text: Column, hits: Column, pattern: str, kind: int) -> Column:
    """Spans of `hits`, which matches(text, pattern) gave, from the lengths of the text's pieces between them.

    Spans are counted from the start of runs of RUN of them first, so that many spans cost no more each."""
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr(NONE).alias("out"))

    def step(acc: Column, both: Column) -> Column:
        at = acc["at"] + F.length(both["piece"])
        end = at + F.length(both["hit"])
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), both["hit"].alias("value"))
        return F.struct(F.coalesce(end, at).alias("at"), F.when(both["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    both = F.zip_with(pieces, hits, lambda piece, hit: F.struct(piece.alias("piece"), hit.alias("hit")))
    run = lambda x, i: F.aggregate(F.slice(x, i * RUN + 1, F.lit(RUN)), start, step)
    runs = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda i: run(x, i))
    moved = lambda s, by: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value"))

    def placed(rows: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(rows, 1, i), F.lit(0), lambda n, r: n + r["at"])
        return F.flatten(F.transform(rows, lambda r, i: let(before(i), lambda by: F.transform(r["out"], lambda s: moved(s, by)))))

    return F.when(F.size(hits) > 0, let(both, lambda x: let(runs(x), placed))).otherwise(F.expr(NONE))


def let(value: Column, fn) -> Column:
    """fn(value), with value computed once a row."""
    return F.transform(F.array(value), fn)[0]


def written(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_start(spans: Column) -> Column:
    return F.array_sort(spans)


def by_kind(spans: Column) -> Column:
    turned = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return F.transform(F.array_sort(turned), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def masked(text: Column, spans: Column, kinds: list[str]) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""
    names = F.array(*map(F.lit, kinds))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        mask = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, mask).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(by_start(spans), start, step, rest)).otherwise(text)
