"""Repair of conversations by a fold of Spark SQL's higher-order functions; DataFrame functions only.

A conversation should read `(s?(ua)+)?` by the first letters of its roles: perhaps a system turn, then
user and assistant in turn. Faults are flagged row by row: blank texts, turns seen before (by a window
over equal turns), truncated texts. The conversation's turns are then collected in order, and
`aggregate()` carries the cheapest edits for each of four states: nothing kept yet, after a system
turn, after a user turn, after an assistant turn. Each is a struct (cost, audit) and the cheapest of
several is their `least`: costs first, then the edits' letters in ASCII order.

Edits: K keeps a turn, R gives it the role user or assistant, D deletes it (the only choice for blank and
repeated turns), I inserts an empty turn of either role. What role an I or R gives follows from its place,
so the letters tell the repaired conversation.

Null roles and texts are one space; null turns come first; turns of one number are ordered by role and
text. Rows of a null conversation id are one conversation. A repeated row is a repeated turn. No rows give
no conversations. Other columns are not read. A conversation is one value here, as its result is (the
edits' letters, a digest of the whole): it has to fit into one task, however many conversations there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
#: Costs of edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: More than any conversation costs.
NEVER = 1 << 50


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone, and place (what orders turns of one number), damaged by crc32 of `conv_id:turn` modulo 20.

    0 drops a row (it stays here with `gone`, so that its conversation does), 1 empties its text, 2 removes its
    `.!?`, 3 repeats it next to itself, 4 gives it the role user.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn))) % 20
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"), kind.alias("kind"))
    text_now = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role_now = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("copy", copies)
    return rows.select("conv_id", "turn", role_now.alias("role"), text_now.alias("text"), (F.col("kind") == 0).alias("gone"), F.struct("role", "text", "copy").alias("place"))


def flagged(turns: DataFrame) -> DataFrame:
    """turns with `fault`: blank, duplicate, truncated or null, the first that holds. turns: conv_id, turn, role, text, gone, place."""
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "place")
    seen = F.row_number().over(same) > 1
    kept = F.rtrim("text", F.lit(SPACES))
    fault = F.when(kept == "", "blank").when(F.col("__seen"), "duplicate").when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), "truncated")
    return turns.withColumn("__seen", seen).withColumn("fault", fault).drop("__seen")


def spent(state: Column, cost: int | Column, letter: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit"))


def states(start: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The four states, with what insertions make of them."""
    user = F.least(user, spent(start, INSERT, "I"), spent(system, INSERT, "I"), spent(assistant, INSERT, "I"))
    return F.struct(start.alias("start"), system.alias("system"), user.alias("user"), F.least(assistant, spent(user, INSERT, "I")).alias("assistant"))


def step(now: Column, row: Column) -> Column:
    """The states after one more turn."""
    start, system, user, assistant = (now[s] for s in ("start", "system", "user", "assistant"))
    kept = F.when(row["fault"] == "truncated", CUT_OFF).otherwise(0)
    never = F.lit(NEVER)
    must_go = F.coalesce(row["fault"].isin("blank", "duplicate"), F.lit(False))
    keep = lambda initial: F.when(~must_go & (row["initial"] == initial), kept).otherwise(never)
    rerole = F.when(~must_go, kept + REROLE).otherwise(never)
    before_user = (start, system, assistant)
    return states(
        spent(start, DELETE, "D"),
        F.least(spent(system, DELETE, "D"), spent(start, keep("s"), "K")),
        F.least(spent(user, DELETE, "D"), *(spent(s, keep("u"), "K") for s in before_user), *(spent(s, rerole, "R") for s in before_user)),
        F.least(spent(assistant, DELETE, "D"), spent(user, keep("a"), "K"), spent(user, rerole, "R")),
    )


def cheapest(rows: Column) -> Column:
    """struct(cost, audit) for an array of turns (initial, fault, ...) in order."""
    nothing = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    never = F.struct(F.lit(NEVER).alias("cost"), F.lit("").alias("audit"))
    return F.aggregate(rows, states(nothing, never, never, never), step, lambda end: F.least(end["start"], end["assistant"]))


def edited(rows: Column, audit: Column) -> Column:
    """The repaired turns, array<struct<role, text>>, by the edits' letters."""
    letters = F.filter(F.split(audit, ""), lambda x: x != "")
    every = F.transform(letters, lambda x, i: F.struct(i.alias("at"), x.alias("edit")))
    own = F.filter(every, lambda x: x["edit"] != "I")
    of_rows = F.zip_with(own, rows, lambda e, r: F.struct(e["at"].alias("at"), e["edit"].alias("edit"), r["role"].alias("role"), r["text"].alias("text")))
    put_in = F.transform(F.filter(every, lambda x: x["edit"] == "I"), lambda e: F.struct(e["at"].alias("at"), e["edit"].alias("edit"), F.lit("").alias("role"), F.lit("").alias("text")))
    return F.filter(F.array_sort(F.concat(of_rows, put_in)), lambda x: x["edit"] != "D")


def repaired(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role, text).

    turns: conv_id, turn, role, text, gone (not counted as a turn), place.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "place", F.substring("role", 1, 1).alias("initial"), "fault", "role", "text")
    # equal turns and a conversation's turns need one and the same shuffle
    rows = flagged(turns.repartition("conv_id")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(~F.col("gone"), turn))).alias("rows"))
    numbers = F.filter(F.transform("rows", lambda x: x["turn"]), lambda x: x.isNotNull())
    gaps = F.coalesce(F.array_max("numbers") - F.array_min("numbers") + 1 - F.size(F.array_distinct("numbers")), F.lit(0)).cast("long")
    many = lambda fault: F.size(F.filter("rows", lambda x: x["fault"] == fault)).cast("long").alias(fault)
    others = F.greatest(F.size("rows") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("rows", F.lit(1), others), F.slice("rows", F.lit(2), others), lambda x, y: F.concat(x["initial"], y["initial"]))
    illegal = F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au"))).cast("long")
    df = rows.withColumn("numbers", numbers).withColumn("best", cheapest(F.col("rows")))
    df = df.withColumn("left", edited(F.col("rows"), F.col("best.audit")))
    system = F.coalesce((F.get("left", F.lit(0))["edit"] == "K") & F.get("left", F.lit(0))["role"].startswith("s"), F.lit(False)).cast("int")
    role = lambda x, i: F.when(x["edit"] == "K", x["role"]).otherwise(F.when((i + F.col("system")) % 2 == 0, "user").otherwise("assistant"))
    df = df.withColumn("system", system)
    out = F.transform("left", lambda x, i: F.struct(role(x, i).alias("role"), x["text"].alias("text")))
    return df.select("conv_id", gaps.alias("gaps"), many("blank"), many("duplicate"), many("truncated"), illegal.alias("illegal"), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), out.alias("repaired"))


def report(conversations: DataFrame) -> DataFrame:
    """`repaired` for the damaged conversations, with a digest (repaired_sha256) of each repaired one instead of its turns."""
    lines = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    out = repaired(damaged(conversations))
    return out.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")
