"""Queries whose results are orders: buffered shuffles and throttled calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.operators.buffers import Buffer, shuffled_shards
from loomset.operators.throttle import throttled
from loomset.plans.catalog import query, t

BUFFER = Buffer(workers=8, initial=40, full=100, seed=3, epoch=1)

#: A buffer as a recursion over its contents: one row comes in each step, or one that is left goes.
BUFFERED = f"""
WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey % 50 AS shard FROM orders),
s AS (SELECT shard, rank % {BUFFER.workers} AS worker, rank // {BUFFER.workers} AS turn FROM (SELECT shard, row_number() OVER (ORDER BY md5('{BUFFER.seed + BUFFER.epoch}:' || shard), shard) - 1 AS rank FROM (SELECT DISTINCT shard FROM o))),
r AS (SELECT worker, o_orderkey, row_number() OVER (PARTITION BY worker ORDER BY turn, o_orderkey) AS i FROM o JOIN s USING (shard)),
n AS (SELECT worker, count(*) AS n FROM r GROUP BY 1),
g AS (SELECT worker, CAST(0 AS BIGINT) AS p, CAST([] AS BIGINT[]) AS held, false AS second, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS given FROM n
  UNION ALL
  SELECT worker, p, CASE WHEN NOT pick THEN h WHEN k = len(h) - 1 THEN h[:len(h) - 1] ELSE list_concat(list_append(h[:k], h[len(h)]), h[k + 2:len(h) - 1]) END, wait, step + CAST(pick AS BIGINT), CASE WHEN pick THEN h[k + 1] END
  FROM (SELECT *, NOT wait AND (drained OR len(h) >= {BUFFER.initial}) AS pick, CAST('0x' || md5(({BUFFER.seed + BUFFER.epoch} + 1000 * worker) || ':' || step)[:8] AS BIGINT) % len(h) AS k
    FROM (SELECT worker, least(p + 1, n) AS p, CASE WHEN p < n THEN list_append(held, p + 1) ELSE held END AS h, step, p < n AND NOT second AND len(held) + 1 < {BUFFER.full} AS wait, p >= n AS drained
      FROM g JOIN n USING (worker) WHERE p < n OR len(held) > 0)))
SELECT CAST(g.worker AS INT) AS worker, g.step - 1 AS step, r.o_orderkey FROM g JOIN r ON r.worker = g.worker AND r.i = g.given
"""


@query("flow2_buffered", BUFFERED)
def _(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("shard"))
    return shuffled_shards(orders, "shard", "o_orderkey", BUFFER).select("worker", "step", "o_orderkey")


@query(
    "flow2_shuffle_order",
    "SELECT o_orderkey, row_number() OVER (ORDER BY md5('4:' || o_orderkey), o_orderkey) - 1 AS place FROM orders",
)
def _(spark, sf):
    """The whole table's order, as a column: shards of one row, and workers that hold nothing back."""
    from loomset.operators.ranking import positioned

    orders = t(spark, sf, "orders").select("o_orderkey", F.md5(F.concat(F.lit("4:"), F.col("o_orderkey"))).alias("random"))
    return positioned(orders, ["random", "o_orderkey"], "place").select("o_orderkey", F.col("place").cast("long"))


THROTTLE = """WITH RECURSIVE e AS (SELECT {key} AS user_id, ts, event_id, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, ts AS last, event_id, true AS run FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN e.ts >= r.last + INTERVAL {every} THEN e.ts ELSE r.last END, e.event_id, e.ts >= r.last + INTERVAL {every} FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, user_id FROM r WHERE run"""


@query("win3_throttled_events", THROTTLE.format(key="user_id", every="1 HOUR"))
def _(spark, sf):
    return throttled(t(spark, sf, "events"), "user_id", "ts", "event_id", 3600).select("event_id", "user_id")


@query("win3_hot_key", THROTTLE.format(key="CASE WHEN user_id % 3 > 0 THEN 0 ELSE user_id END", every="10 MINUTE"))
def _(spark, sf):
    """Two thirds of all events are of one key."""
    hot = F.when(F.col("user_id") % 3 > 0, 0).otherwise(F.col("user_id"))
    return throttled(t(spark, sf, "events").withColumn("user_id", hot), "user_id", "ts", "event_id", 600).select("event_id", "user_id")
