"""Queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlog.catalogue.registry import query
from strandlog.operators import queues as Q
from strandlog.sources import datasets as D
from strandlog.sources.datasets import NOW_MS

MESSAGES = f"""m AS (SELECT event_type AS queue, lpad(event_id::VARCHAR, 26, '0') AS msg_id, props AS body,
  CASE WHEN event_type = 'view' THEN (epoch_us(ts) // 1000) + 3600000 ELSE 0 END AS exp FROM events),
  live AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY msg_id) AS place FROM m WHERE exp = 0 OR exp > {NOW_MS})"""


@query("queue_live", f"WITH {MESSAGES} SELECT queue, msg_id, body FROM live")
def queue_live(spark, d):
    return Q.pending(D.messages(spark, d), NOW_MS).select("queue", "msg_id", "body")


@query("queue_pop", f"WITH {MESSAGES} SELECT queue, msg_id, body FROM live WHERE place = 1")
def queue_pop(spark, d):
    return Q.pop(D.messages(spark, d), 1, NOW_MS).select("queue", "msg_id", "body")


@query("queue_pop_n", f"WITH {MESSAGES} SELECT queue, msg_id, body, place FROM live WHERE place <= 3")
def queue_pop_n(spark, d):
    return Q.pop(D.messages(spark, d), 3, NOW_MS).select("queue", "msg_id", "body", F.col("place").cast("bigint"))


@query("queue_pop_cap", f"WITH {MESSAGES} SELECT queue, count(*) AS n FROM live WHERE place <= 1000 GROUP BY queue")
def queue_pop_cap(spark, d):
    """One call delivers 1000 messages at most: that is the operator's own limit."""
    return Q.pop(D.messages(spark, d), 5000, NOW_MS).groupBy("queue").agg(F.count("*").alias("n"))


@query("queue_after_pop", f"WITH {MESSAGES} SELECT queue, count(*) AS n FROM live WHERE place > 3 GROUP BY queue")
def queue_after_pop(spark, d):
    rows = D.messages(spark, d)
    return Q.length(Q.without(rows, Q.pop(rows, 3, NOW_MS)), NOW_MS)


@query("queue_deliver", f"""WITH {MESSAGES}, w AS (SELECT event_type AS queue, sum(least(event_id % 3, 1000)) AS wanted FROM events WHERE event_id % 50 = 0 GROUP BY 1)
  SELECT queue, msg_id FROM live JOIN w USING (queue) WHERE place <= wanted""")
def queue_deliver(spark, d):
    """A series of pops of different sizes, answered in one pass."""
    pops = D.table(spark, d, "events").where("event_id % 50 = 0").select(F.col("event_type").alias("queue"), (F.col("event_id") % 3).alias("n"))
    return Q.deliver(D.messages(spark, d), pops, NOW_MS).select("queue", "msg_id")


@query("queue_len", f"WITH {MESSAGES} SELECT queue, count(*) AS n FROM live GROUP BY queue")
def queue_len(spark, d):
    return Q.length(D.messages(spark, d), NOW_MS)


@query("queue_list", "SELECT DISTINCT event_type AS queue FROM events")
def queue_list(spark, d):
    return Q.queues(D.messages(spark, d))
