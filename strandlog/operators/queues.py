"""First-in-first-out queues as one message table: (queue, msg_id, body, expires_at_ms).

Message ids sort in order of arrival.  Expired messages are never delivered and don't count.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_POP = 1000


def check_queue_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", name):
        raise ValueError(f"not a queue name: {name!r}")
    return name


def pending(messages: DataFrame, now_ms: int) -> DataFrame:
    at = F.coalesce(F.col("expires_at_ms"), F.lit(0))
    return messages.where((at == 0) | (at > now_ms))


def pop(messages: DataFrame, count: int, now_ms: int) -> DataFrame:
    """The first `count` (1000 at most) messages of each queue with their `place` from 1.

    The rank limit is applied before the shuffle as well, so a queue of any length sends few rows.
    """
    w = Window.partitionBy("queue").orderBy("msg_id")
    return pending(messages, now_ms).withColumn("place", F.row_number().over(w)).where(F.col("place") <= min(count, MAX_POP))


def without(messages: DataFrame, taken: DataFrame) -> DataFrame:
    return messages.join(taken.select("queue", "msg_id"), ["queue", "msg_id"], "left_anti")


def deliver(messages: DataFrame, pops: DataFrame, now_ms: int) -> DataFrame:
    """Replay pops (queue, n) against a fixed backlog: per queue the first sum of n messages."""
    wanted = pops.groupBy("queue").agg(F.sum(F.least("n", F.lit(MAX_POP))).alias("wanted"))
    w = Window.partitionBy("queue").orderBy("msg_id")
    ranked = pending(messages, now_ms).withColumn("place", F.row_number().over(w))
    return ranked.join(wanted, "queue").where("place <= wanted").drop("wanted")


def length(messages: DataFrame, now_ms: int) -> DataFrame:
    return pending(messages, now_ms).groupBy("queue").agg(F.count("*").alias("n"))


def queues(messages: DataFrame) -> DataFrame:
    return messages.select("queue").distinct()
