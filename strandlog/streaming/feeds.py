"""Streams over the log: change feed, last-writer-wins state, de-duplicated writes, queue delivery.

Sources are folders of Parquet files in the log's schema; with `availableNow` a stream reads what is there and stops, and its
checkpoint makes the next run go on from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlog.operators import log as L
from strandlog.operators import queues as Q
from strandlog.sources.shared import ensure_checkpoint_dir
from strandlog.sources.store import Files


def changes(spark: SparkSession, path: str, schema: T.StructType = L.SCHEMA) -> DataFrame:
    """Every revision as it is committed."""
    return spark.readStream.schema(schema).parquet(path)


def newest(feed: DataFrame, now_ms: int | None = None, own_cluster: int | None = None) -> DataFrame:
    """Last writer per key, as a streaming aggregate (update or complete mode); late, older records change nothing."""
    if own_cluster is not None:
        feed = feed.where(F.col("rev.cluster") != own_cluster)
    if now_ms is not None:
        feed = feed.where(~L.expired(now_ms))
    feed = feed.where(~L.namespace_sentinel())
    rest = [c for c in L.SCHEMA.names if c not in L.KEY]
    picked = feed.groupBy(*L.KEY).agg(F.max_by(F.struct(*rest), "rev").alias("_r"))
    return picked.select(*L.KEY, "_r.*")


_KEPT = T.StructType([T.StructField("ns", T.StringType()), T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("value", T.StringType())])
_STATE = "seq long, op string, value string, ttl boolean"


def without_repeats(feed: DataFrame) -> DataFrame:
    """Puts that repeat the value before them are dropped on the fly: (ns, key, seq, value).

    Per key the state is its last write; a write with an expiry and a tombstone both stand between equal values.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        last: Any = state.get if state.exists else (-1, "", "", True)
        out = []
        for r in rows.itertuples(index=False):
            now = (int(r.seq), r.op, r.value if r.value is not None else "", bool(r.ttl))
            if now[0] <= last[0]:
                continue
            if not (now[1] != "tombstone" and now[1:] == last[1:] and not now[3]):
                out.append((key[0], key[1], now[0], r.value))
            last = now
        state.update(last)
        yield pd.DataFrame(out, columns=_KEPT.names)

    flat = feed.select(
        "ns", F.coalesce("key_s", F.col("key_i").cast("string")).alias("key"), F.col("rev.seq").alias("seq"), "op", F.col("value").cast("string").alias("value"),
        (F.coalesce("expires_at_ms", F.lit(0)) != 0).alias("ttl"),
    )
    return flat.groupBy("ns", "key").applyInPandasWithState(step, _KEPT, _STATE, "append", GroupStateTimeout.NoTimeout)


def deliver(
    spark: SparkSession, messages: DataFrame, count: int, now_ms: int, sink: Callable[[DataFrame, int], None], backlog: str | None = None
) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: with each micro-batch the first `count` live messages per queue go to the sink.

    What isn't delivered waits in the folder `backlog` and comes before later messages by its id.  The folder belongs to the
    stream's checkpoint; without one the backlog lasts as long as the returned function.  Each batch writes
    the messages that are left as a table of its own number, so a batch that runs again finds what it found before.
    """
    root = backlog or f"{ensure_checkpoint_dir(spark)}/backlog-{uuid.uuid4().hex}"

    def table(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    def each(batch: DataFrame, number: int) -> None:
        files = Files(spark, root)
        earlier = [n for n in (int(f.removeprefix("left=")) for f in files.names("") if f.startswith("left=")) if n < number]
        waiting = Q.pending(batch, now_ms)
        if earlier:
            held = spark.read.schema(batch.schema).parquet(f"{root}/left={max(earlier)}")
            waiting = Q.pending(held, now_ms).unionByName(waiting)
        taken = table(Q.pop(waiting, count, now_ms), f"taken={number}")
        table(Q.without(waiting, taken).select(batch.columns), f"left={number}")
        sink(taken, number)
        for n in earlier:
            files.delete(f"taken={n}")
            if n < max(earlier):
                files.delete(f"left={n}")

    return each


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per hour and kind with a bound for late events."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_once(stream: DataFrame, checkpoint: str, mode: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is there, wait, and leave the checkpoint for the next run."""
    started = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    started.awaitTermination()
    return started
