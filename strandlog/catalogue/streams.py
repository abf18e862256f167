"""The same answers from streams: the events are read as a file stream, processed to the end, and the result is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.catalogue.kv import _DEDUP, EVENTS, LIVE
from strandlog.catalogue.queueing import MESSAGES
from strandlog.catalogue.registry import query
from strandlog.operators import log as L
from strandlog.sources import datasets as D
from strandlog.sources.datasets import NOW_MS
from strandlog.sources.shared import ensure_checkpoint_dir
from strandlog.streaming import feeds as S


def _events(spark, d) -> DataFrame:
    schema = D.table(spark, d, "events").schema
    # a pattern, since a plain path would have to be a folder and the table may be one file
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")


def _through(spark, stream: DataFrame, mode: str, work=None) -> DataFrame:
    """Run the stream to its end; each micro-batch is one folder of the result, so that a batch that runs again replaces itself."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    S.run_once(stream, f"{root}/state", mode, work(put) if work else put)
    return spark.read.parquet(f"{root}/out")


@query("stream_newest", f"WITH {LIVE} SELECT k, event_id, value FROM live")
def stream_newest(spark, d):
    """Last writer per key as a streaming aggregate; the last update of each key counts."""
    updates = _through(spark, S.newest(D.as_event_log(_events(spark, d))), "update").drop("batch")
    live = L.latest(updates).where(~L.dead(NOW_MS))
    return live.select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"), F.col("value").cast("string").cast("double").alias("value"))


@query("stream_dedup", f"WITH {_DEDUP} SELECT k, event_id FROM m WHERE NOT skipped AND event_id NOT IN (SELECT event_id FROM q WHERE tomb)")
def stream_dedup(spark, d):
    """Repeated puts dropped by a stateful operator; tombstones only separate."""
    events = _events(spark, d)
    log = D.as_event_log(events.withColumn("value", F.lit(0.0)), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("c"))
    kept = _through(spark, S.without_repeats(log), "append")
    return kept.where("value IS NOT NULL").select(F.col("key").cast("bigint").alias("k"), F.col("seq").alias("event_id"))


@query("stream_windows", f"WITH {EVENTS} SELECT event_type, ts_ms // 86400000 AS day, count(*) AS n FROM e GROUP BY ALL")
def stream_windows(spark, d):
    """Counts per day and kind; update mode gives the whole state once."""
    counted = _through(spark, S.event_windows(_events(spark, d), size="1 day"), "update")
    newest = counted.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return newest.select("event_type", F.expr("unix_date(CAST(start AS DATE))").cast("bigint").alias("day"), "n")


@query("stream_delivery", f"WITH {MESSAGES} SELECT queue, msg_id FROM live WHERE place <= 5")
def stream_delivery(spark, d):
    """The first messages of each queue in a micro-batch."""
    feed = D.as_messages(_events(spark, d))
    return _through(spark, feed, "append", lambda put: S.deliver(spark, feed, 5, NOW_MS, put)).select("queue", "msg_id")
