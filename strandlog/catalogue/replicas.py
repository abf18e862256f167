"""Replication and sharding queries: three peers take turns in writing the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.catalogue.registry import query
from strandlog.operators import log as L
from strandlog.sources import datasets as D
from strandlog.sources.datasets import NOW_MS

PEERS = """p AS (SELECT user_id AS k, event_id, event_id % 3 AS cluster, value, (event_id * 7919) % 10007 AS arrival, event_type = 'error' AS del,
  CASE WHEN event_type = 'view' THEN (epoch_us(ts) // 1000) + 3600000 ELSE 0 END AS exp FROM events)"""


def _peers(spark, d) -> DataFrame:
    """Revisions carry their peer; time and sequence order them before the peer does, so newest means latest event."""
    log = D.event_log(spark, d)
    rev = L.revision(F.col("rev.seq"), F.col("rev.seq"), F.col("rev.seq") % 3)
    return log.withColumn("rev", rev).withColumn("arrival", (F.col("rev.seq") * 7919) % 10007)


@query("lww_merge", f"WITH {PEERS} SELECT k, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM p WHERE NOT del GROUP BY k")
def lww_merge(spark, d):
    merged = L.last_writer_wins(_peers(spark, d).where("op = 'data'"))
    return merged.select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"), F.col("value").cast("string").cast("double").alias("value"))


@query("lww_merge_live", f"""WITH {PEERS}, w AS (SELECT * FROM p WHERE exp = 0 OR exp > {NOW_MS} QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
  SELECT k, event_id FROM w WHERE NOT del""")
def lww_merge_live(spark, d):
    """Expired records are skipped before they can win; a winning tombstone still deletes."""
    merged = L.last_writer_wins(_peers(spark, d), now_ms=NOW_MS).where("op <> 'tombstone'")
    return merged.select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"))


@query("lww_loop", f"WITH {PEERS} SELECT k, max(event_id) AS event_id FROM p WHERE cluster <> 1 GROUP BY k")
def lww_loop(spark, d):
    """What peer 1 takes from the others: its own records come back and are dropped."""
    merged = L.last_writer_wins(_peers(spark, d), own_cluster=1)
    return merged.select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"))


@query("lww_conflicts", f"""WITH {PEERS} SELECT k, count(*) FILTER (event_id <= best) AS rejected FROM
  (SELECT *, max(event_id) OVER (PARTITION BY k ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p) GROUP BY k""")
def lww_conflicts(spark, d):
    return L.conflicts(_peers(spark, d), "arrival").select(F.col("key_i").alias("k"), "rejected")


@query("feed_incremental", f"WITH {PEERS} SELECT cluster, count(*) AS n FROM p WHERE event_id > 500 GROUP BY cluster")
def feed_incremental(spark, d):
    """Records after a checkpoint, per peer."""
    rows = L.after_revision(_peers(spark, d), L.revision(F.lit(500), F.lit(1 << 40), 9))
    return rows.groupBy(F.col("rev.cluster").cast("bigint").alias("cluster")).agg(F.count("*").alias("n"))


@query("route_lookup", "SELECT DISTINCT event_type AS ns, CASE event_type WHEN 'click' THEN 'blue' WHEN 'view' THEN 'green' ELSE 'main' END AS shard FROM events")
def route_lookup(spark, d):
    table = spark.createDataFrame([("click", "blue"), ("view", "green")], "ns string, shard string")
    return L.routes(D.text_key_log(spark, d).select("ns").distinct(), table, "main")


@query("shard_owned", "SELECT event_type AS ns, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def shard_owned(spark, d):
    return L.owned(D.text_key_log(spark, d), ["click", "error"]).groupBy("ns").agg(F.count("*").alias("n"))
