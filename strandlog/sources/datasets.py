"""The driver's tables seen as a revision log, a queue and a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators.graph import Graph, Link
from strandlog.operators.log import SCHEMA, revision

#: All queries take this as the present, 2024-01-20 00:00 UTC; views of events live for an hour.
NOW_MS = 1_705_708_800_000
HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(ts: str = "ts") -> Column:
    """Epoch milliseconds of a timestamp without zone, read as UTC whatever the session's zone is."""
    seconds = f"CAST(floor(extract(SECOND FROM {ts}) * 1000) AS BIGINT)"
    return F.expr(f"unix_date(CAST({ts} AS DATE)) * 86400000L + hour({ts}) * 3600000L + minute({ts}) * 60000L + {seconds}")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key: user; revision: event; `error` deletes, `view` expires after an hour."""
    return as_event_log(table(spark, sf_dir, "events"))


def as_event_log(e: DataFrame, value: Column | None = None) -> DataFrame:
    """Events, a table or a stream of them, as log rows."""
    ts = _ms()
    return e.select(
        F.lit("events").alias("ns"), F.col("user_id").cast("bigint").alias("key_i"), F.lit(None).cast("string").alias("key_s"),
        revision(ts, F.col("event_id")).alias("rev"), F.when(F.col("event_type") == "error", "tombstone").otherwise("data").alias("op"),
        F.when(F.col("event_type") != "error", (F.col("value") if value is None else value).cast("string").cast("binary")).alias("value"),
        F.lit(None).cast("string").alias("obj_hash"), F.lit(None).cast("bigint").alias("obj_size"),
        F.when(F.col("event_type") == "view", ts + HOUR_MS).otherwise(F.lit(0)).cast("bigint").alias("expires_at_ms"),
    )


def text_key_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events by type as namespace and `u<user>` as key."""
    e = table(spark, sf_dir, "events")
    ts = _ms()
    return e.select(
        F.col("event_type").alias("ns"), F.lit(None).cast("bigint").alias("key_i"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key_s"),
        revision(ts, F.col("event_id")).alias("rev"), F.when(F.col("event_id") % 7 == 0, "tombstone").otherwise("data").alias("op"),
        F.when(F.col("event_id") % 7 != 0, F.col("props").cast("binary")).alias("value"), F.lit(None).cast("string").alias("obj_hash"),
        F.lit(None).cast("bigint").alias("obj_size"), F.lit(0).cast("bigint").alias("expires_at_ms"),
    )


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespace: language; key: document; value: its text.  Every eleventh document is written and then deleted."""
    d = table(spark, sf_dir, "documents")
    base = d.select(
        F.col("lang").alias("ns"), F.col("doc_id").alias("key_i"), F.lit(None).cast("string").alias("key_s"), revision(F.lit(0), F.col("doc_id")).alias("rev"),
        F.lit("data").alias("op"), F.col("text").cast("binary").alias("value"), F.lit(None).cast("string").alias("obj_hash"),
        F.lit(None).cast("bigint").alias("obj_size"), F.lit(0).cast("bigint").alias("expires_at_ms"),
    )
    gone = base.where("key_i % 11 = 0").withColumns({"op": F.lit("tombstone"), "value": F.lit(None).cast("binary"), "rev": revision(F.lit(1), F.col("key_i"))})
    return base.unionByName(gone)


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue: event type; every event is a message; those of `view` expire after an hour."""
    return as_messages(table(spark, sf_dir, "events"))


def as_messages(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_type").alias("queue"), F.lpad(F.col("event_id").cast("string"), 26, "0").alias("msg_id"), F.col("props").alias("body"),
        F.when(F.col("event_type") == "view", _ms() + HOUR_MS).otherwise(F.lit(0)).cast("bigint").alias("expires_at_ms"),
    )


def commerce_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes: region, nation, customer, supplier, part, orders; links along their keys; order lines are summed per pair."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda c: F.col(c).cast("string")
    g = Graph(spark)
    g.create_table("region", t("region").select(key("r_regionkey").alias("key"), F.col("r_name").alias("name")))
    g.create_table("nation", t("nation").select(key("n_nationkey").alias("key"), F.col("n_name").alias("name")))
    g.create_table("customer", t("customer").select(key("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")))
    g.create_table("supplier", t("supplier").select(key("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")))
    g.create_table("part", t("part").select(key("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("bigint").alias("size"), F.col("p_retailprice").alias("price")))
    g.create_table("orders", t("orders").select(key("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority")))

    def link(name: str, source: str, target: str, rows: DataFrame, bidirectional: bool = False, cascade: bool = False) -> None:
        g.create_link(name, Link(source, target, rows, bidirectional, cascade))

    link("in-region", "nation", "region", t("nation").select(key("n_nationkey").alias("src"), key("n_regionkey").alias("dst")))
    link("customer-of", "customer", "nation", t("customer").select(key("c_custkey").alias("src"), key("c_nationkey").alias("dst")), cascade=True)
    link("supplier-of", "supplier", "nation", t("supplier").select(key("s_suppkey").alias("src"), key("s_nationkey").alias("dst")), bidirectional=True)
    link("placed-by", "orders", "customer", t("orders").select(key("o_orderkey").alias("src"), key("o_custkey").alias("dst"), F.col("o_totalprice").alias("total")), cascade=True)
    lines = t("lineitem").groupBy(key("l_orderkey").alias("src"), key("l_partkey").alias("dst")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    link("contains", "orders", "part", lines)
    supplied = t("lineitem").select(key("l_partkey").alias("src"), key("l_suppkey").alias("dst")).distinct()
    link("supplied-by", "part", "supplier", supplied)
    return g
