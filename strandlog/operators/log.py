"""State, history and merging of the revision log.

    log(ns, key_i, key_s, rev struct<ts_ms, cluster, process, seq>, op, value, obj_hash, obj_size, expires_at_ms)

`op` is 'data', 'null' or 'tombstone'; `expires_at_ms` is 0 for never; exactly one of key_i and key_s is set.  Time is
always an argument.  A revision that expires at or before `now_ms` counts as deleted.  The newest revision of a key
decides alone: if it is dead, older ones don't come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["ns", "key_i", "key_s"]
REVISION = T.StructType(
    [T.StructField("ts_ms", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("process", T.IntegerType()), T.StructField("seq", T.LongType())]
)
SCHEMA = T.StructType([
    T.StructField("ns", T.StringType()), T.StructField("key_i", T.LongType()), T.StructField("key_s", T.StringType()),
    T.StructField("rev", REVISION), T.StructField("op", T.StringType()), T.StructField("value", T.BinaryType()),
    T.StructField("obj_hash", T.StringType()), T.StructField("obj_size", T.LongType()), T.StructField("expires_at_ms", T.LongType()),
])

def revision(ts_ms: Column, seq: Column, cluster: Column | int = 0, process: Column | int = 0) -> Column:
    as_col = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        ts_ms.cast("bigint").alias("ts_ms"), as_col(cluster, "int").alias("cluster"), as_col(process, "int").alias("process"), seq.cast("bigint").alias("seq")
    )


def key_order(descending: bool = False) -> list[Column]:
    kind, number, text = F.col("key_s").isNotNull(), F.col("key_i"), F.col("key_s")
    return [kind.desc(), number.desc(), text.desc()] if descending else [kind.asc(), number.asc(), text.asc()]


def expired(now_ms: int | Column) -> Column:
    at = F.coalesce(F.col("expires_at_ms"), F.lit(0))
    return (at != 0) & (at <= now_ms)


def dead(now_ms: int | Column) -> Column:
    return (F.col("op") == "tombstone") | expired(now_ms)


def latest(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest revision of each key, whatever it is.  An aggregate: keys with very many revisions shrink before the shuffle."""
    keys = keys or KEY
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "rev").alias("_r"))
    return picked.select(*keys, "_r.*").select(log.columns)


def live(log: DataFrame, now_ms: int, keys: list[str] | None = None) -> DataFrame:
    """Keys that exist at `now_ms` with their value: rank first, then drop the dead."""
    return latest(log, keys).where(~dead(now_ms))


def live_keys(log: DataFrame, now_ms: int, keys: list[str] | None = None) -> DataFrame:
    """Live keys without their values: what scans and counts need, so values are never read."""
    return live(log.select(*(keys or KEY), "rev", "op", "expires_at_ms"), now_ms, keys)


def as_of(log: DataFrame, ts_ms: int, keys: list[str] | None = None, now_ms: int | None = None) -> DataFrame:
    """The live view as it was at `ts_ms`."""
    return live(log.where(F.col("rev.ts_ms") <= ts_ms), ts_ms if now_ms is None else now_ms, keys)


def history(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All revisions with `index`, 0 for the oldest."""
    w = Window.partitionBy(*(keys or KEY)).orderBy("rev")
    return log.withColumn("index", F.row_number().over(w).cast("bigint") - 1)


def history_range(log: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Revisions made in [from_ms, to_ms]; the bound reaches the scan."""
    return log.where(F.col("rev.ts_ms").between(from_ms, to_ms))


def rev_count(log: DataFrame, now_ms: int, keys: list[str] | None = None) -> DataFrame:
    """Revisions per key, tombstones included, expired ones not."""
    return log.where(~expired(now_ms)).groupBy(*(keys or KEY)).agg(F.count("*").alias("revisions"))


def rev_get(log: DataFrame, index: int, keys: list[str] | None = None) -> DataFrame:
    return history(log, keys).where(F.col("index") == index)


def rev_get_with_ttl(log: DataFrame, index: int, now_ms: int, keys: list[str] | None = None) -> DataFrame:
    """As `rev_get`, with `is_expired` and `remaining_ms` (null without expiry, 0 when over)."""
    found = rev_get(log, index, keys)
    left = F.greatest(F.col("expires_at_ms") - now_ms, F.lit(0))
    return found.withColumn("is_expired", expired(now_ms)).withColumn("remaining_ms", F.when(F.col("expires_at_ms") != 0, left))


def ttl(log: DataFrame, now_ms: int, keys: list[str] | None = None) -> DataFrame:
    """Remaining time of each live key, null for no expiry."""
    return live(log, now_ms, keys).withColumn("remaining_ms", F.when(F.col("expires_at_ms") != 0, F.col("expires_at_ms") - now_ms))


# ---- writes as rows


def tombstones(keys: DataFrame, rev: Column) -> DataFrame:
    """Delete markers for the given keys; a key need not exist."""
    return keys.select(
        *KEY, rev.alias("rev"), F.lit("tombstone").alias("op"), F.lit(None).cast("binary").alias("value"), F.lit(None).cast("string").alias("obj_hash"),
        F.lit(None).cast("bigint").alias("obj_size"), F.lit(0).cast("bigint").alias("expires_at_ms"),
    )


def batch(ops: DataFrame, ts_ms: int, first_seq: int = 0, cluster: int = 0, process: int = 0) -> DataFrame:
    """One row per operation of an ordered array `ops` of (op, key_i, key_s, value, expires_at_ms), with increasing revisions."""
    flat = ops.select("ns", F.posexplode("ops").alias("nth", "o"))
    return flat.select(
        "ns", "o.key_i", "o.key_s", revision(F.lit(ts_ms), F.col("nth") + first_seq, cluster, process).alias("rev"), "o.op",
        F.when(F.col("o.op") == "data", F.col("o.value")).alias("value"), F.lit(None).cast("string").alias("obj_hash"),
        F.lit(None).cast("bigint").alias("obj_size"), F.coalesce("o.expires_at_ms", F.lit(0)).alias("expires_at_ms"),
    )


def widen_keys(log: DataFrame) -> DataFrame:
    """Where a namespace has a text key, all its integer keys become text."""
    mixed = log.groupBy("ns").agg(F.max(F.col("key_s").isNotNull()).alias("_text"))
    met = log.join(mixed, "ns")
    text = F.when(F.col("_text"), F.coalesce("key_s", F.col("key_i").cast("string")))
    return met.withColumns({"key_s": text, "key_i": F.when(~F.col("_text"), F.col("key_i"))}).select(log.columns)


def dedup_writes(log: DataFrame, keys: list[str] | None = None, enabled: Column | None = None) -> DataFrame:
    """Drop puts that repeat the value just before them, if neither has an expiry; tombstones block this."""
    return mark_repeats(log, keys, enabled).where(~F.col("skipped")).drop("checked", "skipped")


def mark_repeats(log: DataFrame, keys: list[str] | None = None, enabled: Column | None = None) -> DataFrame:
    """`checked`: puts that could repeat; `skipped`: those that do.

    In a run of equal values comparing with the row before is the same as comparing with the last one kept; a put with an
    expiry is always kept and stands between.
    """
    w = Window.partitionBy(*(keys or KEY)).orderBy("rev")
    no_ttl = F.coalesce(F.col("expires_at_ms"), F.lit(0)) == 0
    on = F.lit(True) if enabled is None else enabled
    checked = on & F.col("op").isin("data", "null") & no_ttl
    same = (F.lag("op").over(w) == F.col("op")) & (F.coalesce(F.lag("expires_at_ms").over(w), F.lit(0)) == 0)
    same = same & F.lag("value").over(w).eqNullSafe(F.col("value")) & F.lag("obj_hash").over(w).eqNullSafe(F.col("obj_hash"))
    return log.withColumn("checked", checked).withColumn("skipped", checked & F.coalesce(same, F.lit(False)))


def dedup_scope(op: Column, namespace: Column, everywhere: bool) -> Column:
    """The nearest setting counts: the operation's, the namespace's, the global one."""
    return F.coalesce(op, namespace, F.lit(everywhere))


# ---- maintenance


def compact(log: DataFrame, now_ms: int, keys: list[str] | None = None, bottom: bool = True) -> DataFrame:
    """Drop dead revisions; at the bottom level drop the whole history of keys whose newest revision is dead."""
    gone = dead(now_ms)
    if bottom:
        w = Window.partitionBy(*(keys or KEY)).orderBy(F.desc("rev"))
        return log.withColumn("_dead", gone).withColumn("_over", F.first("_dead").over(w)).where("NOT _over AND NOT _dead").drop("_dead", "_over")
    return log.where(~gone)


def compact_before(log: DataFrame, cut_ms: int, keys: list[str] | None = None) -> DataFrame:
    """Forget history before `cut_ms` but for what was newest then."""
    old = F.col("rev.ts_ms") < cut_ms
    w = Window.partitionBy(*(keys or KEY), "_old").orderBy(F.desc("rev"))
    return log.withColumn("_old", old).withColumn("_rn", F.row_number().over(w)).where("NOT _old OR _rn = 1").drop("_old", "_rn")


def forget_expired(log: DataFrame, now_ms: int, keys: list[str] | None = None) -> DataFrame:
    """Expiry erases history: keys whose newest revision has expired lose all revisions."""
    keys = keys or KEY
    over = latest(log, keys).where(expired(now_ms)).select(*keys)
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return log.alias("l").join(over.alias("r"), on, "left_anti")


def dump(log: DataFrame, now_ms: int, after: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """The newest live row per key, without history and expiry; only those newer than `after` if given."""
    out = live(log, now_ms, keys)
    if after is not None:
        out = out.where(F.col("rev") > after)
    return out.withColumn("expires_at_ms", F.lit(0).cast("bigint"))


def after_revision(log: DataFrame, rev: Column) -> DataFrame:
    """Records of an incremental feed: strictly newer than the checkpoint."""
    return log.where(F.col("rev") > rev)


def stats(log: DataFrame, now_ms: int) -> DataFrame:
    """Per namespace: revisions by kind, keys, live keys, bytes, newest revision time."""
    kinds = log.groupBy("ns").agg(
        F.count("*").alias("revisions"), F.count_if(F.col("op") != "tombstone").alias("puts"), F.count_if(F.col("op") == "tombstone").alias("deletes"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"), F.max("rev.ts_ms").alias("last_ts_ms"),
    )
    keys = latest(log).groupBy("ns").agg(F.count("*").alias("keys"), F.count_if(~dead(now_ms)).alias("live_keys"))
    return kinds.join(keys, "ns")


def prometheus(stats_rows: list, prefix: str = "strandlog") -> str:
    """Text exposition of rows of `stats`, which are one per namespace."""
    out = []
    for name in ("revisions", "puts", "deletes", "bytes", "keys", "live_keys"):
        out.append(f"# TYPE {prefix}_{name} gauge")
        out += [f'{prefix}_{name}{{ns="{r.ns}"}} {r[name]}' for r in stats_rows]
    return "\n".join(out) + "\n"


#: Upper bounds of the latency histogram in microseconds: 10 us to 60 s.
LATENCY_US = [10, 50, 100, 500, 1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000, 60_000_000]


def latency_histogram(samples: DataFrame, column: str = "us") -> DataFrame:
    """(le, n): cumulative counts per bound; the last bound is infinite (null)."""
    place = F.lit(len(LATENCY_US))
    for i in range(len(LATENCY_US) - 1, -1, -1):
        place = F.when(F.col(column) <= LATENCY_US[i], i).otherwise(place)
    counts = samples.groupBy(place.alias("place")).agg(F.count("*").alias("c"))
    bounds = samples.sparkSession.createDataFrame([(i, b) for i, b in enumerate([*LATENCY_US, None])], "i int, le bigint")
    met = bounds.join(counts, F.col("place") <= F.col("i"), "left")
    return met.groupBy("i", "le").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).orderBy("i").drop("i")


# ---- replication


def last_writer_wins(logs: DataFrame, now_ms: int | None = None, own_cluster: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Newest revision per key over all peers' records; the order of arrival doesn't matter.

    Records that come back from `own_cluster` are dropped as loops, expired ones before they can win, and those that
    only create a namespace (empty text key, null value) aren't data.
    """
    if own_cluster is not None:
        logs = logs.where(F.col("rev.cluster") != own_cluster)
    if now_ms is not None:
        logs = logs.where(~expired(now_ms))
    return latest(logs.where(~namespace_sentinel()), keys)


def namespace_sentinel() -> Column:
    return F.coalesce((F.col("key_s") == "") & (F.col("op") == "null"), F.lit(False))


def conflicts(arrivals: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """Per key how many records came after a newer one; `order` is the arrival.

    Of records that arrive together none came after another: they are taken oldest first, whatever order they are read in.
    """
    w = Window.partitionBy(*(keys or KEY)).orderBy(order, "rev").rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.col("rev") <= F.max("rev").over(w), F.lit(False))
    return arrivals.withColumn("_late", late).groupBy(*(keys or KEY)).agg(F.count_if("_late").alias("rejected"))


def routes(namespaces: DataFrame, table: DataFrame, default: str) -> DataFrame:
    """(ns, shard): the routing table's entry or the default group.  A routing table lists namespaces, so it stays small;
    the optimizer broadcasts it by its measured size."""
    return namespaces.join(table, "ns", "left").select("ns", F.coalesce("shard", F.lit(default)).alias("shard"))


def owned(log: DataFrame, namespaces: list[str]) -> DataFrame:
    """Rows of owned namespaces; an empty list owns all."""
    return log.where(F.col("ns").isin(namespaces)) if namespaces else log
