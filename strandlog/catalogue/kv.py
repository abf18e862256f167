"""Key-value queries: state, scans, history, expiry, de-duplication, maintenance, objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.catalogue.registry import query
from strandlog.functions import scalars as S
from strandlog.operators import log as L
from strandlog.operators import scan as SC
from strandlog.operators import values as V
from strandlog.sources import datasets as D
from strandlog.sources.datasets import NOW_MS

EVENTS = """e AS (SELECT user_id AS k, event_id, event_type, value, (epoch_us(ts) // 1000) AS ts_ms, event_type = 'error' AS del,
  CASE WHEN event_type = 'view' THEN (epoch_us(ts) // 1000) + 3600000 ELSE 0 END AS exp FROM events)"""
NEWEST = EVENTS + ", n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)"
LIVE = NEWEST + f", live AS (SELECT * FROM n WHERE NOT del AND (exp = 0 OR exp > {NOW_MS}))"
#: Text keys: namespace is the event type, every seventh event deletes.
TEXT = """t AS (SELECT event_type AS ns, 'u' || user_id AS k, event_id, event_id % 7 = 0 AS del, props FROM events),
  tn AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY ns, k ORDER BY event_id DESC) = 1)"""


def _value():
    return F.col("value").cast("string").cast("double").alias("value")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"), _value())


def _view(spark, d) -> DataFrame:
    return L.live(D.event_log(spark, d), NOW_MS)


def _text_view(spark, d, ns: str | None = None) -> DataFrame:
    log = D.text_key_log(spark, d)
    return L.live(log if ns is None else log.where(F.col("ns") == ns), NOW_MS)


@query("kv_live", f"WITH {LIVE} SELECT k, event_id, value FROM live")
def kv_live(spark, d):
    return _shown(_view(spark, d))


@query("kv_get", f"WITH {LIVE} SELECT k, event_id, value FROM live WHERE k = 7")
def kv_get(spark, d):
    """A get with its revision: the key filter reaches the scan, before the aggregate."""
    return _shown(SC.get(_view(spark, d), 7))


@query("kv_get_many", f"WITH {LIVE} SELECT k, event_id, value FROM live WHERE k IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def kv_get_many(spark, d):
    wanted = D.table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'")
    keys = wanted.select(F.lit("events").alias("ns"), F.col("c_custkey").alias("key_i"), F.lit(None).cast("string").alias("key_s"))
    return _shown(SC.get_many(_view(spark, d), keys))


@query("kv_latest_raw", f"WITH {NEWEST} SELECT k, event_id, CASE WHEN del THEN 'tombstone' ELSE 'data' END AS op FROM n")
def kv_latest_raw(spark, d):
    return L.latest(D.event_log(spark, d)).select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"), "op")


@query("kv_deleted", f"WITH {NEWEST} SELECT k, del AS removed, NOT del AS expired FROM n WHERE del OR (exp <> 0 AND exp <= {NOW_MS})")
def kv_deleted(spark, d):
    gone = L.latest(D.event_log(spark, d)).where(L.dead(NOW_MS))
    return gone.select(F.col("key_i").alias("k"), (F.col("op") == "tombstone").alias("removed"), (F.col("op") != "tombstone").alias("expired"))


@query("kv_exists", f"WITH {LIVE} SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT k FROM live)")
def kv_exists(spark, d):
    live = _view(spark, d).select(F.col("key_i").alias("k"))
    return D.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(live, "k", "left_semi")


@query("kv_scan_prefix", f"WITH {TEXT} SELECT k, event_id FROM tn WHERE ns = 'click' AND NOT del AND k LIKE 'u1%' ORDER BY k LIMIT 20")
def kv_scan_prefix(spark, d):
    rows = SC.scan(_text_view(spark, d, "click"), "u1", 20)
    return rows.select(F.col("key_s").alias("k"), F.col("rev.seq").alias("event_id"))


@query("kv_page", f"WITH {TEXT} SELECT k, event_id FROM tn WHERE ns = 'click' AND NOT del AND k LIKE 'u%' ORDER BY k LIMIT 10 OFFSET 5")
def kv_page(spark, d):
    """Offsets count live rows only."""
    return SC.scan(_text_view(spark, d, "click"), "u", 10, 5).select(F.col("key_s").alias("k"), F.col("rev.seq").alias("event_id"))


@query("kv_rscan_prefix", f"WITH {TEXT} SELECT k, event_id FROM tn WHERE ns = 'view' AND NOT del AND k LIKE 'u%' ORDER BY k DESC LIMIT 15")
def kv_rscan_prefix(spark, d):
    return SC.scan(_text_view(spark, d, "view"), "u", 15, reverse=True).select(F.col("key_s").alias("k"), F.col("rev.seq").alias("event_id"))


@query("kv_scan_range", f"WITH {LIVE} SELECT k, event_id, value FROM live WHERE k >= 10 ORDER BY k LIMIT 25")
def kv_scan_range(spark, d):
    return _shown(SC.scan(_view(spark, d), 10, 25, ordered=True))


@query("kv_rscan_range", f"WITH {LIVE} SELECT k, event_id, value FROM live WHERE k <= 100 ORDER BY k DESC LIMIT 25")
def kv_rscan_range(spark, d):
    return _shown(SC.scan(_view(spark, d), 100, 25, ordered=True, reverse=True))


@query("kv_scan_deleted_too", f"WITH {TEXT} SELECT ns, k, del AS removed FROM tn WHERE k LIKE 'u2%'")
def kv_scan_deleted_too(spark, d):
    rows = SC.deleted_too(D.text_key_log(spark, d)).where(SC.by_prefix("u2", False))
    return rows.select("ns", F.col("key_s").alias("k"), (F.col("op") == "tombstone").alias("removed"))


@query("kv_limit_zero", "SELECT user_id AS k FROM events LIMIT 0")
def kv_limit_zero(spark, d):
    return SC.scan(_view(spark, d), "", 0, ordered=True).select(F.col("key_i").alias("k"))


@query("kv_count", f"WITH {LIVE} SELECT count(*) AS n FROM live")
def kv_count(spark, d):
    return SC.count(_view(spark, d))


@query("kv_count_prefix", f"WITH {TEXT} SELECT count(*) AS n FROM tn WHERE ns = 'purchase' AND NOT del AND k LIKE 'u1%'")
def kv_count_prefix(spark, d):
    return SC.count(_text_view(spark, d, "purchase"), "u1")


@query("kv_entries", f"WITH {TEXT} SELECT ns, k, props AS value FROM tn WHERE NOT del")
def kv_entries(spark, d):
    return _text_view(spark, d).select("ns", F.col("key_s").alias("k"), F.col("value").cast("string").alias("value"))


@query("kv_pop_first", f"WITH {LIVE} SELECT k, event_id, value FROM live ORDER BY k LIMIT 1")
def kv_pop_first(spark, d):
    return _shown(SC.pop_first(_view(spark, d), "", ordered=True))


@query("kv_delete_range", f"WITH {LIVE} SELECT k, 'tombstone' AS op FROM live WHERE k >= 20 AND k < 60")
def kv_delete_range(spark, d):
    rows = SC.delete_range(_view(spark, d), 20, 60, L.revision(F.lit(NOW_MS), F.lit(0)))
    return rows.select(F.col("key_i").alias("k"), "op")


@query("kv_delete_range_count", f"WITH {LIVE} SELECT count(*) AS n FROM live WHERE k BETWEEN 20 AND 60")
def kv_delete_range_count(spark, d):
    return SC.delete_range(_view(spark, d), 20, 60, L.revision(F.lit(NOW_MS), F.lit(0)), inclusive=True).agg(F.count("*").alias("n"))


@query("kv_delete_prefix", f"WITH {TEXT} SELECT ns, count(*) AS n FROM tn WHERE NOT del AND k LIKE 'u3%' GROUP BY ns")
def kv_delete_prefix(spark, d):
    rows = SC.delete_prefix(_text_view(spark, d), "u3", L.revision(F.lit(NOW_MS), F.lit(0)))
    return rows.groupBy("ns").agg(F.count("*").alias("n"))


@query("kv_write_batch", f"""WITH {LIVE}, o AS (SELECT k, value, 'data' AS op FROM live WHERE k % 2 = 0 UNION ALL SELECT k, NULL, 'tombstone' FROM live WHERE k % 2 = 1),
  s AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS seq FROM o) SELECT k, op, seq FROM s""")
def kv_write_batch(spark, d):
    """One ordered batch for the namespace: even keys are put again, odd ones deleted."""
    view = _view(spark, d)
    item = F.struct(
        "key_i", F.when(F.col("key_i") % 2 == 0, "data").otherwise("tombstone").alias("op"), F.lit(None).cast("string").alias("key_s"), "value",
        F.lit(0).cast("bigint").alias("expires_at_ms"),
    )
    ops = view.groupBy("ns").agg(F.sort_array(F.collect_list(item)).alias("ops"))
    return L.batch(ops, NOW_MS).select(F.col("key_i").alias("k"), "op", F.col("rev.seq").alias("seq"))


@query("kv_after_writes", f"WITH {LIVE} SELECT k, event_id, value FROM live WHERE NOT (k >= 20 AND k < 60)")
def kv_after_writes(spark, d):
    """The view of the log with a range delete appended."""
    log = D.event_log(spark, d)
    gone = SC.delete_range(L.live(log, NOW_MS), 20, 60, L.revision(F.lit(NOW_MS * 2), F.lit(0)))
    return _shown(L.live(log.unionByName(gone), NOW_MS))


@query("kv_rev_count", f"WITH {EVENTS} SELECT k, count(*) AS revisions FROM e WHERE exp = 0 OR exp > {NOW_MS} GROUP BY k")
def kv_rev_count(spark, d):
    return L.rev_count(D.event_log(spark, d), NOW_MS).select(F.col("key_i").alias("k"), "revisions")


@query("kv_rev_get", f"WITH {EVENTS} SELECT k, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) - 1 AS i FROM e) WHERE i = 2 AND NOT del")
def kv_rev_get(spark, d):
    return _shown(L.rev_get(D.event_log(spark, d), 2).where("op <> 'tombstone'"))


@query("kv_rev_get_with_ttl", f"""WITH {EVENTS} SELECT k, event_id, exp <> 0 AND exp <= {NOW_MS} AS is_expired, CASE WHEN exp <> 0 THEN greatest(exp - {NOW_MS}, 0) END::VARCHAR AS remaining_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) - 1 AS i FROM e) WHERE i = 5""")
def kv_rev_get_with_ttl(spark, d):
    found = L.rev_get_with_ttl(D.event_log(spark, d), 5, NOW_MS)
    return found.select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"), "is_expired", F.col("remaining_ms").cast("string").alias("remaining_ms"))


@query("kv_history", f"WITH {EVENTS} SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY event_id) - 1 AS i FROM e")
def kv_history(spark, d):
    return L.history(D.event_log(spark, d)).select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"), F.col("index").alias("i"))


@query("kv_ttl", f"WITH {LIVE} SELECT k, CASE WHEN exp <> 0 THEN exp - {NOW_MS} END::VARCHAR AS remaining_ms FROM live")
def kv_ttl(spark, d):
    return L.ttl(D.event_log(spark, d), NOW_MS).select(F.col("key_i").alias("k"), F.col("remaining_ms").cast("string").alias("remaining_ms"))


_DEDUP = EVENTS + """, q AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN event_type WHEN del THEN 'x' ELSE 'c' END AS v, del AS tomb FROM e),
  m AS (SELECT k, event_id, NOT tomb AND exp = 0 AS checked,
    coalesce(NOT tomb AND exp = 0 AND NOT lag(tomb) OVER w AND lag(exp) OVER w = 0 AND lag(v) OVER w = v, false) AS skipped
    FROM q WINDOW w AS (PARTITION BY k ORDER BY event_id))"""


def _repeating(spark, d) -> DataFrame:
    """Values are the kind of event, so that writes repeat."""
    log = D.event_log(spark, d)
    kinds = D.table(spark, d, "events").select(F.col("event_id").alias("_id"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("c").alias("_v"))
    met = log.join(kinds, F.col("rev.seq") == F.col("_id"))
    return met.withColumn("value", F.when(F.col("op") == "data", F.col("_v").cast("binary"))).select(log.columns)


@query("kv_dedup", f"WITH {_DEDUP} SELECT k, event_id FROM m WHERE NOT skipped")
def kv_dedup(spark, d):
    return L.dedup_writes(_repeating(spark, d)).select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"))


@query("kv_dedup_stats", f"WITH {_DEDUP} SELECT count(*) FILTER (checked) AS checks, count(*) FILTER (skipped) AS skips FROM m")
def kv_dedup_stats(spark, d):
    return L.mark_repeats(_repeating(spark, d)).agg(F.count_if("checked").alias("checks"), F.count_if("skipped").alias("skips"))


@query("kv_dedup_scope", f"WITH {_DEDUP} SELECT k, event_id FROM m WHERE NOT (skipped AND k % 3 <> 0)")
def kv_dedup_scope(spark, d):
    """Operations on every third key turn de-duplication off for themselves; the namespace has it on, all others off."""
    own = F.when(F.col("key_i") % 3 == 0, F.lit(False))
    kept = L.dedup_writes(_repeating(spark, d), enabled=L.dedup_scope(own, F.lit(True), False))
    return kept.select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"))


_MIXED = """x AS (SELECT event_type AS ns, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN NULL WHEN event_type = 'view' THEN NULL ELSE 'u' || user_id END AS ks, user_id AS ki FROM events),
  y AS (SELECT *, max(ks IS NOT NULL) OVER (PARTITION BY ns) AS txt FROM x)"""


@query("kv_widen_keys", f"""WITH {_MIXED} SELECT ns, CASE WHEN NOT txt THEN ki END::VARCHAR AS key_i, CASE WHEN txt THEN coalesce(ks, ki::VARCHAR) END AS key_s, count(*) AS n FROM y GROUP BY ALL""")
def kv_widen_keys(spark, d):
    log = D.text_key_log(spark, d)
    user = F.substring("key_s", 2, 20).cast("bigint")
    number = (F.col("ns") == "view") | ((F.col("ns") == "click") & (F.col("rev.seq") % 2 == 0))
    mixed = log.withColumns({"key_i": F.when(number, user), "key_s": F.when(~number, F.col("key_s"))})
    return L.widen_keys(mixed).groupBy("ns", F.col("key_i").cast("string").alias("key_i"), "key_s").agg(F.count("*").alias("n"))


@query("kv_compact", f"""WITH {EVENTS}, g AS (SELECT *, del OR (exp <> 0 AND exp <= {NOW_MS}) AS dead FROM e),
  h AS (SELECT *, first(dead) OVER (PARTITION BY k ORDER BY event_id DESC) AS over FROM g) SELECT k, event_id FROM h WHERE NOT dead AND NOT over""")
def kv_compact(spark, d):
    return L.compact(D.event_log(spark, d), NOW_MS).select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"))


@query("kv_compact_upper", f"WITH {EVENTS} SELECT k, event_id FROM e WHERE NOT del AND (exp = 0 OR exp > {NOW_MS})")
def kv_compact_upper(spark, d):
    return L.compact(D.event_log(spark, d), NOW_MS, bottom=False).select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"))


_CUT = NOW_MS - 5 * 86_400_000


@query("kv_compact_before", f"""WITH {EVENTS} SELECT k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY k, ts_ms < {_CUT} ORDER BY event_id DESC) AS rn FROM e)
  WHERE ts_ms >= {_CUT} OR rn = 1""")
def kv_compact_before(spark, d):
    return L.compact_before(D.event_log(spark, d), _CUT).select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"))


@query("kv_forget_expired", f"WITH {NEWEST} SELECT k, event_id FROM e WHERE k NOT IN (SELECT k FROM n WHERE exp <> 0 AND exp <= {NOW_MS})")
def kv_forget_expired(spark, d):
    return L.forget_expired(D.event_log(spark, d), NOW_MS).select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"))


@query("kv_asof", f"""WITH {EVENTS}, a AS (SELECT * FROM e WHERE ts_ms <= {_CUT} QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
  SELECT k, event_id, value FROM a WHERE NOT del AND (exp = 0 OR exp > {_CUT})""")
def kv_asof(spark, d):
    return _shown(L.as_of(D.event_log(spark, d), _CUT))


@query("kv_history_range", f"WITH {EVENTS} SELECT k, event_id FROM e WHERE ts_ms BETWEEN {_CUT} AND {NOW_MS}")
def kv_history_range(spark, d):
    return L.history_range(D.event_log(spark, d), _CUT, NOW_MS).select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"))


@query("kv_dump", f"WITH {LIVE} SELECT k, event_id, value, 0::BIGINT AS expires_at_ms FROM live")
def kv_dump(spark, d):
    out = L.dump(D.event_log(spark, d), NOW_MS)
    return out.select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"), _value(), "expires_at_ms")


@query("kv_incremental_dump", f"WITH {LIVE} SELECT k, event_id, value FROM live WHERE ts_ms > {_CUT} OR (ts_ms = {_CUT} AND event_id > 100)")
def kv_incremental_dump(spark, d):
    return _shown(L.dump(D.event_log(spark, d), NOW_MS, L.revision(F.lit(_CUT), F.lit(100))))


@query("kv_feed_after", f"WITH {EVENTS} SELECT k, event_id FROM e WHERE ts_ms > {_CUT}")
def kv_feed_after(spark, d):
    after = L.revision(F.lit(_CUT), F.lit(1 << 40))
    return L.after_revision(D.event_log(spark, d), after).select(F.col("key_i").alias("k"), F.col("rev.seq").alias("event_id"))


@query("ns_list", "SELECT DISTINCT event_type AS ns FROM events")
def ns_list(spark, d):
    return D.text_key_log(spark, d).select("ns").distinct().orderBy("ns")


@query("ns_drop", f"WITH {TEXT} SELECT ns, count(*) AS n FROM t WHERE ns <> 'click' GROUP BY ns")
def ns_drop(spark, d):
    return D.text_key_log(spark, d).where("ns <> 'click'").groupBy("ns").agg(F.count("*").alias("n"))


@query("ns_stats", f"""WITH {TEXT}, a AS (SELECT ns, count(*) AS revisions, count(*) FILTER (NOT del) AS puts, count(*) FILTER (del) AS deletes,
    sum(CASE WHEN NOT del THEN strlen(props) ELSE 0 END)::BIGINT AS bytes FROM t GROUP BY ns),
  b AS (SELECT ns, count(*) AS keys, count(*) FILTER (NOT del) AS live_keys FROM tn GROUP BY ns) SELECT * FROM a JOIN b USING (ns)""")
def ns_stats(spark, d):
    return L.stats(D.text_key_log(spark, d), NOW_MS).drop("last_ts_ms")


@query("latency_histogram", """WITH b AS (SELECT unnest([10, 50, 100, 500, 1000, 5000, 10000, 50000, 100000, 500000, 1000000, 5000000, 10000000, 60000000, NULL])::BIGINT AS le)
  SELECT coalesce(le, -1) AS le, (SELECT count(*) FROM events WHERE le IS NULL OR value * 100 <= le) AS n FROM b""")
def latency_histogram(spark, d):
    return L.latency_histogram(D.table(spark, d, "events").select((F.col("value") * 100).alias("us"))).select(F.coalesce("le", F.lit(-1)).alias("le"), "n")


# ---- objects


@query("obj_separate", "SELECT doc_id, strlen(text) > 1024 AS separated, CASE WHEN strlen(text) > 1024 THEN sha256(text) END AS obj_hash, CASE WHEN strlen(text) > 1024 THEN strlen(text) ELSE 0 END AS obj_size FROM documents")
def obj_separate(spark, d):
    rows = V.separate(D.document_log(spark, d).where("op = 'data'"))
    return rows.select(F.col("key_i").alias("doc_id"), F.col("obj_hash").isNotNull().alias("separated"), "obj_hash", F.coalesce("obj_size", F.lit(0)).alias("obj_size"))


@query("obj_dedup", "SELECT lang AS ns, sha256(text) AS obj_hash, max(strlen(text)) AS obj_size FROM documents WHERE strlen(text) > 1024 GROUP BY 1, 2")
def obj_dedup(spark, d):
    return V.objects(D.document_log(spark, d)).select("ns", "obj_hash", "obj_size")


@query("obj_resolve", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 11 <> 0")
def obj_resolve(spark, d):
    log = D.document_log(spark, d)
    rows = V.resolve(L.live(V.separate(log), NOW_MS), V.objects(log))
    return rows.select(F.col("key_i").alias("doc_id"), F.sha2("value", 256).alias("digest"))


_POINTERS = "p AS (SELECT DISTINCT lang AS ns, sha256(text) AS obj_hash FROM documents WHERE strlen(text) > 1024 AND doc_id % 11 <> 0), o AS (SELECT DISTINCT lang AS ns, sha256(text) AS obj_hash FROM documents WHERE strlen(text) > 1024)"


@query("obj_gc", f"WITH {_POINTERS} SELECT ns, obj_hash FROM o EXCEPT SELECT ns, obj_hash FROM p")
def obj_gc(spark, d):
    """Objects that no live row points to after the deletions."""
    log = D.document_log(spark, d)
    return V.orphans(V.objects(log), L.live(V.separate(log), NOW_MS)).select("ns", "obj_hash")


@query("obj_referenced", f"WITH {_POINTERS} SELECT ns, obj_hash FROM p")
def obj_referenced(spark, d):
    log = D.document_log(spark, d)
    return V.referenced(V.objects(log), L.live(V.separate(log), NOW_MS)).select("ns", "obj_hash")


@query("value_encryption", f"WITH {TEXT} SELECT ns, k, props AS value, true AS hidden FROM tn WHERE NOT del")
def value_encryption(spark, d):
    """Values are encrypted and read back; while encrypted they differ from what they were."""
    key = V.derive_key("correct horse", b"0123456789abcdef")
    view = _text_view(spark, d)
    locked = V.encrypt_values(view.withColumn("_was", F.col("value")), key)
    locked = locked.withColumn("hidden", (F.col("value") != F.col("_was")) & (F.octet_length("value") == F.octet_length("_was") + 28))
    return V.decrypt_values(locked, key).select("ns", F.col("key_s").alias("k"), F.col("value").cast("string").alias("value"), "hidden")


@query("rev_print", f"WITH {EVENTS} SELECT event_id, ts_ms FROM e")
def rev_print(spark, d):
    """Revisions printed in base 32 and taken apart again."""
    shown = D.event_log(spark, d).select("rev", S.revision_base32(F.col("rev")).alias("b"))
    padded = F.lpad("b", 26, "0")
    digit = lambda i: F.position(F.substring(padded, i, F.lit(1)), F.lit(S.ALPHABET)) - 1
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(26)), lambda i: F.lpad(F.conv(digit(i).cast("string"), 10, 2), 5, "0")), "")
    part = lambda at, n: F.conv(F.substring(bits, at, n), 2, 10).cast("bigint")
    return shown.select(part(83, 48).alias("event_id"), part(3, 48).alias("ts_ms"))


@query("kv_keys", f"WITH {LIVE} SELECT k FROM live")
def kv_keys(spark, d):
    """Live keys only; values aren't read."""
    return L.live_keys(D.event_log(spark, d), NOW_MS).select(F.col("key_i").alias("k"))
