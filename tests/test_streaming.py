from pyspark.sql import functions as F

from strandlog.operators import log as L
from strandlog.streaming import feeds as S


def rows(spark, items):
    return spark.createDataFrame([("n", None, k, (seq, 0, 0, seq), op, v, None, None, ttl) for seq, k, op, v, ttl in items], L.SCHEMA)


def test_newest_over_two_runs(spark, tmp_path):
    src, seen = str(tmp_path / "src"), {}

    def sink(batch, _):
        seen.update({r.key_s: bytes(r.value) for r in batch.collect()})

    for items in ([(1, "a", "data", b"1", 0), (5, "b", "data", b"5", 0)], [(3, "b", "data", b"3", 0), (4, "a", "data", b"4", 0)]):
        rows(spark, items).coalesce(1).write.mode("append").parquet(src)
        S.run_once(S.newest(S.changes(spark, src)), str(tmp_path / "ck"), "update", sink)
    assert seen == {"a": b"4", "b": b"5"}  # the late write of b lost


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    src, kept = str(tmp_path / "src"), []
    batches = [
        [(1, "a", "data", b"x", 0), (2, "a", "data", b"x", 0), (3, "a", "data", b"y", 0)],
        [(4, "a", "data", b"y", 0), (5, "a", "data", b"y", 99), (6, "a", "data", b"y", 0), (7, "a", "tombstone", None, 0), (8, "a", "data", b"y", 0)],
    ]
    for items in batches:
        rows(spark, items).coalesce(1).write.mode("append").parquet(src)
        S.run_once(S.without_repeats(S.changes(spark, src)), str(tmp_path / "ck"), "append", lambda b, _: kept.extend(r.seq for r in b.collect()))
    every = rows(spark, [i for b in batches for i in b])
    assert sorted(kept) == sorted(r.rev.seq for r in L.dedup_writes(every).collect())


def test_delivery_per_batch(spark, tmp_path):
    got = []
    msgs = spark.createDataFrame([("q", f"{i:03d}", f"b{i}", 0) for i in range(5)] + [("r", "1", "x", 5)], "queue string, msg_id string, body string, expires_at_ms long")
    msgs.write.parquet(str(tmp_path / "m"))
    feed = S.changes(spark, str(tmp_path / "m"), msgs.schema)
    S.run_once(feed, str(tmp_path / "ck"), "append", S.deliver(spark, msgs, 2, 10, lambda b, _: got.extend(r.body for r in b.orderBy("msg_id").collect())))
    assert got == ["b0", "b1"]


def test_undelivered_messages_wait(spark, tmp_path):
    got, schema = [], "queue string, msg_id string, body string, expires_at_ms long"
    src, names = str(tmp_path / "m"), {"ck": str(tmp_path / "ck"), "left": str(tmp_path / "left")}
    for items in ([("q", f"{i:03d}", f"b{i}", 0) for i in range(5)], [("q", "009", "b9", 0), ("r", "001", "r1", 0)], [("r", "002", "r2", 5)], [("q", "010", "b10", 0)]):
        spark.createDataFrame(items, schema).coalesce(1).write.mode("append").parquet(src)
        feed = S.changes(spark, src, spark.createDataFrame([], schema).schema)
        batch = []
        sink = S.deliver(spark, feed, 2, 10, lambda b, _: batch.extend(r.body for r in b.orderBy("queue", "msg_id").collect()), names["left"])
        S.run_once(feed, names["ck"], "append", sink)
        got.append(batch)
    assert got == [["b0", "b1"], ["b2", "b3", "r1"], ["b4", "b9"], ["b10"]]


def test_a_batch_that_runs_again_delivers_the_same(spark, tmp_path):
    got, schema = [], "queue string, msg_id string, body string, expires_at_ms long"
    each = S.deliver(spark, None, 1, 10, lambda b, n: got.append((n, [r.body for r in b.collect()])), str(tmp_path / "left"))
    first = spark.createDataFrame([("q", "1", "a", 0), ("q", "2", "b", 0), ("q", "3", "c", 0)], schema)
    none = spark.createDataFrame([], schema)
    for batch, number in ((first, 0), (none, 1), (none, 1), (none, 2)):
        each(batch, number)
    assert got == [(0, ["a"]), (1, ["b"]), (1, ["b"]), (2, ["c"])]


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in S.event_windows(df).collect()) == [1, 2]
