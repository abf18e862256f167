"""Random writes: the log's queries against a plain dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from strandlog.operators import log as L
from strandlog.operators import scan as SC
from strandlog.operators import values as V

NOW = 10_000


def make(seed, n=400):
    r = random.Random(seed)
    out = []
    for seq in range(n):
        op = r.choices(["data", "tombstone", "null"], [7, 2, 1])[0]
        value = r.choice(["x", "y", "zz", "", "q" * 2000]) if op == "data" else None
        ttl = r.choice([0, 0, 0, NOW - 5, NOW, NOW + 5]) if op != "tombstone" else 0
        out.append((f"n{r.randrange(2)}", None, f"k{r.randrange(12)}", (seq // 3, r.randrange(3), 0, seq), op, value.encode() if value is not None else None, None, None, ttl))
    return out


@pytest.fixture(scope="module", params=[1, 2])
def both(request, spark):
    rows = make(request.param)
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, L.SCHEMA)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[3]):
        out.setdefault((r[0], r[2]), []).append(r)
    return out


def alive(r, now=NOW):
    return r[4] != "tombstone" and (r[8] == 0 or r[8] > now)


def got(df):
    return {(r.ns, r.key_s): (tuple(r.rev), bytes(r.value) if r.value is not None else None) for r in df.collect()}


def test_live_and_latest(both):
    rows, log = both
    newest = {k: v[-1] for k, v in by_key(rows).items()}
    assert got(L.latest(log)) == {k: (r[3], r[5]) for k, r in newest.items()}
    assert got(L.live(log, NOW)) == {k: (r[3], r[5]) for k, r in newest.items() if alive(r)}


def test_expired_newest_hides_older(spark):
    rows = [("n", None, "k", (1, 0, 0, 1), "data", b"old", None, None, 0), ("n", None, "k", (2, 0, 0, 2), "data", b"new", None, None, NOW)]
    log = spark.createDataFrame(rows, L.SCHEMA)
    assert L.live(log, NOW).isEmpty() and L.live(log, NOW - 1).first().value == b"new"


def test_history(both):
    rows, log = both
    for i in (0, 3):
        want = {k: v[i][3] for k, v in by_key(rows).items() if len(v) > i}
        assert {(r.ns, r.key_s): tuple(r.rev) for r in L.rev_get(log, i).collect()} == want
    want = {k: sum(not (r[8] and r[8] <= NOW) for r in v) for k, v in by_key(rows).items()}
    assert {(r.ns, r.key_s): r.revisions for r in L.rev_count(log, NOW).collect()} == {k: n for k, n in want.items() if n}


def test_dedup(both):
    rows, log = both
    want = set()
    for v in by_key(rows).values():
        last = None
        for r in v:
            if r[4] != "tombstone" and r[8] == 0 and last is not None and (last[4], last[5]) == (r[4], r[5]) and last[8] == 0:
                continue
            want.add(r[3])
            last = r
    assert {tuple(r.rev) for r in L.dedup_writes(log).collect()} == want


def test_compact(both):
    rows, log = both
    want = {r[3] for v in by_key(rows).values() if alive(v[-1]) for r in v if alive(r)}
    assert {tuple(r.rev) for r in L.compact(log, NOW).collect()} == want
    assert got(L.live(L.compact(log, NOW), NOW)) == got(L.live(log, NOW))


def test_compact_before_keeps_the_state_at_the_cut(both):
    rows, log = both
    cut = 60
    kept = L.compact_before(log, cut)
    for at in (cut - 1, cut, cut + 20, 1000):
        assert got(L.as_of(kept, at)) == got(L.as_of(log, at))


def test_merge_ignores_order_of_arrival(both):
    rows, log = both
    assert got(L.last_writer_wins(log.orderBy(F.desc("rev")))) == got(L.last_writer_wins(log))


def test_two_peers_converge(spark):
    a = spark.createDataFrame([("n", None, "k", (1, 1, 0, 0), "data", b"value_a", None, None, 0)], L.SCHEMA)
    b = spark.createDataFrame([("n", None, "k", (2, 2, 0, 0), "data", b"value_b", None, None, 0)], L.SCHEMA)
    for feed in (a.union(b), b.union(a)):
        assert L.last_writer_wins(feed).first().value == b"value_b"
    late = b.withColumn("arrival", F.lit(1)).union(a.withColumn("arrival", F.lit(2)))
    assert L.conflicts(late, "arrival").first().rejected == 1
    assert L.last_writer_wins(a.union(b), own_cluster=2).first().value == b"value_a"


def test_records_that_arrive_together(spark):
    """In whatever order they are read, none came after the other; an older one that arrives later did."""
    made = [spark.createDataFrame([("n", None, "k", (at, at, 0, 0), "data", b"", None, None, 0)], L.SCHEMA).withColumn("arrival", F.lit(arrival)) for at, arrival in ((2, 5), (3, 5), (1, 6))]
    for a, b, c in ((0, 1, 2), (1, 0, 2), (2, 1, 0)):
        assert L.conflicts(made[a].union(made[b]).union(made[c]).coalesce(1), "arrival").first().rejected == 1


def test_scans(both):
    rows, log = both
    view = L.live(log, NOW).where("ns = 'n0'")
    want = sorted(k for (ns, k), v in by_key(rows).items() if ns == "n0" and alive(v[-1]) and k.startswith("k1"))
    names = lambda df: [r.key_s for r in df.collect()]
    assert names(SC.scan(view, "k1")) == want
    assert names(SC.scan(view, "k1", reverse=True)) == want[::-1]
    assert names(SC.scan(view, "k1", 2, 1)) == want[1:3]
    assert names(SC.scan(view, "k1", 0)) == []
    assert SC.count(view, "k1").first().n == len(want)


def test_widening(spark):
    rows = [("m", 42, None, (1, 0, 0, 1), "data", b"int_value", None, None, 0), ("m", None, "hello", (2, 0, 0, 2), "data", b"str_value", None, None, 0), ("i", 42, None, (3, 0, 0, 3), "data", b"z", None, None, 0)]
    wide = L.widen_keys(spark.createDataFrame(rows, L.SCHEMA))
    mixed = wide.where("ns = 'm'")
    assert SC.get(mixed, 42).isEmpty() and SC.get(mixed, "42").first().value == b"int_value"
    assert SC.get(wide.where("ns = 'i'"), 42).first().value == b"z"


def test_objects_and_encryption(both):
    _, log = both
    apart = V.separate(log)
    assert apart.where("octet_length(value) > 1024").isEmpty()
    assert V.objects(log).count() == 2
    each = lambda df: sorted((tuple(r.rev), bytes(r.value) if r.value is not None else None) for r in df.collect())
    assert each(V.resolve(apart, V.objects(log))) == each(log)
    key = V.derive_key("pw", b"salt" * 4)
    locked = V.encrypt_values(log, key)
    assert each(V.decrypt_values(locked, key)) == each(log)
    assert V.orphans(V.objects(log), apart).isEmpty()


def test_passwords(spark):
    key = V.derive_key("pw", b"s" * 16)
    token = V.verification_token(spark, key)
    assert V.password_fits(spark, token, key) and not V.password_fits(spark, token, V.derive_key("other", b"s" * 16))
