import random

import pytest
from pyspark.sql import functions as F

from strandlog.operators import log as L
from strandlog.plans import lang
from strandlog.plans.commands import Shell
from strandlog.plans.engine import Engine, KeyNotFound, ReadOnly
from strandlog.sources import store as ST


@pytest.fixture
def engine(spark, tmp_path):
    now = [1000]
    e = Engine(spark, str(tmp_path / "db"), clock=lambda: now[0])
    e.now = now
    return e


def test_key_values(engine):
    n = engine.namespace("a")
    n.put("k1", "v1")
    n.write_batch([("put", "k1", "v2"), ("put", "k2", "x"), ("put", "k3", None, "1s"), ("delete", "k2")])
    assert n.get("k1") == b"v2" and n.rev_count("k1") == 2 and n.rev_get("k1", 0) == b"v1"
    assert n.get("k3") is None and n.exists("k3") and n.ttl("k3") == 1000
    assert n.scan() == ["k1", "k3"] and n.get_raw("k2") == "tombstone" and n.get_raw("nope") is None
    with pytest.raises(KeyNotFound):
        n.get("k2")
    engine.now[0] = 3000
    assert n.scan() == ["k1"] and n.scan(include_deleted=True) == ["k1", "k2", "k3"]
    assert n.pop_first() == ("k1", b"v2") and n.count() == 0
    assert engine.list_namespaces() == ["a"]
    engine.drop_namespace("a")
    assert engine.list_namespaces() == []


def test_integer_keys_until_a_text_key_comes(engine):
    n = engine.namespace()
    n.write_batch([("put", k, str(k)) for k in (5, -3, 40)])
    assert n.scan() == [-3, 5, 40] and n.scan(5) == [5, 40] and n.scan(5, reverse=True) == [5, -3]
    n.put("hello", "s")
    assert n.get("40") == b"40"
    with pytest.raises(KeyNotFound):
        n.get(40)


def test_dedup_setting(engine):
    n = engine.namespace("d")
    engine.set_namespace_dedup("d", True)
    assert n.write_batch([("put", "k", "v"), ("put", "k", "v"), ("put", "k", "w"), ("put", "k", "v")]) == 3
    assert n.put("k", "v") == 0 and n.put("k", "v", dedup=False) == 1
    n.delete("k")
    assert n.put("k", "v") == 1
    assert Shell(engine).run("namespaces") == ["d"]


def test_ranges(engine):
    n = engine.namespace("r")
    n.write_batch([("put", f"k{i}", "v") for i in range(6)])
    assert n.delete_range("k1", "k3") == 2 and n.delete_range("k3", "k4", inclusive=True) == 2
    assert n.delete_prefix("k") == 2 and n.delete_prefix("k") == 0


def test_passwords(engine):
    engine.namespace("s", "pw").put("x", "secret")
    raw = engine.store.read().where("ns = 's'").first().value
    assert bytes(raw) != b"secret" and engine.namespace("s", "pw").get("x") == b"secret"
    with pytest.raises(PermissionError):
        engine.namespace("s", "wrong")


def test_queues(engine):
    q = engine.queue("jobs")
    q.push_batch([("a", None), ("b", None), ("c", "1s")])
    q.push("d")
    assert q.pop() == "a" and len(q) == 3
    engine.now[0] = 5000
    assert q.pop_batch(10) == ["b", "d"] and q.pop() is None
    assert engine.list_queues() == ["jobs"]
    with pytest.raises(ValueError):
        engine.queue("no spaces")
    engine.delete_queue("jobs")
    engine.delete_queue("jobs")
    assert engine.list_queues() == []


def test_random_operations_against_a_dictionary(engine):
    r, n, model = random.Random(7), engine.namespace("fuzz"), {}
    for _ in range(6):
        ops = []
        for _ in range(40):
            k = f"k{r.randrange(15)}"
            if r.random() < 0.3:
                ops.append(("delete", k))
                model.pop(k, None)
            else:
                v = bytes(r.randrange(256) for _ in range(r.randrange(4)))
                ops.append(("put", k, v))
                model[k] = v
        n.write_batch(ops)
        if r.random() < 0.5:
            engine.compact()
        assert dict(n.entries()) == dict(sorted(model.items()))


def test_store_is_atomic_and_reopens(engine, spark, tmp_path):
    n = engine.namespace("a")
    n.put("k", "v")
    spark.createDataFrame([("a", None, "lost", (9, 0, 0, 9), "data", bytearray(b"?"), None, None, 0)], L.SCHEMA).write.partitionBy("ns").parquet(f"{engine.store.root}/data/commit=unpublished")
    again = Engine(spark, engine.store.root, clock=lambda: 5)
    assert again.namespace("a").scan() == ["k"] and again.store.vacuum() == 1
    again.namespace("a").put("k", "w")  # the clock stands behind what is stored; revisions still grow
    assert again.namespace("a").get("k") == b"w"
    with pytest.raises(ReadOnly):
        Engine(spark, engine.store.root, read_only=True).namespace("a").put("k", "z")


def test_dump_load_and_repair(engine, spark, tmp_path):
    n = engine.namespace("a")
    n.write_batch([("put", "k", "v"), ("put", "gone", "x", "1s"), ("put", "k", "w")])
    engine.now[0] = 9000
    ST.dump(engine.store.read(), str(tmp_path / "dump"), 9000)
    other = ST.LogStore(spark, str(tmp_path / "other"))
    ST.load(spark, str(tmp_path / "dump"), other, lambda rev: L.revision(F.lit(1), rev.seq))
    assert [(r.key_s, bytes(r.value)) for r in other.read().collect()] == [("k", b"w")]
    with pytest.raises(FileExistsError):
        ST.load(spark, str(tmp_path / "dump"), other, lambda rev: rev)
    bad = other.append(other.read())
    for name in other.files.names(f"data/commit={bad}/ns=a"):
        if name.endswith(".parquet"):
            other.files.delete(f"data/commit={bad}/ns=a/{name}")
            other.files.write(f"data/commit={bad}/ns=a/{name}", "not parquet")
    assert other.repair() == {"kept": 1, "dropped": 1}
    assert other.read().count() == 1


def test_peers(spark, tmp_path):
    a, b = (Engine(spark, str(tmp_path / f"p{c}"), clock=lambda c=c: 1000 * c, cluster=c) for c in (1, 2))
    a.namespace("n").put("k", "from a")
    b.namespace("n").put("k", "from b")
    a.merge_peer(b.store.read())
    b.merge_peer(a.store.read())
    assert a.namespace("n").get("k") == b.namespace("n").get("k") == b"from b"


def test_graph_session(engine):
    g = engine.graph("campus")
    for name in ("person", "school", "out"):
        g.create_table(name)
    g.create_link("attends", "person", "school")
    for line in ("+{person alice}[role=teacher, age=30]", "+{person bob}", "+{school mit}[ranking=1]", "+(attends alice -> mit)[year=2020]", "+(attends bob -> mit)"):
        assert g.run(line) == 1
    assert [r.key for r in g.run("?{person | age>20}").collect()] == ["alice"]
    assert [r.key for r in g.run("?{person alice} -> (attends | year>2019) -> {school | ranking<5}").collect()] == ["mit"]
    g.update("person", "alice", {"age": 31, "role": None})
    assert [h[1] for h in g.history("person", "alice")] == [{"role": "teacher", "age": 30}, {"age": 31}]
    assert g.run("?{person} => {}[age=person.age] | +{out key=key}") == 2
    assert g.run("?{out}").count() == 2
    outcome = g.batch(["+(attends nobody -> mit)", "+{person carol}[age=1]"])
    assert outcome[0][1].startswith("error") and outcome[1][1] == "ok"
    g.alter_link("attends", cascade=True)
    assert g.delete_node("school", "mit") == 3
    assert [r.key for r in g.run("?{person}").collect()] == ["carol"]


def test_a_deleted_node_goes_with_its_links_in_one_commit(engine):
    g = engine.graph("yard")
    for name in ("box", "shelf"):
        g.create_table(name)
    g.create_link("on", "box", "shelf")
    g.create_link("next", "box", "box")
    for line in ("+{box été}", "+{box b}", "+{box c}", "+{shelf s}", "+(on été -> s)", "+(on b -> s)", "+(next été -> b)", "+(next b -> c)"):
        g.run(line)
    before = len(engine.store.commits())
    assert g.delete_node("box", "été") == 1
    assert len(engine.store.commits()) == before + 1
    left = g.graph()
    assert sorted(r.key for r in left.tables["box"].collect()) == ["b", "c"]
    assert [(r.src, r.dst) for r in left.links["on"].entries.collect()] == [("b", "s")]
    assert [(r.src, r.dst) for r in left.links["next"].entries.collect()] == [("b", "c")]
    assert g.delete_node("box", "b", cascade=True) == 3
    left = g.graph()
    assert all(t.isEmpty() for t in left.tables.values()) and all(x.entries.isEmpty() for x in left.links.values())


def test_dump_of_a_locked_namespace_stays_encrypted(engine, spark, tmp_path):
    engine.namespace("vault", "pass").put("k", "hidden words")
    engine.namespace("vault", "pass").dump(str(tmp_path / "dump"))
    held = spark.read.parquet(str(tmp_path / "dump")).collect()
    assert all(b"hidden" not in bytes(r.value or b"") for r in held)
    other = ST.LogStore(spark, str(tmp_path / "other"))
    ST.load(spark, str(tmp_path / "dump"), other, lambda rev: rev)
    with pytest.raises(PermissionError):
        Engine(spark, str(tmp_path / "other")).namespace("vault")
    with pytest.raises(PermissionError):
        Engine(spark, str(tmp_path / "other")).namespace("vault", "guess")
    assert Engine(spark, str(tmp_path / "other")).namespace("vault", "pass").get("k") == b"hidden words"


def test_start_of_a_traversal_keeps_its_offset(engine):
    g = engine.graph("o")
    g.create_table("p")
    g.create_link("to", "p", "p")
    for line in ("+{p a}", "+{p b}", "+{p x}", "+{p y}", "+(to a -> x)", "+(to b -> y)"):
        g.run(line)
    plan = lang.parse("?{p} -> (to) -> {p}")
    plan.start.offset, plan.start.limit = 1, 1
    assert [r.key for r in lang.to_frame(g.graph(), plan).collect()] == ["y"]


def test_time_travel(engine):
    g = engine.graph("t")
    g.create_table("p")
    g.run("+{p a}[v=1]")
    engine.now[0] = 1_704_067_200_000
    g.run("+{p a}[v=2]")
    assert g.run("?{p | v=2}").count() == 1
    assert [r.v for r in g.run("?{p} AT 2023-06-01").collect()] == [1]


def test_shell(engine):
    s = Shell(engine)
    s.run("put k1 v1 1h")
    s.run("put 7 seven")
    assert s.run("get k1") == b"v1"
    assert s.run("scan") == ["7", "k1"] and s.run("count k") == 1 and s.run("has k1") and s.run("ttl k1") == 3_600_000
    assert s.run("batch put a 1 ; put b 2 ; del k1") == 3
    assert s.run("rev count a") == 1 and s.run("wipe a") == 1
    s.run("use other")
    s.run("push jobs body")
    assert s.run("take jobs 5") == ["body"] and s.run("length jobs") == 0
    assert "strandlog_keys" in s.run("metrics")
    with pytest.raises(ValueError):
        s.run("dance")


def test_a_replica_drops_and_compacts_nothing(spark, tmp_path):
    from strandlog.plans.engine import Engine, ReadOnly

    Engine(spark, str(tmp_path / "s")).namespace("a").put("k", "v")
    replica = Engine(spark, str(tmp_path / "s"), read_only=True)
    for change in (lambda: replica.drop_namespace("a"), replica.compact):
        with pytest.raises(ReadOnly):
            change()
    assert replica.list_namespaces() == ["a"]
