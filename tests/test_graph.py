import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlog.functions.predicates import Eq, Gt, In, Like, Lt, NotExists
from strandlog.operators import graph as G
from strandlog.operators import parcels
from strandlog.operators.graph import Graph, Hop, Link
from strandlog.plans.lang import run_query


@pytest.fixture(scope="module")
def campus(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    g = Graph(spark)
    g.create_table("person", t([("alice", "teacher", False), ("bob", None, True)], "key string, role string, _set boolean"))
    g.create_table("school", t([("mit", 1, False), ("stanford", None, True)], "key string, ranking long, _set boolean"))
    g.create_table("city", t([("cambridge", True)], "key string, _set boolean"))
    g.create_link("attends", Link("person", "school", t([("alice", "mit", 2020), ("bob", "stanford", None)], "src string, dst string, year long")))
    g.create_link("located-in", Link("school", "city", t([("mit", "cambridge")], "src string, dst string")))
    g.create_link("friends", Link("person", "person", t([("alice", "bob")], "src string, dst string"), bidirectional=True))
    return g


def leaves(df):
    return sorted(f"{r.tbl}.{r.key}" for r in df.collect())


def go(g, key, *hops, table="person", **kw):
    return leaves(g.traverse(g.start(table, key), hops, **kw))


def test_hops(campus):
    assert go(campus, "alice", "attends") == ["school.mit"]
    assert go(campus, "alice", "attends", "located-in") == ["city.cambridge"]
    assert go(campus, "alice") == ["person.alice"]
    assert go(campus, "nobody", "attends") == []


@pytest.fixture(scope="module")
def web(spark):
    """Two tables and links of all kinds, with repeated entries, loops and nodes that are met again."""
    r = random.Random(4)
    nodes = lambda: spark.createDataFrame([(str(k), k) for k in range(30)], "key string, rank long")
    g = G.Graph(spark, {"a": nodes(), "b": nodes()})
    for name, source, target, both in (("ab", "a", "b", False), ("ba", "b", "a", False), ("aa", "a", "a", True), ("lost", "b", "a", False)):
        rows = [(str(r.randrange(30)), str(r.randrange(30))) for _ in range(60)] + ([("1", None), ("2", None)] if name == "lost" else [])
        g.create_link(name, G.Link(source, target, spark.createDataFrame(rows + rows[:9], "src string, dst string"), bidirectional=both))
    return g


@pytest.mark.parametrize("hops", [["ab", "ba"], ["aa", "aa"], ["aa", "aa", "ab"], ["ab", Hop("ab", backwards=True), "aa"], ["ab", Hop("ba", node_filter=Gt("rank", 11))], ["ab", "lost"], ["ab", "ba", "ab", "ba"]])
def test_paths_compared_together_are_those_compared_one_by_one(web, monkeypatch, hops):
    starts = web.tables["a"].select(F.lit("a").alias("tbl"), "key")
    got = []
    for limit in (10**9, G.TOGETHER, 0):
        monkeypatch.setattr(G, "TOGETHER", limit)
        rows = web.traverse(starts, hops, with_paths=True).select("start_tbl", "start_key", "tbl", "key", "path").collect()
        got.append(sorted(map(repr, rows)))
    assert got[0] == got[1] == got[2] and got[0]


def test_no_row_per_path_is_shuffled(web):
    """The last hop's paths are made from lists behind the last shuffle; a shuffled row for each took 1 GB of disk for 0.01 GB of lines."""
    starts = web.tables["a"].select(F.lit("a").alias("tbl"), "key")
    plan = web.traverse(starts, ["ab", "ba"], with_paths=True)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.find("Generate inline") < plan.find("Exchange")


def test_paths_travel_packed(spark, monkeypatch):
    """Keys that are numbers, large ones, other texts, and starts that are met again, compared a few at a time."""
    name = lambda k: str(k * k * 10**11) if k % 3 == 0 else str(k) if k % 3 == 1 else f"n{k} é"
    r = random.Random(7)
    g = G.Graph(spark, {"a": spark.createDataFrame([(name(k),) for k in range(60)], "key string")})
    rows = {(name(r.randrange(60)), name(r.randrange(60))) for _ in range(400)}
    g.create_link("to", G.Link("a", "a", spark.createDataFrame(sorted(rows), "src string, dst string")))
    starts = g.tables["a"].select(F.lit("a").alias("tbl"), "key")
    shown = lambda: sorted(map(repr, g.traverse(starts, ["to", "to", "to"], with_paths=True).collect()))
    monkeypatch.setattr(parcels, "PATHS", 50)
    monkeypatch.setattr(parcels, "BUCKET_PATHS", 9000)
    monkeypatch.setattr(parcels, "WAYS", 300)
    packed = shown()
    monkeypatch.setattr(G, "TOGETHER", 0)
    assert packed == shown() and packed


def test_gaps_of_a_parcel_are_small():
    lists = [[str(k) for k in range(i, 1_000_000, 20_000)] for i in range(600)]
    gaps, plain = parcels._gaps(pa.array(lists, pa.list_(pa.string())))
    n, none = len(lists), pa.nulls(len(lists), pa.list_(pa.string()))
    texts = {"t0": ["a"] * n, "k0": [str(i) for i in range(n)], "t1": ["b"] * n, "k1": [str(i * 7919 % 1000) for i in range(n)], "to": ["c"] * n}
    part = {c: pa.array(v, pa.string()) for c, v in texts.items()} | {"gaps": gaps, "far": none}
    made = parcels._parcel(part, ["t0", "k0", "t1", "k1"])
    assert not plain and len(made) < 30_000 // 2  # 30,000 keys
    heads, sizes, keys, words = parcels._open([made], ["t0", "k0", "t1", "k1"])
    assert heads.to_pydict() == texts and words is None
    assert np.split(keys, np.cumsum(sizes)[:-1])[599].tolist() == [int(k) for k in lists[599]]


def test_paths(campus):
    found = campus.traverse(campus.start("person", "alice"), ["attends", "located-in"], with_paths=True).collect()
    assert [[n.key for n in r.path] for r in found] == [["alice", "mit", "cambridge"]]


def test_filters(campus):
    assert go(campus, "alice", Hop("attends", Gt("year", 2019))) == ["school.mit"]
    assert go(campus, "alice", Hop("attends", Gt("year", 2021))) == []
    assert go(campus, "alice", Hop("attends", node_filter=Lt("ranking", 5))) == ["school.mit"]
    assert go(campus, "alice", Hop("attends", node_filter=Gt("ranking", 100))) == []
    # a node without properties fails every filter, even one for a missing property
    assert go(campus, "bob", Hop("attends", node_filter=NotExists("ranking"))) == []
    assert go(campus, "bob", Hop("attends", NotExists("year"))) == ["school.stanford"]


def test_cycle(spark):
    g = Graph(spark)
    g.create_table("n", spark.createDataFrame([("a",), ("b",)], "key string"))
    g.create_link("knows", Link("n", "n", spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")))
    assert go(g, "a", "knows", "knows", table="n") == []


def test_reverse_over_bidirectional_links(campus):
    assert go(campus, "bob", "friends") == ["person.alice"]
    assert go(campus, "mit", Hop("attends", backwards=True), table="school") == ["person.alice"]


def test_unknown_link(campus):
    with pytest.raises(G.NotFound):
        go(campus, "alice", "nothing")


def test_discovery(campus):
    d = lambda key, n, both=False: leaves(campus.discover(campus.start("person", key), n, both))
    assert d("alice", 1) == ["person.bob", "school.mit"]
    assert d("alice", 2) == ["city.cambridge", "person.bob", "school.mit", "school.stanford"]
    assert d("bob", 1, True) == ["person.alice", "school.stanford"]
    assert d("alice", 0) == []


def test_language(campus):
    assert leaves(run_query(campus, "?{person alice} -> (attends | year>2019) -> {school | ranking<5}")) == ["school.mit"]
    assert leaves(run_query(campus, "?{person alice} <-> (friends) -> (attends)")) == ["school.stanford"]
    assert leaves(run_query(campus, "?{person bob} <-> (*:1)")) == ["person.alice", "school.stanford"]
    assert [r.key for r in run_query(campus, "?{person | role=teacher}").collect()] == ["alice"]


def test_schema_rules(campus, spark):
    g = Graph(spark, dict(campus.tables), dict(campus.links))
    with pytest.raises(ValueError):
        g.create_table("person", campus.tables["person"])
    with pytest.raises(G.NotFound):
        g.create_link("x", Link("person", "nowhere", campus.links["attends"].entries))
    g.alter_link("attends", cascade=True)
    assert g.links["attends"].cascade and not campus.links["attends"].cascade
    g.drop_table("school")
    assert set(g.links) == {"friends"}


@pytest.fixture(scope="module")
def circle(spark):
    def make(flag):
        g = Graph(spark)
        g.create_table("person", spark.createDataFrame([("alice",), ("bob",), ("charlie",)], "key string"))
        g.create_table("school", spark.createDataFrame([("mit",)], "key string"))
        g.create_link("attends", Link("person", "school", spark.createDataFrame([("alice", "mit"), ("bob", "mit")], "src string, dst string"), cascade=flag))
        g.create_link("friends", Link("person", "person", spark.createDataFrame([("alice", "bob")], "src string, dst string"), bidirectional=True))
        return g

    return make


def test_cascade(circle):
    g = circle(False)
    assert leaves(g.cascade(g.start("person", "alice"), everything=True)) == ["person.alice", "person.bob", "school.mit"]
    assert leaves(g.cascade(g.start("person", "alice"))) == ["person.alice"]
    left = g.delete_cascade(g.start("person", "alice"), everything=True)
    assert [r.key for r in left.tables["person"].collect()] == ["charlie"]
    assert left.links["attends"].entries.isEmpty() and left.links["friends"].entries.isEmpty()
    flagged = circle(True)
    assert "school.mit" in leaves(flagged.cascade(flagged.start("person", "alice")))


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("alice", "Alice", 45, "teacher"), ("bob", "Bob", 22, "student"), ("charlie", "Charlie", 35, "teacher")], "key string, name string, age long, role string")


def keys(df):
    return [r.key for r in df.collect()]


def test_node_queries(people):
    assert keys(G.query(people, Eq("role", "teacher"))) == ["alice", "charlie"]
    assert G.query(people, fields=["name"]).columns == ["key", "name"]
    assert keys(G.query(people, Like("name", "Al%"))) == ["alice"]
    assert keys(G.query(people, In("role", ["teacher", "admin"]))) == ["alice", "charlie"]
    assert G.count(people).first().n == 3 and G.count(people, Eq("role", "teacher")).first().n == 2


def test_pages(people):
    got, more, cursor = G.page(people, 2).fetch()
    assert [r.key for r in got] == ["alice", "bob"] and more and cursor == "bob"
    got, more, cursor = G.page(people, 2, cursor=cursor).fetch()
    assert [r.key for r in got] == ["charlie"] and not more


def test_sorted_pages_cover_all_rows_once(spark):
    df = spark.createDataFrame([(f"k{i}", None if i % 4 == 0 else i % 3) for i in range(12)], "key string, v long")
    for way in ("asc", "desc"):
        seen, cursor = [], None
        while True:
            got, more, cursor = G.page(df, 5, sort=[("v", way)], cursor=cursor).fetch()
            seen += [r.key for r in got]
            if not more:
                break
        assert seen == keys(G.query(df, sort=[("v", way)]))


def test_updates(spark, people):
    new = spark.createDataFrame([("bob", 23)], "key string, age long")
    merged = {r.key: (r.name, r.age) for r in G.update(people, new).collect()}
    assert merged["bob"] == ("Bob", 23) and merged["alice"] == ("Alice", 45)
    gone = G.update(people, people.where("key = 'bob'").select("key"), removed=["name", "age", "role"])
    assert {r.key: r._set for r in gone.collect()} == {"alice": False, "bob": True, "charlie": False}
    put = G.insert(people, spark.createDataFrame([("bob", "Robert")], "key string, name string"))
    assert put.where("key = 'bob'").first().age is None and put.count() == 3


def test_deep_traversal_cuts_lineage(spark):
    g = Graph(spark)
    rows = [(f"{i:03d}", f"{i + 1:03d}") for i in range(12)]
    g.create_table("n", spark.createDataFrame([(f"{i:03d}",) for i in range(13)], "key string"))
    g.create_link("next", Link("n", "n", spark.createDataFrame(rows, "src string, dst string")))
    assert go(g, "000", *["next"] * 9, table="n") == ["n.009"]
    reached = g.discover(g.start("n", "000"), 11).agg(F.max("hops")).first()[0]
    assert reached == 11


def test_link_entries(spark):
    a = spark.createDataFrame([("1",), ("2",), ("3",)], "key string")
    rows = spark.createDataFrame([("1", "2", 5, "x"), ("1", "3", None, None), ("3", "2", 7, "y")], "src string, dst string, w int, s string")
    g = G.Graph(spark, {"a": a}, {"to": G.Link("a", "a", rows)})
    shown = lambda df: sorted(map(tuple, df.select("src", "dst", "w").collect()))
    assert shown(g.entry("to", "1", "2")) == [("1", "2", 5)] and g.entry("to", "2", "1").isEmpty()
    ones = g.start("a", "1").unionByName(g.start("a", "1"))  # a repeated key gives its entries once
    assert len(g.outgoing("to", ones).collect()) == 2 and len(g.incoming("to", g.start("a", "2")).collect()) == 2
    new = spark.createDataFrame([("1", "2", 9), ("2", "3", 1)], "src string, dst string, w int")
    put = g.insert_entries("to", new)
    assert [r for r in shown(put.links["to"].entries) if r[2]] == [("1", "2", 9), ("2", "3", 1), ("3", "2", 7)]
    assert put.entry("to", "1", "2").first().s is None  # replaced as a whole
    merged = g.update_entries("to", new, removed=["s"]).links["to"].entries
    assert {(r.src, r.dst): (r.w, r.s) for r in merged.collect()} == {("1", "2"): (9, None), ("1", "3"): (None, None), ("3", "2"): (7, "y")}
    assert shown(g.delete_entries("to", new).links["to"].entries.fillna(0)) == [("1", "3", 0), ("3", "2", 7)]
    assert len(g.links["to"].entries.collect()) == 3  # the graph itself stays as it was
    with pytest.raises(G.NotFound):
        g.outgoing("from", ones)
