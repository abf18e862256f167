"""Graph queries: node queries, expansion, traversal, discovery, cascade, history, places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.catalogue.functions import NODES, nodes
from strandlog.catalogue.registry import query
from strandlog.functions.predicates import Eq, Ge, Gt, Like, Lt
from strandlog.operators import graph as G
from strandlog.operators import log as L
from strandlog.operators.graph import Hop
from strandlog.plans.lang import run_query
from strandlog.sources import datasets as D
from strandlog.sources.datasets import NOW_MS

# ---- node queries


@query("q_filter_project", f"WITH {NODES} SELECT key, segment, rank FROM c WHERE coalesce(rank > 50, false)")
def q_filter_project(spark, d):
    return G.query(nodes(spark, d), Gt("rank", 50), fields=["segment", "rank"])


@query("q_sort_asc", f"WITH {NODES} SELECT key, acctbal FROM c ORDER BY acctbal ASC NULLS FIRST, key LIMIT 400")
def q_sort_asc(spark, d):
    """Missing values first, ties by key."""
    return G.query(nodes(spark, d), sort=[("acctbal", "asc")], fields=["acctbal"], limit=400)


@query("q_sort_desc", f"WITH {NODES} SELECT key, rank FROM c ORDER BY rank DESC NULLS LAST, key LIMIT 100")
def q_sort_desc(spark, d):
    return G.query(nodes(spark, d), sort=[("rank", "desc")], fields=["rank"], limit=100)


@query("q_sort_many", f"WITH {NODES} SELECT key, segment, acctbal FROM c ORDER BY segment ASC NULLS FIRST, acctbal DESC NULLS LAST, key LIMIT 500")
def q_sort_many(spark, d):
    return G.query(nodes(spark, d), sort=[("segment", "asc"), ("acctbal", "desc")], fields=["segment", "acctbal"], limit=500)


@query("q_rename", f"WITH {NODES} SELECT key, segment AS market, acctbal AS balance FROM c")
def q_rename(spark, d):
    return G.query(nodes(spark, d), fields={"market": "segment", "balance": "acctbal"})


@query("q_keyset", f"WITH {NODES} SELECT key, segment FROM c WHERE key > 40 ORDER BY key LIMIT 20")
def q_keyset(spark, d):
    return G.query(nodes(spark, d), fields=["segment"], limit=20, cursor=40)


@query("q_keyset_sorted", f"""WITH {NODES} SELECT key, rank FROM c WHERE rank > 30 OR (rank = 30 AND key > 130) ORDER BY rank NULLS FIRST, key LIMIT 20""")
def q_keyset_sorted(spark, d):
    """The cursor of a sorted query holds the sort value and the key."""
    return G.query(nodes(spark, d), sort=[("rank", "asc")], fields=["rank"], limit=20, cursor=([30], 130))


@query("q_keyset_missing", f"WITH {NODES} SELECT key, coalesce(rank, -1) AS rank FROM c WHERE rank IS NULL AND key > 60 OR rank IS NOT NULL ORDER BY c.rank NULLS FIRST, key LIMIT 300")
def q_keyset_missing(spark, d):
    return G.query(nodes(spark, d), sort=[("rank", "asc")], fields=["rank"], limit=300, cursor=([None], 60)).select("key", F.coalesce("rank", F.lit(-1)).alias("rank"))


@query("q_count", f"WITH {NODES} SELECT count(*) AS n FROM c WHERE coalesce(segment = 'BUILDING', false)")
def q_count(spark, d):
    return G.count(nodes(spark, d), Eq("segment", "BUILDING"))


@query("q_language", f"WITH {NODES} SELECT key, rank FROM c WHERE coalesce(segment = 'BUILDING', false) AND coalesce(rank > 30, false) ORDER BY rank DESC NULLS LAST, key LIMIT 10")
def q_language(spark, d):
    """The same through the expression language."""
    graph = G.Graph(spark, {"customer": nodes(spark, d)})
    return run_query(graph, "?:10{customer | segment=BUILDING, rank>30}[rank:desc]").select("key", "rank")


# ---- node writes


@query("node_insert", """SELECT key, segment FROM (SELECT c_custkey AS key, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer)
  UNION ALL SELECT c_custkey + 10000000, 'NEW' FROM customer WHERE c_custkey % 10 = 0""")
def node_insert(spark, d):
    """Insert replaces whole rows and adds new ones."""
    old = D.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    tenth = old.where("key % 10 = 0")
    new = tenth.select("key", F.lit("NEW").alias("segment")).unionByName(tenth.select((F.col("key") + 10_000_000).alias("key"), F.lit("NEW").alias("segment")))
    return G.insert(old, new)


@query("node_update", f"WITH {NODES} SELECT key, CASE WHEN key % 2 = 0 THEN 'EVEN' ELSE segment END AS segment, rank::VARCHAR AS rank, CASE WHEN key % 2 = 0 THEN '1' END AS level FROM c")
def node_update(spark, d):
    """Merge: given properties win, others stay."""
    base = nodes(spark, d).select("key", "segment", F.col("rank").cast("string").alias("rank"))
    change = base.where("key % 2 = 0").select("key", F.lit("EVEN").alias("segment"), F.lit("1").alias("level"))
    return G.update(base, change)


@query("node_update_nulls", f"""WITH {NODES} SELECT key, CASE WHEN key % 2 = 0 THEN NULL ELSE segment END AS segment, rank::VARCHAR AS rank,
  (key % 2 = 0 OR segment IS NULL) AND rank IS NULL AS _set FROM c""")
def node_update_nulls(spark, d):
    """A null removes the property; a node that is left with none has no properties at all."""
    base = nodes(spark, d).select("key", "segment", F.col("rank").cast("string").alias("rank"))
    return G.update(base, base.where("key % 2 = 0").select("key"), removed=["segment"])


@query("node_update_missing", "SELECT c_custkey + 10000000 AS key FROM customer WHERE c_custkey % 10 = 0")
def node_update_missing(spark, d):
    base = nodes(spark, d)
    return G.missing_keys(base, base.where("key % 10 = 0").select((F.col("key") + 10_000_000).alias("key")))


@query("node_merge_maps", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'b=2' WHEN c_custkey % 3 = 1 THEN 'a=9,b=2' ELSE 'a=1' END AS props FROM customer")
def node_merge_maps(spark, d):
    """Properties kept as a map: {a:1} merged with {a:null,b:2}, {a:9,b:2} or nothing."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    old = F.create_map(F.lit("a"), F.lit("1"))
    new = (
        F.when(k % 3 == 0, F.create_map(F.lit("a"), none, F.lit("b"), F.lit("2")))
        .when(k % 3 == 1, F.create_map(F.lit("a"), F.lit("9"), F.lit("b"), F.lit("2")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    pairs = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e.key, e.value))
    return D.table(spark, d, "customer").select(k.alias("key"), G.merge_maps(old, new).alias("m")).select("key", F.array_join(pairs, ",").alias("props"))


# ---- links


@query("link_get", "SELECT o_orderkey::VARCHAR AS src, o_custkey::VARCHAR AS dst, o_totalprice AS total FROM orders WHERE o_orderkey = 5")
def link_get(spark, d):
    g = D.commerce_graph(spark, d)
    dst = D.table(spark, d, "orders").where("o_orderkey = 5").select(F.col("o_custkey").cast("string")).first()
    return g.entry("placed-by", "5", dst[0] if dst else "")


@query("expand_out", "SELECT DISTINCT l_partkey::VARCHAR AS dst FROM lineitem WHERE l_orderkey = 7")
def expand_out(spark, d):
    g = D.commerce_graph(spark, d)
    return g.outgoing("contains", g.start("orders", "7")).select("dst")


@query("expand_in", "SELECT c_custkey::VARCHAR AS src FROM customer WHERE c_nationkey = 3")
def expand_in(spark, d):
    g = D.commerce_graph(spark, d)
    return g.incoming("customer-of", g.start("nation", "3")).select("src")


@query("link_query", "SELECT l_orderkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity::DECIMAL(18,2)) > 60")
def link_query(spark, d):
    entries = D.commerce_graph(spark, d).links["contains"].entries
    return G.restrict(entries, Gt("quantity", 60.0))


@query("endpoint_violations", "SELECT c_custkey::VARCHAR AS src, (c_nationkey + 20)::VARCHAR AS dst FROM customer WHERE c_nationkey + 20 > 24")
def endpoint_violations(spark, d):
    """Links to nations that don't exist."""
    g = D.commerce_graph(spark, d)
    rows = D.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("src"), (F.col("c_nationkey") + 20).cast("string").alias("dst"))
    g.create_link("moved-to", G.Link("customer", "nation", rows))
    return g.endpoint_violations("moved-to")


@query("link_delete", "SELECT o_orderkey::VARCHAR AS src, o_custkey::VARCHAR AS dst FROM orders WHERE o_orderkey % 2 = 1")
def link_delete(spark, d):
    g = D.commerce_graph(spark, d)
    gone = g.links["placed-by"].entries.where("CAST(src AS BIGINT) % 2 = 0")
    return g.delete_entries("placed-by", gone).links["placed-by"].entries.select("src", "dst")


@query("link_insert", """SELECT o_orderkey::VARCHAR AS src, o_custkey::VARCHAR AS dst, CASE WHEN o_orderkey % 5 = 0 THEN 1.5 ELSE o_totalprice::DOUBLE END AS total FROM orders
  UNION ALL SELECT 'new' || c_custkey, c_custkey::VARCHAR, 2.5 FROM customer""")
def link_insert(spark, d):
    """Entries are known by both ends: a fifth is replaced, one for each customer is new."""
    g = D.commerce_graph(spark, d)
    again = g.links["placed-by"].entries.where("CAST(src AS BIGINT) % 5 = 0").select("src", "dst", F.lit(1.5).alias("total"))
    new = g.tables["customer"].select(F.concat(F.lit("new"), "key").alias("src"), F.col("key").alias("dst"), F.lit(2.5).alias("total"))
    return g.insert_entries("placed-by", again.unionByName(new)).links["placed-by"].entries.select("src", "dst", F.col("total").cast("double").alias("total"))


@query("link_update", """SELECT o_orderkey::VARCHAR AS src, o_custkey::VARCHAR AS dst, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice::DOUBLE END AS total,
  CASE WHEN o_orderkey % 3 = 0 THEN 'settled' END AS state FROM orders""")
def link_update(spark, d):
    """A third of the entries get a property and lose another; an entry that doesn't exist is not made."""
    g = D.commerce_graph(spark, d)
    third = g.links["placed-by"].entries.where("CAST(src AS BIGINT) % 3 = 0").select("src", "dst")
    nowhere = g.tables["customer"].select(F.lit("none").alias("src"), F.col("key").alias("dst"))
    changed = g.update_entries("placed-by", third.unionByName(nowhere).withColumn("state", F.lit("settled")), removed=["total"])
    return changed.links["placed-by"].entries.select("src", "dst", F.col("total").cast("double").alias("total"), "state")


@query("link_count", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000")
def link_count(spark, d):
    return G.count(D.commerce_graph(spark, d).links["placed-by"].entries, Gt("total", 1000.0))


# ---- traversal


def _leaves(df: DataFrame) -> DataFrame:
    return df.select("tbl", "key")


@query("trav_1hop", "SELECT 'customer' AS tbl, o_custkey::VARCHAR AS key FROM orders WHERE o_orderkey = 11")
def trav_1hop(spark, d):
    g = D.commerce_graph(spark, d)
    return _leaves(g.traverse(g.start("orders", "11"), ["placed-by"]))


@query("trav_3hop", """SELECT 'orders' AS tbl, o_orderkey::VARCHAR AS key FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE n_regionkey = 2 AND c_mktsegment = 'BUILDING'""")
def trav_3hop(spark, d):
    """Region to its orders, against the links' direction, by way of customers of one segment."""
    g = D.commerce_graph(spark, d)
    hops = [Hop("in-region", backwards=True), Hop("customer-of", node_filter=Eq("segment", "BUILDING"), backwards=True), Hop("placed-by", backwards=True)]
    return _leaves(g.traverse(g.start("region", "2"), hops))


@query("trav_forward", "SELECT 'region' AS tbl, n_regionkey::VARCHAR AS key FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 20")
def trav_forward(spark, d):
    g = D.commerce_graph(spark, d)
    return _leaves(g.traverse(g.start("orders", "20"), ["placed-by", "customer-of", "in-region"]))


@query("trav_link_filter", "SELECT DISTINCT 'orders' AS tbl, o_orderkey::VARCHAR AS key FROM orders WHERE o_custkey BETWEEN 1 AND 20 AND o_totalprice > 1000")
def trav_link_filter(spark, d):
    g = D.commerce_graph(spark, d)
    starts = g.tables["customer"].where("CAST(key AS BIGINT) BETWEEN 1 AND 20").select(F.lit("customer").alias("tbl"), "key")
    return _leaves(g.traverse(starts, [Hop("placed-by", link_filter=Gt("total", 1000.0), backwards=True)])).distinct()


@query("trav_link_filter_all", "SELECT DISTINCT 'orders' AS tbl, o_orderkey::VARCHAR AS key FROM orders WHERE o_totalprice > 1000")
def trav_link_filter_all(spark, d):
    g = D.commerce_graph(spark, d)
    starts = g.tables["customer"].select(F.lit("customer").alias("tbl"), "key")
    return _leaves(g.traverse(starts, [Hop("placed-by", link_filter=Gt("total", 1000.0), backwards=True)])).distinct()


@query("trav_node_filter", "SELECT DISTINCT 'part' AS tbl, p_partkey::VARCHAR AS key FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey < 50 AND p_size < 10")
def trav_node_filter(spark, d):
    g = D.commerce_graph(spark, d)
    starts = g.tables["orders"].where("CAST(key AS BIGINT) < 50").select(F.lit("orders").alias("tbl"), "key")
    return _leaves(g.traverse(starts, [Hop("contains", node_filter=Lt("size", 10))])).distinct()


@query("trav_node_filter_all", "SELECT DISTINCT 'part' AS tbl, p_partkey::VARCHAR AS key FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def trav_node_filter_all(spark, d):
    g = D.commerce_graph(spark, d)
    starts = g.tables["orders"].select(F.lit("orders").alias("tbl"), "key")
    return _leaves(g.traverse(starts, [Hop("contains", node_filter=Lt("size", 10))])).distinct()


@query("trav_paths", """SELECT start_key, min('orders/' || start_key || ' part/' || l_partkey || ' supplier/' || l_suppkey) AS path, l_suppkey::VARCHAR AS key FROM
  (SELECT a.l_orderkey::VARCHAR AS start_key, b.l_partkey, b.l_suppkey FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_orderkey < 10) GROUP BY 1, 3""")
def trav_paths(spark, d):
    """One path per leaf and start: the least."""
    g = D.commerce_graph(spark, d)
    starts = g.tables["orders"].where("CAST(key AS BIGINT) < 10").select(F.lit("orders").alias("tbl"), "key")
    found = g.traverse(starts, ["contains", "supplied-by"], with_paths=True)
    shown = F.concat_ws(" ", *(F.concat_ws("/", F.col("path")[i].tbl, F.col("path")[i].key) for i in range(3)))
    return found.select("start_key", shown.alias("path"), "key")


@query("trav_paths_all", """SELECT start_key, min('orders/' || start_key || ' part/' || l_partkey || ' supplier/' || l_suppkey) AS path, l_suppkey::VARCHAR AS key FROM
  (SELECT a.l_orderkey::VARCHAR AS start_key, b.l_partkey, b.l_suppkey FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey) GROUP BY 1, 3""")
def trav_paths_all(spark, d):
    """One path per leaf and start: the least."""
    g = D.commerce_graph(spark, d)
    starts = g.tables["orders"].select(F.lit("orders").alias("tbl"), "key")
    found = g.traverse(starts, ["contains", "supplied-by"], with_paths=True)
    shown = F.concat_ws(" ", *(F.concat_ws("/", F.col("path")[i].tbl, F.col("path")[i].key) for i in range(3)))
    return found.select("start_key", shown.alias("path"), "key")


@query("trav_bidi", """SELECT a.k AS start_key, s_suppkey::VARCHAR AS key FROM supplier JOIN (SELECT s_nationkey AS n, min(s_suppkey::VARCHAR) AS k FROM supplier GROUP BY 1) a
  ON s_nationkey = a.n AND s_suppkey::VARCHAR <> a.k""")
def trav_bidi(spark, d):
    """A link that goes both ways: from each nation's first supplier to the nation and on to its others; the start was visited."""
    g = D.commerce_graph(spark, d)
    first = g.links["supplier-of"].entries.groupBy("dst").agg(F.min("src").alias("key"))
    return g.traverse(first.select(F.lit("supplier").alias("tbl"), "key"), ["supplier-of", "supplier-of"]).select("start_key", "key")


@query("trav_no_hops", "SELECT 'nation' AS tbl, '4' AS key")
def trav_no_hops(spark, d):
    g = D.commerce_graph(spark, d)
    return _leaves(g.traverse(g.start("nation", "4"), []))


@query("trav_many_starts", "SELECT c_nationkey::VARCHAR AS start_key, count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def trav_many_starts(spark, d):
    """Every nation is a start; what each has visited is kept apart."""
    g = D.commerce_graph(spark, d)
    starts = g.tables["nation"].select(F.lit("nation").alias("tbl"), "key")
    found = g.traverse(starts, [Hop("customer-of", backwards=True), Hop("placed-by", backwards=True)])
    return found.groupBy("start_key").agg(F.count("*").alias("n"))


@query("trav_asof", """SELECT DISTINCT 'user' AS tbl, user_id::VARCHAR AS key FROM events WHERE event_type = 'click' AND (epoch_us(ts) // 1000) <= 1705000000000""")
def trav_asof(spark, d):
    """Traversal of the graph as it was: type to users, over the links that existed then."""
    e = D.text_key_log(spark, d)
    rows = e.where(F.col("rev.ts_ms") <= 1_705_000_000_000).select(F.col("ns").alias("src"), F.substring("key_s", 2, 20).alias("dst")).distinct()
    g = G.Graph(spark)
    g.create_table("type", rows.select(F.col("src").alias("key")).distinct())
    g.create_table("user", rows.select(F.col("dst").alias("key")).distinct())
    g.create_link("made-by", G.Link("type", "user", rows))
    return _leaves(g.traverse(g.start("type", "click"), ["made-by"]))


_ALL_LINKS = """l AS (SELECT 'nation' AS a, n_nationkey::VARCHAR AS ak, 'region' AS b, n_regionkey::VARCHAR AS bk FROM nation
  UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'nation', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, 'nation', s_nationkey::VARCHAR FROM supplier
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'customer', o_custkey::VARCHAR FROM orders
  UNION ALL SELECT DISTINCT 'orders', l_orderkey::VARCHAR, 'part', l_partkey::VARCHAR FROM lineitem
  UNION ALL SELECT DISTINCT 'part', l_partkey::VARCHAR, 'supplier', l_suppkey::VARCHAR FROM lineitem)"""


@query("discover_2", f"""WITH {_ALL_LINKS}, h1 AS (SELECT DISTINCT b, bk FROM l WHERE a = 'orders' AND ak = '15'),
  h2 AS (SELECT DISTINCT l.b, l.bk FROM h1 JOIN l ON h1.b = l.a AND h1.bk = l.ak EXCEPT SELECT * FROM h1)
  SELECT b AS tbl, bk AS key, 1 AS hops FROM h1 UNION ALL SELECT b, bk, 2 FROM h2""")
def discover_2(spark, d):
    g = D.commerce_graph(spark, d)
    return g.discover(g.start("orders", "15"), 2).select("tbl", "key", "hops")


@query("discover_bidi", f"""WITH {_ALL_LINKS}, e AS (SELECT * FROM l UNION ALL SELECT b, bk, a, ak FROM l WHERE a = 'supplier'),
  h1 AS (SELECT DISTINCT b, bk FROM e WHERE a = 'supplier' AND ak = '2'),
  h2 AS (SELECT DISTINCT e.b, e.bk FROM h1 JOIN e ON h1.b = e.a AND h1.bk = e.ak WHERE NOT (e.b = 'supplier' AND e.bk = '2') EXCEPT SELECT * FROM h1)
  SELECT b AS tbl, bk AS key FROM h1 UNION ALL SELECT b, bk FROM h2""")
def discover_bidi(spark, d):
    g = D.commerce_graph(spark, d)
    return _leaves(g.discover(g.start("supplier", "2"), 2, bidirectional=True))


@query("shortest_path", "SELECT o_orderkey::VARCHAR AS start_key, 3 AS hops FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND o_orderkey < 200 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def shortest_path(spark, d):
    """Hops from orders without lines to a region."""
    g = D.commerce_graph(spark, d)
    lined = g.links["contains"].entries.select(F.col("src").alias("key"))
    starts = g.tables["orders"].where("CAST(key AS BIGINT) < 200").join(lined, "key", "left_anti").select(F.lit("orders").alias("tbl"), "key")
    return g.shortest_path(starts, "region", "1", 3).select("start_key", "hops")


@query("shortest_path_all", "SELECT o_orderkey::VARCHAR AS start_key, 3 AS hops FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def shortest_path_all(spark, d):
    """Hops from orders without lines to a region."""
    g = D.commerce_graph(spark, d)
    lined = g.links["contains"].entries.select(F.col("src").alias("key"))
    starts = g.tables["orders"].join(lined, "key", "left_anti").select(F.lit("orders").alias("tbl"), "key")
    return g.shortest_path(starts, "region", "1", 3).select("start_key", "hops")


# ---- deletion

_CLOSURE = """RECURSIVE l AS (SELECT 'customer/' || c_custkey AS a, 'nation/' || c_nationkey AS b FROM customer UNION ALL SELECT 'orders/' || o_orderkey, 'customer/' || o_custkey FROM orders),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), gone AS (SELECT 'customer/3' AS x UNION SELECT e.b FROM gone JOIN e ON gone.x = e.a)"""


@query("cascade_closure", f"WITH {_CLOSURE} SELECT split_part(x, '/', 1) AS tbl, split_part(x, '/', 2) AS key FROM gone")
def cascade_closure(spark, d):
    """Deleting a customer cascades over the links that say so, in both directions."""
    g = D.commerce_graph(spark, d)
    return g.cascade(g.start("customer", "3"))


@query("cascade_survivors", f"""WITH {_CLOSURE} SELECT 'customer' AS tbl, count(*) AS n FROM customer WHERE 'customer/' || c_custkey NOT IN (SELECT x FROM gone)
  UNION ALL SELECT 'placed-by', count(*) FROM orders WHERE 'orders/' || o_orderkey NOT IN (SELECT x FROM gone)
  UNION ALL SELECT 'customer-of', count(*) FROM customer WHERE 'customer/' || c_custkey NOT IN (SELECT x FROM gone)
  UNION ALL SELECT 'in-region', count(*) FROM nation WHERE 'nation/' || n_nationkey NOT IN (SELECT x FROM gone)""")
def cascade_survivors(spark, d):
    g = D.commerce_graph(spark, d)
    left = g.delete_cascade(g.start("customer", "3"))
    counted = [left.tables["customer"].select(F.lit("customer").alias("tbl"))]
    counted += [left.links[n].entries.select(F.lit(n).alias("tbl")) for n in ("placed-by", "customer-of", "in-region")]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out.groupBy("tbl").agg(F.count("*").alias("n"))


@query("node_delete", "SELECT o_orderkey::VARCHAR AS src, o_custkey::VARCHAR AS dst FROM orders WHERE o_custkey % 10 <> 3")
def node_delete(spark, d):
    """A plain delete removes the node's links and nothing else."""
    g = D.commerce_graph(spark, d)
    left = g.delete_nodes("customer", g.tables["customer"].where("CAST(key AS BIGINT) % 10 = 3"))
    return left.links["placed-by"].entries.select("src", "dst")


# ---- history of nodes


@query("node_history", "SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_type AS status FROM events WHERE user_id < 20")
def node_history(spark, d):
    """Nodes are users, their status is the kind of their last event; every revision keeps its own id."""
    e = D.table(spark, d, "events").where("user_id < 20")
    log = e.select(F.col("user_id").cast("string").alias("key"), L.revision(F.lit(0), F.col("event_id")).alias("rev"), F.col("event_type").alias("status"))
    return L.history(log, ["key"]).select("key", F.col("index").alias("i"), "status")


@query("node_history_all", "SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_type AS status FROM events")
def node_history_all(spark, d):
    """Nodes are users, their status is the kind of their last event; every revision keeps its own id."""
    e = D.table(spark, d, "events")
    log = e.select(F.col("user_id").cast("string").alias("key"), L.revision(F.lit(0), F.col("event_id")).alias("rev"), F.col("event_type").alias("status"))
    return L.history(log, ["key"]).select("key", F.col("index").alias("i"), "status")


@query("node_at_revision", "SELECT key, status FROM (SELECT user_id::VARCHAR AS key, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE i = 3")
def node_at_revision(spark, d):
    e = D.table(spark, d, "events")
    log = e.select(F.col("user_id").cast("string").alias("key"), L.revision(F.lit(0), F.col("event_id")).alias("rev"), F.col("event_type").alias("status"))
    return L.rev_get(log, 3, ["key"]).select("key", "status")


# ---- places

_PLACES = "p AS (SELECT c_custkey AS key, (c_custkey % 180) - 90 AS lat, (c_custkey * 7 % 360) - 180 AS lon FROM customer)"


def _places(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return D.table(spark, d, "customer").select(
        k.alias("key"), F.struct(((k % 180) - 90).cast("double").alias("lat"), ((k * 7 % 360) - 180).cast("double").alias("lon")).alias("place")
    )


@query("geo_within", f"WITH {_PLACES} SELECT key FROM p WHERE lat BETWEEN 10 AND 40 AND lon BETWEEN -20 AND 60")
def geo_within(spark, d):
    return _places(spark, d).where(G.within(F.col("place"), 10, -20, 40, 60)).select("key")


@query("geo_near", f"""WITH {_PLACES} SELECT key FROM p WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - 48.0) / 2), 2)
  + cos(radians(lat)) * cos(radians(48.0)) * pow(sin(radians(lon - 11.0) / 2), 2)))) <= 3000000""")
def geo_near(spark, d):
    return _places(spark, d).where(G.near(F.col("place"), 48.0, 11.0, 3_000_000)).select("key")


# ---- roadmap: aggregation over a filtered node set


@query("agg_group", f"WITH {NODES} SELECT segment, count(*) AS n, max(rank) AS top FROM c WHERE coalesce(name LIKE 'Customer%', false) AND coalesce(rank >= 10, false) GROUP BY segment")
def agg_group(spark, d):
    rows = nodes(spark, d)
    return G.query(rows, Like("name", "Customer%") & Ge("rank", 10)).groupBy("segment").agg(F.count("*").alias("n"), F.max("rank").alias("top"))


@query("stats_graph", "SELECT 'customer' AS tbl, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def stats_graph(spark, d):
    g = D.commerce_graph(spark, d)
    out = None
    for name in ("customer", "orders", "part"):
        one = G.count(g.tables[name]).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("q_live_nodes", f"""SELECT user_id::VARCHAR AS key FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
  WHERE rn = 1 AND event_type <> 'error' AND (event_type <> 'view' OR (epoch_us(ts) // 1000) + 3600000 > {NOW_MS})""")
def q_live_nodes(spark, d):
    """Nodes with an expiry: the live view of their revisions."""
    return L.live(D.event_log(spark, d), NOW_MS).select(F.col("key_i").cast("string").alias("key"))
