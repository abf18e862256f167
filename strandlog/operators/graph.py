"""Property graph: node and link tables, node queries, traversal, discovery, cascade.

A node table has `key` and one nullable column per property; `_set` (optional) marks nodes that have no
properties at all.  A link table has `src`, `dst` and property columns, and goes from one node table to another.

Traversal is level-synchronous: each hop joins the frontier with one link table, applies filters, drops what the
start has visited and keeps one row per node.  Frontiers are DataFrames, so one call serves any number of starts;
whether a side is broadcast is left to the optimizer, which knows its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.geo import near, within  # noqa: F401
from strandlog.functions.predicates import Condition, restrict
from strandlog.functions.scalars import check_name
from strandlog.operators import parcels
from strandlog.sources.shared import dropped_shuffles, settle

#: Up to this many hops make one lazy plan; each further hop is written to the shared folder, since a plan that holds
#: every level twice, as frontier and as visited nodes, would double with each hop.
LAZY_HOPS = 3
#: Up to this many paths of one start are compared together; `traverse` knows the bound from the links' largest fan-outs.
TOGETHER = 10_000
START, NODE = ["start_tbl", "start_key"], ["tbl", "key"]


class NotFound(KeyError):
    pass


@dataclass
class Link:
    source: str
    target: str
    entries: DataFrame
    bidirectional: bool = False
    cascade: bool = False


@dataclass
class Hop:
    """One step of a traversal."""

    link: str
    link_filter: Condition | None = None
    node_filter: Condition | None = None
    backwards: bool = False


@dataclass
class Page:
    rows: DataFrame
    limit: int
    sort: list[tuple[str, str]] = field(default_factory=list)

    def fetch(self) -> tuple[list, bool, object]:
        """At most `limit` rows, whether more follow, and the cursor that leads on."""
        got = self.rows.collect() if self.limit else self.rows.collect()
        more = bool(self.limit) and len(got) > self.limit
        got = got[: self.limit] if self.limit else got
        if not more or not got:
            return got, more, None
        last = got[-1]
        return got, more, ([last[f] for f, _ in self.sort], last["key"]) if self.sort else last["key"]


@dataclass
class Graph:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    links: dict[str, Link] = field(default_factory=dict)

    # ---- schema

    def create_table(self, name: str, nodes: DataFrame, if_not_exists: bool = False) -> None:
        if name in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table exists: {name}")
        self.tables[check_name(name)] = nodes

    def drop_table(self, name: str) -> None:
        """Links that use the table go with it."""
        if name not in self.tables:
            raise NotFound(name)
        del self.tables[name]
        self.links = {k: x for k, x in self.links.items() if name not in (x.source, x.target)}

    def create_link(self, name: str, link: Link, if_not_exists: bool = False) -> None:
        if name in self.links:
            if if_not_exists:
                return
            raise ValueError(f"link table exists: {name}")
        for end in (link.source, link.target):
            if end not in self.tables:
                raise NotFound(end)
        self.links[check_name(name)] = link

    def drop_link(self, name: str) -> None:
        if name not in self.links:
            raise NotFound(name)
        del self.links[name]

    def alter_link(self, name: str, bidirectional: bool | None = None, cascade: bool | None = None) -> None:
        old = self._link(name)
        self.links[name] = replace(
            old, bidirectional=old.bidirectional if bidirectional is None else bidirectional, cascade=old.cascade if cascade is None else cascade
        )

    def _link(self, name: str) -> Link:
        if name not in self.links:
            raise NotFound(name)
        return self.links[name]

    # ---- traversal

    def start(self, table: str, key: str) -> DataFrame:
        return self.spark.createDataFrame([(table, key)], "tbl string, key string")

    def traverse(self, starts: DataFrame, hops: Sequence[Hop | str], with_paths: bool = False) -> DataFrame:
        """(start_tbl, start_key, tbl, key[, path]) of the nodes first reached at the last hop.

        The path is the least in the order of its nodes; for text keys that is the one found first breadth-first.  No hops
        give the starts.  Starts need not exist.
        """
        hops = [Hop(h) if isinstance(h, str) else h for h in hops]
        for h in hops:
            self._link(h.link)
        frontier = starts.select(F.col("tbl").alias("start_tbl"), F.col("key").alias("start_key"), "tbl", "key").distinct()
        if with_paths:
            frontier = frontier.withColumn("path", F.array(F.struct("tbl", "key")))
        seen = frontier.select(*START, *NODE)
        fan_out = paths = 0
        for i, hop in enumerate(hops):
            if with_paths and len(hops) > 1 and (not i or 0 < fan_out <= TOGETHER):
                most, entries = self._fan_out(hop)
                fan_out, paths = (fan_out * most, paths * most) if i else (most, entries)
            if i and 0 < fan_out <= TOGETHER:
                frontier = self._step_together(frontier, seen, hop, i + 1, paths)
            elif not i and fan_out and len(self._ways(hop)) == 1:
                frontier = self._first_step(frontier, hop)
            else:
                reached = self._step(frontier, hop).join(seen, [*START, *NODE], "left_anti")
                if with_paths:
                    frontier = reached.groupBy(*START, *NODE).agg(F.min("path").alias("path"))
                else:
                    frontier = reached.select(*START, *NODE).distinct()
            if i + 1 < len(hops):
                if i + 1 >= LAZY_HOPS:
                    frontier = settle(frontier)
                    seen = settle(seen) if i + 1 == LAZY_HOPS else seen
                seen = seen.unionByName(frontier.select(*START, *NODE))
        return frontier

    def _ways(self, hop: Hop) -> list[tuple[str, str, DataFrame]]:
        """For each way over the hop's link: table it leads from, table it leads to, (_near, _far) of the entries that pass."""
        link = self._link(hop.link)
        entries = restrict(link.entries, hop.link_filter)
        ways = [(link.target, "dst", link.source, "src")] if hop.backwards else [(link.source, "src", link.target, "dst")]
        if link.bidirectional:
            ways.append((link.source, "src", link.target, "dst") if hop.backwards else (link.target, "dst", link.source, "src"))
        out = []
        for from_table, near, to_table, far in ways:
            pairs = entries.select(F.col(near).alias("_near"), F.col(far).alias("_far"))
            if hop.node_filter is not None:
                nodes = self._passing(to_table, hop.node_filter)
                pairs = pairs.join(nodes, F.col("_far") == F.col("_node"), "left_semi")
            out.append((from_table, to_table, pairs))
        return out

    def _fan_out(self, hop: Hop) -> tuple[int, int]:
        """The most entries that lead on from one node, and all entries; (0, 0) (not known) if any leads to a missing key."""
        total = entries = 0
        with dropped_shuffles(self.spark):
            for _, _, pairs in self._ways(replace(hop, node_filter=None)):
                by_node = pairs.groupBy("_near").agg(F.count("*").alias("n"), F.count("_far").alias("known"))
                most, n, lost = by_node.agg(F.max("n"), F.sum("n"), F.sum(F.col("n") - F.col("known"))).first()
                if lost:
                    return 0, 0
                total, entries = total + (most or 0), entries + (n or 0)
        return max(total, 1), entries

    def _lists(self, pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("_near").agg(F.collect_set("_far").alias("far"))

    def _first_step(self, frontier: DataFrame, hop: Hop) -> DataFrame:
        """The first frontier with paths over a link that leads one way: a start has one path yet, so nothing is compared."""
        ((from_table, to_table, pairs),) = self._ways(hop)
        met = frontier.where(F.col("tbl") == from_table).join(self._lists(pairs), F.col("key") == F.col("_near"))
        met = met.select(*START, "path", F.inline(F.arrays_zip("far")).alias("far"))
        met = met.where((F.col("start_tbl") != to_table) | (F.col("start_key") != F.col("far")))
        node = F.struct(F.lit(to_table).alias("tbl"), F.col("far").alias("key"))
        return met.select(*START, F.lit(to_table).alias("tbl"), F.col("far").alias("key"), F.concat("path", F.array(node)).alias("path"))

    def _step_together(self, frontier: DataFrame, seen: DataFrame, hop: Hop, length: int, paths: int) -> DataFrame:
        """The next frontier with paths (of `length` nodes so far), for starts of few paths each: what a node leads to travels to the
        start as one list, packed with many others, so that neither a row per path nor the paths' common part is shuffled."""
        nodes = [f"{c}{i}" for i in range(length) for c in "tk"]
        inner = [F.col("path")[i][c].alias(f"{c[0]}{i}") for i in range(1, length - 1) for c in ("tbl", "key")]
        ways = None
        for from_table, to_table, pairs in self._ways(hop):
            lists = parcels.encode(self._lists(pairs), ["_near"])
            one = frontier.where(F.col("tbl") == from_table).select(*START, *inner, *NODE).join(lists, F.col("key") == F.col("_near"))
            ends = {"t0": "start_tbl", "k0": "start_key", f"t{length - 1}": "tbl", f"k{length - 1}": "key"}
            one = one.select(*(F.col(ends.get(c, c)).alias(c) for c in nodes), F.lit(to_table).alias("to"), "gaps", "far")
            old = seen.where(F.col("tbl") == to_table).groupBy(*START).agg(F.collect_set("key").alias("far"))
            old = parcels.encode(old, START).withColumnsRenamed({"start_tbl": "t0", "start_key": "k0"})
            old = old.select("t0", "k0", *(F.lit(None).cast("string").alias(c) for c in nodes[2:]), F.lit(to_table).alias("to"), "gaps", "far")
            ways = one.unionByName(old) if ways is None else ways.unionByName(one).unionByName(old)
        each = parcels.compare(parcels.pack(ways, nodes, parcels.buckets(paths)), nodes)
        each = each.select(*nodes, "to", F.inline(F.arrays_zip("far")).alias("next"))
        path = [F.struct(F.col(f"t{i}").alias("tbl"), F.col(f"k{i}").alias("key")) for i in range(length)]
        last = F.struct(F.col("to").alias("tbl"), F.col("next").alias("key"))
        return each.select(F.col("t0").alias("start_tbl"), F.col("k0").alias("start_key"), F.col("to").alias("tbl"), F.col("next").alias("key"), F.array(*path, last).alias("path"))

    def _step(self, frontier: DataFrame, hop: Hop) -> DataFrame:
        out = None
        for from_table, to_table, pairs in self._ways(hop):
            met = frontier.where(F.col("tbl") == from_table).join(pairs, F.col("key") == F.col("_near"))
            met = met.withColumns({"tbl": F.lit(to_table), "key": F.col("_far")}).drop("_near", "_far")
            if "path" in met.columns:
                met = met.withColumn("path", F.concat("path", F.array(F.struct("tbl", "key"))))
            out = met if out is None else out.unionByName(met)
        return out

    def _passing(self, table: str, cond: Condition) -> DataFrame:
        """Keys of nodes that pass; nodes without properties never do."""
        nodes = self.tables[table]
        if "_set" in nodes.columns:
            nodes = nodes.where(~F.coalesce("_set", F.lit(False)))
        return restrict(nodes, cond).select(F.col("key").alias("_node"))

    def edges(self, reverse: bool) -> DataFrame:
        """All links as (tbl, key, to_tbl, to_key); with `reverse` bidirectional ones both ways."""
        out = None
        for x in self.links.values():
            one = x.entries.select(F.lit(x.source).alias("tbl"), F.col("src").alias("key"), F.lit(x.target).alias("to_tbl"), F.col("dst").alias("to_key"))
            two = one.select(F.col("to_tbl").alias("tbl"), F.col("to_key").alias("key"), F.col("tbl").alias("to_tbl"), F.col("key").alias("to_key"))
            one = one.unionByName(two) if reverse and x.bidirectional else one
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.spark.createDataFrame([], "tbl string, key string, to_tbl string, to_key string")
        return out

    def discover(self, starts: DataFrame, max_hops: int, bidirectional: bool = False) -> DataFrame:
        """(start_tbl, start_key, tbl, key, hops) of all nodes within `max_hops` over any link, the start left out."""
        edges = self.edges(bidirectional)
        first = starts.select(F.col("tbl").alias("start_tbl"), F.col("key").alias("start_key"), "tbl", "key").distinct()
        return spread(first.withColumn("hops", F.lit(0)), edges, max_hops).where("hops > 0")

    # ---- cascade

    def cascade(self, starts: DataFrame, everything: bool = False) -> DataFrame:
        """(tbl, key) of the nodes that go when the starts are deleted: over all links if `everything`, else cascading ones."""
        out = None
        for x in self.links.values():
            if not (everything or x.cascade):
                continue
            one = x.entries.select(F.lit(x.source).alias("tbl"), F.col("src").alias("key"), F.lit(x.target).alias("to_tbl"), F.col("dst").alias("to_key"))
            both = one.unionByName(one.select(F.col("to_tbl").alias("tbl"), F.col("to_key").alias("key"), F.col("tbl").alias("to_tbl"), F.col("key").alias("to_key")))
            out = both if out is None else out.unionByName(both)
        begun = starts.select(F.lit("").alias("start_tbl"), F.lit("").alias("start_key"), *NODE).distinct()
        if out is None:
            return begun.select(*NODE)
        return spread(begun.withColumn("hops", F.lit(0)), out, None).select(*NODE)

    def delete_cascade(self, starts: DataFrame, everything: bool = False) -> Graph:
        """The graph without the closure and without links that touch it."""
        gone = settle(self.cascade(starts, everything))
        left = Graph(self.spark, dict(self.tables), dict(self.links))
        for name, nodes in self.tables.items():
            left.tables[name] = nodes.join(gone.where(F.col("tbl") == name).select("key"), "key", "left_anti")
        for name, x in self.links.items():
            entries = x.entries
            for end, table in (("src", x.source), ("dst", x.target)):
                entries = entries.join(gone.where(F.col("tbl") == table).select(F.col("key").alias(end)), end, "left_anti")
            left.links[name] = replace(x, entries=entries.select(x.entries.columns))
        return left

    def delete_nodes(self, table: str, keys: DataFrame) -> Graph:
        """Delete nodes and all links that touch them."""
        left = Graph(self.spark, dict(self.tables), dict(self.links))
        left.tables[table] = self.tables[table].join(keys.select("key"), "key", "left_anti")
        for name, x in self.links.items():
            entries = x.entries
            for end, other in (("src", x.source), ("dst", x.target)):
                if other == table:
                    entries = entries.join(keys.select(F.col("key").alias(end)), end, "left_anti")
            left.links[name] = replace(x, entries=entries.select(x.entries.columns))
        return left

    # ---- links

    def entry(self, name: str, src: str, dst: str) -> DataFrame:
        """The entry between two nodes, or no row."""
        return self._link(name).entries.where((F.col("src") == src) & (F.col("dst") == dst))

    def outgoing(self, name: str, keys: DataFrame) -> DataFrame:
        """Entries that start at the given keys."""
        return self._at("src", name, keys)

    def incoming(self, name: str, keys: DataFrame) -> DataFrame:
        """Entries that end at the given keys."""
        return self._at("dst", name, keys)

    def _at(self, end: str, name: str, keys: DataFrame) -> DataFrame:
        entries = self._link(name).entries
        return entries.join(keys.select(F.col("key").alias(end)), end, "left_semi").select(entries.columns)

    def insert_entries(self, name: str, new: DataFrame) -> Graph:
        """Whole entries by source and target, new ones replacing old ones; `endpoint_violations` tells whether ends are missing."""
        return self._with_entries(name, _by_pair(insert(_by_key(self._link(name).entries), _by_key(new))))

    def update_entries(self, name: str, changes: DataFrame, removed: Sequence[str] = ()) -> Graph:
        """Merge properties into existing entries; those that don't exist stay missing."""
        merged = update(_by_key(self._link(name).entries), _by_key(changes), removed)
        return self._with_entries(name, _by_pair(merged.drop("_set")))

    def delete_entries(self, name: str, pairs: DataFrame) -> Graph:
        """Delete entries by source and target; nodes stay."""
        entries = self._link(name).entries
        return self._with_entries(name, entries.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti").select(entries.columns))

    def _with_entries(self, name: str, entries: DataFrame) -> Graph:
        return Graph(self.spark, dict(self.tables), {**self.links, name: replace(self._link(name), entries=entries)})

    def endpoint_violations(self, name: str) -> DataFrame:
        """Entries of a link of which an end doesn't exist."""
        x = self._link(name)
        src = x.entries.join(self.tables[x.source].select(F.col("key").alias("src")), "src", "left_anti").select(x.entries.columns)
        dst = x.entries.join(self.tables[x.target].select(F.col("key").alias("dst")), "dst", "left_anti").select(x.entries.columns)
        return src.unionByName(dst).dropDuplicates(["src", "dst"])

    def shortest_path(self, starts: DataFrame, table: str, key: str, max_hops: int, bidirectional: bool = False) -> DataFrame:
        """(start_tbl, start_key, hops) to one node, over any link."""
        found = self.discover(starts, max_hops, bidirectional)
        return found.where((F.col("tbl") == table) & (F.col("key") == key)).select(*START, "hops")


def spread(frontier: DataFrame, edges: DataFrame, max_hops: int | None) -> DataFrame:
    """All nodes reached, with the number of hops; without a bound until nothing new is found."""
    seen, hop = frontier, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        met = frontier.join(edges, NODE).select(*START, F.col("to_tbl").alias("tbl"), F.col("to_key").alias("key")).distinct()
        frontier = met.join(seen.select(*START, *NODE), [*START, *NODE], "left_anti").withColumn("hops", F.lit(hop))
        if max_hops is None or (hop >= LAZY_HOPS and hop < max_hops):
            frontier, seen = settle(frontier), settle(seen) if hop == LAZY_HOPS else seen
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


# ---- node queries


def order_by(sort: Sequence[tuple[str, str]], schema) -> list[Column]:
    """Missing values come first ascending and last descending; ties are in key order either way."""
    out = []
    for name, way in sort:
        if name in schema.names and name != "key":
            out.append(F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_first())
        elif name == "key" and way == "desc":
            out.append(F.col("key").desc())
    return [*out, F.col("key").asc()]


def _beyond(cursor, sort: Sequence[tuple[str, str]]) -> Column:
    """Rows after the cursor in the query's order: a row-value comparison that knows where missing values stand."""
    values, key = cursor if isinstance(cursor, tuple) else ([], cursor)
    out = F.col("key") > key
    for (name, way), value in reversed(list(zip(sort, values))):
        c = F.col(name)
        if value is None:
            after, same = (c.isNotNull() if way != "desc" else F.lit(False)), c.isNull()
        else:
            after = (c > F.lit(value)) if way != "desc" else ((c < F.lit(value)) | c.isNull())
            same = c == F.lit(value)
        out = F.coalesce(after, F.lit(False)) | (F.coalesce(same, F.lit(False)) & out)
    return out


def query(nodes: DataFrame, where: Condition | None = None, sort: Sequence[tuple[str, str]] = (), fields: Sequence[str] | dict[str, str] | None = None, limit: int = 0, cursor=None, offset: int = 0) -> DataFrame:
    """Filter, sort, cut and project; a limit of 0 is none.  Rows have an order if a sort, limit or offset asks for one.  `fields` keeps the key; a dict renames (new name -> property)."""
    out = restrict(nodes, where)
    if cursor is not None:
        out = out.where(_beyond(cursor, sort))
    if sort or limit or offset:
        out = out.orderBy(*order_by(sort, nodes.schema))
    if offset:
        out = out.offset(offset)
    if limit:
        out = out.limit(limit)
    if fields is None:
        return out
    wanted = fields if isinstance(fields, dict) else {f: f for f in fields}
    return out.select("key", *[F.col(f).alias(n) for n, f in wanted.items() if f in nodes.columns and n != "key"])


def page(nodes: DataFrame, limit: int, where: Condition | None = None, sort: Sequence[tuple[str, str]] = (), cursor=None) -> Page:
    """One page; a row more than `limit` is read to know whether more follow."""
    return Page(query(nodes, where, sort, None, limit + 1 if limit else 0, cursor), limit, list(sort))


def count(nodes: DataFrame, where: Condition | None = None) -> DataFrame:
    return restrict(nodes, where).agg(F.count("*").alias("n"))


def _by_key(entries: DataFrame) -> DataFrame:
    return entries.select(F.struct("src", "dst").alias("key"), *[c for c in entries.columns if c not in ("src", "dst")])


def _by_pair(rows: DataFrame) -> DataFrame:
    return rows.select("key.src", "key.dst", *[c for c in rows.columns if c != "key"])


def insert(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Whole rows by key, new ones replacing old ones."""
    return nodes.join(new.select("key"), "key", "left_anti").unionByName(new, allowMissingColumns=True)


def update(nodes: DataFrame, changes: DataFrame, removed: Sequence[str] = ()) -> DataFrame:
    """Merge properties into existing nodes: what is given wins, `removed` properties go."""
    new = changes.select("key", *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != "key"], F.lit(True).alias("_hit"))
    met = nodes.join(new, "key", "left")
    cols = [c for c in dict.fromkeys([*nodes.columns, *changes.columns]) if c not in ("key", "_set")]

    def value(c: str) -> Column:
        old = F.col(c) if c in nodes.columns else F.lit(None)
        out = F.coalesce(f"_new_{c}", old) if c in changes.columns else old
        return (F.when(F.col("_hit").isNull(), out) if c in removed else out).alias(c)

    out = met.select("key", *[value(c) for c in cols])
    if "_set" in nodes.columns or removed:
        empty = F.lit(True)
        for c in cols:
            empty = empty & F.col(c).isNull()
        out = out.withColumn("_set", empty)
    return out


def missing_keys(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Keys that an update would not find."""
    return changes.select("key").join(nodes.select("key"), "key", "left_anti")


def merge_maps(old: Column, new: Column) -> Column:
    """For properties kept as a map: new values win, null removes, an empty result becomes null."""
    merged = F.map_zip_with(F.coalesce(old, F.create_map().cast("map<string,string>")), new, lambda _, o, n: F.coalesce(n, o))
    kept = F.map_filter(merged, lambda k, v: v.isNotNull() & ~F.coalesce(F.map_contains_key(new, k) & F.element_at(new, k).isNull(), F.lit(False)))
    return F.when(F.size(kept) > 0, kept)
