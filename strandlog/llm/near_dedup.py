"""Near-duplicates: fast similarity sketches, banding, exact verification, connected components.

A document's set holds the hashes of its distinct word shingles.  Its sketch has `BANDS * ROWS` coordinates, filled in
rounds: in each of the first rounds every element is thrown into one coordinate, and a coordinate keeps the least
value of the earliest round that reached it; after as many rounds as there are coordinates, each further round fills one
coordinate with the least over all elements.  So every coordinate is filled, agreement estimates similarity as
sharply as independent hashing does, and a set of n elements costs about n + t log t steps, not n * t.

1. Equal sets form one class, whatever their number; only classes go on.  Classes are numbered; a class is known by
   its set alone, so ids may be of any size or sign, missing, or repeated with other texts.
2. Bands of `ROWS` coordinates put classes into buckets.  In each bucket every class is compared with the least
   class only; a link is confirmed on the full sets (100 * intersection >= percent * union).
3. Components of these links.  Buckets that still hold several components are searched exactly: two sets that are similar
   enough share an element among their rarest ones (prefix filter), so classes of different components meet by
   those, and what meets is confirmed on the full sets.  Classes of the commonest component at an element aren't paired
   with each other; those of many different components that share a rare element are.
4. Components of these components by the links found so.  Each document gets the least id of its component.

Two sets at the threshold of 0.8 share no band with probability below 1e-5.

Cases: null texts and texts without words have no set and are linked with nothing; fewer words than a
shingle form one shingle; rows that repeat an id are judged by their own texts; documents with a null id belong to
components but give the component's id only if no member has one (then it is null), and are kept just then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import Scratch, add_columns, hot_join, small_join, text_key
from strandlog.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 80
BANDS, ROWS = 50, 7
#: Rarer elements of a set that are looked at before one of its prefix makes it meet others.
AHEAD = 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _turn(k: int) -> np.uint64:
    return np.uint64(k * int(_STEP) & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and the offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(_LOWER[raw].tobytes())], offset=texts.offset)
    split = pc.ascii_split_whitespace(low)
    flat, cuts = split.flatten(), split.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[cuts - cuts[0]]
    coded = flat.filter(full).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    at = known[coded.indices.to_numpy()] if len(known) else known
    n = np.diff(ends)
    chain = _mix(at + _STEP)
    if len(at):
        doc_end = np.repeat(ends[1:], n)
        where = np.arange(len(at))
        for k in range(1, words):
            more = where + k < doc_end
            chain[more] = _mix(chain[more] * _STEP + at[where[more] + k])
    out, sizes = [], np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n):
        own = np.unique(chain[ends[i] : max(ends[i] + 1, ends[i + 1] - words + 1)])
        sizes[i] = len(own)
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def sketches(flat: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """[sets, size] coordinates; sets without elements get all ones."""
    sets = len(ends) - 1
    n = np.diff(ends)
    out = np.full((sets, size), _NONE, np.uint64)
    live = np.flatnonzero(n)
    element, of = flat, np.repeat(np.arange(sets), n)
    for turn in range(2 * size):
        if not len(live):
            break
        hashes = _mix(element + _turn(turn + 1))
        if turn < size:
            place = of * size + ((hashes >> np.uint64(40)) * np.uint64(size) >> np.uint64(24)).astype(np.int64)
            least = np.full(sets * size, _NONE, np.uint64)
            np.minimum.at(least, place, hashes >> np.uint64(1))
            least = least.reshape(sets, size)
            new = (out == _NONE) & (least != _NONE)
            out[new] = least[new]
        else:  # each set's elements all go to one coordinate
            column = turn - size
            open_ = live[out[live, column] == _NONE]
            for i in open_:
                out[i, column] = (_mix(flat[ends[i] : ends[i + 1]] + _turn(turn + 1)) >> np.uint64(1)).min()
            still = (out[live] == _NONE).any(1)
            live = live[still]
            continue
        still = (out[live] == _NONE).any(1)
        if not still.all():
            live = live[still]
            keep = np.zeros(sets, bool)
            keep[live] = True
            stays = keep[of]
            element, of = element[stays], of[stays]
    return out


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sketch.reshape(len(sketch), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, part.shape[:2]).copy()
    for r in range(rows):
        out = _mix(out * _STEP + part[:, :, r])
    return out


def digests(flat: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums that name each set."""
    used = np.flatnonzero(np.diff(ends))
    out = []
    for seed in (1, 2):
        total = np.zeros(len(ends) - 1, np.uint64)
        if len(used):
            total[used] = np.add.reduceat(_mix(flat ^ _turn(seed)), ends[:-1][used])
        out.append(pa.array(total.view(np.int64)))
    return out


def sketch(docs: DataFrame, words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, text_col: str = "text") -> DataFrame:
    """Append n_shingles, the 128-bit digest (set_a, set_b) of the set, and the band hashes."""

    def make():
        def work(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            flat, ends = shingle_sets(texts, words)
            n = np.diff(ends)
            hashes = band_hashes(sketches(flat, ends, bands * rows), bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(hashes.ravel()), mask=pa.array(n == 0))
            return [pa.array(n), *digests(flat, ends), lists]

        return work

    return add_columns(docs, text_col, make, "n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, n, elements) for the given classes (node, set_a, set_b, least), from the texts of their least ids."""
    ids = nodes.where("least IS NOT NULL").select(F.col("least").alias("doc_id")).distinct()
    texts = docs.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))

    def make():
        def work(batch_texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            flat, ends = shingle_sets(batch_texts, words)
            return [*digests(flat, ends), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))]

        return work

    made = add_columns(texts.select("text"), "text", make, "set_a bigint, set_b bigint, elements array<bigint>").drop("text")
    met = made.join(nodes.select("node", "set_a", "set_b"), ["set_a", "set_b"])
    return met.dropDuplicates(["node"]).select("node", F.size("elements").alias("n"), "elements")  # one class, one set


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))
    met = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    shared = F.size(F.array_intersect("ea", "eb"))
    return met.where(shared * 100 >= (F.col("na") + F.col("nb") - shared) * percent).select("a", "b")


def _rest(entries: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket and an element of their prefixes."""
    labelled = entries.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    nodes = labelled.join(mixed, "bucket", "left_semi").groupBy("node").agg(F.first("label").alias("label"))
    nodes = scratch.put(nodes, "rest_nodes")
    if nodes.isEmpty():
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    elements = sets.join(nodes, "node").select("node", "label", "n", F.explode("elements").alias("x"))
    elements = scratch.put(elements, "rest_elements")
    often = scratch.put(elements.groupBy("x").agg(F.count("*").alias("df")).where("df > 1"), "rest_often")
    # elements that only one set has can't be shared; they fill the prefix first, so they only shorten it
    shared = hot_join(elements, often, ["x"], "df")
    rarest = Window.partitionBy("node").orderBy("df", "x")
    ranked = shared.withColumn("k", F.row_number().over(rarest)).withColumn("common", F.count("*").over(Window.partitionBy("node")))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("common"))
    # elements from this one on, this one included: the most that a pair can share if it is their first common one
    rest = F.col("common") - F.col("k") + 1
    # a pair is wanted at its first common element; one that also shares an element just before needn't be found again
    ahead = F.collect_list("x").over(rarest.rowsBetween(-AHEAD, -1))
    ranked = ranked.withColumn("ahead", ahead)
    prefix = scratch.put(ranked.where(F.col("k") <= length).select("x", "node", "label", "n", rest.alias("rest"), "ahead"), "rest_prefix")
    # the label that most classes at an element have is met by the others only
    by_label = prefix.groupBy("x", "label").agg(F.count("*").alias("c"))
    main = by_label.groupBy("x").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.sum("c").alias("c")).where("labels > 1").drop("labels")
    minor = hot_join(prefix, scratch.put(main, "rest_main"), ["x"], "c").where("label <> main")
    one = minor.select("x", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("ahead").alias("before_a"))
    two = prefix.select("x", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("ahead").alias("before_b"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    enough = F.least("ra", "rb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    first = ~F.arrays_overlap("before_a", "before_b")
    return one.join(two, "x").where((F.col("la") != F.col("lb")) & near & enough & first).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _classes(rows: DataFrame, docs: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """(set_a, set_b, component, least): each class of equal sets with its component's number and least document id."""
    classes = rows.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    # numbers are unique whichever attempt of a task wrote them, and are only read from the table
    classes = scratch.put(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    centres = entries.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").drop("last")
    entries = scratch.put(entries.join(centres, "bucket"), "entries")  # those of buckets with two classes or more
    pairs = scratch.put(entries.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    wanted = classes.select("node", "set_a", "set_b", "least").join(entries.select("node").distinct(), "node", "left_semi")
    sets = scratch.put(_full_sets(docs, wanted, words), "sets")
    links = scratch.put(_confirm(pairs, sets, percent), "links")
    labels = components(links, scratch, "first")
    more = _rest(entries.select("bucket", "node"), labels, sets, scratch, percent).join(pairs, ["a", "b"], "left_anti")
    more = scratch.put(_confirm(more, sets, percent), "more_links")
    joined = classes.select("set_a", "set_b", "node", "least").join(labels, "node", "left")
    joined = joined.withColumn("component", F.coalesce("component", "node")).drop("node")
    if not more.isEmpty():  # they link whole components, so only those are searched again
        for end in ("a", "b"):
            more = more.join(labels.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        over = components(more, scratch, "all").select(F.col("node").alias("component"), F.col("component").alias("over"))
        joined = small_join(joined, over, ["component"], "left").withColumn("component", F.coalesce("over", "component")).drop("over")
    joined = scratch.put(joined, "joined")
    least = joined.groupBy("component").agg(F.min("least").alias("least"), F.count("*").alias("members"))
    found = scratch.put(hot_join(joined.drop("least"), least, ["component"], "members").drop("members"), "found")
    scratch.drop("joined", "classes", "entries", "pairs", "sets", "links", "more_links", *(f"rest_{k}" for k in ("nodes", "elements", "often", "prefix", "main")))
    return found


def find(docs: DataFrame, scratch: Scratch, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id, text).

    `docs` is read twice: once for sketches, once for the full sets of what has to be confirmed.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = scratch.put(sketch(docs, words).drop("text"), "sketches")
    met = rows.drop("bands").join(_classes(rows, docs, scratch, words, percent), ["set_a", "set_b"], "left")
    component = F.when(F.col("component").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("least"))
    return met.withColumn("component_id", component).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, scratch: Scratch, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component: that of the least id, of rows that share it the one whose content has the
    least hash.  Rows without a set stay, and so do rows without an id, which can't be named."""
    keys = dict(zip(("_row_a", "_row_b"), text_key(*map(F.col, docs.columns))))
    keyed = docs.withColumns(keys)
    narrow = keyed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "_row_a", "_row_b")
    rows = scratch.put(sketch(narrow, words).drop("text"), "sketches")
    met = rows.where("n_shingles > 0").drop("bands").join(_classes(rows, narrow.select("doc_id", "text"), scratch, words, percent), ["set_a", "set_b"])
    order = F.struct("doc_id", "_row_a", "_row_b")
    stay = met.where("doc_id IS NOT NULL").groupBy("component").agg(F.min(order).alias("first")).select("first._row_a", "first._row_b")
    empty = rows.where("n_shingles = 0 OR doc_id IS NULL").select("_row_a", "_row_b").distinct().withColumn("whole", F.lit(True))
    stay = stay.withColumn("whole", F.lit(False)).unionByName(empty)
    kept = keyed.join(scratch.put(stay, "stay"), ["_row_a", "_row_b"])
    return kept.where("NOT whole").dropDuplicates(["_row_a", "_row_b"]).unionByName(kept.where("whole")).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), words=2)
