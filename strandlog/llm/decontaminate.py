"""Benchmark decontamination: find benchmark passages in documents, then cut them or drop documents.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased.  A window is 13 words of
an item in a row; an item of fewer words, but not none, is one window.

How a document is scanned, without a row per window: 13 words in a row always hold a block of 7 words
that starts at a multiple of 7 (a window of n words one of (n + 1) // 2), so a document's few
aligned blocks are hashed first and looked up in the hash set of all blocks of that size in the benchmark.
Documents without such a block hold no window.  The rest get each window's hash looked up, and hits are
verified by joining the windows' full text.  Both sides are lower-cased before they are cut into words, and by the
same translation of A-Z, so no window is lost and hits are the same on either path:

* The block and window hashes become sets in the scan's own expression, and the window table goes to all tasks, only if
  they were counted and have at most `max_broadcast` entries and `MAX_BYTES` bytes, item ids included.
* Beyond that, documents meet the blocks in a shuffle, one row per seven words; the windows of those that met one
  are looked up in a second shuffle, and the texts of the windows whose hashes met in a third.

Cases: a null text has no words; null item texts have no windows; items that repeat an id count once;
a null item id marks words as hit but isn't an item; rows that repeat are judged one by one; an empty benchmark
hits nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Entries of the broadcast hash set and window table.
MAX_BROADCAST = 40_000
#: Bytes of the window table, item ids included, that go to all tasks.
MAX_BYTES = 32 << 20
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_list(text: Column) -> Column:
    """The words of a text whose case is settled already or doesn't matter."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAK), "")


def _starts(count: Column) -> Column:
    """0 .. count - 1, or an empty array."""
    return F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _once(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is then computed once however the optimizer merges projections."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _block_size(n_words: int) -> int:
    return (min(n_words, WINDOW) + 1) // 2


class Benchmark:
    """Windows and blocks of the items, counted before anything is broadcast."""

    def __init__(self, items: DataFrame, max_broadcast: int = MAX_BROADCAST) -> None:
        base = items.select(F.col("item_id").cast("string").alias("item_id"), word_list(ascii_lower(F.col("text"))).alias("w"))
        base = base.withColumn("n", F.size("w")).where("n > 0")
        size = F.least(F.col("n"), F.lit(WINDOW))
        windows = base.select(
            "item_id", "w", size.alias("len"), F.explode(_starts(F.col("n") - size + 1)).alias("i")
        ).select("item_id", "len", F.array_join(F.slice("w", F.col("i") + 1, F.col("len")), " ").alias("window"))
        windows = windows.groupBy("len", "window").agg(F.collect_set("item_id").alias("items"))
        self.windows = windows
        part = F.floor((size + 1) / 2).cast("int")
        blocks = base.select("w", part.alias("m"), F.explode(_starts(F.col("n") - part + 1)).alias("i"))
        # words of both sides in the windows' own form, so that no window is lost
        self.blocks = blocks.select("m", F.xxhash64(F.slice("w", F.col("i") + 1, F.col("m"))).alias("h")).distinct()
        # a window has 13 words at most, so these are few
        self.lengths = sorted(r.len for r in self.windows.select("len").distinct().collect())
        held = F.octet_length("window") + F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
        n_windows, n_bytes = self.windows.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
        self.small = max(n_windows, self.blocks.count()) <= max_broadcast and n_bytes <= MAX_BYTES
        if self.small:
            self.block_set = {m: [] for m in map(_block_size, self.lengths)}
            for r in self.blocks.collect():  # at most max_broadcast numbers
                self.block_set[r.m].append(r.h)
            self.window_set = {n: [] for n in self.lengths}
            for r in self.windows.select("len", self.hash_of(F.split("window", " ")).alias("h")).collect():
                self.window_set[r.len].append(r.h)

    @staticmethod
    def hash_of(words: Column) -> Column:
        return F.xxhash64(words)


def _in_set(name: str, numbers: list[int]) -> str:
    return f"{name} IN ({', '.join(f'{x}L' if x > -(1 << 63) else '-9223372036854775807L - 1L' for x in sorted(numbers))})"


def _hits_by_set(docs: DataFrame, bench: Benchmark, text_col: str) -> DataFrame:
    """One row per document and verified window, one at least per document."""
    docs = docs.withColumn("_loose", word_list(ascii_lower(F.col(text_col)))).withColumn("_n", F.size("_loose"))
    tests = [
        _once("_loose", "w", f"exists(transform(CASE WHEN size(w) >= {m} THEN sequence(0, size(w) DIV {m} - 1) ELSE array() END, "
        f"i -> xxhash64(slice(w, CAST(i AS INT) * {m} + 1, {m}))), h -> {_in_set('h', found)})")
        for m, found in bench.block_set.items()
        if found
    ]
    docs = docs.withColumn("_near", F.expr(" OR ".join(tests) or "false"))
    docs = docs.withColumn("_w", F.when(F.col("_near"), word_list(ascii_lower(F.col(text_col)))))
    scans = [
        f"transform(filter(CASE WHEN size(w) >= {n} THEN sequence(0, size(w) - {n}) ELSE array() END, "
        f"i -> {_in_set(f'xxhash64(slice(w, CAST(i AS INT) + 1, {n}))', found)}), "
        f"i -> named_struct('pos', CAST(i AS INT), 'len', {n}, 'window', array_join(slice(w, CAST(i AS INT) + 1, {n}), ' ')))"
        for n, found in bench.window_set.items()
    ]
    empty = "CAST(array() AS ARRAY<STRUCT<pos: INT, len: INT, window: STRING>>)"
    docs = docs.withColumn("_hits", F.expr(f"CASE WHEN _near THEN {_once('_w', 'w', f'concat({chr(44).join(scans)})')} ELSE {empty} END" if scans else empty))
    flat = docs.select("_row", "doc_id", F.col("_n").alias("n_words"), F.explode_outer("_hits").alias("_hit"))
    flat = flat.select("_row", "doc_id", "n_words", "_hit.pos", "_hit.len", "_hit.window")
    return flat.join(F.broadcast(bench.windows), ["len", "window"], "left").where("len IS NULL OR items IS NOT NULL")


def _hits_by_join(docs: DataFrame, bench: Benchmark, text_col: str) -> DataFrame:
    """As `_hits_by_set`, for a benchmark of any size: blocks, then windows, meet in a shuffle."""
    docs = docs.withColumn("_w", word_list(ascii_lower(F.col(text_col)))).withColumn("_n", F.size("_w"))
    sizes = sorted(set(map(_block_size, bench.lengths)))
    aligned = [
        f"transform(CASE WHEN size(w) >= {m} THEN sequence(0, size(w) DIV {m} - 1) ELSE array() END, "
        f"i -> named_struct('m', {m}, 'h', xxhash64(slice(w, CAST(i AS INT) * {m} + 1, {m}))))"
        for m in sizes
    ]
    blocks = docs.select("_row", F.inline(F.array_distinct(F.expr(_once("_w", "w", f"concat({', '.join(aligned)})")))))
    near = docs.join(blocks.join(bench.blocks, ["m", "h"], "left_semi").select("_row").distinct(), "_row", "left_semi")
    windows = [
        f"transform(CASE WHEN size(w) >= {n} THEN sequence(0, size(w) - {n}) ELSE array() END, "
        f"i -> named_struct('pos', CAST(i AS INT), 'len', {n}, 'h', xxhash64(slice(w, CAST(i AS INT) + 1, {n}))))"
        for n in bench.lengths
    ]
    rows = near.select("_row", F.inline(F.expr(_once("_w", "w", f"concat({', '.join(windows)})"))))
    known = bench.windows.select("len", Benchmark.hash_of(F.split("window", " ")).alias("h")).distinct()
    met = rows.join(known, ["len", "h"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("pos", "len")).alias("_met"))
    texts = F.transform("_met", lambda x: F.struct(x.pos.alias("pos"), x.len.alias("len"), F.array_join(F.slice("_w", x.pos + 1, x.len), " ").alias("window")))
    found = near.join(met, "_row").select("_row", F.inline(texts)).join(bench.windows, ["len", "window"]).select("_row", "pos", "len", "items")
    narrow = docs.select("_row", "doc_id", F.col("_n").alias("n_words"))
    return narrow.join(found, "_row", "left")


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: _row, doc_id, n_words, n_hit, n_items, items, hits (word ranges), contaminated."""
    bench = Benchmark(items, max_broadcast)
    # the row's place in the input: only file order counts, so a task that runs again gives the same
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    if not bench.lengths:
        met = rows.select("_row", "doc_id", F.size(word_list(F.col("text"))).alias("n_words"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items"))
    else:
        met = (_hits_by_set if bench.small else _hits_by_join)(rows, bench, "text")
    by_row = met.groupBy("_row", "doc_id", "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", (F.col("pos") + F.col("len")).alias("end"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    merged = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a.n + F.greatest(x.end - F.greatest(x.pos, a.end), F.lit(0))).alias("n"), F.greatest(x.end, a.end).alias("end")
        ),
    )
    out = by_row.select("_row", "doc_id", F.col("n_words").cast("long").alias("n_words"), merged.n.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits")
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def cut(text: Column, hits: Column) -> Column:
    """The text without the hit words and without what stands between two of them."""
    parts = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    lead = F.when(F.rlike(text, F.lit(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")), 1).otherwise(0)

    def gone(_: Column, i: Column) -> Column:
        word = F.floor((i - lead) / 2)  # the word itself, or the one before the gap
        is_word = F.pmod(i - lead, F.lit(2)) == 0
        return ~F.exists(hits, lambda h: (h.pos <= word) & (word < F.when(is_word, h.end).otherwise(h.end - 1)))

    return F.when(F.size(hits) > 0, F.array_join(F.filter(parts, gone), "")).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
