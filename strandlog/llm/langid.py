"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to `ORDER` bytes is counted on its sample.  A byte's code
length is that of PPM with escape method C and no exclusion: in the longest context that the tree has, a byte seen
c times of n, with d kinds, costs -log2(c / (n + d)); an unseen one pays the escape -log2(d / (n + d))
and is tried in the next shorter context; below order 0 all 256 values are equal.  The counts are frozen after
training, so a code length depends on the ORDER + 1 bytes that end at it, and a text's length is an exact sum.

That sum is taken over the distinct windows of ORDER + 1 bytes: each is priced once per language from the
trees (sorted arrays of hashed contexts) and kept in a table of fixed size.

Training takes at most about `SAMPLE_ROWS` rows, in equal shares for the languages, drawn by a hash of the id
among rows that aren't held out; their texts count whole, and at most `WINDOWS` distinct windows, the commonest of each
language, go into the trees.  A-Z are folded to lower case.

Cases: a text that is null or has no letter is `und` with score 0; without any training row all texts are `und`.
Ties go to the language that sorts first.  The score is the share of the best language when
code lengths per byte are taken as evidence of up to 64 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import Scratch, add_columns, draw_limit, held_out

ORDER = 4
SAMPLE_ROWS = 3_000
#: Distinct windows that the trees of all languages hold together.
WINDOWS = 4_000_000
#: Slots of the table of priced windows, a power of two.
SLOTS = 1 << 19
UNDETERMINED = "und"
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte the ORDER + 1 bytes that end at it, as a number; 0 stands for what is before a text."""
    out = data.copy()
    where = np.arange(len(data)) - starts
    for k in range(1, ORDER + 1):
        part = np.zeros_like(data)
        part[k:] = data[:-k] << np.uint64(8 * k)
        part[where < k] = 0
        out |= part
    return out


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts and the texts' offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return _FOLD[raw], at - at[0]


class ContextTree:
    """Counts of one language, order by order, as sorted arrays."""

    def __init__(self, levels: list[tuple[np.ndarray, ...]]) -> None:
        self.levels = levels  # per order: grams, their counts, contexts, their counts, kinds of next bytes

    @classmethod
    def from_counts(cls, windows: np.ndarray, n: np.ndarray) -> ContextTree:
        levels = []
        for order in range(ORDER + 1):
            grams, at = np.unique(windows & np.uint64((1 << (8 * (order + 1))) - 1), return_inverse=True)
            counts = np.bincount(at, n, len(grams))
            contexts, at, kinds = np.unique(grams >> np.uint64(8), return_inverse=True, return_counts=True)
            levels.append((grams, counts, contexts, np.bincount(at, counts, len(contexts)), kinds.astype(float)))
        return cls(levels)

    def price(self, windows: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each window."""
        bits = np.zeros(len(windows))
        todo = np.arange(len(windows))
        for order in range(ORDER, -1, -1):
            grams, counts, contexts, sums, kinds = self.levels[order]
            if not len(grams):
                continue
            sought = windows[todo] & np.uint64((1 << (8 * (order + 1))) - 1)
            c = np.minimum(np.searchsorted(contexts, sought >> np.uint64(8)), len(contexts) - 1)
            known = contexts[c] == sought >> np.uint64(8)
            g = np.minimum(np.searchsorted(grams, sought), len(grams) - 1)
            seen = grams[g] == sought
            total = sums[c] + kinds[c]
            cost = np.where(seen, -np.log2(counts[g] / total), np.where(known, -np.log2(kinds[c] / total), 0.0))
            bits[todo] += cost
            todo = todo[~seen]
            if not len(todo):
                break
        bits[todo] += 8.0
        return bits


class Identifier:
    def __init__(self, trees: dict[str, ContextTree]) -> None:
        self.languages = sorted(trees)
        self.trees = [trees[k] for k in self.languages]
        self.keys = np.full(SLOTS, np.uint64(1) << np.uint64(63), np.uint64)
        self.bits = np.zeros((SLOTS, len(trees)), np.float32)
        self.shift = np.uint64(64 - (SLOTS.bit_length() - 1))

    def _price(self, windows: np.ndarray) -> np.ndarray:
        return np.stack([t.price(windows) for t in self.trees], 1).astype(np.float32)

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """[texts, languages] bits."""
        data, ends = _bytes_of(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(data):
            return out
        sizes = np.diff(ends)
        windows = _windows(data, np.repeat(ends[:-1], sizes))
        slot = ((windows * _MIX) >> self.shift).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != windows)
        if len(missing):
            new = np.unique(windows[missing])
            priced = self._price(new)
            at = ((new * _MIX) >> self.shift).astype(np.int64)
            self.keys[at] = new
            winner = self.keys[at] == new  # of windows that share a slot, one stays
            self.bits[at[winner]] = priced[winner]
            missing = np.flatnonzero(self.keys[slot] != windows)  # what has no slot, or has just lost it
            if len(missing):
                again, back = np.unique(windows[missing], return_inverse=True)
                place = np.minimum(np.searchsorted(new, again), len(new) - 1)
                old = new[place] != again
                bits = priced[place]
                if old.any():
                    bits[old] = self._price(again[old])
                rest = bits[back]
        used = np.flatnonzero(sizes)
        for k in range(len(self.languages)):
            each = self.bits[slot, k]
            if len(missing):
                each[missing] = rest[:, k]
            out[used, k] = np.add.reduceat(each, ends[:-1][used], dtype=np.float64)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        bits = self.code_lengths(texts)
        size = np.maximum(np.diff(_bytes_of(texts)[1]), 1)
        best = bits.argmin(1)
        per_byte = bits / size[:, None]
        weight = np.exp2(-(per_byte - per_byte.min(1, keepdims=True)) * np.minimum(size, 64)[:, None])
        score = 1 / weight.sum(1)
        lettered = pc.fill_null(pc.match_substring_regex(texts.cast(pa.string()), r"\pL"), False).to_numpy(zero_copy_only=False)
        names = np.where(lettered, np.array(self.languages, object)[best], UNDETERMINED)
        return names.tolist(), np.where(lettered, score, 0.0)


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, text): an equal share of `rows` for each language, drawn by a hash of the id."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    share = rows / max(1, len(counts))
    limits = {k: draw_limit(share / n) for k, n in counts.items()}
    draw = F.xxhash64(F.lit("langid"), "doc_id").bitwiseAND(F.lit((1 << 63) - 1))
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map(F.lit(""), F.lit(-1).cast("bigint"))
    return usable.where(draw <= F.coalesce(F.try_element_at(limit, F.col("lang")), F.lit(-1).cast("bigint"))).select("lang", "text")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, ContextTree]:
    """Trees per language, from the windows of the sample counted in Spark."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0)
            texts = batch.column(1)
            data, ends = _bytes_of(texts)
            windows = _windows(data, np.repeat(ends[:-1], np.diff(ends)))
            coded = langs.dictionary_encode()
            lang = np.repeat(coded.indices.to_numpy(), np.diff(ends))
            for k, name in enumerate(coded.dictionary.to_pylist()):
                found, n = np.unique(windows[lang == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "window", "n"]
                )

    sample = training_sample(docs, rows)
    counted = sample.mapInArrow(run, "lang string, window bigint, n bigint").groupBy("lang", "window").agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession)
    counted = scratch.put(counted, "langid_windows")
    # a language's tree holds its commonest windows, so that the trees have a bound whatever the texts' lengths
    share = WINDOWS // max(1, counted.select("lang").distinct().count())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "window"))
    table = counted.withColumn("rank", rank).where(F.col("rank") <= share).drop("rank").toArrow()
    scratch.drop("langid_windows")
    trees = {}
    langs = table["lang"].combine_chunks().dictionary_encode() if table.num_rows else None
    for k, name in enumerate(langs.dictionary.to_pylist() if langs is not None else []):
        own = table.filter(pc.equal(table["lang"], name))
        trees[name] = ContextTree.from_counts(own["window"].to_numpy().astype(np.uint64), own["n"].to_numpy())
    return trees


def identify(docs: DataFrame, trees: dict[str, ContextTree], text_col: str = "text") -> DataFrame:
    """Append `lang_pred` and `score`."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        model = Identifier(sent.value)

        def work(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            names, score = model.predict(texts)
            return [pa.array(names, pa.string()), pa.array(score)]

        return work

    return add_columns(docs, text_col, make, "lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
