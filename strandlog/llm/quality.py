"""Quality rules: counts that fail a document outright, then a perplexity band for its language.

The language model is an interpolated modified Kneser-Ney model over n-grams of `ORDER` characters as they are.  Spark
counts the n-grams of every document, and counts, contexts and probabilities stay distributed tables that grow with
the corpus; nothing of their size comes to the driver or to every task.  Texts are packed into parts of about `PART`
bytes, each a compressed row of a table beside the part's distinct n-grams.  The n-grams of all parts give the
model; a join answers what each part asks for, and a part, where it lies, meets its answers as sorted hash arrays.  Every
language has a model and bands of its own; documents of no language share one.

The bands are drawn on bits per letter (or digit): marks between the words cost bits and give no letters.  Per
language the distribution over all documents that pass the counts gives the band, from `BELOW` robust standard
deviations under the median to `ABOVE` over it, wider for short texts, whose averages vary more.  The lower end holds
for the whole text; the upper one for the middle one of its pieces of `PIECE` symbols, so that a quotation in
another language that fills less than half of a text doesn't count.  A document outside is rejected: far below it
repeats itself, far above it is full of marks or isn't written in its language.

Cases: a null text has no words; an empty text fails (fewer than 50 words); a language with one document has a model of that document; no document is dropped here, `kept` says what to do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.common import SMALL_ROWS, Scratch, chunks, give_back, small_batches, small_join

ORDER = 4
CLASSES = 40
#: Model of the documents without a language.
SHARED = "\u0000none"
#: Robust standard deviations on either side of the median.
BELOW = ABOVE = 5.0
#: Symbols in a piece of a text, of which the middle one is held against the upper end.
PIECE = 256
#: Bits added on either side, divided by the root of the number of symbols.
SHORT = 2.0
#: Bins of the histograms that give the spread, in a bit.
BINS = 200
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Bytes of text worked on at once, and characters whose n-grams are: each takes some 50 bytes of arrays.
_CHUNK = 1 << 20
#: Bytes of text whose n-grams are asked for together, one text at least.
PART = 16 << 20
#: Bits that hold a character's number plus 1 (0 is before a text) in an n-gram.
_BITS = 21
_LOW = (1 << _BITS) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Byte -> class; 0 is kept for what is before a text."""
    out = np.full(256, 33, np.int32)
    out[:32] = 34
    out[127] = 34
    out[[32, 9, 11, 12, 13]] = 1
    out[10] = 2
    out[48:58] = 3
    out[65:91] = out[97:123] = np.arange(4, 30)
    out[[ord(c) for c in ".,;:"]] = 30
    out[[ord(c) for c in "!?"]] = 31
    out[[ord(c) for c in "#*$%&|<>"]] = 32
    out[0x80:0xC0] = 36 + (np.arange(0x80, 0xC0) >> 4 & 3)
    out[0xC0:] = 35
    return out


_CLASS_OF = _classes()
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_FOLLOWS = np.arange(256) >> 6 == 2


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes and offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def grams(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte the number of the n-gram that ends at it."""
    kind = _CLASS_OF[raw]
    out = kind.copy()
    starts = ends[:-1][np.diff(ends) > 0]
    for k in range(1, ORDER):
        part = np.zeros_like(kind)
        part[k:] = kind[:-k] * np.int32(CLASSES**k)
        for ahead in range(k):  # nothing of the text before
            first = starts + ahead
            part[first[first < len(part)]] = 0
        out += part
    return out


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ends) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    used = np.flatnonzero(np.diff(ends))
    if len(used):
        out[used] = np.add.reduceat(values, ends[:-1][used], dtype=out.dtype)
    return out


def middle_piece(bits: np.ndarray, letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text: bits per letter of its middle piece, the lower one of two."""
    size = np.diff(ends)
    out = np.zeros(len(size))
    used = np.flatnonzero(size)
    if not len(used):
        return out
    n = np.maximum(size[used] // PIECE, 1)
    first = np.cumsum(n) - n
    owner = np.repeat(used, n)
    start = ends[owner] + (np.arange(len(owner)) - np.repeat(first, n)) * size[owner] // np.repeat(n, n)
    each = np.add.reduceat(bits, start, dtype=np.float64) / np.maximum(np.add.reduceat(letters, start, dtype=np.int64), 1)
    out[used] = each[np.lexsort((each, owner))[first + (n - 1) // 2]]
    return out


# ---------------------------------------------------------------- base counts


def repeated_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words, and words in 3-word windows that the text has twice or more."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat, cuts = split.flatten(), split.offsets.to_numpy()
    cuts = cuts - cuts[0]
    full = np.concatenate([[0], np.cumsum(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))])
    ends = full[cuts]
    flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    n = np.diff(ends)
    out = np.zeros(len(n), np.int64)
    if not len(flat):
        return n, out
    coded = flat.dictionary_encode()
    ids, kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.flatnonzero(doc[:-2] == doc[2:]) if len(ids) > 2 else np.zeros(0, np.int64)
    if not len(start):
        return n, out
    _, pair = np.unique(ids[start] * kinds + ids[start + 1], return_inverse=True)
    key = (doc[start] * (int(pair.max()) + 1) + pair) * kinds + ids[start + 2]
    order = np.argsort(key)
    ranked = key[order]
    twin = np.zeros(len(key), bool)
    same = ranked[1:] == ranked[:-1]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    covered = np.zeros(len(ids) + 2, bool)
    for k in range(3):
        covered[start[twin] + k] = True
    return n, _per_text(covered[: len(ids)].astype(np.int64), ends)


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text:
        return 0
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def base_counts(texts: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw, ends = _raw(texts)
    n, repeated = repeated_words(texts)
    chars = _per_text(~_SPACE[raw] & ~_FOLLOWS[raw], ends)
    symbols = _per_text(_SYMBOL[raw], ends)
    lines = np.array([repeated_lines(t) for t in texts.to_pylist()], np.int64)
    return [n.astype(np.int64), chars, symbols, lines, repeated]


# ---------------------------------------------------------------- the model


class SortedHashes:
    """n-gram -> value, as hashes in order beside their values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        hashes = keys.astype(np.uint64) * _MIX  # an odd factor: no two n-grams share a hash
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(keys), default)
        sought = keys.astype(np.uint64) * _MIX
        at = np.minimum(np.searchsorted(self.hashes, sought), len(self.hashes) - 1)
        return np.where(self.hashes[at] == sought, self.values[at], default)


@dataclass
class KneserNey:
    """In memory, over the folded classes of `grams`: what `price` does in Spark, for tests to hold against.

    Per order: what an n-gram's own count gives, and what its context leaves to the shorter order."""

    own: list[SortedHashes]
    left: list[SortedHashes]

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From the counts of the longest n-grams; shorter orders count distinct left neighbours."""
        tables = [(keys, counts.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            keys, counts = np.unique(tables[-1][0] % CLASSES**order, return_counts=True)
            tables.append((keys, counts.astype(np.float64)))
        own, left = [], []
        for keys, counts in reversed(tables):
            n = [max(1, int((counts == k).sum())) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            cut = np.clip([0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0, [0, 0.95, 1.9, 2.85])
            discount = cut[np.minimum(counts, 3).astype(np.int64)]
            contexts, at = np.unique(keys // CLASSES, return_inverse=True)
            total = np.bincount(at, counts, len(contexts))
            own.append(SortedHashes(keys, (counts - discount) / total[at]))
            left.append(SortedHashes(contexts, np.maximum(np.bincount(at, discount, len(contexts)) / total, 1e-9)))
        return cls(own, left)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each n-gram's last symbol after the others."""
        p = np.full(len(keys), 1.0 / CLASSES)
        for order in range(1, ORDER + 1):
            gram = keys % CLASSES**order
            p = self.own[order - 1].get(gram, 0.0) + self.left[order - 1].get(gram // CLASSES, 1.0) * p
        return -np.log2(p)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters as numbers, and offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.int32), ends


def _letters(points: np.ndarray) -> np.ndarray:
    """Letters and digits; all that isn't ASCII counts as such."""
    lower = points | 32
    return (points >= 128) | ((lower >= 97) & (lower <= 122)) | ((points >= 48) & (points <= 57))


def _distinct(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them."""
    if size > 1 << 23:
        return np.unique(keys, return_inverse=True)
    place = np.zeros(size, np.int64)
    place[keys] = 1
    found = np.flatnonzero(place)
    place[found] = np.arange(len(found))
    return found, place[keys]


def wide_grams(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of whole characters, as first and last half, and for each character the one that ends at it."""
    kinds, at = _distinct(points + 1, 1 << _BITS)
    kinds, at = np.concatenate([[0], kinds]), at + 1
    starts = ends[:-1][np.diff(ends) > 0]

    def before(values: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[k:] = values[:-k]
        for ahead in range(k):  # nothing of the text before
            first = starts + ahead
            out[first[first < len(out)]] = 0
        return out

    pair, last = _distinct(np.concatenate([[0], before(at, 1) * len(kinds) + at]), len(kinds) ** 2)
    last = last[1:]  # pair 0: two places before the text
    gram, of = _distinct(before(last, 2) * len(pair) + last, len(pair) ** 2)
    packed = kinds[pair // len(kinds)] << _BITS | kinds[pair % len(kinds)]
    return packed[gram // len(pair)], packed[gram % len(pair)], of


def sliced_grams(points: np.ndarray, ends: np.ndarray):
    """`wide_grams` of `_CHUNK` characters at a time, however long a text is: (first, last, a, b, gram of each)."""
    for lo in range(0, len(points), _CHUNK):
        hi = min(lo + _CHUNK, len(points))
        at = max(lo - ORDER + 1, 0)  # the characters before the slice are context only
        inner = ends[(ends > at) & (ends < hi)] - at
        a, b, of = wide_grams(points[at:hi].astype(np.int64), np.concatenate([[0], inner, [hi - at]]))
        if at < lo:
            used, of = np.unique(of[lo - at :], return_inverse=True)
            a, b = a[used], b[used]
        yield lo, hi, a, b, of


def _by_model(texts: pa.Array, models: pa.Array):
    """Per model of a slice: its name, its rows, and their characters."""
    names = np.array(models.to_pylist(), object)
    for name in sorted(set(names.tolist())):
        rows = np.flatnonzero(names == name)
        points, ends = _points(texts.take(pa.array(rows)))
        if len(points):
            yield name, rows, points, ends


def _sum_up(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct (a, b) with the sums of their numbers."""
    a, b, n = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(n, first)


def gram_numbers(texts: pa.Array, models: pa.Array) -> dict[str, list[tuple[np.ndarray, ...]]]:
    """Per model: (a, b, n) of each slice of these texts."""
    out: dict[str, list] = {}
    for name, _, points, ends in _by_model(texts, models):
        for _, _, a, b, of in sliced_grams(points, ends):
            out.setdefault(name, []).append((a, b, np.bincount(of, minlength=len(a))))
    return out


def gram_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(model, a, b, n): the n-grams of each slice of a task, with their numbers."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts, models = (batch.column(batch.schema.get_field_index(n)) for n in (text_col, "_model"))
            for x, y in chunks(texts, _CHUNK):
                for name, found in gram_numbers(texts.slice(x, y - x), models.slice(x, y - x)).items():
                    a, b, n = _sum_up(found)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(a), pa.string()), *map(pa.array, (a, b, n))], names=["model", "a", "b", "n"])
        give_back()

    return docs.mapInArrow(run, "model string, a bigint, b bigint, n bigint")


def pack(docs: DataFrame) -> DataFrame:
    """(part, rows, model, a, b, n): a part's documents as one compressed value, and rows of its distinct n-grams.

    Parts are numbered by task; their numbers hold because they are only read from the table that is written of them.
    """
    small_batches(docs.sparkSession)
    schema = T._parse_datatype_string("part bigint, rows binary, model string, a bigint, b bigint, n bigint")

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0

        def close():
            part = (task << 32) + number
            stream.close()
            none = [pa.nulls(1, t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), *none], names=schema.names)
            for name in sorted(found):
                a, b, n = _sum_up(found[name])
                fixed = [pa.array(np.full(len(a), part)), pa.nulls(len(a), pa.binary()), pa.array([name] * len(a), pa.string())]
                yield pa.RecordBatch.from_arrays([*fixed, *map(pa.array, (a, b, n))], names=schema.names)

        stream, sink, found, size = None, None, {}, 0
        for batch in batches:
            texts, models = (batch.column(batch.schema.get_field_index(n)) for n in ("text", "_model"))
            for x, y in chunks(texts, _CHUNK):
                if size >= PART:
                    yield from close()
                    stream, found, size, number = None, {}, 0, number + 1
                if stream is None:  # rows are compressed as they come, so a part is never held as it is
                    sink = pa.BufferOutputStream()
                    stream = pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5)))
                stream.write_batch(batch.slice(x, y - x))
                mine = texts.slice(x, y - x)
                for name, slices in gram_numbers(mine, models.slice(x, y - x)).items():
                    found.setdefault(name, []).extend(slices)
                    if len(found[name]) > 4:
                        found[name] = [_sum_up(found[name])]
                size += pc.sum(pc.binary_length(mine)).as_py() or 0
        if stream is not None:
            yield from close()
        del stream, sink, found
        give_back()

    return docs.mapInArrow(run, schema)


def price(counted: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda table, _: table) -> DataFrame:
    """(model, a, b, bits): -log2 of the probability of each counted n-gram's last character after the others.

    Shorter orders count distinct left neighbours.  An order's own share and what its contexts leave to the shorter
    order are columns of its table; each table takes the shorter order's probability by a join.  What a model has once
    goes to all tasks if few models were counted.  `keep` writes the shorter orders' tables, which are read several times:
    as one plan they would stand in it over and over, and the driver replans all of it after every stage.
    """
    few = counted.select("model").distinct().limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    once = F.broadcast if few else (lambda table: table)
    second, third, fourth = F.col("a").bitwiseAND(_LOW), F.shiftright("b", _BITS), F.col("b").bitwiseAND(_LOW)
    longest = counted.select("model", "a", "b", "n", second.alias("c2"), third.alias("c3"))
    three = longest.groupBy("model", "c2", "b").agg(F.count("*").alias("n")).withColumn("c3", third)
    three = keep(three, "three")
    two = three.groupBy("model", "b").agg(F.count("*").alias("n")).withColumn("c3", third).withColumn("c4", fourth)
    two = keep(two, "two")
    one = two.groupBy("model", "c4").agg(F.count("*").alias("n"))

    def shares(table: DataFrame, context: list[str]) -> DataFrame:
        seen = [F.greatest(F.count_if(F.col("n") == k), F.lit(1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
        cut = table.groupBy("model").agg(*seen).withColumn("y", F.expr("n1 / (n1 + 2 * n2)"))
        cut = cut.selectExpr(
            "model", "greatest(0D, least(0.95D, 1 - 2 * y * n2 / n1)) AS d1", "greatest(0D, least(1.9D, 2 - 3 * y * n3 / n2)) AS d2",
            "greatest(0D, least(2.85D, 3 - 4 * y * n4 / n3)) AS d3",
        )
        cut_each = table.join(once(cut), "model").withColumn("d", F.expr("CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"))
        sums = cut_each.groupBy("model", *context).agg(F.sum("n").alias("total"), F.sum("d").alias("cut"))
        both = cut_each.join(sums if context else once(sums), ["model", *context])
        return both.withColumn("own", F.expr("(n - d) / total")).withColumn("left", F.expr("greatest(cut / total, 1e-9D)")).drop("d", "d1", "d2", "d3", "total", "cut", "n")

    kinds = one.groupBy("model").agg(F.count("*").alias("kinds"))
    p = shares(one, []).join(once(kinds), "model").selectExpr("model", "c4", "own + left / kinds AS p")
    for table, context, key in ((two, ["c3"], ["c4"]), (three, ["c2", "c3"], ["b"]), (longest, ["a", "c3"], ["c2", "b"])):
        mine = shares(table, context).join(p, ["model", *key])
        names = [n for n in ("a", "c2", "b") if n in table.columns]
        p = mine.select("model", *names, F.expr("own + left * p").alias("p"))
        p = p if table is longest else keep(p, f"{len(context)}_before")
    return p.select("model", "a", "b", (-F.log2("p")).alias("bits"))


def measure(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Append the base counts, `model`, `bits` per symbol, `per_letter` and `middle` (null without text) and `base_failed`."""
    fields = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, model string, bits double, per_letter double, middle double, symbols bigint"
    new = T._parse_datatype_string(fields)
    kept = [f for f in docs.schema.fields if f.name not in new.names]
    names = [f.name for f in kept]
    docs = docs.select(*names, F.coalesce("lang", F.lit(SHARED)).alias("_model"))
    packed = scratch.put_dealt(pack(docs), "packed", "part")
    grams = packed.where("model IS NOT NULL").drop("rows")
    counted = scratch.put(grams.groupBy("model", "a", "b").agg(F.sum("n").alias("n")), "grams")
    priced = scratch.put(price(counted, scratch.put).withColumn("bits", F.col("bits").cast("float")), "priced")
    answers = grams.drop("n").join(priced, ["model", "a", "b"]).select(F.col("part").alias("asked"), "model", "a", "b", "bits")
    documents = packed.where("model IS NULL").select("part", "rows")

    def work(texts: pa.Array, models: pa.Array, known: dict[str, SortedHashes]) -> list[pa.Array]:
        n, chars, symbols, lines, repeated = base_counts(texts)
        out = np.zeros((3, len(texts)))
        size = np.zeros(len(texts), np.int64)
        for name, rows, points, ends in _by_model(texts, models):
            each, letter = np.empty(len(points), np.float32), _letters(points)
            for lo, hi, a, b, of in sliced_grams(points, ends):
                each[lo:hi] = known[name].get(_key(a, b), np.nan)[of]
            total = _per_text(each, ends)
            size[rows] = np.diff(ends)
            out[:, rows] = total / np.maximum(size[rows], 1), total / np.maximum(_per_text(letter, ends), 1), middle_piece(each, letter, ends)
        failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
        return [*map(pa.array, (n, chars, symbols, lines, repeated)), pa.array(failed), models.cast(pa.string()), *(pa.array(x, mask=size == 0) for x in out), pa.array(size)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {}
        for name in pc.unique(right["model"]).to_pylist():
            mine = right.filter(pc.equal(right["model"], name))
            known[name] = SortedHashes(_key(mine["a"].to_numpy(), mine["b"].to_numpy()), mine["bits"].to_numpy())
        made = []
        for blob in left["rows"].to_pylist():
            for batch in pa.ipc.open_stream(blob):
                col = {n: batch.column(batch.schema.get_field_index(n)) for n in [*names, "_model"]}
                made.append(pa.RecordBatch.from_arrays([*(col[n] for n in names), *work(col["text"], col["_model"], known)], names=names + new.names))
        give_back()
        return pa.Table.from_batches(made)

    return documents.groupBy("part").cogroup(answers.groupBy("asked")).applyInArrow(run, T.StructType(kept + list(new.fields)))


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits for the 84 of an n-gram."""
    mixed = a.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ mixed >> np.uint64(29)) + b.astype(np.uint64)


def _spread(passed: DataFrame, end: str) -> DataFrame:
    """(model, median, off): median and median distance from it, from a histogram whose size doesn't grow with the table."""
    bins = passed.groupBy("model", F.floor(F.col(end) * BINS).alias("bin")).agg(F.count("*").alias("c"))

    def half(table: DataFrame, by: str) -> DataFrame:
        so_far = F.sum("c").over(Window.partitionBy("model").orderBy(by))
        every = F.sum("c").over(Window.partitionBy("model"))
        return table.withColumn("so_far", so_far).withColumn("every", every).where("2 * so_far >= every").groupBy("model").agg(F.min(by).alias(f"half_{by}"))

    middle = half(bins, "bin")
    off = bins.join(middle, "model").withColumn("off", F.abs(F.col("bin") - F.col("half_bin"))).groupBy("model", "off").agg(F.sum("c").alias("c"))
    return middle.join(half(off, "off"), "model").select("model", ((F.col("half_bin") + 0.5) / BINS).alias("median"), (F.col("half_off") * (1.4826 / BINS)).alias("off"))


def bands(measured: DataFrame) -> DataFrame:
    """(model, low, high): the least bits per letter of a text and the most of its middle piece, over all documents."""
    passed = measured.where("NOT base_failed AND bits IS NOT NULL")
    low = _spread(passed, "per_letter").select("model", (F.col("median") - BELOW * F.col("off")).alias("low"))
    high = _spread(passed, "middle").select("model", (F.col("median") + ABOVE * F.col("off")).alias("high"))
    return low.join(high, "model")


def judge(docs: DataFrame, scratch: Scratch | None = None, columns: list[str] | None = None) -> DataFrame:
    """Append counts, `perplexity` and `kept` to `docs` (text, lang and what else it has).

    The measured rows are kept as a table, with those of the input's columns that are wanted, so that each text is measured once.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    measured = measure(docs, scratch)
    if columns is not None:
        measured = measured.drop(*[c for c in docs.columns if c not in columns])
    measured = scratch.put(measured, "quality")
    scratch.drop("packed", "grams", "priced", "three", "two", "1_before", "2_before")
    ends = scratch.put(bands(measured).withColumnsRenamed({"low": "_low", "high": "_high"}), "bands")
    measured = small_join(measured, ends, ["model"], "left")
    slack = SHORT / F.sqrt(F.greatest("symbols", F.lit(1)))
    inside = (F.col("per_letter") >= F.col("_low") - slack) & (F.col("middle") <= F.col("_high") + slack)
    return measured.withColumn("perplexity", F.pow(F.lit(2.0), "bits")).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("model", "bits", "per_letter", "middle", "symbols", "_low", "_high")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    judged = judge(docs, Scratch(spark), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")
