"""Paths on their way to their start, packed: the last shuffle of a step that compares a start's paths together.

A way is a path of a start, as columns t0, k0, t1, k1, ... of its nodes, the table `to` that it leads into and the keys it leads to:
as `gaps` (the sorted numbers' differences, four bytes each) if they are plain decimals, else as the texts `far`.  Ways without t1 hold
the nodes that the start has visited.  `pack` makes parcels of many ways, column by column and compressed, `compare` opens those of a
bucket and leaves each key to the least path that leads to it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ways that are packed at once, and paths that are compared at once and that a bucket holds at most; they bound a worker's memory.
WAYS, PATHS, BUCKET_PATHS = 1 << 18, 1 << 21, 1 << 22
#: At most this many buckets: more would leave few ways in a parcel, and those don't compress.
MOST_BUCKETS = 2048
#: Ways that go back to Spark at once.
BATCH = 4096
CODEC = pa.Codec("zstd", compression_level=3)
DECIMAL = r"^(0|[1-9][0-9]{0,17})$"


def encode(lists: DataFrame, columns: list[str], far: str = "far") -> DataFrame:
    """The columns, and the list `far` of distinct texts as `gaps` or, if they aren't numbers with gaps of four bytes, as it is."""
    kept = lists.select(*columns, far).schema
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = pa.list_(pa.string())
            texts = b.column(far).cast(names)
            gaps, plain = _gaps(texts)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), gaps, texts if plain else pa.nulls(len(texts), names)], [*columns, "gaps", "far"])

    fields = ", ".join(f"`{c}` {kept[c].dataType.simpleString()}" for c in columns)
    return lists.select(*columns, far).mapInArrow(run, f"{fields}, gaps binary, far array<string>")


def _gaps(texts: pa.ListArray) -> tuple[pa.Array, bool]:
    flat, ends = texts.flatten(), np.cumsum(_lengths(texts))
    if len(texts) and pc.all(pc.match_substring_regex(flat, DECIMAL), min_count=0).as_py() and not flat.null_count:
        numbers, starts = flat.cast(pa.int64()).to_numpy(), np.concatenate([[0], ends[:-1]])
        counts = ends - starts
        numbers = numbers[np.lexsort((numbers, np.repeat(np.arange(len(counts)), counts)))]
        gaps = np.diff(numbers, prepend=0)
        gaps[starts[counts > 0]] = numbers[starts[counts > 0]]
        if not len(gaps) or gaps.max() < 1 << 32 and 4 * len(gaps) < 1 << 31:
            offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(gaps.astype("<u4"))]), False
    return pa.nulls(len(texts), pa.binary()), True


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


# ---- columns


def _thin(column: pa.Array) -> tuple:
    """Texts as numbers, if they are plain decimals, or as places in a short table."""
    if column.null_count == len(column):
        return "null", len(column)
    found = column.dictionary_encode()
    if len(found.dictionary) < 256 and len(found.dictionary) * 4 < len(column) + 4:
        return "few", found.dictionary.to_pylist(), pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False).astype(np.int16)
    if not column.null_count and pc.all(pc.match_substring_regex(column, DECIMAL)).as_py():
        numbers = column.cast(pa.int64()).to_numpy()
        rising = bool((numbers[1:] >= numbers[:-1]).all())
        return "numbers", rising, _planes(np.diff(numbers, prepend=0) if rising else numbers)
    return "texts", column.to_pylist()


def _wide(thin: tuple) -> pa.Array:
    match thin:
        case "null", n:
            return pa.nulls(n, pa.string())
        case "few", words, places:
            return pa.array(words, pa.string()).take(pa.array(places, mask=places < 0))
        case "numbers", rising, planes:
            numbers = _whole(planes, "<i8")
            return pa.array(np.cumsum(numbers) if rising else numbers).cast(pa.string())
        case _, texts:
            return pa.array(texts, pa.string())


def _planes(numbers: np.ndarray) -> np.ndarray:
    """All first bytes, then all second ones: the high ones are mostly zero and compress to nothing."""
    width = numbers.dtype.itemsize
    return np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, width).T)


def _whole(planes: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


# ---- parcels


def buckets(paths: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-paths // BUCKET_PATHS)))


def pack(ways: DataFrame, nodes: list[str], n: int) -> DataFrame:
    """(bucket, parcel) of the ways, by a hash of the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= WAYS:
                yield from _parcels(held, nodes)
                held, rows = [], 0
        if rows:
            yield from _parcels(held, nodes)

    return ways.select(F.pmod(F.xxhash64("t0", "k0"), F.lit(n)).cast("int").alias("bucket"), *nodes, "to", "gaps", "far").mapInArrow(run, "bucket int, parcel binary")


def _parcels(held: list[pa.RecordBatch], nodes: list[str]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    keys = table.select(["bucket", "k0"]).append_column("n", pc.binary_length(table["k0"]))
    table = table.take(pc.sort_indices(keys, [("bucket", "ascending"), ("n", "ascending"), ("k0", "ascending")])).combine_chunks()
    bucket = table["bucket"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, z in zip(cuts, cuts[1:]):
        part = {c: table[c].chunk(0).slice(a, z - a) for c in table.column_names}
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([_parcel(part, nodes)], pa.binary())], ["bucket", "parcel"])


def _parcel(part: dict[str, pa.Array], nodes: list[str]) -> bytes:
    gaps, far = part["gaps"], part["far"]
    sizes = pc.fill_null(pc.binary_length(gaps), 0).to_numpy(zero_copy_only=False).astype(np.uint32) // 4
    data = np.frombuffer(b"".join(x for x in gaps.to_pylist() if x), "<u4")
    raw = pickle.dumps(([_thin(part[c]) for c in (*nodes, "to")], _planes(sizes), _planes(data), None if far.null_count == len(far) else far.to_pylist()), protocol=5)
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def _open(parcels: list[bytes], nodes: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array | None]:
    """Nodes and `to` of all ways, how many keys each leads to, and those keys: numbers, or places in the given texts."""
    heads, sizes, keys, plain = [], [], [], []
    for p in parcels:
        columns, size, data, far = pickle.loads(CODEC.decompress(memoryview(p)[8:], int.from_bytes(p[:8], "little"), asbytes=True))
        heads.append(pa.table([_wide(c) for c in columns], names=[*nodes, "to"]))
        size, gaps = _whole(size, "<u4").astype(np.int64), _whole(data, "<u4").astype(np.int64)
        starts = np.cumsum(size) - size
        some = size > 0
        total = np.cumsum(gaps)
        numbers = total - np.repeat(total[starts[some]] - gaps[starts[some]], size[some])
        if far is None:
            sizes.append(size)
            keys.append(numbers)
            plain.append(None)
            continue
        read = iter(numbers.astype(str).tolist())
        lists = [x if x is not None else [next(read) for _ in range(n)] for x, n in zip(far, size.tolist())]
        sizes.append(np.array([len(x) for x in lists], np.int64))
        keys.append(None)
        plain.append(pa.array([k for x in lists for k in x], pa.string()))
    words = None
    if any(x is not None for x in plain):
        found = pa.concat_arrays([x if x is not None else pa.array(n).cast(pa.string()) for x, n in zip(plain, keys)]).dictionary_encode()
        keys, words = [found.indices.to_numpy().astype(np.int64)], found.dictionary
    return pa.concat_tables(heads).combine_chunks(), np.concatenate(sizes), np.concatenate(keys), words


def compare(parcels: DataFrame, nodes: list[str]) -> DataFrame:
    """(nodes, to, far): per way the keys that no lesser path of the start leads to, and that it hasn't visited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for bucket, parcel in zip(b.column("bucket").to_pylist(), b.column("parcel").to_pylist()):
                if bucket != at and held:
                    yield from _compared(held, nodes)
                    held = []
                at = bucket
                held.append(parcel)
        if held:
            yield from _compared(held, nodes)

    fields = ", ".join(f"{c} string" for c in (*nodes, "to"))
    return parcels.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{fields}, far array<string>")


def _compared(parcels: list[bytes], nodes: list[str]) -> Iterator[pa.RecordBatch]:
    heads, sizes, keys, words = _open(parcels, nodes)
    # what was visited has no t1 and comes first
    order = pc.sort_indices(heads, [(c, "ascending") for c in ("k0", *(c for c in nodes if c != "k0"))], null_placement="at_start").to_numpy()
    offsets = (np.cumsum(sizes) - sizes)[order]
    heads, sizes = heads.take(order).combine_chunks(), sizes[order]
    start = np.concatenate([[0], np.cumsum(_changes(heads["k0"]) | _changes(heads["t0"]))]) if len(order) else np.zeros(0, np.int64)
    table = heads["to"].chunk(0).dictionary_encode().indices.to_numpy().astype(np.int64)
    old = pc.is_null(heads["t1"].chunk(0)).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(order):
        z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PATHS, "right"))
        if z < len(order):  # whole starts, one at least
            cut = int(np.searchsorted(start, start[z], "left"))
            z = cut if cut > a else int(np.searchsorted(start, start[a], "right"))
        way = np.repeat(np.arange(a, z), sizes[a:z])
        first = np.cumsum(sizes[a:z]) - sizes[a:z]
        key = keys[np.repeat(offsets[a:z] - first, sizes[a:z]) + np.arange(len(way))]
        places = np.unique(key, return_inverse=True)[1] if len(key) and key.max() >= 1 << 31 else key
        wide = int(places.max()) + 1 if len(places) else 1
        group = (start[way] - start[a]) * (int(table.max()) + 1) + table[way]
        if len(group) and int(group.max() + 1) * wide >= 1 << 62:
            places = np.unique(places, return_inverse=True)[1]
            wide = int(places.max()) + 1
        won = np.zeros(len(way), bool)
        won[np.unique(group * wide + places, return_index=True)[1]] = True
        won &= ~old[way]
        counts = np.bincount(way[won] - a, minlength=z - a)
        far = pa.array(key[won])
        far = far.cast(pa.string()) if words is None else words.take(far)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        for i in range(a, z, BATCH):
            j = min(i + BATCH, z)
            cuts = bounds[i - a : j - a + 1]
            lists = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), far[cuts[0] : cuts[-1]])
            some = pa.array(counts[i - a : j - a] > 0)
            out = pa.table([*(heads[c].slice(i, j - i) for c in (*nodes, "to")), lists], names=[*nodes, "to", "far"]).filter(some)
            yield from out.combine_chunks().to_batches()
        a = z


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    one = column.chunk(0)
    return pc.not_equal(one[1:], one[:-1]).to_numpy(zero_copy_only=False)
