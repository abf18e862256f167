"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

Words of equal length advance together through the lattice: the polynomial hash of every substring is
looked up among the sorted hashes of the vocabulary's pieces, and the best predecessor of each
end position is kept as a backpointer.

* For a *unigram* model a path's score is the sum of its pieces' log probabilities.
* For a *BPE* model the library does not maximise a sum: it applies merges in order of rank.  A path
  is the library's own segmentation exactly if each two neighbouring pieces would stay apart when
  their joint text were encoded alone, so the lattice allows a step only between such neighbours; one
  path is left, and its last piece at each position is the backpointer.

Models with other normalisers than identity are refused.  Text is treated as that one does: a space is put before the
text and spaces become U+2581.  Characters outside the vocabulary become byte pieces.  A null text has
null ids; an empty text has no ids.  A literal U+2581 decodes to a space, as in the library.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.common import add_columns

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int64(1) << 40
#: Cells of the lattice that are worked on at once.
_CELLS = 1 << 19
#: Characters of a word that is encoded whole, of the stretches of a longer one, and what two stretches share.
LONG, STRETCH, SHARED = 1024, 512, 96


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """[B, L] code points -> [B, L + 1] hashes of every prefix."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
    return out


def _spread(keys: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit keys that fills the leading bits evenly."""
    keys = (keys ^ (keys >> np.uint64(32))) * _BASE
    return keys ^ (keys >> np.uint64(29))


class SortedKeys:
    """Sorted 64-bit keys, spread evenly; their leading bits tell where a search starts."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = _spread(keys)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.first = np.append(self.first, np.int32(len(keys)))
        self.longest = int(np.diff(self.first).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key among the sorted keys, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        wanted = _spread(wanted)
        bucket = (wanted >> self.shift).astype(np.int64)
        at = self.first[bucket]
        left = np.flatnonzero(at < self.first[bucket + 1])
        at, end, sought = at[left], self.first[bucket[left] + 1], wanted[left]
        for _ in range(self.longest):
            hit = self.keys[at] == sought
            out[left[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, sought = left[more], at[more], end[more], sought[more]
            if not len(left):
                break
        return out


def _merge_order(piece: str, rank: dict[str, int]) -> list[tuple[str, str]]:
    """The merges, first to last, that the ranks apply to the characters of `piece`."""
    parts, done = list(piece), []
    while len(parts) > 1:
        best = min(((rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=None)
        if best is None or best[0] == 1 << 40:
            break
        i = best[1]
        done.append((parts[i], parts[i + 1]))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return done if len(parts) == 1 else []


@dataclass
class PieceModel:
    """The vocabulary as arrays; its size is that of the model file, so it may be sent to every task."""

    bpe: bool
    raw: list[bytes]  # what each id decodes to
    keys: SortedKeys  # hashes of the pieces that text can match
    ids: np.ndarray  # their ids, in the keys' order
    longest: int
    score: np.ndarray
    rank: np.ndarray  # per id: place in the merge order, -1 for what no merge makes
    left: np.ndarray
    right: np.ndarray
    pair_keys: SortedKeys  # id pairs whose joint text is a piece
    pair_rank: np.ndarray
    byte_ids: np.ndarray | None
    unknown: int

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        bpe = proto.trainer_spec.model_type == 2
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that normalise by identity, with a space in front, are supported")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        plain = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("pieces that span words are not supported")
        score = np.array([p.score for p in proto.pieces] + [0.0])
        n = len(proto.pieces)
        score[n] = min((p.score for p in proto.pieces if p.type == 1), default=0.0) - 10.0
        raw = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" for p in proto.pieces]
        byte_ids = np.full(256, -1, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                byte_ids[int(p.piece[3:5], 16)] = i
                raw[i] = bytes([int(p.piece[3:5], 16)])
        rank = np.full(n + 1, -1, np.int64)
        left, right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        pairs: dict[int, int] = {}
        matched = dict(plain)
        if bpe:
            order = {p: int(-proto.pieces[i].score) for p, i in plain.items() if len(p) > 1}
            for p, i in plain.items():
                if len(p) < 2:
                    continue
                for cut in range(1, len(p)):
                    a, b = plain.get(p[:cut]), plain.get(p[cut:])
                    if a is not None and b is not None:
                        pairs[a * (n + 1) + b] = order[p]
                merges = _merge_order(p, order)
                if merges:
                    rank[i], left[i], right[i] = order[p], plain[merges[-1][0]], plain[merges[-1][1]]
                else:  # no order of merges arrives at it, so the library never gives it
                    del matched[p]
        hashes = np.array([_prefix_hashes(np.array([[ord(c) for c in p]], np.uint64))[0, -1] for p in matched], np.uint64)
        ids = np.array(list(matched.values()), np.int64)
        keys = SortedKeys(hashes)
        pair_keys = SortedKeys(np.array(list(pairs), np.uint64))
        return cls(
            bpe, raw, keys, ids[keys.order], max(map(len, matched)), score, rank, left, right, pair_keys,
            np.array(list(pairs.values()), np.int64)[pair_keys.order], byte_ids if (byte_ids >= 0).all() else None,
            next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0),
        )

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the joint text of pieces a and b gives just these two.

        Merges are undone from the last to the first; the two sides may not have had a merge across
        their border that was due before the merge that was undone.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), _FAR)
        width = len(self.rank)
        while len(live):
            at = self.pair_keys.find((a * width + b).astype(np.uint64))
            crossed = (at >= 0) & (self.pair_rank[at] < limit) if len(self.pair_rank) else at >= 0
            ok[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            later = rb >= ra
            limit = np.where(later, rb + 1, ra)
            a, b = np.where(later, a, self.right[a]), np.where(later, self.left[b], b)
        return ok

    def _lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[B, L] code points -> for each end position the id and the length of its best last piece."""
        rows, length = codes.shape
        none = len(self.raw)
        prefix = _prefix_hashes(codes)
        found = [np.empty(0)]
        for size in range(1, min(self.longest, length) + 1):
            power = np.uint64(pow(int(_BASE), size, 1 << 64))
            at = self.keys.find((prefix[:, size:] - prefix[:, :-size] * power).ravel())
            found.append(np.where(at >= 0, self.ids[at], none if size == 1 else -1).reshape(rows, -1))
        last = np.full((rows, length + 1), -1, np.int64)
        back = np.zeros((rows, length + 1), np.int64)
        best = np.zeros((rows, length + 1))
        for end in range(1, length + 1):
            if not self.bpe:
                best[:, end] = -np.inf
            todo = np.arange(rows)
            for size in range(min(self.longest, end), 0, -1):
                start = end - size
                piece = found[size][todo, start]
                able = piece >= 0
                on, piece = todo[able], piece[able]
                if not len(on):
                    continue
                if self.bpe:
                    if start:
                        fits = self.stay_apart(last[on, start], piece)
                        on, piece = on[fits], piece[fits]
                else:
                    total = best[on, start] + self.score[piece]
                    more = total > best[on, end]
                    on, piece = on[more], piece[more]
                    best[on, end] = total[more]
                last[on, end], back[on, end] = piece, size
                if self.bpe:
                    todo = todo[back[todo, end] == 0]
        return last, back

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, and the offsets (one more than words)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        long = np.flatnonzero(sizes > LONG) if self.bpe else np.zeros(0, np.int64)
        if not len(long):
            return self._bytes_for_unknown(*self._segment(codes, starts, sizes)[:2])
        short = np.flatnonzero(sizes <= LONG)
        flat, ends, _ = self._segment(codes, starts[short], sizes[short])
        made: list[np.ndarray] = [None] * len(words)
        for k, i in enumerate(short.tolist()):
            made[i] = flat[ends[k] : ends[k + 1]]
        for i in long.tolist():
            made[i] = self._long_word(codes[starts[i] : starts[i] + sizes[i]])
        return self._bytes_for_unknown(np.concatenate(made), np.concatenate([[0], np.cumsum([len(x) for x in made])]))

    def _long_word(self, codes: np.ndarray) -> np.ndarray:
        """The pieces of one long word for a BPE model, from stretches that are encoded together."""
        starts = np.arange(0, max(len(codes) - SHARED, 1), STRETCH)
        flat, ends, lengths = self._segment(codes, starts, np.minimum(STRETCH + SHARED, len(codes) - starts))
        none, out, done = len(self.raw), [], 0  # `done`: where the pieces taken so far end
        for k, start in enumerate(starts.tolist()):
            ids = flat[ends[k] : ends[k + 1]]
            stops = start + np.cumsum(lengths[ends[k] : ends[k + 1]])
            first = int(np.searchsorted(stops, done, "right"))  # the first piece that begins at `done`
            if k + 1 == len(starts):
                out.append(ids[first:])
                break
            own, after = slice(ends[k + 1], ends[k + 2]), starts[k + 1]
            next_ids, next_from = flat[own], after + np.cumsum(lengths[own]) - lengths[own]
            # places where a piece ends here and one begins there, those in the middle of the shared part first
            both, here, there = np.intersect1d(stops[first:], next_from, return_indices=True)
            here = here + first
            fits = self.stay_apart(np.where(ids[here] < 0, none, ids[here]), np.where(next_ids[there] < 0, none, next_ids[there]))
            usable = np.flatnonzero(fits & (both > done))
            if not len(usable):
                return self._segment(codes, np.zeros(1, np.int64), np.array([len(codes)]))[0]
            at = usable[np.argmin(np.abs(both[usable] - after - SHARED // 2))]
            out.append(ids[first : here[at] + 1])
            done = int(both[at])
        return np.concatenate(out)

    def _segment(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1 - code point for what no piece matches) of each run of characters, the offsets, and the pieces' lengths."""
        none = len(self.raw)
        counts = np.zeros(len(sizes), np.int64)
        made = []
        by_size = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[by_size], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(sizes)]):
            length = int(sizes[by_size[lo]])
            step = max(1, _CELLS // max(length, 1))
            for at in range(lo, hi if length else lo, step):
                rows = by_size[at : min(at + step, hi)]
                block = codes[starts[rows][:, None] + np.arange(length)]
                last, back = self._lattice(block)
                pos, live, steps = np.full(len(rows), length), np.arange(len(rows)), []
                while len(live):
                    token, size = last[live, pos[live]], back[live, pos[live]]
                    cp = block[live, pos[live] - 1].astype(np.int64)
                    steps.append((live, np.where(token == none, -1 - cp, token), size))
                    pos[live] -= size
                    live = live[pos[live] > 0]
                n = np.bincount(np.concatenate([s[0] for s in steps]), minlength=len(rows))
                counts[rows] = n
                flat, lengths = np.empty(n.sum(), np.int64), np.empty(n.sum(), np.int64)
                ends = np.cumsum(n)
                for k, (live, token, size) in enumerate(steps):
                    flat[ends[live] - 1 - k], lengths[ends[live] - 1 - k] = token, size
                made.append((rows, flat, lengths))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out, spans = np.empty(offsets[-1], np.int64), np.empty(offsets[-1], np.int64)
        for rows, flat, lengths in made:
            n = counts[rows]
            place = np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(len(flat))
            out[place], spans[place] = flat, lengths
        return out, offsets, spans

    def _bytes_for_unknown(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace -1 - code point by the ids of its UTF-8 bytes, or by the unknown id."""
        cp = -1 - ids
        odd = cp >= 0
        if not odd.any():
            return ids, offsets
        if self.byte_ids is None:
            return np.where(odd, self.unknown, ids), offsets
        n = np.where(odd, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), 1)
        ends = np.cumsum(n)
        out, cp, size = np.repeat(ids, n), np.repeat(cp, n), np.repeat(n, n)
        nth = np.arange(len(out)) - np.repeat(ends - n, n)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        low = cp >> (6 * np.maximum(size - 1 - nth, 0))
        byte = np.where(size == 1, cp, np.where(nth == 0, lead | low, 0x80 | (low & 63)))
        out = np.where(cp >= 0, self.byte_ids[np.where(cp >= 0, byte, 0)], out)
        return out, np.concatenate([[0], ends])[offsets]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as an Arrow list<int32>."""
        texts = texts.cast(pa.string())
        spaced = pc.fill_null(texts, "")
        plain = pc.and_(pc.invert(pc.match_substring_regex(spaced, f"  |^ |{SPACE}")), pc.greater(pc.binary_length(spaced), 0))
        if pc.all(plain).as_py():
            split = pc.split_pattern(spaced, " ")
            words, at = split.flatten(), split.offsets.to_numpy()
        else:
            unit = re.compile(f"{SPACE}+[^{SPACE}]*")
            parts = [unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in spaced.to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            words = pa.array([w[1:] for p in parts for w in p], pa.string())
        coded = words.dictionary_encode()
        flat, offsets = self.encode_words([SPACE + w for w in coded.dictionary.to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        spread = lists.take(coded.indices)
        ends = spread.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(ends[at], pa.int32()), spread.values[ends[0] : ends[-1]], mask=texts.is_null())

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each list of ids: a gather from the pieces' bytes, cut at the texts' ends."""
        flat = ids.flatten()
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        table = pa.array(self.raw, pa.large_binary())
        spread = table.take(pc.fill_null(flat, self.unknown))
        _, offs, data = spread.buffers()
        offs = np.frombuffer(offs, np.int64)[spread.offset : spread.offset + len(spread) + 1] if len(spread) else np.zeros(1, np.int64)
        cut = offs[ends]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        first = cut[:-1] + ((cut[1:] > cut[:-1]) & (whole[np.minimum(cut[:-1], len(whole) - 1)] == 32))
        blob = whole.tobytes()
        out = [blob[a:b].decode("utf-8", "replace") for a, b in zip(first.tolist(), cut[1:].tolist())]
        return pa.array(out, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))


def encode(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Append `token_ids` (array of int) and `n_tokens`; null text has null ids and no tokens."""
    sent = df.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def make():
        model = sent.value

        def work(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            ids = model.encode(texts)
            return [ids, pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64())]

        return work

    return add_columns(df, text_col, make, "token_ids array<int>, n_tokens bigint")


def decode(df: DataFrame, model_path: str, ids_col: str = "token_ids") -> DataFrame:
    """Append `decoded`, the text of the ids; null for null."""
    sent = df.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def run(batches):
        model = sent.value
        for batch in batches:
            step = 256
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                yield part.append_column("decoded", model.decode(part.column(part.schema.get_field_index(ids_col))))

    kept = df.drop("decoded")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Encode, decode again and append `round_trip`: whether the text came back unchanged.

    One pass over the rows: ids go to the decoder inside the task and are not sent to the JVM between.
    """
    sent = df.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def make():
        model = sent.value

        def work(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            ids = model.encode(texts)
            same = pc.equal(model.decode(ids), texts.cast(pa.string()))
            return [ids, pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64()), pc.fill_null(same, True)]

        return work

    return add_columns(df, text_col, make, "token_ids array<int>, n_tokens bigint, round_trip boolean")


def query(spark, sf_dir: str, model_path: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, model_path).select("doc_id", "n_tokens", F.col("token_ids"), "round_trip")
