"""Toxicity scores: boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities of lexicon entries (a fixed list and one learned from labels), how near they stand to
the second person, capitals, punctuation and disguised spellings.  The label, language, source and id of a
document are never features.

What is learned comes from labelled rows that aren't held out: at most about `SAMPLE_ROWS` of them,
drawn by a hash of their id.  One half, by another hash, gives the lexicon; the other half trains the trees, so
that words which happen to stand in one toxic text don't look like evidence.  Scoring is one pass over the texts.

Cases: a null text counts as empty and is scored like any other; several labels of one id count as the
highest; labels without id, label or document are ignored; without usable labels all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm import boosting
from strandlog.llm.common import Scratch, add_columns, drawn, held_out

#: Labelled rows that are learned from, and entries of the learned lexicon.
SAMPLE_ROWS = 16_000
LEXICON_ROWS = 4_000
THRESHOLD = 0.7

# Common insults, and the second person in the corpus languages.
INSULTS = frozenset("idiot moron clown pathetic loser disgusting stupid trash worthless scum".split())
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tú".split()
)
DISGUISE = str.maketrans("013457@$!*", "oieastasi.")
_EDGE = ".,;:!?\"'()[]{}<>|#%&*$@~`^_-+=/\\"
_ODD = re.compile(r"[^\W\d_][@$*0-9!]+[^\W\d_]|(.)\1\1")
_NEAR = 5

FEATURES = [
    "fixed", "fixed_kinds", "strong", "strong_kinds", "weak", "weight", "near_you", "you", "disguised_hits", "capitals",
    "shouted", "exclaimed", "punctuation", "odd_spelling", "log_words",
]


def entries(word: str) -> list[str]:
    """What a lexicon may list of a word: the word itself, and how it begins."""
    return [word + "$", *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


def _tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens, the token numbers of all texts in order, and the texts' offsets."""
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.string()), "")))
    coded = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]


def count_entries(sample: DataFrame) -> DataFrame:
    """(entry, toxic, clean): documents of either label that have it, counted per chunk before the shuffle."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            labels = batch.column(batch.schema.get_field_index("toxic")).to_pylist()
            words, at, ends = _tokens(texts)
            known = [entries(w.strip(_EDGE).lower()) if w.strip(_EDGE) else [] for w in words]
            counts = Counter(), Counter()
            for i, label in enumerate(labels):
                counts[bool(label)].update({e for w in np.unique(at[ends[i] : ends[i + 1]]) for e in known[w]})
            names = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([counts[k][n] for n in names], pa.int64()) for k in (1, 0))],
                names=["entry", "toxic", "clean"],
            )

    return sample.mapInArrow(run, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame, rows: int = LEXICON_ROWS) -> dict[str, float]:
    """Entry -> log ratio of its rates in toxic and clean texts; the `rows` that mark most toxic texts."""
    totals = {r.toxic: r["count"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not clean:
        return {}
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    scored = count_entries(sample).where("toxic >= 2").withColumn("ratio", ratio).where(F.col("ratio") >= np.log(4.0))
    top = scored.orderBy(F.desc(F.col("ratio") * F.col("toxic")), "entry").limit(rows)
    return {r.entry: r.ratio for r in top.collect()}


def make_features(lexicon: dict[str, float]):
    """A function from texts to the matrix of `FEATURES`."""

    def of_word(token: str) -> tuple:
        core = token.strip(_EDGE)
        low = core.lower()
        weight = max((lexicon.get(e, 0.0) for e in entries(low)), default=0.0) if low and lexicon else 0.0
        odd = bool(_ODD.search(core))
        plain = low.translate(DISGUISE) if odd else low
        disguised = odd and (plain in INSULTS or any(lexicon.get(e, 0.0) > 3 for e in entries(plain)))
        letters = sum(map(str.isalpha, core)) if core else 0
        caps = sum(map(str.isupper, core)) if letters and core != low else 0
        return (
            low in INSULTS, weight > 3, 0 < weight <= 3, weight, low in SECOND_PERSON, disguised, caps, letters,
            caps == letters and letters > 1, token.count("!"), len(token) - letters, odd,
        )

    def features(texts: pa.Array) -> np.ndarray:
        words, at, ends = _tokens(texts)
        out = np.zeros((len(texts), len(FEATURES)))
        if not words:
            return out
        table = np.array([of_word(w) for w in words], np.float64)
        used = np.flatnonzero(np.diff(ends))

        def total(values: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(texts))
            sums[used] = np.add.reduceat(values, ends[:-1][used])
            return sums

        n = np.maximum(np.diff(ends), 1).astype(float)
        cols = {name: table[:, i] for i, name in enumerate(("fixed", "strong", "weak", "weight", "you", "disguised", "caps", "letters", "shouted", "bang", "other", "odd"))}
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        letters = np.maximum(total(cols["letters"][at]), 1)

        def kinds(flag: np.ndarray) -> np.ndarray:
            hit = np.flatnonzero(flag[at] > 0)
            pairs = np.unique(doc[hit].astype(np.int64) * len(words) + at[hit])
            return np.bincount(pairs // len(words), minlength=len(texts)).astype(float)

        hot = np.flatnonzero((cols["strong"][at] > 0) | (cols["fixed"][at] > 0))
        you = np.flatnonzero(cols["you"][at] > 0)
        near = np.zeros(len(texts))
        if len(hot) and len(you):
            right = np.searchsorted(you, hot)
            close = np.zeros(len(hot), bool)
            for k in (np.maximum(right - 1, 0), np.minimum(right, len(you) - 1)):
                close |= (np.abs(you[k] - hot) <= _NEAR) & (doc[you[k]] == doc[hot])
            near = np.bincount(doc[hot[close]], minlength=len(texts)).astype(float)
        out[:] = np.stack([
            total(cols["fixed"][at]) / n, kinds(cols["fixed"]), total(cols["strong"][at]) / n, kinds(cols["strong"]),
            total(cols["weak"][at]) / n, total(cols["weight"][at]) / n, near / n, total(cols["you"][at]) / n,
            total(cols["disguised"][at]), total(cols["caps"][at]) / letters, total(cols["shouted"][at]) / n,
            total(cols["bang"][at]) / n, total(cols["other"][at]) / letters, total(cols["odd"][at]) / n, np.log1p(np.diff(ends)),
        ], axis=1)
        return out

    return features


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of about `rows` labelled documents at most, none of them held out.

    Ids are drawn by hash on both sides first; so few labels are left that they are sent to the texts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    few = drawn(share, F.lit("toxicity"), F.col("doc_id"))
    return docs.select("doc_id", "text").where(few).join(F.broadcast(known.where(few)), "doc_id")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], boosting.Boosted]:
    scratch = Scratch(docs.sparkSession)
    sample = scratch.put(labelled_sample(docs, labels, rows), "toxicity_sample")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    lexicon = learn_lexicon(sample.where(half))
    rest = add_columns(sample.where(~half), "text", lambda: _as_work(make_features(lexicon)), "features array<double>")
    got = rest.select("doc_id", "toxic", "features").orderBy("doc_id").collect()  # at most `rows` rows
    scratch.drop("toxicity_sample")
    x = np.array([r.features for r in got]).reshape(-1, len(FEATURES))
    return lexicon, boosting.fit(x, np.array([float(r.toxic > 0) for r in got]))


def _as_work(features):
    def work(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
        x = features(texts)
        ends = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(x.ravel()))]

    return work


def score(docs: DataFrame, lexicon: dict[str, float], model: boosting.Boosted, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append `score` (0 to 1) and `predicted` (1 from `threshold` on)."""
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, model))  # LEXICON_ROWS entries and a few hundred numbers

    def make():
        features, trees = make_features(sent.value[0]), sent.value[1]

        def work(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            p = np.clip(trees.score(features(texts)), 0, 1)
            return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

        return work

    return add_columns(docs, text_col, make, "score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon, model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, lexicon, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
