"""Perplexity bands and the distributed language model."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlog.llm import quality

SYLLABLES = ["ba", "de", "ki", "lo", "mu", "na", "pe", "ra"]


def prose(r, syllables=SYLLABLES, n=300):
    return [("".join(r.choices(syllables, k=r.randint(1, 4)))) for _ in range(n)]


def test_bands_follow_the_spread(make):
    """Marks after every word are rejected; a quotation in another language isn't, a whole text in it is."""
    r = random.Random(4)
    foreign = ["xt", "zu", "wy", "qo", "vj", "hg"]
    texts = [" ".join(prose(r)) for _ in range(200)]
    texts += [" | ".join(prose(r)), "".join(w + r.choice(["### ", "$$$ ", "%%% "]) for w in prose(r))]
    texts += [" ".join(prose(r) + prose(r, foreign, 100) + prose(r)), " ".join(prose(r, foreign))]
    kept = {x.doc_id: x.kept for x in quality.judge(make(texts)).collect()}
    assert all(kept[i] for i in range(200)) and [kept[i] for i in range(200, 204)] == [False, False, True, False]


def test_distributed_model_equals_the_one_in_memory(spark, make, scratch):
    """Marks and letters outside ASCII keep their identity, and the prices are a modified Kneser-Ney model's."""
    r = random.Random(5)
    texts = [" ".join(prose(r, ["да", "не", "ба", "#", "$"], 40)) for _ in range(30)]
    docs = make(texts).withColumn("_model", F.lit("en"))
    counted = quality.gram_rows(docs.select("text", "_model")).groupBy("model", "a", "b").agg(F.sum("n").alias("n"))
    rows = {(x.a, x.b): x for x in counted.join(quality.price(counted), ["model", "a", "b"]).collect()}
    plain = Counter(tuple(("\0" * 3 + t)[i : i + 4]) for t in texts for i in range(len(t)))
    point = {c: ord(c) + 1 if c != "\0" else 0 for c in set("\0" + "".join(texts))}
    pack = lambda g: (point[g[0]] << 21 | point[g[1]], point[g[2]] << 21 | point[g[3]])
    assert {k: x.n for k, x in rows.items()} == {pack(g): n for g, n in plain.items()}
    number = {c: i for i, c in enumerate(sorted(point))}
    keys = sorted((sum(number[c] * 40 ** (3 - i) for i, c in enumerate(g)), pack(g), n) for g, n in plain.items())
    model = quality.KneserNey.fit(np.array([k for k, _, _ in keys]), np.array([n for _, _, n in keys]))
    # the folded model spreads what is left at the end over 40 classes, the other over those seen
    model.left[0].values[:] *= 40 / (len(point) - 1)
    assert [rows[p].bits for _, p, _ in keys] == pytest.approx(model.bits(np.array([k for k, _, _ in keys])).tolist(), abs=1e-6)


def test_every_language_has_its_own_bands(spark):
    """A small tenth language is not judged by what a ninth and larger one writes."""
    r = random.Random(6)
    noise = lambda: prose(r, "abcdefghijklmnopqrstuvwxyz", 300)
    rows = [(lang, " ".join(prose(r, n=60))) for lang in "abcdefgh" for _ in range(31)] + [("i", " ".join(prose(r))) for _ in range(30)]
    rows += [("j", " ".join(noise())) for _ in range(5)]
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")
    assert [x.lang for x in quality.judge(docs).where("NOT kept").collect() if x.lang in "ij"] == []


def plain_bits(texts):
    """Interpolated modified Kneser-Ney over 4-grams of characters, by dictionaries: text -> bits of each character."""
    grams = [Counter()]
    for t in texts:
        padded = "\0" * 3 + t
        grams[0].update(padded[i : i + 4] for i in range(len(t)))
    for _ in range(3):  # shorter ones count the kinds of characters before them
        grams.insert(0, Counter(g[1:] for g in grams[0]))
    cut, total, spare = [], [], []
    for level in grams:
        n = [max(1, sum(c == k for c in level.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        top = [0, 0.95, 1.9, 2.85]
        d = [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), top[k]) for k in (1, 2, 3))]
        sums, left = Counter(), Counter()
        for g, c in level.items():
            sums[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        cut.append(d), total.append(sums), spare.append(left)
    kinds = len(grams[0])

    def p(g):
        if not g:
            return 1 / kinds
        k, c = len(g) - 1, grams[len(g) - 1][g]
        return (c - cut[k][min(c, 3)]) / total[k][g[:-1]] + max(spare[k][g[:-1]] / total[k][g[:-1]], 1e-9) * p(g[1:])

    return lambda t: [-np.log2(p(("\0" * 3 + t)[i : i + 4])) for i in range(len(t))]


def test_perplexity_against_brute_force(make, scratch, monkeypatch):
    """Also when a part holds one text and a slice a few characters only."""
    r = random.Random(15)
    texts = [" ".join(prose(r, ["да", "не", "ba", "ki", "é", "|"], r.randint(1, 30))) for _ in range(40)] + ["", None, "x"]
    bits = plain_bits([t for t in texts if t])
    for part, chunk in ((quality.PART, quality._CHUNK), (1, 7)):
        monkeypatch.setattr(quality, "PART", part)
        monkeypatch.setattr(quality, "_CHUNK", chunk)
        got = {x.doc_id: x.perplexity for x in quality.judge(make(texts), scratch()).collect()}
        for i, t in enumerate(texts):
            assert got[i] == (pytest.approx(2 ** np.mean(bits(t)), rel=1e-4) if t else None), (part, i)


def test_texts_in_another_script_are_rejected(spark):
    r = random.Random(16)
    russian = lambda n=120: " ".join(prose(r, ["да", "не", "по", "ло", "ми", "ра", "су", "ки"], n))
    odd = [" ".join(prose(r, ["αλ", "βε", "γο", "δι"], 120)), " ".join(prose(r, ["שא", "לב", "מי"], 120)), " ".join("".join(r.choices("абвгдежзийклмнопрстуфхцчшщъыьэюя", k=7)) for _ in range(120))]
    docs = spark.createDataFrame([(i, t, "ru") for i, t in enumerate([russian() for _ in range(300)] + odd)], "doc_id long, text string, lang string")
    rejected = sorted(x.doc_id for x in quality.judge(docs).where("NOT kept").collect())
    assert rejected == [300, 301, 302]
