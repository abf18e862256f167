"""Ids of any size, repeated ids, letters of any script, columns of any name: nothing may be lost by them."""

import random

import pytest
from oracle import DATA
from pyspark.sql import functions as F
from test_text_queries import near_groups

import corpus_pipeline as P
from strandlog.llm import decontaminate, langid, near_dedup, toxicity
from strandlog.llm.common import draw_limit, hot_join

SF = f"{DATA}/sf0.001"


def text_of(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


def test_ids_of_any_size_and_sign(make, scratch):
    big = 1 << 62
    rows = [(big + 5, text_of(1)), (big + 6, text_of(2)), (-7, text_of(3)), (-(1 << 63), text_of(4)), ((1 << 63) - 1, text_of(3)), (0, text_of(1) + " end")]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.find(make(rows), scratch()).collect()}
    assert got == {big + 5: (0, False), big + 6: (big + 6, True), -7: (-7, True), -(1 << 63): (-(1 << 63), True), (1 << 63) - 1: (-7, False), 0: (0, True)}
    assert sorted(r.doc_id for r in near_dedup.keep_one(make(rows), scratch()).collect()) == [-(1 << 63), -7, 0, big + 6]


def test_repeated_ids_are_judged_by_their_own_text(make, scratch):
    rows = [(5, text_of(1)), (5, text_of(2)), (6, text_of(1) + " end"), (7, text_of(2) + " end"), (8, text_of(9))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.find(make(rows), scratch()).collect())
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True)]
    kept = near_dedup.keep_one(make(rows), scratch()).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, text_of(1)), (5, text_of(2)), (8, text_of(9))])


def test_crowded_elements(make, scratch, monkeypatch):
    """The exact search of mixed buckets finds all links, also of sets that are made of common elements."""
    monkeypatch.setattr(near_dedup, "BANDS", 2)
    r = random.Random(8)
    base = [f"b{i}" for i in range(12)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(12)] = f"z{r.randrange(6)}"
        texts.append(" ".join(words))
    sets = scratch().put(near_dedup._full_sets(make(texts).select("doc_id", "text"), _numbered(make(texts), scratch()), 1), "s")
    entries = sets.select("node", F.lit(1).alias("bucket"))
    labels = sets.select("node", F.col("node").alias("component")).limit(0)
    found = near_dedup._rest(entries, labels, sets, scratch(), 80)
    got = {(x.a, x.b) for x in near_dedup._confirm(found, sets, 80).collect()}
    full = {x.node: frozenset(x.elements) for x in sets.collect()}
    want = {(a, b) for a in full for b in full if a > b and 100 * len(full[a] & full[b]) >= 80 * len(full[a] | full[b])}
    assert got == want and want


def _numbered(docs, scratch):
    rows = near_dedup.sketch(docs.select("doc_id", "text"), 1)
    classes = rows.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"))
    return scratch.put(classes.withColumn("node", F.monotonically_increasing_id()), "numbered")


def test_near_groups_of_common_words(make, scratch):
    r = random.Random(3)
    texts = [" ".join(r.choices("abcdefgh", k=r.randint(1, 14))) for _ in range(150)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.find(make(texts), scratch(), words=2).collect()}
    assert got == near_groups(enumerate(texts), 2)


def test_hot_keys_are_joined_once(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 ELSE id DIV 4 END AS k")
    by_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    want = sorted(map(tuple, rows.join(by_key, "k").select("k", "id", "n", "least").collect()))
    assert sorted(map(tuple, hot_join(rows, by_key, ["k"], "n").select("k", "id", "n", "least").collect())) == want


GREEK = "ΟΔΟΣ'ΑΒ ΟΔΟΣ.Γ σίγμα ΤΕΛΟΣ"
TURKISH = "İstanbul IĞDIR ısı İZMİR"


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST, 0])
def test_scripts_on_both_paths(spark, make, limit):
    """Both paths agree with a plain search, whatever the letters and their neighbours."""
    import re

    r = random.Random(12)
    pool = (GREEK + " " + TURKISH + " Plain WORDS 1 2 x").split(" ")
    texts = [" ".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(40)]
    items = [(i, " ".join(r.choices(pool, k=k))) for i, k in enumerate([2, 3, 13, 14, 20, 5])]
    texts += ["a b c " + items[3][1] + "'x", items[4][1], items[4][1].upper(), None, ""]

    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]

    want = {}
    for i, t in enumerate(texts):
        w, hit, own = words(t), set(), set()
        for item, body in items:
            b = words(body)
            n = min(13, len(b))
            for j in range(len(b) - n + 1):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == b[j : j + n]:
                        hit |= set(range(at, at + n))
                        own.add(str(item))
        want[i] = (len(w), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, list(x["items"]), x.contaminated) for x in decontaminate.find(make(texts), bench, max_broadcast=limit).collect()}
    assert got == want and any(v[3] for v in want.values())


def test_draws_of_large_tables():
    assert draw_limit(1.0) == draw_limit(3.0) == (1 << 63) - 1 and draw_limit(0.0) == -1
    for rows, n in ((750, 10**11), (toxicity.SAMPLE_ROWS, 10**12), (langid.SAMPLE_ROWS, 10**11)):
        expected = n * (draw_limit(rows / n) + 1) / (1 << 63)
        assert abs(expected - rows) < 1


def test_stages_with_clashing_names(spark):
    """Columns that bear the operators' own names go through every stage unchanged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["bits", "model", "symbols", "n_words", "_key", "kept", "bands", "set_a", "component", "node", "least", "removed_runs", "key_a", "_row", "_w", "_part", "_model", "per_letter", "middle", "a", "b", "Words two"]
    odd = docs.selectExpr("*", *[f"concat('{i}:', doc_id) AS `{n}`" for i, n in enumerate(names)])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows, name
        for row in rows:
            assert [row[n] for n in names] == [f"{i}:{row.doc_id}" for i in range(len(names))], name
