"""Edge cases of the operators: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_queries import base_spans, check_pii, near_groups

from strandlog.llm import boosting, decontaminate, html_text, langid, line_dedup, near_dedup, pii, preference, quality, toxicity
from strandlog.llm.components import components

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))


# ---- preference pairs


def test_preference_pairs(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", None),
        (2, "chosen", 0, None, "x"), (3, "chosen", 0, "user", "a"), (3, "rejected", 0, "user", "a"), (None, "chosen", 0, "user", "lost"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("prompt", F.lit("mine"))
    got = {r.pair_id: r for r in preference.pair_turns(df).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n" and one.n_prompt_turns == 1
    for text, spans, said in ((one.chosen, one.chosen_spans, "yes<|end|>"), (one.rejected, one.rejected_spans, "no<|end|>")):
        a, b = map(int, spans.split(":"))
        assert text[a:b] == said
    assert one.rejected.endswith("<|user|>\n<|end|>\n") and one.complete
    assert got[2].chosen == "<|unknown|>\nx<|end|>\n" and got[2].rejected == "" and not got[2].complete
    assert got[3].n_prompt_turns == 1 and got[3].chosen == got[3].rejected == ""
    assert preference.pair_turns(df.limit(0)).isEmpty()


# ---- toxicity


def test_boosting_and_calibration():
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.5)).astype(float)
    m = boosting.fit(x, y)
    p = m.score(x)
    assert ((p >= 0.5) == (y > 0)).mean() > 0.97 and p.min() >= 0 and p.max() <= 1
    xs, ys = boosting.isotonic(x[:, 0], y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    cut = m.margin_for(0.7)
    assert (p[m.margin(x) >= cut + 1e-9] >= 0.7 - 1e-6).all()
    for labels in (np.zeros(20), np.ones(20), np.zeros(0)):
        assert set(boosting.fit(np.zeros((len(labels), 2)), labels).score(np.zeros((3, 2)))) == {labels.mean() if len(labels) else 0.0}


def test_trees_as_sql(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3)).round(2)
    m = boosting.fit(x, (x[:, 1] > 0).astype(float), trees=8)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    got = [r[0] for r in df.select(F.expr(m.margin_sql(["a", "b", "c"]))).collect()]
    assert np.allclose(got, m.margin(x))


def test_toxicity_learns_words_of_any_language(spark, make):
    r = random.Random(1)
    words = [f"mot{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = r.choices(words, k=60)
        for _ in range(4 if bad else 0):
            w[r.randrange(60)] = r.choice(["blorfa", "blorfig", "blorfum"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (5, 1, None), (10**9, 1, 1)]
    docs = make(rows + [(1000, None), (1001, ""), (1002, LONG)])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon, model = toxicity.train(docs, lab)
    out = {x.doc_id: x for x in toxicity.score(docs, lexicon, model).collect()}
    assert sum(out[i].predicted == (i % 5 == 0) for i in range(900)) > 880
    assert all(0 <= x.score <= 1 for x in out.values()) and out[1000].score == out[1001].score
    none = toxicity.train(docs, lab.limit(0))
    assert {x.score for x in toxicity.score(docs.limit(5), *none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), lexicon, model).isEmpty()


# ---- decontamination


ITEM = "One two three four five six seven eight nine ten Eleven twelve thirteen fourteen"
SHORT = "alpha beta gamma"


def contaminated(spark, make, texts, **kw):
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, SHORT), (9, None), (None, "lone words here"), (10, "")], "item_id long, text string")
    return {r.doc_id: r for r in decontaminate.find(make(texts), items, **kw).collect()}


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST, 0])
def test_contamination(spark, make, limit):
    cut = " ".join(ITEM.split()[1:14]).upper().replace(" ", "--")
    got = contaminated(spark, make, [None, "", f"pad pad {ITEM} pad", f"x {cut} y", " ".join(ITEM.split()[:12]), "ALPHA, beta; gamma!", "lone words here", LONG, LONG + " " + ITEM], max_broadcast=limit)
    assert [(got[i].n_words, got[i].n_hit, got[i].n_items) for i in range(7)] == [(0, 0, 0), (0, 0, 0), (17, 14, 1), (15, 13, 1), (12, 0, 0), (3, 3, 1), (3, 3, 0)]
    assert got[2]["items"] == ["7"] and got[5]["items"] == ["8"]
    assert not got[7].contaminated and got[8].n_hit == 14 and not got[8].contaminated and got[2].contaminated


def test_no_benchmark(spark, make):
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.find(make(["a b", None]), items).collect()] == [0, 0]
    assert decontaminate.find(make(["a"]).limit(0), items).isEmpty()


def test_cutting_spans(spark, make):
    text = f"Before it. {ITEM}! After it."
    docs = make([text, "clean"])
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    found = decontaminate.find(docs, items).select(F.col("doc_id").alias("id"), "hits")
    out = docs.join(found, F.col("doc_id") == F.col("id")).select("doc_id", decontaminate.cut(F.col("text"), F.col("hits")).alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in out] == ["Before it. ! After it.", "clean"]


# ---- quality


def test_kneser_ney_is_a_distribution():
    r = np.random.default_rng(1)
    raw = r.integers(97, 105, 4000).astype(np.uint8)
    keys, counts = np.unique(quality.grams(raw, np.array([0, 4000])), return_counts=True)
    m = quality.KneserNey.fit(keys, counts)
    for context in (keys[0] // quality.CLASSES, keys[9] // quality.CLASSES, 12345):
        p = 2.0 ** -m.bits(context * quality.CLASSES + np.arange(quality.CLASSES))
        assert p.sum() == pytest.approx(1, abs=1e-6) and (p > 0).all()


def test_quality_edges(make):
    r = random.Random(2)
    syllables = ["ba", "de", "ki", "lo", "mu", "na", "pe", "ra"]
    prose = lambda: " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(120)) + "."
    docs = make([prose() for _ in range(60)] + [None, "", "short", "the same words " * 60, "".join(r.choices("QXZJVK0189", k=9000)).replace("0", " "), LONG])
    out = {x.doc_id: x for x in quality.judge(docs).collect()}
    assert all(out[i].kept for i in range(60)) and len(out) == 66
    assert [out[i].base_failed for i in (60, 61, 62, 63)] == [True] * 4 and not out[64].kept
    assert out[63].n_repeat_words == 180 and out[60].n_words == 0
    assert quality.judge(docs.limit(0)).isEmpty()


# ---- personal data

PII_TEXTS = [
    None, "", "a@b.c_x@d.e and x@y@z.com", "1.2.3.4.5 999.1.1.1 007.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (132) 555-1352, +12 and +1234567890123456",
    "é𐍈 mail: a.b+c@x-y.co.uk!", "5" * 3000, "1.1" * 2000, "a" * 5000 + "@", ".a" * 4000 + "@x" + ".y" * 4000, "12--34 5 6-7 8", 'token = "0a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6e7f8a9b" end',
]


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train(spark, 1500)


def test_personal_data(make, pii_model):
    df = pii.find(make(PII_TEXTS), pii_model)
    rows = df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.as_text(F.col("base_spans")), 256).alias("base_sha256"), pii.as_text(F.col("all_spans")).alias("spans")).collect()
    assert len(rows) == len(PII_TEXTS)
    check_pii(rows, dict(enumerate(PII_TEXTS)))
    assert "secret:9:49" in next(r.spans for r in rows if r.doc_id == 12)
    for r in df.collect():
        for kind in pii.ADDED:
            assert r[f"n_{kind}"] == sum(x.kind == kind for x in r.all_spans)
    assert pii.find(make(["x"]).limit(0), pii_model).isEmpty()


def test_redaction(make, pii_model):
    docs = make(["write to a@b.com or 10.0.0.1 now", "nothing"])
    met = docs.select("doc_id", "text").join(pii.find(docs, pii_model).select("doc_id", "all_spans"), "doc_id")
    out = {r.doc_id: r.t for r in met.select("doc_id", pii.redact(F.col("text"), F.col("all_spans")).alias("t")).collect()}
    assert out == {0: "write to [email] or [ip] now", 1: "nothing"} and base_spans("x") == []


# ---- line de-duplication


def runs_removed(docs, least):
    """Brute force: every window that begins or ends at a line, in order of id and line."""
    seen, out = {}, {}
    for d, t in sorted(docs):
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if any(x.split(" "))]
        n = [len([w for w in lines[i].split(" ") if w]) for i in at]
        spans = set()
        for a in range(len(at)):
            for way in (1, -1):
                total, b = 0, a
                while 0 <= b < len(at):
                    total += n[b]
                    if total >= least:
                        spans.add((min(a, b), max(a, b)))
                        break
                    b += way
        for a, b in sorted(spans):
            key = tuple(lines[at[k]] for k in range(a, b + 1))
            if seen.setdefault(key, (d, at[a])) < (d, at[a]):
                out.setdefault(d, set()).update(range(at[a], at[b] + 1))
    return out


def test_line_runs(spark, make, scratch):
    r = random.Random(4)
    pool = [" ".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(14)]
    texts = ["\n".join(r.choice([*pool, "", " "]) for _ in range(r.randint(0, 25))) for _ in range(60)]
    texts += [texts[3], texts[3], "a b c d e f g h i j k l\n" * 9]
    docs = make(list(enumerate(texts)) + [(500, None), (501, ""), (502, LONG), (503, LONG)])
    out = {x.doc_id: x for x in line_dedup.remove_repeats(docs, scratch(), min_words=12).collect()}
    want = runs_removed([(i, t) for i, t in enumerate(texts)], 12)
    assert sum(map(len, want.values())) > 100
    for i, t in enumerate(texts):
        assert out[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ())), i
    assert out[500].text is None and out[501].text == "" and out[502].text == LONG and out[503].text == ""
    assert out[0].score == "mine" and out[503].n_removed_lines == 1
    assert line_dedup.remove_repeats(docs.limit(0), scratch()).isEmpty()


def test_repeated_rows_count_once(make, scratch):
    long = " ".join(map(str, range(60)))
    out = line_dedup.remove_repeats(make([(1, long), (1, long), (None, long)]), scratch()).collect()
    assert sorted((str(x.doc_id), x.text == long) for x in out) == [("1", False), ("1", False), ("None", True)]


# ---- near-duplicates


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 900).astype(np.uint64)
    sets = [np.unique(a), np.unique(np.concatenate([a[:800], r.integers(0, 1 << 63, 100).astype(np.uint64)])), a[:1], np.zeros(0, np.uint64)]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    s = near_dedup.sketches(np.concatenate(sets), ends, 350)
    assert (s[:3] != near_dedup._NONE).all() and (s[3] == near_dedup._NONE).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups(make, scratch, words):
    r = random.Random(words)
    vocabulary = [f"v{i}" for i in range(60)]
    base = [r.choices(vocabulary, k=r.randint(40, 90)) for _ in range(6)]
    texts = []
    for _ in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    texts += ["one", "one", "One two", "", None, " \n", LONG, LONG + " tail"]
    want = near_groups(enumerate(texts), words)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.find(make(texts), scratch(), words=words).collect()}
    assert got == want


def test_nameless_and_repeated(make, scratch):
    t = "a b c d e f g h"
    out = near_dedup.find(make([(3, t), (3, t), (None, t), (None, "x y z u v w"), (None, None), (2, "x y z u v w q")]), scratch()).collect()
    assert sorted((str(x.doc_id), str(x.component_id), x.kept) for x in out if x.n_shingles and x.n_shingles == 4) == [("3", "3", True), ("3", "3", True), ("None", "3", False)]
    assert near_dedup.find(make(["x"]).limit(0), scratch()).isEmpty()


def test_components(spark, scratch):
    r = random.Random(9)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for p in links for x in p if root(x) != x}
    df = spark.createDataFrame(links, "a long, b long")
    assert {x.node: x.component for x in components(df, scratch()).collect()} == want
    assert components(df.limit(0), scratch()).isEmpty()


def test_a_step_of_components_shuffles_three_times_at_most(spark, scratch):
    """Each shuffle is a stage of as many tasks as there are partitions, and the driver keeps an account of every task."""
    from strandlog.llm import components as module

    df = spark.createDataFrame([(9, k) for k in range(9)] + [(k, 3) for k in range(10, 400)], "u long, v long")
    plan = module._step(scratch().put(df, "links"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    assert {(x.node, x.component) for x in components(df.toDF("a", "b"), scratch()).collect()} == {(k, 0) for k in range(1, 400)}


# ---- pages


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b", "a\nb"), ("<ul><li>x<li>y</ul>", "- x\n- y"),
    ("<ol start=3><li>x<li>y<ul><li>z</ul></ol>", "3. x\n4. y\n  - z"), ("a<script>var t='</p>'</script>b<style>x</style>", "ab"),
    ("<p hidden>a</p><p style='display: none'>b</p>c", "c"), ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
    ("<style>.x{display:none}</style><p class='y x'>a</p>b", "b"), ("<table><tr><th>Name<th>N<tr><td>a<td>10<tr><td>long name<td>2</table>", "Name       N\na          10\nlong name  2"),
    ("<pre>a  b\n c</pre>", "a  b\n c"), ("1 &lt; 2 &amp; 3 < 4", "1 < 2 & 3 < 4"), ("<details><summary>S</summary>no</details>", "S"), ("</p>x</div></b>", "x"),
    ("<a href='x>y'>l</a> <!-- no --> m", "l m"), ("<title>t</title>b", "b"), ("<p>un<b>closed", "unclosed"), ("a <a '", "a"),
])
def test_rendering(html, text):
    assert html_text.render(html) == text


def test_pages(spark):
    df = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (3, "<p>x", "m"), (4, "<div>" * 20_000 + "deep" + "<table><td>" * 50, "m")], "page_id long, html string, visible_text string")
    out = {r.page_id: r.visible_text for r in html_text.extract(df).collect()}
    assert out == {1: None, 2: "", 3: "x", 4: "deep"}
    assert html_text.extract(df.limit(0)).isEmpty()


# ---- language


def ppm_bits(train, text, order=langid.ORDER):
    """Byte by byte with dictionaries."""
    from math import log2

    fold = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    seen = [{} for _ in range(order + 1)]
    for t in train:
        data = bytes(order) + fold(t)
        for i in range(order, len(data)):
            for k in range(order + 1):
                c = seen[k].setdefault(data[i - k : i], {})
                c[data[i]] = c.get(data[i], 0) + 1
    data, total = bytes(order) + fold(text), 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            c = seen[k].get(data[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if data[i] in c:
                total -= log2(c[data[i]] / (n + d))
                break
            total -= log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    train = {"a": ["The cat sat.", "A cat, the hat"], "b": ["Der Hund saß über", "die Katze"]}
    trees = {}
    for k, ts in train.items():
        data, ends = langid._bytes_of(pa.array(ts))
        w, n = np.unique(langid._windows(data, np.repeat(ends[:-1], np.diff(ends))), return_counts=True)
        trees[k] = langid.ContextTree.from_counts(w, n)
    texts = ["the cat", "die Hüte", "", "zzz!", "Über", "a" * 300]
    got = langid.Identifier(trees).code_lengths(pa.array(texts))
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx([ppm_bits(train[k], t) for k in ("a", "b")], rel=1e-4, abs=1e-3)


def test_languages(spark, make):
    r = random.Random(1)
    kinds = {"xx": ["ba", "do", "ki"], "yy": ["str", "ölk", "ung"], "zz": ["que", "ión", "ar"]}
    rows = []
    for i in range(240):
        k = sorted(kinds)[i % 3]
        rows.append((i, " ".join("".join(r.choices(kinds[k], k=3)) for _ in range(20)), k))
    rows += [(300, None, "xx"), (301, "", "xx"), (302, "12 34 !", "yy"), (303, "badoki badoki", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("mine"))
    out = {x.doc_id: x for x in langid.identify(docs, langid.train(docs)).collect()}
    assert all(out[i].lang_pred == sorted(kinds)[i % 3] for i in range(240)) and out[303].lang_pred == "xx"
    assert [out[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and all(0 <= x.score <= 1 for x in out.values())
    empty = langid.train(docs.limit(0))
    assert {x.lang_pred for x in langid.identify(docs, empty).collect()} == {"und"}
