"""Queries that SQL can express, and those that brute force checks, on the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from oracle import DATA, assert_same, connection

from strandlog.llm.queries import ORACLES, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert_same(spark, connection(SF), QUERIES[name], ORACLES[name], SF)


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts(spark, texts):
    for r in QUERIES["op4_quality_rules"](spark, SF).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (dup, len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for k, (name, p) in enumerate(PII.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = name == "email" or (name == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (name == "card" and 12 <= len(d) <= 19 and luhn(d)) or (name == "phone" and 9 <= len(d) <= 15)
            if ok:
                out.append((m.start(), k, name, m.end()))
    return [f"{n}:{a}:{b}" for a, _, n, b in sorted(out)]


def check_pii(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in PII]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_personal_data(spark, texts):
    check_pii(QUERIES["op5_pii"](spark, SF).collect(), texts)


def near_groups(docs, words, percent=80):
    sets = {}
    for d, t in docs:
        w = WORD.findall(ascii_lower(t or ""))
        sets[d] = frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            having[x].add(d)
    for d, s in sets.items():
        shared = Counter(o for x in s for o in having[x] if o < d)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = root(o), root(d)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(spark, texts):
    want = near_groups(texts.items(), 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_near_dedup"](spark, SF).collect()}
    assert got == want


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
