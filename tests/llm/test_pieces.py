import os

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlog.llm import pieces
from strandlog.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


HARD = ["", " ", "  a ", "aaaaaaaaaaaaaaa aaaa  bbbb", "\n\n\t €𐍈 ", "hehehehehe thththth    x", "<s>▁a", "Ǆ́" * 30, "a" * 5000, "日本語のテキスト", "ab " * 3000]


def test_same_ids_as_the_library(model, library):
    got = model.encode(pa.array(HARD, pa.string())).to_pylist()
    assert got == [library.encode(t) for t in HARD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abehilnorst  ▁\nTé€𐍈.0"), max_size=40), min_size=1, max_size=6))
def test_random_texts(model, library, texts):
    ids = model.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [library.encode(t) for t in texts]
    assert model.decode(ids).to_pylist() == [t.replace("▁", " ") for t in texts]


def test_columns(spark, make):
    df = make([None, "", "Hello world", "Hello world"])
    rows = pieces.round_trip(df, PATH).orderBy("doc_id").collect()
    assert [r.token_ids for r in rows][:2] == [None, []] and rows[2].token_ids == rows[3].token_ids
    assert [r.n_tokens for r in rows][:2] == [0, 0] and all(r.round_trip for r in rows) and rows[0].score == "mine"
    assert [r.decoded for r in pieces.decode(pieces.encode(df, PATH), PATH).orderBy("doc_id").collect()] == [None, "", "Hello world", "Hello world"]
    assert pieces.round_trip(make(["x"]).limit(0), PATH).isEmpty()


def test_unigram_scores_are_maximised():
    """A tiny unigram model: the best sum of scores wins, against all segmentations."""
    import itertools

    import numpy as np

    names = ["▁", "a", "b", "c", "▁a", "ab", "bc", "▁ab", "abc"]
    scores = [-4.0, -2.0, -2.5, -3.0, -3.5, -3.1, -4.2, -5.0, -5.2]
    hashes = np.array([pieces._prefix_hashes(np.array([[ord(c) for c in p]], np.uint64))[0, -1] for p in names], np.uint64)
    keys = pieces.SortedKeys(hashes)
    none = np.full(len(names) + 1, -1)
    m = pieces.PieceModel(False, [p.encode() for p in names], keys, np.arange(len(names))[keys.order], 3, np.array([*scores, -20.0]), none, none, none, pieces.SortedKeys(np.zeros(0, np.uint64)), np.zeros(0, np.int64), None, 0)
    table = dict(zip(names, scores))

    def best(word):
        cuts = (c for n in range(len(word)) for c in itertools.combinations(range(1, len(word)), n))
        splits = ([word[a:b] for a, b in zip((0, *c), (*c, len(word)))] for c in cuts)
        return max(sum(table[p] for p in s) for s in splits if all(p in table for p in s))

    for word in ("▁abc", "▁aabbcc", "▁cab", "▁abcabc", "▁b"):
        ids, _ = m.encode_words([word])
        assert "".join(names[i] for i in ids) == word
        assert sum(scores[i] for i in ids) == pytest.approx(best(word))
