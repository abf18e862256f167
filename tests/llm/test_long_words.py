"""Words without a space in them, and models that aren't supported."""

import random

import pyarrow as pa
import pytest
import sentencepiece as sp

from strandlog.llm import pieces
from strandlog.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.mark.parametrize("kind", ["letters", "prose", "same", "digits", "script", "period"])
def test_long_words_have_the_library_s_ids(kind):
    r = random.Random(kind)
    text = {
        "letters": lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789/+", k=20_000)),
        "prose": lambda: "".join(r.choices(["the", "and", "tion", "quick", "über", "ment", "ing", "straße", "x"], k=6_000)),
        "same": lambda: "a" * 9_001,
        "digits": lambda: "".join(r.choices("0123456789", k=9_000)),
        "script": lambda: "".join(chr(r.randrange(0x4E00, 0x5200)) for _ in range(9_000)),
        "period": lambda: "ha" * 4_000 + "-=" * 900,
    }[kind]()
    model, library = pieces.PieceModel.load(MODEL), sp.SentencePieceProcessor(model_file=MODEL)
    texts = ["short words " + text, text + " end", text[:1023], text[:1024], text[:1025], "plain"]
    got = model.encode(pa.array(texts))
    assert got.to_pylist() == [library.encode(t) for t in texts]
    assert model.decode(got).to_pylist() == texts


def test_other_normalisers_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    for change in ("charsmap", "prefix", "spaces"):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(MODEL, "rb") as file:
            proto.ParseFromString(file.read())
        rules = proto.normalizer_spec
        if change == "charsmap":
            rules.precompiled_charsmap = b"x"
        elif change == "prefix":
            rules.add_dummy_prefix = False
        else:
            rules.remove_extra_whitespaces = True
        path = tmp_path / f"{change}.model"
        path.write_bytes(proto.SerializeToString())
        with pytest.raises(ValueError):
            pieces.PieceModel.load(str(path))
