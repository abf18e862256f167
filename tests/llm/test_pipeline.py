import pytest
from oracle import DATA

import corpus_pipeline as P
from strandlog.llm.common import Scratch

SF = f"{DATA}/sf0.001"


def test_stages_hand_over(spark):
    docs, scratch = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark)
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        docs = scratch.put(stage(spark, docs, SF), name)
        n = docs.count()
        assert 0 < n <= before
        before = n
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
    assert {r.round_trip for r in docs.select("round_trip").collect()} == {True}
    assert P.run(spark, SF).count() == before


def test_odd_documents(spark):
    text = " ".join(f"word{i}" for i in range(70))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text + " more", None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0), (4, text + " tail", "en", "s", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        assert stage(spark, odd, SF).count() <= len(rows), name
        stage(spark, odd.limit(0), SF).count()
    near = P.near_duplicates(spark, odd, SF)
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "2", "3", "None"]


@pytest.mark.parametrize("name", ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"])
def test_names(name):
    assert name in dict(P.STAGES)
