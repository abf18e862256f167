import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (id, text) pairs; extra columns bear names that operators use themselves."""

    def build(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        return df.selectExpr("*", "'mine' AS score", "'mine' AS kept", "'mine' AS token_ids", "'mine' AS _row", "'mine' AS key_a", "'mine' AS removed_runs", "'mine' AS component_id", "'mine' AS bits")

    return build


@pytest.fixture(scope="session")
def scratch(spark):
    from strandlog.llm.common import Scratch

    return lambda: Scratch(spark)
