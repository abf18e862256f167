import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog.functions import scalars as S
from strandlog.operators.log import REVISION
from strandlog.plans import lang


@given(st.integers(0, (1 << 128) - 1))
def test_base32_round_trip(n):
    assert S.from_base32(S.base32(n)) == n and len(S.base32(n, 26)) == 26
    assert S.revision_number(*S.split_revision(n)) == n


def test_revision_column(spark):
    rows = [((1_705_000_000_123, 3, 9, 77),), ((0, 0, 0, 0),), (((1 << 48) - 1, 65535, 65535, (1 << 48) - 1),)]
    import pyspark.sql.types as T

    df = spark.createDataFrame(rows, T.StructType([T.StructField("rev", REVISION)]))
    assert [r[0] for r in df.select(S.revision_base32(F.col("rev"))).collect()] == [S.base32(S.revision_number(*r[0])) for r in rows]


@pytest.mark.parametrize(("text", "ms"), [("90", 90_000), ("5m", 300_000), ("2h", 7_200_000), ("1d", 86_400_000), ("250ms", 250), ("7s", 7_000)])
def test_durations(spark, text, ms):
    assert S.duration_ms(text) == ms
    assert spark.createDataFrame([(text,)], "t string").select(S.duration_ms_column(F.col("t"))).first()[0] == ms


def test_bad_durations():
    for text in ("", "x", "5w", "-3s"):
        with pytest.raises(ValueError):
            S.duration_ms(text)


def test_tokens_and_literals():
    assert [S.key_of_token(t) for t in ("true", "false", "42", "-7", "x", "99999999999999999999")] == [1, 0, 42, -7, "x", "99999999999999999999"]
    assert [S.literal(t) for t in ("42", "3.14", "true", '"hello"', "world")] == [42, 3.14, True, "hello", "world"]
    assert [S.literal(t) for t in ("TRUE", "False", '"TRUE"')] == [True, False, "TRUE"]
    assert S.show_bytes(2048) == "2.0 KB" and S.show_duration(7_200_000) == "2h"
    assert S.property_json(b"abc") == "<3 bytes>" and S.property_of_json("[1, 2]") == (1.0, 2.0)
    for bad in ('{"a": 1}', "[1]", "[1, 2, 3]"):
        with pytest.raises(ValueError):
            S.property_of_json(bad)


def test_names():
    for bad in ("", "a.b", "a\x01", "x" * 512):
        with pytest.raises(ValueError):
            S.check_name(bad)


def test_language_plans():
    p = lang.parse("+{person alice}[role=teacher, age=30]")
    assert (p.table, p.key, p.props) == ("person", "alice", {"role": "teacher", "age": 30})
    assert lang.parse("+{person alice}").props is None
    link = lang.parse("+(attends alice -> mit)[year=2020]")
    assert (link.link, link.src, link.dst, link.both, link.props) == ("attends", "alice", "mit", False, {"year": 2020})
    assert lang.parse("+(friends alice <-> bob)").both
    assert isinstance(lang.parse("-{person alice}"), lang.DropNode) and lang.parse("-!{person alice}").cascade
    assert isinstance(lang.parse("?{person alice}"), lang.GetNode)
    assert lang.parse("?{person}").where is None and lang.parse("?{person | role=teacher, age>30}").where is not None
    q = lang.parse("?:10+5{person}[age:desc]")
    assert (q.limit, q.offset, q.sort) == (10, 5, [("age", "desc")])
    t = lang.parse("?{person alice} -> (attends) -> (located-in)")
    assert [s.link for s in t.steps] == ["attends", "located-in"]
    d = lang.parse("?{person alice} -> (*:3)")
    assert d.max_hops == 3 and not d.both and lang.parse("?{person alice} <-> (*:2)").both
    for bad in ("", "person", "?{person", "?{person | age}", "?{p} -> {q}", "+{p k}[a]", "?{p}[a:up]"):
        with pytest.raises(ValueError):
            lang.parse(bad)
