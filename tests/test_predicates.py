import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from strandlog.functions.predicates import And, Eq, Exists, Ge, Gt, In, Le, Like, Lt, Ne, Near, Not, NotExists, Or, Within, bind, evaluate, restrict

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType()),
])
ROWS = [
    (0, None, None, None, None), (1, 30, 9.5, "alice", True), (2, -1, float("nan"), "a_b", False), (3, 0, 30.0, "axb", None), (4, 9, -0.0, "", True),
    (5, 1 << 40, 1e300, "Zoë", False), (6, 10, 10.0, "a\\b%c", None), (7, None, 2.0, "teacher", True), (8, 31, None, "line\nbreak", False),
]

values = st.one_of(st.sampled_from([30, 9, 10, 0, -1]), st.sampled_from([30.0, 9.5, 10.0, float("nan"), 0.0]), st.sampled_from(["alice", "a_b", "", "axb", "Zoë"]), st.booleans())
fields = st.sampled_from(["i", "f", "s", "b", "missing"])
patterns = st.sampled_from(["ali%", "%ice", "%lic%", "alice", "a_b", "%", "", "a%c", "%\\%", "a%b", "%\n%", "%e%"])
leaves = st.one_of(
    st.builds(lambda c, f, v: c(f, v), st.sampled_from([Eq, Ne, Gt, Ge, Lt, Le]), fields, values),
    st.builds(Exists, fields), st.builds(NotExists, fields), st.builds(Like, fields, patterns), st.builds(In, fields, st.lists(values, max_size=3)),
)
conditions = st.recursive(leaves, lambda c: st.one_of(st.builds(And, st.lists(c, max_size=3)), st.builds(Or, st.lists(c, max_size=3)), st.builds(Not, c)), max_leaves=6)


def props(row):
    return {n: v for n, v in zip(SCHEMA.names[1:], row[1:]) if v is not None}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(conditions, min_size=25, max_size=25))
def test_columns_follow_the_model(spark, conds):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = df.select("id", *[bind(c, SCHEMA).alias(f"c{k}") for k, c in enumerate(conds)]).collect()
    for r in got:
        for k, c in enumerate(conds):
            assert r[f"c{k}"] == evaluate(c, props(ROWS[r.id])), (c, ROWS[r.id])
    for c in conds[:3]:
        assert {r.id for r in restrict(df, c).select("id").collect()} == {r[0] for r in ROWS if evaluate(c, props(r))}


@pytest.mark.parametrize(("cond", "held", "expected"), [
    (Eq("age", 30), {}, False), (Ne("age", 30), {}, True), (Gt("age", 30), {}, False), (NotExists("age"), {}, True), (Not(Gt("age", 3)), {}, True),
    (Gt("score", 9), {"score": 9.5}, True), (Lt("score", 10), {"score": 9.5}, True), (Like("name", "ali%"), {"name": "alice"}, True),
    (Like("name", "%ice"), {"name": "alice"}, True), (Like("name", "%lic%"), {"name": "alice"}, True), (Eq("age", 30), {"age": 30.0}, False),
])
def test_single_rows(cond, held, expected):
    assert evaluate(cond, held) is expected


def test_places(spark):
    df = spark.createDataFrame([(1, (42.36, -71.09)), (2, (37.42, -122.17)), (3, None)], "id long, place struct<lat:double,lon:double>")
    keep = lambda c: [r.id for r in df.where(bind(c, df.schema)).collect()]
    assert keep(Near("place", 42.3, -71.1, 10_000)) == [1]
    assert keep(Within("place", 30, -130, 40, -100)) == [2]
    assert keep(Eq("place", (42.36, -71.09))) == [1]
    assert keep(Near("id", 0, 0, 1)) == []


def test_simple_patterns_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "concat('k', id) AS s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda c: restrict(df, c)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(s,k1)" in plan(Like("s", "k1%"))
    assert "EqualTo(s,k2)" in plan(And([Eq("s", "k2"), Gt("id", 1)])) and "GreaterThan(id,1)" in plan(And([Eq("s", "k2"), Gt("id", 1)]))
    assert "In(id, [1,2])" in plan(In("id", [1, 2]))
