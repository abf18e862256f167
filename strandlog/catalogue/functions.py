"""One query per predicate and per scalar function, on customers of which some properties are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.catalogue.registry import query
from strandlog.functions import scalars as S
from strandlog.functions.predicates import And, Condition, Eq, Exists, Ge, Gt, In, Le, Like, Lt, Ne, Not, NotExists, Or
from strandlog.operators import graph as G
from strandlog.sources import datasets as D

NODES = """c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS acctbal,
  CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 3 = 0 END AS vip, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 100 END AS rank,
  CASE WHEN c_custkey % 8 <> 0 THEN replace(c_name, '#', '_') END AS name,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'NaN'::DOUBLE ELSE c_custkey / 10.0 END AS score FROM customer)"""


def nodes(spark, d) -> DataFrame:
    c, k = D.table(spark, d, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("key"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("acctbal"),
        F.when(k % 7 != 0, k % 3 == 0).alias("vip"), F.when(k % 6 != 0, k % 100).alias("rank"),
        F.when(k % 8 != 0, F.translate("c_name", "#", "_")).alias("name"),
        F.when(k % 9 != 0, F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(k / 10.0)).alias("score"),
    )


def _predicate(name: str, cond: Condition, sql: str) -> None:
    query(name, f"WITH {NODES} SELECT key FROM c WHERE {sql}")(lambda spark, d: G.query(nodes(spark, d), cond).select("key"))


_predicate("pred_eq", Eq("segment", "BUILDING"), "coalesce(segment = 'BUILDING', false)")
_predicate("pred_eq_strict", Or([Eq("rank", 30.0), Eq("acctbal", 30)]), "false")
_predicate("pred_ne", Ne("segment", "BUILDING"), "coalesce(segment <> 'BUILDING', true)")
_predicate("pred_ne_unknown", Ne("nothing", 1), "true")
_predicate("pred_gt", Gt("acctbal", 5000.0), "coalesce(acctbal > 5000, false)")
_predicate("pred_gt_mixed", Gt("acctbal", 5000), "coalesce(acctbal > 5000, false)")
_predicate("pred_int_float", And([Ge("rank", 9.5), Lt("rank", 20.5)]), "coalesce(rank >= 9.5 AND rank < 20.5, false)")
_predicate("pred_ge", Ge("rank", 50), "coalesce(rank >= 50, false)")
_predicate("pred_lt", Lt("rank", 10), "coalesce(rank < 10, false)")
_predicate("pred_le", Le("name", "Customer_000000100"), "coalesce(name <= 'Customer_000000100', false)")
_predicate("pred_bool_order", Lt("vip", True), "coalesce(NOT vip, false)")
_predicate("pred_exists", Exists("segment"), "segment IS NOT NULL")
_predicate("pred_not_exists", NotExists("segment"), "segment IS NULL")
_predicate("pred_like_prefix", Like("name", "Customer_00000000%"), "coalesce(starts_with(name, 'Customer_00000000'), false)")
_predicate("pred_like_suffix", Like("name", "%7"), "coalesce(suffix(name, '7'), false)")
_predicate("pred_like_inner", Like("name", "%_0000000%"), "coalesce(contains(name, '_0000000'), false)")
_predicate("pred_like_many", Like("name", "C%_0%1%"), "coalesce(name LIKE 'C%!_0%1%' ESCAPE '!', false)")
_predicate("pred_like_literal", Like("segment", "BUILDIN_"), "false")
_predicate("pred_like_number", Like("rank", "1%"), "false")
_predicate("pred_in", In("segment", ["BUILDING", "MACHINERY", 7]), "coalesce(segment IN ('BUILDING', 'MACHINERY'), false)")
_predicate("pred_and", And([Eq("segment", "BUILDING"), Gt("rank", 20)]), "coalesce(segment = 'BUILDING', false) AND coalesce(rank > 20, false)")
_predicate("pred_and_empty", And([]), "true")
_predicate("pred_or", Or([Eq("segment", "BUILDING"), Gt("rank", 90)]), "coalesce(segment = 'BUILDING', false) OR coalesce(rank > 90, false)")
_predicate("pred_or_empty", Or([]), "false")
_predicate("pred_not", Not(Gt("rank", 20)), "NOT coalesce(rank > 20, false)")
_predicate("pred_not_like_in", Not(Or([Like("name", "%1%"), In("rank", [5, 50])])), "NOT (coalesce(contains(name, '1'), false) OR coalesce(rank IN (5, 50), false))")
_predicate("pred_nan", Or([Gt("score", 100.0), Le("score", 3.0), Eq("score", 5.0)]), "NOT isnan(coalesce(score, 0)) AND coalesce(score > 100 OR score <= 3 OR score = 5, false)")
_predicate("pred_nan_ne", Ne("score", 5.0), "coalesce(score <> 5, true)")

_TOKENS = """t AS (SELECT key, CASE key % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN key::VARCHAR WHEN 3 THEN '-' || key WHEN 4 THEN 'k' || key ELSE '99999999999999999999' END AS token,
  key || (CASE key % 6 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'h' WHEN 4 THEN 'd' ELSE '' END) AS span FROM c)"""


def _tokens(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    text = k.cast("string")
    return D.table(spark, d, "customer").select(
        k.alias("key"),
        F.expr("CASE c_custkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN string(c_custkey) WHEN 3 THEN '-' || c_custkey WHEN 4 THEN 'k' || c_custkey ELSE '99999999999999999999' END").alias("token"),
        F.concat(text, F.expr("CASE c_custkey % 6 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'h' WHEN 4 THEN 'd' ELSE '' END")).alias("span"),
    )


@query("fn_key_token", f"""WITH {NODES}, {_TOKENS} SELECT key, CASE token WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE try_cast(token AS BIGINT) END::VARCHAR AS key_i,
  CASE WHEN token NOT IN ('true', 'false') AND try_cast(token AS BIGINT) IS NULL THEN token END AS key_s FROM t""")
def fn_key_token(spark, d):
    rows = _tokens(spark, d).withColumn("key_i", S.key_int(F.col("token")))
    return rows.select("key", F.col("key_i").cast("string").alias("key_i"), F.when(F.col("key_i").isNull(), F.col("token")).alias("key_s"))


@query("fn_duration", f"""WITH {NODES}, {_TOKENS} SELECT key, key * CASE key % 6 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000 WHEN 3 THEN 3600000 WHEN 4 THEN 86400000 ELSE 1000 END AS ms FROM t""")
def fn_duration(spark, d):
    return _tokens(spark, d).select("key", S.duration_ms_column(F.col("span")).alias("ms"))


@query("fn_widen_narrow", f"WITH {NODES}, {_TOKENS} SELECT key, coalesce(token, key::VARCHAR) AS wide, try_cast(token AS BIGINT)::VARCHAR AS narrow FROM t")
def fn_widen_narrow(spark, d):
    return _tokens(spark, d).select("key", S.widen(F.col("key"), F.col("token")).alias("wide"), S.narrow(F.col("token")).cast("string").alias("narrow"))


@query("fn_prefix_match", f"WITH {NODES}, {_TOKENS} SELECT key, starts_with(token, 'k1') AS text_hit, key = 12 AS number_hit FROM t")
def fn_prefix_match(spark, d):
    rows, no_key = _tokens(spark, d), F.lit(None)
    return rows.select("key", S.matches_prefix(no_key, F.col("token"), "k1").alias("text_hit"), S.matches_prefix(F.col("key"), no_key, 12).alias("number_hit"))


@query("fn_base32", """WITH RECURSIVE b AS (SELECT event_id, event_id AS rest, '' AS out FROM events WHERE event_id > 0
  UNION ALL SELECT event_id, rest // 32, substr('0123456789abcdefghjkmnpqrstvwxyz', (rest % 32)::INT + 1, 1) || out FROM b WHERE rest > 0) SELECT event_id, out AS shown FROM b WHERE rest = 0""")
def fn_base32(spark, d):
    from strandlog.operators.log import revision

    e = D.table(spark, d, "events").where("event_id > 0")
    return e.select("event_id", S.revision_base32(revision(F.lit(0), F.col("event_id"))).alias("shown"))
