"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The longest common prefix of turns (same role, same text) of the chosen and the rejected conversation is
rendered once as the prompt.  What follows in each is its completion, with the spans that count
for the loss: the text of the assistant's turns and the mark that ends it.  Spans are
`start:end` in code points of the completion, end exclusive, comma-joined.

Cases: a null role is rendered as `unknown`, a null text as empty; both compare by their rendered form.
Turns that share a number are ordered by role, then text; repeated turns stay.  Turns without a conversation id
belong to no pair and are left out.  If one side is missing, its completion is empty and `complete` is
false.  Two equal conversations give a prompt and two empty completions.

One shuffle: turns meet by pair.  A conversation is one row of the result, so its turns come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The chat template.
OPEN, NAME_END, CLOSE = "<|", "|>\n", "<|end|>\n"


def _rendered(turns: Column) -> Column:
    """Each turn as (text, length of what stands before the content, whether it is trained on)."""
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(OPEN), t.role, F.lit(NAME_END), t.text, F.lit(CLOSE)).alias("text"),
            (F.length(t.role) + len(OPEN) + len(NAME_END)).alias("lead"),
            (t.role == "assistant").alias("trained"),
        ),
    )


def _spans(parts: Column) -> Column:
    """`start:end` of what is trained on; the mark's newline is left out."""
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, p: F.struct(
            (acc.at + F.length(p.text)).alias("at"),
            F.when(
                p.trained,
                F.concat(
                    acc.out,
                    F.array(F.concat_ws(":", (acc.at + p.lead).cast("string"), (acc.at + F.length(p.text) - 1).cast("string"))),
                ),
            ).otherwise(acc.out).alias("out"),
        ),
    )
    return F.array_join(walked.out, ",")


def pair_turns(turns: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text) -> one row per pair; side is `chosen` or `rejected`."""
    clean = turns.where("pair_id IS NOT NULL AND side IS NOT NULL").select(
        "pair_id",
        F.struct(
            "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
        F.col("side"),
    )

    def side(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("t"))))

    met = clean.groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False)))
    first_other = F.array_position(same, False)
    met = met.select(
        "pair_id",
        F.when(first_other > 0, first_other - 1).otherwise(F.size("c")).cast("int").alias("n"),
        _rendered(F.col("c")).alias("c"),
        _rendered(F.col("r")).alias("r"),
    )

    def tail(name: str) -> Column:
        return F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))

    met = met.select("pair_id", "n", F.size("c").alias("nc"), F.size("r").alias("nr"), F.slice("c", 1, F.col("n")).alias("p"), tail("c").alias("c"), tail("r").alias("r"))
    return met.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        F.array_join(F.transform("p", lambda x: x.text), "").alias("prompt"),
        F.array_join(F.transform("c", lambda x: x.text), "").alias("chosen"),
        _spans(F.col("c")).alias("chosen_spans"),
        F.array_join(F.transform("r", lambda x: x.text), "").alias("rejected"),
        _spans(F.col("r")).alias("rejected_spans"),
        ((F.col("nc") > 0) & (F.col("nr") > 0)).alias("complete"),
    )


def neighbours_as_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected one of pair k."""
    return conversations.where("conv_id IS NOT NULL").select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn", "role", "text",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pair_turns(neighbours_as_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT pair_id, k, count(*) FILTER (side = 0) AS c, count(*) FILTER (side = 1) AS r,
             count(DISTINCT (role, text)) AS d FROM t GROUP BY ALL),
n AS (SELECT pair_id, coalesce(min(k) FILTER (NOT (c = 1 AND r = 1 AND d = 1)) - 1, max(k)) AS n,
             sum(c) > 0 AND sum(r) > 0 AS complete FROM k GROUP BY pair_id),
p AS (
  SELECT t.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece,
         length(role) + 5 AS lead FROM t JOIN n USING (pair_id)),
q AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM p WHERE k > n),
pr AS (SELECT pair_id, string_agg(piece, '' ORDER BY k) AS prompt FROM p WHERE k <= n AND side = 0 GROUP BY pair_id),
s AS (SELECT pair_id,
        string_agg(piece, '' ORDER BY k) FILTER (side = 0) AS chosen, string_agg(piece, '' ORDER BY k) FILTER (side = 1) AS rejected,
        string_agg((pos + lead)::BIGINT || ':' || (pos + length(piece) - 1)::BIGINT, ',' ORDER BY k) FILTER (side = 0 AND role = 'assistant') AS chosen_spans,
        string_agg((pos + lead)::BIGINT || ':' || (pos + length(piece) - 1)::BIGINT, ',' ORDER BY k) FILTER (side = 1 AND role = 'assistant') AS rejected_spans
      FROM q GROUP BY pair_id)
SELECT n.pair_id::BIGINT AS pair_id, n.n::BIGINT AS n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
       coalesce(chosen_spans, '') AS chosen_spans, coalesce(rejected, '') AS rejected, coalesce(rejected_spans, '') AS rejected_spans, complete
FROM n LEFT JOIN pr USING (pair_id) LEFT JOIN s USING (pair_id)
"""
