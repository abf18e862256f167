"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of `documents`.  The operators see the id, the text and the language only; other columns travel beside
them in one struct, so their names may be any.  Of rows without an id, and of rows that repeat one, each is judged by its
own text; rows without an id can't be named by the near-duplicate stage and stay there, and rows that are equal in every
column are one document to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import decontaminate, line_dedup, near_dedup, pieces, quality
from strandlog.llm.common import Scratch, text_key
from strandlog.llm.queries import TOKENIZERS

SEEN = ("doc_id", "text", "lang")


def _packed(docs: DataFrame) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c not in SEEN]
    return docs.select(*SEEN, F.struct(F.lit(0).alias("_"), *others).alias("_others"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*[F.col(c) if c in SEEN else F.col(f"_others.`{c}`").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what fails the counts or lies outside its language's perplexity band."""
    return _unpacked(quality.judge(_packed(docs), Scratch(spark)).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of lines; a text that holds nothing else becomes empty."""
    found = line_dedup.remove_repeats(_packed(docs), Scratch(spark))
    if "n_chars" in docs.columns:
        n = F.when(F.size("removed_runs") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_others.n_chars"))
        found = found.withColumn("_others", F.col("_others").withField("n_chars", n))
    return _unpacked(found, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the least id."""
    return _unpacked(near_dedup.keep_one(_packed(docs), Scratch(spark)), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more repeats benchmark passages."""
    a, b = text_key(F.col("doc_id"), F.col("text"))
    keyed = _packed(docs).withColumn("_key", F.concat_ws(":", a.cast("string"), b.cast("string")))
    found = decontaminate.find(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key")
    bad = found.where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return _unpacked(keyed.join(bad, "_key", "left_anti"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Append token ids, their number and whether decoding gives the text back."""
    return pieces.round_trip(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: The perplexity model, similarity links and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"{k}_{name}")
    return docs
