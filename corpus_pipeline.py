"""Corpus preparation: each stage works on what the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. run() writes each
stage's result to the session's shared folder and reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, minmax, phrases, tiling, toxicity
from lodestone.llm.session import cut

#: The stages learn weights and follow links, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None

#: Documents of this score or more are rejected.
TOXIC = 0.5
#: Documents are near duplicates if their sets of five words have this similarity or more, in hundredths.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the grammar, fitted to the labelled training documents, scores TOXIC or more."""
    grammar = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, grammar).where(F.col("_score") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one of least id."""
    return minmax.drop_near_duplicates(docs, NEAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words in repeated passages. Texts without any stay as they are; others are their kept words joined by a space."""
    out = phrases.remove_repeats(docs)
    changed = F.col("_n_removed") > 0
    columns = {"text": F.when(changed, F.col("_kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("_kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(columns).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item's passages."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("_contaminated")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining text, and whether they decode to its bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.round_trip(docs.select("doc_id", "text"), path, pattern)
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.col("_ids").alias("ids"), F.col("_exact").alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
