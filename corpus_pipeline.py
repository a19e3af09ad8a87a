"""Corpus pipeline: documents pass through five training-data operators, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.  All
but the last return the columns of ``documents``.  Stages handle null, empty and repeated rows
as their operators define it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm import bpe_automaton, line_dedup, mixing, simhash, toxicity
from equilens.llm.common import bucket_of, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not mark; it learns from four fifths of the labelled ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, bucket_of(F.col("id"), 5) != 0)
    return docs.where(toxicity.score(docs["text"], model) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that repeat an earlier passage (three lines, or over 50 words on fewer); ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, long_words=line_dedup.LONG_WORDS)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents in training order, repeated as their source's target asks."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the stream, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_automaton.encode(docs, path, keep=("doc_id", "text"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("SimHash near-dedup", drop_near_copies),
          ("mixing", mix_sources), ("BPE encoding", encode)]
# the toxicity model and the token ids have no SQL form; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
