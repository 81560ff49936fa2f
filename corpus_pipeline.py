"""The training-data pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from strandlake.llm.common import materialize


def _stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go. Fitted on labels of this stage's documents."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, machine)


def _stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs)


def _stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte in a 100-byte string that also starts earlier goes; a character that was cut goes whole. Texts that
    are left empty stay, as empty documents."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def _stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids as packed unsigned 32-bit integers, whether decoding gives the text's bytes)."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "text"])
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return back.select("doc_id", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", _stage_toxicity),
    ("simhash_near_dedup", _stage_near_dedup),
    ("suffix_array_dedup", _stage_suffix_dedup),
    ("benchmark_decontamination", _stage_decontaminate),
    ("byte_bpe_encoding", _stage_encode),
]

#: SQL cannot express the model, the fingerprints and the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
