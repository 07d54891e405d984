"""From raw documents to token ids: the stages, and the run over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import minhash, mixing, pieces, quality, substring
from fleetlens.llm.queries import piece_model_path
from fleetlens.session import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return quality.quality_stage(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at 0.8 over five-word shingles."""
    return minhash.dedup_stage(docs, size=5, share=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that a document of smaller id has."""
    return substring.substring_stage(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule; sources weigh as the square root of their size."""
    return mixing.mixed(docs, mixing.tempered_weights(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their place in the mix, their token ids, and whether the ids decode to the text."""
    out = pieces.encode_decode(mixing.placed(docs), piece_model_path())
    return out.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]
# Token ids are beyond SQL; tests/llm holds the rows against a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; ``mix_position`` is the order of the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
