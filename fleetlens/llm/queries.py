"""The named queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import (
    conversation, embeddings, extraction, lexical, minhash, mixing, packing, pieces, quality, sharding, substring, url_filter, warc,
)
from fleetlens.session import staged


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_read(spark, sf_dir, "documents"), shards=8, seed=2024)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tempered_weights(docs)).drop("_text")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_read(spark, sf_dir, "documents"), size=3, share=85)
    return found.withColumnRenamed("id", "doc_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), joined=True)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def piece_model_path() -> str:
    """Where this machine keeps the public vocabulary of the queries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_decode(docs, piece_model_path())
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.records(warc.read_chunks(warc.archive(_read(spark, sf_dir, "pages"))))
    return found.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched over the month of the events; an event dates an entry for the page its user stands for."""
    pages, events = _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "events")
    minute = F.pmod(F.col("page_id") * 7919, F.lit(43200))
    fetched = F.timestamp_seconds(F.lit(1704067200) + minute * 60)
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    kind, host = F.col("event_type"), url_filter.host_of(F.col("url"))
    section = F.concat(host, F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/]+)/", 1), F.lit("/"))
    entry = events.join(pages.select(F.col("page_id").alias("user_id"), "url"), "user_id")
    log = entry.select(
        F.when(kind.isin("signup", "purchase"), "allow").otherwise("block").alias("list"),
        F.when(kind == "error", section).when(kind == "view", F.regexp_replace(host, r"^(m|blog)\.", "")).otherwise(host).alias("pattern"),
        F.when(kind.isin("click", "purchase"), "remove").otherwise("add").alias("action"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    out = url_filter.judge(captures, log)
    return out.select("page_id", "url", "n_block", "n_allow", F.unix_micros("since").alias("since_us"), "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_read(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_bits"
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy decides over all documents."""
    return quality.ablations(quality.ledger(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extraction.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), top=50)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def word_model_path() -> str:
    """Where this machine keeps the public word vocabulary of the queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"), word_model_path(), end_id=1, window=2048)
    return packed.select(
        F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations")
    rows = conversation.damaged(conversations)
    audit = staged(conversation.audits(rows, conversations), "audits")
    # One row per conversation on both sides.
    digest = conversation.digests(rows, audit).withColumnRenamed("conv_id", "id")
    found = audit.join(digest, F.col("conv_id").eqNullSafe(F.col("id")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_sharding": op2_sharding,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_warc": op7_warc,
    "op8_url_filters": op8_url_filters,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_lexical_search": op11_lexical_search,
    "op12_packing": op12_packing,
    "op13_conversation_repair": op13_conversation_repair,
}
# Reports on stored results of the operators, beside their own queries.
REPORTS = {"quality_ablations": quality_ablations}
