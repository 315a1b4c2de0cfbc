"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = [f"shard-{i:03d}" for i in range(96)]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import chat

    linked = chat.link(chat.as_tool_messages(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return linked.select(
        "conv_id", "turn", "role", "kind", "order_turn", "order_depth", "n_calls", "n_valid_calls", "n_unanswered", "linked",
        F.array_join("errors", "; ").alias("errors"), "message_json",
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import html

    return html.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import ann

    rows = _read(spark, sf_dir, "embeddings")
    vectors = rows.select("vec_id", F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return ann.nearest(vectors, queries)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import suffixdedup

    cut = suffixdedup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import packing

    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "capacity", "step_group")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import mixing

    return mixing.mix_documents(_read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import neardup

    return neardup.classes(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_texts")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality

    judged = quality.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.n_stop_words", "base_failed", "kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import sharding

    return sharding.shard(_read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import language

    found = language.identify(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", F.col("lang").alias("declared"), "language", "text_language", F.round("posterior", 6).alias("posterior"), "accepted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_html_extraction": op2_html_extraction,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
