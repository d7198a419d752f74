"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import (
    contamination, conversations, packing, pii, piece_counts, prefix_trie, quality, ranked_search, resharding, secrets, simhash,
    token_files, tokens, warc)

OLD_SHARDS, NEW_SHARDS = 32, 40
# Pages carry no capture time; each counts as captured this second plus its id.
FIRST_CAPTURE = 1_700_000_000

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups_digest(simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=2))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokens.public_vocabulary("byte_bpe_50k.json", end_id=0, spaces_count=True)
    return token_files.round_trip(_table(spark, sf_dir, "documents"), vocabulary)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.render_maximal(_table(spark, sf_dir, "conversations"))


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by hash of the id to 40 of equal bytes."""
    old = F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS))
    assigned = resharding.reshard(_table(spark, sf_dir, "documents"), old, NEW_SHARDS)
    return resharding.slots_digest(resharding.rewrite(assigned))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_counts.count_tokens(_table(spark, sf_dir, "documents"), model, limit=4096)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokens.public_vocabulary("word_bpe_49k.json", end_id=1, spaces_count=False)
    return packing.packing_digest(packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), vocabulary)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(quality.judge(_table(spark, sf_dir, "documents")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.lit(FIRST_CAPTURE) + F.coalesce("page_id", F.lit(0))
    pages = _table(spark, sf_dir, "pages").withColumn("captured_at", second)
    return warc.captures_digest(warc.capture_histories(pages, time_col="captured_at"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


_QUERIES = (op1_secret_scan, op2_personal_data, op3_simhash, op4_token_files, op5_chat_format, op6_resharding,
            op7_token_counts, op8_decontamination, op9_packing, op10_quality_rules, op11_warc, op12_prefix_trie,
            op13_ranked_search)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": conversations.rendering_sql(), "op10_quality_rules": quality.quality_sql(),
            "op11_warc": warc.captures_sql(FIRST_CAPTURE), "op12_prefix_trie": prefix_trie.trie_sql(),
            "op13_ranked_search": ranked_search.search_sql()}
