"""Thin queries over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontamination, language_id, lexical_search, line_dedup, mixing, ngram_join, quality_rules, rule_classifier, sharding, substring_dedup, token_counts, warc
from .util import materialize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train(read(spark, sf_dir, "documents"))
    return language_id.identify(read(spark, sf_dir, "pages"), model)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.assess(read(spark, sf_dir, "documents"), quality_rules.V1)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op1_rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "pages"), line_dedup.host_of(F.col("url")), line_dedup.visible_lines(F.col("html")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.prepared(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).drop("text")
    return mixing.mix(materialize(docs, "mixing"), targets=LANG_TARGETS).select("doc_id", "source", "lang", "topic", "n_tokens", "p", "weight", "kept")


#: Shares of tokens by language that the mix aims at; sources and topics are tempered.
LANG_TARGETS = {"lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.13, mixing.OTHER: 0.02}}


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.transform("leaks", lambda x: x["item_id"])
    return found.select("doc_id", (F.size("leaks") > 0).alias("leaked"), items.alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x["edits"])).alias("least_edits"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)
    return found.select("item_id", "rank", "doc_id", "score")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
