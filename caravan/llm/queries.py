"""Thin queries over the test tables: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from caravan.llm import balanced_shards, bottomk, chat, decontaminate, language_id, license_scan, paragraph_dedup, quality_rules, ranked_search, sentencepiece_offsets, sstable, warc, whitening
from caravan.llm.shared import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "sstable")
    sstable.write_shards(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return sstable.read_shards(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards.shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the conversations of op5 hold besides the table.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_events(chat.events_of_turns(turns)))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_offsets.encode_with_offsets(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("bounds", 256).alias("bounds_sha256"))


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), window=10)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose repeated paragraphs: how much, where, and which documents keep them."""
    found = paragraph_dedup.dedup_paragraphs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.where("n_words_cut > 0").select("doc_id", "keepers", "n_words_cut", "n_words_left", "cut")


def op10_bottomk_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(_table(spark, sf_dir, "documents"), n=3, ratio=Fraction(85, 100)).select("doc_id", "n_shingles", "component_id", "kept")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.label_languages(docs.drop("lang"), language_id.fit_languages(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(_table(spark, sf_dir, "embeddings"), components=32)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = ranked_search.search(index, _table(spark, sf_dir, "benchmark"), k=20)
    ranked_search.drop_index(index)
    return found


_ALL = (op1_token_sstable, op2_quality_rules, op3_balanced_shards, op4_warc, op5_chat, op6_sentencepiece, op7_wu_manber, op8_license_scan, op9_paragraph_dedup, op10_bottomk_near_duplicates, op11_language_id, op12_whitening, op13_ranked_search)
QUERIES = {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {"op8_license_scan": license_scan.oracle(), "op13_ranked_search": ranked_search.oracle()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
