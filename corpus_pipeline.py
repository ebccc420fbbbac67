"""From raw documents to token ids: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one. docs has
doc_id and text; other columns go along, whatever their names are. All stages take null ids (larger than any other where one
document of a group stays, smaller where the first one keeps a passage), null and empty texts, rows that repeat an id (one document,
all of whose rows go or stay where their texts are the same), texts of any length and tables without rows, which give none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.llm import bottomk, decontaminate, paragraph_dedup, quality_rules, sentencepiece_offsets
from caravan.llm.columns import filtered
from caravan.llm.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects. Null, empty and wordless texts fail the base rule."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8. Texts without words have no duplicates."""
    return bottomk.deduplicate(docs)


#: What the operator adds to documents.
CUT = ["n_words_left", "n_words_cut", "cut", "keepers"]


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs are cut from all documents but the first; documents with nothing left go. n_chars, where documents have it,
    follows the text; a null text stays."""

    def keep(rows: DataFrame) -> DataFrame:
        found = paragraph_dedup.dedup_paragraphs(rows).where("n_words_cut = 0 or n_words_left > 0")
        if "n_chars" not in rows.columns:
            return found
        return found.withColumn("n_chars", F.when(F.col("n_words_cut") > 0, F.length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))

    return filtered(docs, CUT, keep)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item; texts without words have none."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, source bounds and decoded text of each document; a null text counts as empty."""
    return sentencepiece_offsets.encode_with_offsets(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("substring_dedup", substrings), ("decontamination", decontamination), ("sentencepiece", encoding)]
#: The stages learn, sketch and tokenize, which SQL can't express; a test holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
