"""Near-duplicates by bottom-k sketches.

One hash function orders the shingles of every text; a sketch keeps the k smallest. Inverted lists of retained values
generate candidate pairs, the sketch of the union estimates their similarity, and the full shingle sets decide.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravan.llm import words as W
from caravan.llm.shared import attach, discard, materialize, salted_join, small, text_slices
from caravan.llm.similarity import linked_components, normal

#: Of the k values of a sketch, so many must agree for a pair to be looked at. At a similarity of 0.8 the number that
#: agree is binomial (32, 0.8), below 14 with a probability of 1e-6, at 0.85 of 1e-8.
K, AGREE = 32, 14


def _sketcher(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column(1).to_pylist()
            words = [b" ".join(normal(t).split()) for t in texts]
            counts = [w.count(b" ") + 1 if w else 0 for w in words]
            hashes = W.word_hashes(b" ".join(filter(None, words)))[2]  # the words of all texts at once
            windows = W.shingle_hashes(hashes, n)
            sizes, digests, sketches, at = [], [], [], 0
            for word, count in zip(words, counts, strict=True):
                shingles = np.unique(windows[at : at + count - n + 1] if count >= n else W.shingle_hashes(hashes[at : at + count], n))
                at += count
                sizes.append(len(shingles))
                digests.append(hashlib.blake2b(word, digest_size=16).digest() if count else None)
                sketches.append(shingles[:k].view(np.int64))
            tags = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            flat = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            offsets = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tags, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "tag", "n_shingles", "digest", "sketch"],
            )

    return run


def sketch(docs: DataFrame, n: int, k: int = K) -> DataFrame:
    """(doc_id, tag: crc32 of the text, n_shingles, digest of the word sequence, sketch: the k smallest shingle hashes, ascending)."""
    attach(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketcher(n, k), "doc_id long, tag long, n_shingles long, digest binary, sketch array<long>")


def _likely(classes: DataFrame, k: int):
    """Drops pairs whose sketches, as a sketch of the union, agree in too few values."""
    side = lambda x: classes.select(F.col("digest").alias(x), F.col("sketch").alias(f"s{x}"))
    smallest = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    agree = F.size(F.array_intersect(F.array_intersect("sa", "sb"), smallest))
    enough = F.greatest(F.lit(1), F.floor(F.size(smallest) * F.lit(AGREE) / F.lit(K)))
    return lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").where(agree >= enough).select("a", "b")


def _lists(classes: DataFrame, k: int) -> DataFrame:
    """(v, digest, n): the inverted lists to look at.

    Values that one class alone retains link nothing. Of a sketch of s values, those that come first in the order of
    rising frequency are enough: two sketches that share AGREE / K of their values share one of the first s - t + 1.
    So a passage that very many texts hold makes no long list unless it makes up most of those texts.
    """
    values = classes.select("digest", F.col("n_shingles").alias("n"), F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    frequent = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    shared = salted_join(values, frequent, "v", "digest")
    w = Window.partitionBy("digest")
    ranked = shared.withColumn("alone", F.col("s") - F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("f", "v")))
    needed = F.greatest(F.lit(1), F.floor(F.col("s") * F.lit(AGREE) / F.lit(K)))
    return ranked.where(F.col("alone") + F.col("r") <= F.col("s") - needed + 1).select("v", "digest", "n")


def near_duplicates(docs: DataFrame, n: int = 5, ratio: Fraction = Fraction(4, 5), k: int = K) -> DataFrame:
    """Components of documents whose sets of n-word shingles have a Jaccard similarity of at least ratio.

    docs(doc_id, text, ...): words are runs of characters other than ASCII white space, A-Z lower-cased. A text of
    fewer than n words has its whole word sequence as one shingle; a null or wordless text has none and links to nothing.
    -> (doc_id, tag: crc32 of the text, n_shingles, component_id: smallest doc_id reachable, kept: doc_id = component_id). One row per input row;
    rows that repeat a doc_id share a component only if their texts do. A null doc_id counts as larger than any other;
    a component with only such rows has a null component_id and keeps them all. An empty table gives an empty result.

    Copies of a word sequence collapse into one class before anything else; no link between other classes is lost but with
    the probability given at K.
    """
    return _near_duplicates(docs, n, ratio, k)[0]


def _near_duplicates(docs: DataFrame, n: int, ratio: Fraction, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result of near_duplicates() and the written tables that it reads."""
    sketched = materialize(sketch(docs, n, k), "sketches")
    known = sketched.where("digest is not null")
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sketch").alias("sketch")), "classes")
    lists = materialize(_lists(classes, k), "lists")
    texts = materialize(_texts(docs, classes.select("digest", "doc_id").join(lists.select("digest").distinct(), "digest", "left_semi")), "texts")
    roots = linked_components(lists, texts, n, ratio, _likely(classes, k))
    rooted = materialize(classes.select("digest", "doc_id").join(roots, "digest", "left").select("digest", "doc_id", F.coalesce("root", "digest").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(salted_join(rooted, smallest, "root", "digest").select("digest", "component_id"), "named")
    narrow = materialize(sketched.select("doc_id", "tag", "n_shingles", "digest"), "rows")
    discard(sketched, classes, lists, texts, roots, rooted)
    found = narrow.join(named, "digest", "left").select(
        "doc_id", "tag", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found, [narrow, named]


def deduplicate(docs: DataFrame, n: int = 5, ratio: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that near_duplicates() keeps, with their own columns."""
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_key")
    found, steps = _near_duplicates(docs, n, ratio, K)
    gone = materialize(found.where("not kept").select(known, F.col("tag").alias("_tag")).distinct(), "gone")
    discard(*steps)
    tagged = docs.select("*", known, F.crc32(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")).alias("_tag"))
    return tagged.join(small(gone, gone.count() * 32), ["_key", "_tag"], "left_anti").select(*docs.columns)


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(digest, text) of one document of each class in a list. chosen(digest, doc_id): the smallest doc_id of each class."""
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key")  # doc_id may be null, or repeat with other texts
    rows = docs.select(known, F.col("text").cast("string").alias("text")).join(chosen.select(known).distinct(), "key", "left_semi")
    return rows.select("text").mapInArrow(_digester(), "digest binary, text string").join(chosen.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def _digester():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text")
            digests = [hashlib.blake2b(b" ".join(normal(t).split()), digest_size=16).digest() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), texts], ["digest", "text"])

    return run
