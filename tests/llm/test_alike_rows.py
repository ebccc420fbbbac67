"""Many rows that are alike: no task holds them all, and results are whole."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from caravan.llm import balanced_shards, decontaminate, license_scan, paragraph_dedup, sstable

DOCS = "doc_id long, text string"


def test_shards_of_alike_rows(spark, monkeypatch):
    monkeypatch.setattr(balanced_shards, "RANKED", 1000)
    monkeypatch.setattr(balanced_shards, "ALIKE", 700)
    docs = spark.range(12_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")).unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    copies = balanced_shards._numbered(docs.select("doc_id", "text"))
    assert copies.distinct().count() == 12_500 and copies.agg(F.max("copy")).first()[0] == 11_999
    classes = copies.groupBy(F.pmod(F.xxhash64("doc_id", "text", "copy"), F.lit(13))).count().agg(F.max("count")).first()[0]
    assert classes < 2000
    found = balanced_shards.shard_documents(docs, shards=24).collect()
    sizes = Counter(r.shard for r in found)
    assert len(found) == 12_500 and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_token_shards_of_one_id(spark, tmp_path):
    folder = f"file://{tmp_path}/sst"
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text")).unionByName(spark.createDataFrame([(None, None), (6, "a"), (8, "b c")], DOCS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as small as these are, they would be one partition
    files = sstable.write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(sstable.read_shards(spark, folder).collect(), key=lambda r: r.start)
    assert max(f["docs"] for f in files) < 3000 and len(rows) == 4003  # several shards hold the id
    assert [r.doc_id for r in rows] == [None, 6, *[7] * 4000, 8]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_repeated_rows_name_a_place_once(spark):
    words = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, words)] + [(2, words + " end")] * 300, DOCS)
    found = paragraph_dedup.dedup_paragraphs(docs).collect()
    assert {(r.doc_id, r.n_words_cut > 380, tuple(r.keepers)) for r in found} == {(1, False, ()), (2, True, (1,))} and len(found) == 301
    assert len({tuple(map(tuple, r.cut)) for r in found if r.doc_id == 2}) == 1


def test_repeated_items_are_one(spark):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([("a", item)] * 500 + [("b", "zwölf dreizehn")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "Zwölf dreizehn"), (3, "nothing")], DOCS)
    found = {r.doc_id: r["items"] for r in decontaminate.find_contamination(docs, benchmark, pass_bytes=60).collect()}
    assert found == {1: ["a"], 2: ["b"], 3: []}


def test_spellings_of_a_word_are_one(spark):
    texts = ["wilful acts of the licence holder", "willful acts of the license holder"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    assert len({r.text_digest for r in license_scan.scan_licenses(rows).collect()}) == 1
    known = spark.createDataFrame([(f"known number {i} " + "z" * i, f"L{i}") for i in range(license_scan.LENGTHS + 5)], "text string, license string")
    registry = known.select(F.sha2(license_scan.canonical(F.col("text")), 256).alias("digest"), "license", F.length(license_scan.canonical(F.col("text"))).alias("n_chars"))
    found = license_scan.scan_licenses(spark.createDataFrame([(1, "Known number 3 zzz"), (2, "a line\nknown number 900 " + "z" * 900), (3, "other")], DOCS), registry)
    assert {r.doc_id: (r.license, r.notices) for r in found.collect()} == {1: ("L3", "L3"), 2: (None, "L900"), 3: (None, "")}
