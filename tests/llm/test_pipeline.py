"""The pipeline and the queries as they are registered."""

import re

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece
from test_operators import statistics

import __spark_entry__
import corpus_pipeline
from caravan.llm import words as W

D = "/root/testdata/sf0.001"


def windows(text, n):
    w = text.encode().translate(W.LOWER_WORDS).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(sets, ratio):
    """The smallest id that each id is linked with, of id -> set of windows."""
    ids, label = sorted(sets), {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both >= ratio * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: root(i) for i in ids}


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages_against_brute_force(spark):
    """Each stage on its own input: what it keeps, drops and changes, by plain Python over all pairs."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    given, out = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, D), name)
        out[name] = docs
    kept = {name: {r.doc_id: r.text for r in out[name].collect()} for name in list(out)[:-1]}

    good = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").where("quality = 1").collect()}
    failed = set()
    for i, text in given["quality_rules"].items():
        n, _, _, _, repeats = statistics(text)
        failed |= {i} if n < 50 or 100 * repeats > 50 * n else set()
    assert not failed & set(kept["quality_rules"]) and kept["quality_rules"].items() <= given["quality_rules"].items()
    assert len(good - failed - set(kept["quality_rules"])) <= 0.1 * len(good - failed)

    rows = given["near_duplicates"]
    label = components({i: windows(t, 5) or {tuple(t.split())} for i, t in rows.items()}, 0.8)
    assert kept["near_duplicates"] == {i: t for i, t in rows.items() if label[i] == i}

    rows, left, owner = given["substring_dedup"], kept["substring_dedup"], {}
    for i in sorted(rows):
        mine = windows(rows[i], 12)
        alone = all(owner.get(w, i) == i for w in mine)
        for w in mine:
            owner.setdefault(w, i)
        if alone:
            assert left[i] == rows[i]
        elif i in left:
            remaining = iter(rows[i].split())
            assert all(w in remaining for w in left[i].split())  # words go, none is moved or new
    owner = {}
    for i in sorted(left):
        for w in windows(left[i], 51):
            assert owner.setdefault(w, i) == i

    banned = set()
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = split(r.text)
        m = min(10, len(w))
        banned |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
    sizes = {len(w) for w in banned}
    hit = lambda w: any(tuple(w[k : k + m]) in banned for m in sizes for k in range(len(w) - m + 1))
    assert kept["decontamination"] == {i: t for i, t in given["decontamination"].items() if not hit(split(t))}

    tool = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts, coded = given["sentencepiece"], {r.doc_id: r for r in out["sentencepiece"].collect()}
    assert coded.keys() == texts.keys()
    for i, r in coded.items():
        ids = tool.encode(texts[i], add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == tool.decode(ids)
        bounds = np.frombuffer(r.bounds, "<i4")
        assert len(bounds) == r.n_tokens + 1 and bounds[-1] == len(texts[i].encode())
    ran = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, D).collect()}
    assert ran == {i: bytes(r.ids) for i, r in coded.items()}


def test_stages_on_odd_rows(spark):
    """Null ids and texts, empty ones, repeated rows and columns of the operators' own names; a table without rows."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, None, "a"), (None, long, "b"), (1, "", "c"), (2, " \n ", "d"), (3, long, "e"), (3, long, "e"), (4, f"own {long} words", "f"), (5, " ".join(f"v{i * 7 % 901}" for i in range(900)), "g")]
    docs = spark.createDataFrame([(i, t, c, 1, [2], True) for i, t, c in rows], "doc_id long, text string, cut string, n_words_cut int, keepers array<int>, kept boolean")
    expected = {"quality_rules": {(None, "b"), (3, "e"), (4, "f"), (5, "g")}, "near_duplicates": {(None, "a"), (1, "c"), (2, "d"), (3, "e"), (5, "g")}, "substring_dedup": {(None, "a"), (None, "b"), (1, "c"), (2, "d"), (5, "g")}, "decontamination": {(i, c) for i, _, c in rows}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        found = out.collect()
        if name in expected:
            assert out.columns == docs.columns and {(r.doc_id, r.cut) for r in found} == expected[name]
            assert all((r.n_words_cut, r.keepers, r.kept) == (1, [2], True) for r in found)
        else:
            assert len(found) == len(rows)
        assert stage(spark, docs.limit(0), D).count() == 0


def test_bad_documents_go(spark):
    """Of labelled documents that pass the base rule, those called bad go far more often than those called good."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    passed = [r for r in docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect() if (lambda n, _, __, ___, k: n >= 50 and 100 * k <= 50 * n)(*statistics(r.text))]
    share = {q: sum(r.doc_id in kept for r in passed if r.quality == q) / max(1, sum(r.quality == q for r in passed)) for q in (0, 1)}
    assert share[1] > 0.95 and share[0] < 0.75


def test_license_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["op8_license_scan"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["op8_license_scan"](spark, D).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
