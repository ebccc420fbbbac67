"""Language identification, whitening and ranked search against brute force."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pytest

from caravan.llm import language_id, queries, ranked_search, whitening

D = "/root/testdata/sf0.001"


# --- language identification ----------------------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = language_id.Network(["a", "b", "c"], hidden=3)
    for p in net.parameters():
        p += rng.normal(0, 0.2, p.shape).astype(np.float32)
    x, y = rng.integers(97, 102, (7, 4)).astype(np.uint8), rng.integers(0, 3, 4)
    real = np.ones((7, 4), np.float32)
    real[5:, 1] = 0
    _, found = net.gradients(x, real, y)
    for p, g in zip(net.parameters(), found, strict=True):
        for at in zip(*(rng.integers(0, n, 6) for n in p.shape), strict=True):
            at = (int(rng.integers(97, 102)), *at[1:]) if p.shape[0] == 256 else at
            old, loss = p[at], []
            for step in (1e-2, -1e-2):
                p[at] = old + step
                loss.append(net.gradients(x, real, y)[0])
            p[at] = old
            assert abs((loss[0] - loss[1]) / 2e-2 - g[at]) < 2e-3


def test_labeller_is_the_network():
    rng = np.random.default_rng(4)
    net = language_id.Network(["a", "b"], hidden=5)
    for d in (net.ahead, net.back):
        d.bias += rng.normal(0, 0.3, d.bias.shape).astype(np.float32)
    x = rng.integers(0, 256, (9, 6)).astype(np.uint8)
    states = np.concatenate([net.ahead.forward(x, []), net.back.forward(x[::-1], [])[::-1]], axis=2)
    p = np.exp(states @ net.w + net.c)
    assert np.allclose(language_id.Labeller(net).label(x), (p / p.sum(axis=2, keepdims=True)).transpose(0, 2, 1), atol=1e-5)


def test_languages_held_out(spark):
    got = {r.doc_id: r for r in queries.op11_language_id(spark, "/root/testdata/sf0.01").collect()}
    right = []
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect():
        held = zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert got[r.doc_id].held_out == held and 0 <= got[r.doc_id].score <= 1
        if re.search(r"[^\W\d_]", r.text or ""):
            right += [got[r.doc_id].lang_pred == r.lang] if held and r.lang else []
        else:
            assert got[r.doc_id].lang_pred == "und"
    assert len(right) > 200 and np.mean(right) > 0.97


def test_language_edges(spark, monkeypatch):
    rows = [(i, ("das ist ein haus und der hund " if i % 2 else "the house and this is the dog ") * 3, "de" if i % 2 else "en", "x", 0.5) for i in range(60)]
    rows += [(None, None, "en", "x", 0.5), (100, "", "de", "x", 0.5), (101, " 12 ##", "de", "x", 0.5), (102, "the dog " * 40_000, None, "x", 0.5), (None, "und der hund ist ein haus", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    seen = []
    monkeypatch.setattr(language_id, "train", lambda texts, labels: seen.append((texts, labels)) or language_id.Network(sorted(set(labels))))
    language_id.fit_languages(docs)
    other = [(i, t, "xx" if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else m, "x", 0.5) for i, t, m, _, _ in rows]
    language_id.fit_languages(spark.createDataFrame(other, docs.schema).repartition(5))
    assert seen[0] == seen[1] and set(seen[0][1]) == {"de", "en"}  # what is held out changes nothing, nor does the layout
    monkeypatch.undo()
    net = language_id.train(*map(list, zip(*((t, m) for _, t, m, _, _ in rows[:60]), strict=True)), steps=60)
    found = language_id.label_languages(docs, net)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "shares"]
    by = {(r.doc_id, r.text): r for r in found.collect()}
    assert [by[k, t].lang_pred for k, t in ((None, None), (100, ""), (101, " 12 ##"))] == ["und"] * 3 and by[102, rows[63][1]].lang_pred == "en" and by[None, "und der hund ist ein haus"].lang_pred == "de"
    assert all(abs(sum(x.share for x in r.shares) - (r.lang_pred != "und")) < 1e-9 for r in by.values())
    empty = docs.limit(0)
    assert language_id.fit_languages(empty) is None and language_id.label_languages(docs, None).where("lang_pred <> 'und'").count() == 0 == language_id.label_languages(empty, net).count()


# --- whitening ------------------------------------------------------------------------------------------------------


def whitened(vectors, components):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x - [s // n for s in sums]).astype(float) - [(s % n) / n for s in sums]
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return deviation, centred @ axes / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_against_brute_force(spark, parts):
    table = spark.read.parquet(f"{D}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    deviation, white, explained = whitened([v for _, v in rows], 32)
    got = {(r.vec_id, r.component): r for r in whitening.whiten_embeddings(table.repartition(parts)).collect()}
    assert len(got) == 32 * len(rows)
    signs = [np.sign(got[rows[0][0], k + 1].whitened * white[0, k]) for k in range(32)]
    for i, (vec_id, _) in enumerate(rows):
        for k in range(32):
            r = got[vec_id, k + 1]
            assert r.n == len(rows) and r.deviation == deviation[i] and abs(r.whitened - signs[k] * white[i, k]) < 1e-6
            assert abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_edges(spark):
    rows = [(1, [1.0, 2.0, 0.5], 1), (2, None, 2), (3, [1.0], 1), (None, [float("nan"), 1.0, 1.0], 1), (5, [2.0, float("inf"), 1.0], 0), (6, [], 0), (7, [3.0, 1.0, 0.0], 1), (7, [3.0, 1.0, 0.0], 1), (8, [None, 1.0, 1.0], 1), (None, [0.0, 9.0, 4.0], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    found = whitening.whiten_embeddings(docs).collect()
    assert Counter(r.vec_id for r in found) == {1: 2, 7: 4, None: 2} and {r.n for r in found} == {4}  # four vectors, two directions
    assert whitening.whiten_embeddings(docs.limit(0)).count() == 0 == whitening.whiten_embeddings(docs.where("vec_id = 7")).count()
    same = whitening.whiten_embeddings(docs.where("vec_id in (1, 7)").unionByName(spark.createDataFrame([(9, [1e300, -1e300, 0.0], 0)], docs.schema))).collect()
    assert {r.deviation for r in same} == {None} or all(r.deviation >= 0 for r in same if r.deviation is not None)


# --- ranked search --------------------------------------------------------------------------------------------------


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c, c.total()) for i, c in tf if c]
    n, length = len(tf), sum(x for _, _, x in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, c, size in tf:
            m = 75 + 25 * size * n // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            found += [(score, i)] if score > 0 else []
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def search(spark, docs, items, k=20, cluster=8, **options):
    index = ranked_search.build_index(docs, cluster=cluster)
    found = ranked_search.search(ranked_search.open_index(spark, index.path), items, k=k, **options)
    rows = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=repr)
    held = index.clusters.selectExpr("explode(doc_ids) as i").count()
    ranked_search.drop_index(index)
    return rows, held


@pytest.mark.parametrize(("chunk", "cluster", "parts"), [(10_000, 64, 1), (40, 8, 5), (40, 3, 2)])
def test_search_against_brute_force(spark, monkeypatch, chunk, cluster, parts):
    rng = np.random.default_rng(11)
    pool = [f"w{i}" for i in range(60)] + ["Ünï", "x1", "THE"]
    weights = 1 / np.arange(1, len(pool) + 1)
    some = lambda n: " ".join(rng.choice(pool, n, p=weights / weights.sum()))
    docs = [(int(i), some(int(n))) for i, n in enumerate(rng.integers(1, 80, 220))]
    docs += [(1000 - i, "w5 w7 copy of a text") for i in range(110)]  # a third are copies: ties by id
    docs += [(None, "w5 rare"), (None, None), (500, ""), (501, "- . _"), (7, "w5 w7"), (7, "w5 w7"), (502, "w3 " * 40_000)]
    items = [(0, some(12)), (1, "w5 w7 w7 copy"), (2, None), (3, ""), (4, "nowhere"), (5, "RARE the"), (None, "w40 w41"), (1, "w9"), (1, "w9")]
    monkeypatch.setattr(ranked_search, "CHUNK_DOCS", chunk)
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(parts)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    want = ranking(docs, [*dict.fromkeys(items)], 20)
    rows, held = search(spark, frame, asked, cluster=cluster)
    assert rows == want and held == sum(bool(terms(t)) for _, t in docs)
    assert search(spark, frame, asked, cluster=cluster, pass_bytes=40)[0] == want
    assert search(spark, frame.limit(0), asked)[0] == [] == search(spark, frame, asked.limit(0))[0]


def test_bounds_hold_and_clusters_gather_like_documents():
    rng = np.random.default_rng(2)
    topics = rng.permutation(np.repeat(np.arange(4), 32))
    terms_of = [rng.choice(np.arange(t * 20, t * 20 + 20), 8, replace=False) for t in topics]
    begins = np.arange(len(topics) + 1) * 8
    order = ranked_search.bisect(begins, np.concatenate(terms_of), 80, 32)
    assert sorted(order) == list(range(128))
    pure = [np.bincount(topics[order[i : i + 32]]).max() for i in range(0, 128, 32)]
    assert np.mean(pure) > 28  # of 32


def test_wide_clusters_are_sent_and_stored_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "CHUNK_BYTES", 1 << 30)  # one chunk, and one file
    docs = [(i, " ".join(f"x{i + k}" for k in range(30_000))) for i in range(40)]
    index = ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"), cluster=1)
    assert index.clusters.count() == 40
    files = pyarrow.dataset.dataset(index.path.removeprefix("file://") + "/clusters", format="parquet")
    groups = [g.total_byte_size for f in files.get_fragments() for g in f.row_groups]
    assert sum(groups) > 20_000_000 and max(groups) < 12_000_000
    key, value = ranked_search.BATCH_ROWS
    before = spark.conf.get(key)
    found = ranked_search.search(index, spark.createDataFrame([("a", "x0 x30038")], "item_id string, text string"))
    assert sorted((r.item_id, r.doc_id) for r in found.collect()) == [("a", 0), ("a", 39)] and spark.conf.get(key) == before != value
    ranked_search.drop_index(index)
    table = pa.table({"chunk": pa.array([3] * 9, pa.int32()), "doc_id": range(9), "n": [2] * 9, "terms": [np.arange(i, i + 2, dtype=np.uint64).tobytes() for i in range(9)], "tfs": [np.ones(2, np.uint32).tobytes()] * 9})
    sent = list(ranked_search._build(9, 18, 4)(iter(table.to_batches(max_chunksize=5))))
    assert [b.num_rows for b in sent] == [1, 1, 1] and sorted(i for b in sent for i in b.column("doc_ids")[0].as_py()) == list(range(9))


def test_search_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = queries.op13_ranked_search(spark, D).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(tuple(r) for r in got) == sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLE_SQL['op13_ranked_search']})").fetchall())
