"""Ranked lexical search over a clustered index.

Documents are reordered by recursive graph bisection, so that those with common terms stand together: the top levels of the recursion
run over all documents as Spark jobs, the rest within chunks of bounded size. Runs of the order are clusters, each a row with its
inverted lists and the largest impact of each of its terms. A query's bound for a cluster is the sum of its weights times these
impacts; clusters are visited from the highest bound down, and those whose bound lies below the k-th score found so far are skipped,
which loses nothing. Ties between documents go by their ids, whatever their place in the order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caravan.llm import words as W
from caravan.llm.shared import attach, discard, held, materialize, storage, text_slices, work_dir

#: Terms of a document that the upper levels of the bisection know, and buckets that they are counted by; bucket 0 stands for none.
SKETCH, BUCKETS = 16, 1024
#: Levels over all documents at most (a chunk is a part of such a node), rounds of exchanges on each, bins that gains are counted by.
DEPTH, ROUNDS, BINS = 6, 2, 64
#: Documents and bytes of text of a chunk, about; documents of a cluster; rounds and rare terms of a document within a chunk.
CHUNK_DOCS, CHUNK_BYTES, CLUSTER, LOCAL_ROUNDS, LOCAL_TERMS = 2048, 8_000_000, 64, 4, 32
#: Bytes of queries that one pass broadcasts, and clusters that give a query its first threshold.
PASS_BYTES, SEEDS = 4_000_000, 4

#: Clusters are rows of some hundred kilobytes. Parquet's usual settings would gather a hundred of them to a page and 4096 to a batch.
WIDE_ROWS = {"parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "2", "parquet.block.size": "8000000"}
BATCH_ROWS = ("spark.sql.parquet.columnarReaderBatchSize", "16")

_ODD = 0x9FB21C651E98DF25


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats, then of the distinct ones: number of the text, 64-bit hash, occurrences), sorted.

    Terms are runs of ASCII letters and digits and all other non-ASCII characters; A-Z lower-cased.
    """
    cleaned = [(t or "").encode("utf-8", "surrogatepass").translate(W.ALPHANUMERIC_WORDS) for t in texts]
    starts, _, hashes = W.word_hashes(b" ".join(cleaned))
    offsets = np.cumsum([0, *(len(c) + 1 for c in cleaned)])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    for a, b in zip((np.cumsum(counts) - counts).tolist(), np.cumsum(counts).tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return counts, owner[at], hashes[at], np.diff(np.r_[at, len(hashes)])


def _sketches(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the SKETCH terms of each text whose mixed hashes are smallest."""
    mixed = W.mix(hashes)
    order = np.lexsort((mixed, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner, owner)  # owner is sorted, and stays so
    chosen = rank < SKETCH
    out = np.zeros((n, SKETCH), np.uint16)
    out[owner[chosen], rank[chosen]] = 1 + hashes[order][chosen] % np.uint64(BUCKETS - 1)
    return out


def _ties(ids: pa.Array, at: int) -> np.ndarray:
    """A hash of each row, which places rows that are alike; at: rows of the task before them."""
    known = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return W.mix(W.mix(known) + np.arange(at, at + len(known), dtype=np.uint64) * np.uint64(_ODD))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    at = 0
    for batch in text_slices(batches):
        yield batch, _ties(batch.column(0), at)
        at += batch.num_rows


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, ties in _slices(batches):
        texts = batch.column(1).to_pylist()
        counts, owner, hashes, _ = terms_of(texts)
        sketches = _sketches(owner, hashes, len(texts))
        keep = np.flatnonzero(counts)
        size = np.array([len(t or "") for t in texts], np.int64)
        packed = pa.array([row.tobytes() for row in sketches[keep]], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(ties[keep].view(np.int64)), pa.array(counts[keep]), pa.array(size[keep]), packed], ["tie", "n", "size", "sketch"])


def _summed(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray | None:
    """The sum of an array that fn makes of each partition, added in a tree; None without partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([fn(batches).tobytes()], pa.binary())], ["sum"])

    def add(a, b):
        return b if a is None else a if b is None else a + b

    return rows.mapInArrow(run, "sum binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64)).treeAggregate(None, add, add)


@dataclass
class Exchange:
    """A round on a level: what a term adds to the gain of moving, by side, node and bucket; bins from which documents move."""

    gains: np.ndarray
    scale: float
    bins: np.ndarray
    shares: np.ndarray


class Bisection:
    """The upper levels: a document's node follows from its sketch and its tie alone."""

    def __init__(self):
        self.levels: list[list[Exchange]] = []

    def place(self, sketch: np.ndarray, ties: np.ndarray, gains_of: np.ndarray | None = None, scale: float = 1.0):
        """(node, side on the last level), and with gains_of, of a round that isn't decided yet, each document's bin as well."""
        node = side = np.zeros(len(ties), np.int64)
        for level, rounds in enumerate(self.levels):
            node = node * 2 + side
            noise = W.mix(ties + np.uint64((level + 1) * _ODD % 2**64))
            side = (noise & np.uint64(1)).astype(np.int64)
            for i, x in enumerate(rounds):
                bins = self._bins(x.gains, x.scale, node, side, sketch)
                chance = (W.mix(noise + np.uint64(i + 1)) >> np.uint64(11)).astype(np.float64) / 2**53
                limit = x.bins[side, node]
                side = side ^ ((bins > limit) | ((bins == limit) & (chance < x.shares[side, node])))
        return (node, side) if gains_of is None else (node, side, self._bins(gains_of, scale, node, side, sketch))

    @staticmethod
    def _bins(gains, scale, node, side, sketch) -> np.ndarray:
        total = gains[side[:, None], node[:, None], sketch].sum(axis=1)
        return np.clip(np.floor(total * scale) + BINS // 2, 0, BINS - 1).astype(np.int64)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ties = batch.column("tie").to_numpy(zero_copy_only=False).view(np.uint64)
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH), ties


def _degrees(model, nodes: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, nodes, BUCKETS + 1), np.int64)  # the last: documents
        for batch in batches:
            sketch, ties = _columns(batch)
            node, side = model.value.place(sketch, ties)
            at = (side * nodes + node) * (BUCKETS + 1)
            flat = np.bincount((at[:, None] + sketch).ravel(), minlength=out.size) + np.bincount(at + BUCKETS, minlength=out.size)
            out += flat.reshape(out.shape)
        return out

    return fn


def _histogram(model, nodes: int, gains: np.ndarray, scale: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, nodes, BINS), np.int64)
        for batch in batches:
            sketch, ties = _columns(batch)
            node, side, bins = model.value.place(sketch, ties, gains, scale)
            out += np.bincount((side * nodes + node) * BINS + bins, minlength=out.size).reshape(out.shape)
        return out

    return fn


def move_gains(own: np.ndarray, other: np.ndarray, n_own, n_other) -> np.ndarray:
    """What the estimated size of the gaps falls by, for each term, if a document with it moves from one half to the other."""

    def cost(a, b):
        return a * np.log2(n_own / (a + 1.0)) + b * np.log2(n_other / (b + 1.0))

    return np.where(own > 0, cost(own, other) - cost(np.maximum(own - 1, 0), other + 1), 0.0)


def _swaps(hist: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Bins and shares by side and node: as many documents of either side move, those of the highest gains, while pairs gain."""
    nodes = hist.shape[1]
    bins, shares = np.full((2, nodes), BINS, np.int64), np.zeros((2, nodes))
    value = (np.arange(BINS) - BINS // 2 + 0.5) / scale
    for node in range(nodes):
        i = j = BINS - 1
        left, right = hist[0, node].tolist(), hist[1, node].tolist()
        moved = 0
        while i >= 0 and j >= 0 and value[i] + value[j] > 0:
            m = min(left[i], right[j])
            moved, left[i], right[j] = moved + m, left[i] - m, right[j] - m
            i, j = i - (not left[i]), j - (not right[j])
        for side in (0, 1):
            above = moved
            for b in range(BINS - 1, -1, -1):
                have = int(hist[side, node, b])
                if above <= have:
                    bins[side, node], shares[side, node] = b, above / have if have else 0.0
                    break
                above -= have
    return bins, shares


def fit_bisection(sketches: DataFrame, depth: int) -> Bisection:
    """The upper levels over all documents: two sums over sketches a round, each of an array of bounded size."""
    context, out = sketches.sparkSession.sparkContext, Bisection()
    for level in range(depth):
        nodes = 1 << level
        out.levels.append([])
        for _ in range(ROUNDS):
            model = context.broadcast(out)
            degrees = _summed(sketches, _degrees(model, nodes)).reshape(2, nodes, BUCKETS + 1).astype(np.float64)
            n = np.maximum(degrees[:, :, -1:], 1)
            gains = np.stack([move_gains(degrees[s, :, :-1], degrees[1 - s, :, :-1], n[s], n[1 - s]) for s in (0, 1)]).astype(np.float32)
            gains[:, :, 0] = 0
            scale = BINS / 8 / max(float(np.abs(gains[gains != 0]).mean()) * SKETCH**0.5 if gains.any() else 0.0, 1e-9)
            hist = _summed(sketches, _histogram(model, nodes, gains, scale)).reshape(2, nodes, BINS)
            out.levels[-1].append(Exchange(gains, scale, *_swaps(hist, scale)))
            model.unpersist()
    return out


def bisect(begins: np.ndarray, terms: np.ndarray, n_terms: int, least: int) -> np.ndarray:
    """An order of documents by recursive bisection down to parts of least documents. begins: of each document's terms, and the end."""
    order = np.arange(len(begins) - 1)
    stack = [(0, len(order))]
    sizes = np.diff(begins)
    while stack:
        a, b = stack.pop()
        if b - a <= least:
            continue
        docs = order[a:b]
        count = sizes[docs]
        owner = np.repeat(np.arange(b - a), count)
        mine = terms[np.arange(count.sum()) + np.repeat(begins[docs] - (np.cumsum(count) - count), count)]
        _, mine = np.unique(mine, return_inverse=True)
        k = int(mine.max()) + 1 if len(mine) else 0
        half = least * max(1, (b - a) // 2 // least)  # parts are full but for the last
        side = np.arange(b - a) >= half
        for _ in range(LOCAL_ROUNDS):
            right = np.bincount(mine[side[owner]], minlength=k)
            left = np.bincount(mine, minlength=k) - right
            there, back = move_gains(left, right, half, b - a - half), move_gains(right, left, b - a - half, half)
            gain = np.bincount(owner, np.where(side[owner], back[mine], there[mine]), minlength=b - a)
            ls, rs = np.flatnonzero(~side), np.flatnonzero(side)
            ls, rs = ls[np.argsort(-gain[ls], kind="stable")], rs[np.argsort(-gain[rs], kind="stable")]
            m = min(len(ls), len(rs))
            moved = int(np.count_nonzero(gain[ls[:m]] + gain[rs[:m]] > 1e-9))
            if not moved:
                break
            side[ls[:moved]], side[rs[:moved]] = True, False
        order[a:b] = np.r_[docs[~side], docs[side]]
        stack += [(a, a + half), (a + half, b)]
    return order


POSTINGS = "chunk int, doc_id long, n long, terms binary, tfs binary"
CLUSTERS = "chunk int, cluster int, doc_ids array<long>, terms binary, ends binary, docs binary, impacts binary, tops binary"


def _postings(model, base: np.ndarray, parts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ties in _slices(batches):
            texts = batch.column(1).to_pylist()
            counts, owner, hashes, tfs = terms_of(texts)
            node, side = model.value.place(_sketches(owner, hashes, len(texts)), ties)
            node = node * 2 + side if model.value.levels else node
            chunk = base[node] + (W.mix(ties + np.uint64(_ODD)) % parts[node].astype(np.uint64)).astype(np.int64)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
            tfs = tfs.astype(np.uint32)
            keep = np.flatnonzero(counts).tolist()
            packed = [pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in keep], pa.binary()) for x in (hashes, tfs)]
            ids = batch.column(0).cast(pa.int64()).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(chunk[keep].astype(np.int32)), ids, pa.array(counts[keep]), *packed], ["chunk", "doc_id", "n", "terms", "tfs"])

    return run


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of a binary column, one after the other."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind)


def _chunk_order(begins: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """An order of a chunk's documents: rare terms tell most, so of those in two or more, the rarest of each document count."""
    known, local = np.unique(hashes, return_inverse=True)
    df = np.bincount(local, minlength=len(known))[local]
    shared = np.flatnonzero(df > 1)
    owner = np.searchsorted(begins, shared, side="right") - 1
    by = np.lexsort((hashes[shared], df[shared], owner))  # owner is sorted, and stays so
    shared = shared[by[np.arange(len(by)) - np.searchsorted(owner, owner) < LOCAL_TERMS]]
    owner = np.searchsorted(begins, shared, side="right") - 1
    return bisect(np.searchsorted(owner, np.arange(len(begins))), local[shared], len(known), size)


def _build(n_docs: int, n_terms: int, size: int):
    """A chunk's clusters: its documents in bisection order, by runs of size. Each is sent when it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids = table.column("doc_id").to_pylist()
        hashes, tfs = _flat(table.column("terms"), np.uint64), _flat(table.column("tfs"), np.uint32)
        begins = np.cumsum([0, *(len(x.as_buffer()) // 8 for x in table.column("terms"))])
        m = np.array([75 + 25 * n * n_docs // n_terms for n in table.column("n").to_pylist()], np.int64)
        chunk = table.column("chunk")[0].as_py()
        del table
        order = _chunk_order(begins, hashes, size)
        binary = [(name, pa.binary()) for name in ("terms", "ends", "docs", "impacts", "tops")]
        schema = pa.schema([("chunk", pa.int32()), ("cluster", pa.int32()), ("doc_ids", pa.list_(pa.int64())), *binary])
        for c, a in enumerate(range(0, len(order), size)):
            docs = order[a : a + size]
            count = np.diff(begins)[docs]
            at = np.arange(count.sum()) + np.repeat(begins[docs] - (np.cumsum(count) - count), count)
            who = np.repeat(np.arange(len(docs)), count)
            by = np.argsort(hashes[at], kind="stable")
            at, who = at[by], who[by]
            terms, first = np.unique(hashes[at], return_index=True)
            tf = tfs[at].astype(np.int64)
            impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m[docs][who])
            packed = (terms, np.r_[first[1:], len(at)].astype(np.uint32), who.astype(np.uint16), impacts.astype(np.uint32), np.maximum.reduceat(impacts, first).astype(np.uint32))
            row = [[chunk], [c], [[ids[i] for i in docs]], *([x.tobytes()] for x in packed)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return run


@dataclass
class Index:
    """clusters: see CLUSTERS; documents with a term, and all terms with repeats; the folder."""

    clusters: DataFrame
    n_docs: int
    n_terms: int
    path: str


def build_index(docs: DataFrame, path: str | None = None, cluster: int = CLUSTER) -> Index:
    """A clustered index of all documents with a term, written to path (a new shared folder by default).

    docs(doc_id integer, text, ...) is read twice, so it should be a table or a written step. Other columns are left aside. A null
    or termless text is in no cluster; a null doc_id and rows that repeat one are documents of their own; an empty table gives an
    empty index. Terms are known by 64-bit hashes: different words of the same length up to eight bytes never share one, and any two
    others do with a probability of 2^-64.
    """
    if not 0 < cluster <= 1 << 16:
        raise ValueError("a cluster has 1 to 65536 documents")
    spark = docs.sparkSession
    attach(spark)
    path = path or work_dir(spark, "index")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketches = materialize(rows.mapInArrow(_sketch_rows, "tie long, n long, size long, sketch binary"), "sketches")
    totals = sketches.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, totals["n"]) / CHUNK_DOCS))))
    model = spark.sparkContext.broadcast(fit_bisection(sketches, depth))

    def sizes(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, 1 << depth), np.int64)
        for batch in batches:
            node, side = model.value.place(*_columns(batch))
            np.add.at(out, (slice(None), node * 2 + side if depth else node), np.stack([np.ones(len(node), np.int64), batch.column("size").to_numpy()]))
        return out

    found = _summed(sketches, sizes)
    counts = found.reshape(2, -1) if found is not None else np.zeros((2, 1), np.int64)
    parts = np.maximum(1, -(-np.maximum(counts[0] / CHUNK_DOCS, counts[1] / CHUNK_BYTES) // 1)).astype(np.int64)
    base = np.cumsum(parts) - parts
    postings = rows.mapInArrow(_postings(model, base, parts), POSTINGS)
    built = postings.groupBy("chunk").applyInArrow(_build(totals["n"], totals["terms"], cluster), CLUSTERS)
    kept = materialize(built, "index", path + "/clusters", WIDE_ROWS)
    discard(sketches)
    spark.createDataFrame([(totals["n"], totals["terms"])], "n_docs long, n_terms long").coalesce(1).write.parquet(path + "/totals")
    return Index(kept, totals["n"], totals["terms"], path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that build_index() has written."""
    attach(spark)
    row = spark.read.parquet(path + "/totals").first()
    return Index(spark.read.schema(CLUSTERS).parquet(path + "/clusters"), row["n_docs"], row["n_terms"], path)


def drop_index(index: Index) -> None:
    """Remove an index whose results are written."""
    fs, path = storage(index.path)
    fs.delete_dir(path)


class Queries:
    """Of (key, text) rows: the sorted vocabulary, and of each query its terms with repeats, flat."""

    def __init__(self, rows: list[tuple]):
        counts, owner, hashes, tfs = terms_of([text for _, text in rows])
        self.keys = [rows[i][0] for i in np.flatnonzero(counts)]
        self.vocabulary, self.terms = np.unique(hashes, return_inverse=True)
        self.repeats = tfs.astype(np.int64)
        self.query = np.unique(owner, return_inverse=True)[1] if len(owner) else owner
        self.begins = np.searchsorted(self.query, np.arange(len(self.keys) + 1))
        self.weights = np.zeros(len(self.terms), np.int64)
        self.least = np.ones(len(self.keys), np.int64)  # scores from which on documents matter

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
        self.weights = np.array(w, np.int64)[self.terms] * self.repeats


def _frequencies(shared):
    def fn(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        vocabulary = shared.value.vocabulary
        out = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                at, here = _meet(vocabulary, np.frombuffer(terms, np.uint64))
                out[at] += np.diff(np.frombuffer(ends, np.uint32).astype(np.int64), prepend=0)[here]
        return out

    return fn


def _meet(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in both sorted arrays, of what they have in common."""
    few, many = (vocabulary, terms) if len(vocabulary) < len(terms) else (terms, vocabulary)
    at = np.searchsorted(many, few)
    same = many[np.minimum(at, len(many) - 1)] == few if len(many) else np.zeros(len(few), bool)
    found = np.flatnonzero(same), at[same]
    return found if few is vocabulary else found[::-1]


class Visitor:
    """Bounds and scores of one cluster after the other."""

    def __init__(self, queries: Queries):
        self.q = queries
        self.top, self.row = np.zeros(len(queries.vocabulary), np.int64), np.full(len(queries.vocabulary), -1, np.int64)

    def bounds(self, terms: bytes, tops: bytes) -> np.ndarray:
        """The highest score that a document of the cluster can have, for each query."""
        at, here = _meet(self.q.vocabulary, np.frombuffer(terms, np.uint64))
        self.top[at] = np.frombuffer(tops, np.uint32)[here]
        out = np.add.reduceat(self.q.weights * self.top[self.q.terms], self.q.begins[:-1])
        self.top[at] = 0
        return out

    def scores(self, wanted: np.ndarray, n: int, terms: bytes, ends: bytes, docs: bytes, impacts: bytes) -> Iterator[np.ndarray]:
        """Scores of the cluster's n documents, for each of the wanted queries."""
        q = self.q
        at, here = _meet(q.vocabulary, np.frombuffer(terms, np.uint64))
        self.row[at] = here
        end = np.frombuffer(ends, np.uint32).astype(np.int64)
        begin = np.r_[0, end[:-1]]
        docs, impacts = np.frombuffer(docs, np.uint16), np.frombuffer(impacts, np.uint32).astype(np.int64)
        for i in wanted.tolist():
            part = slice(q.begins[i], q.begins[i + 1])
            row = self.row[q.terms[part]]
            weight, row = q.weights[part][row >= 0], row[row >= 0]
            count = end[row] - begin[row]
            listed = np.arange(count.sum()) + np.repeat(begin[row] - (np.cumsum(count) - count), count)
            out = np.zeros(n, np.int64)
            np.add.at(out, docs[listed], impacts[listed] * np.repeat(weight, count))
            yield out
        self.row[at] = -1


class Best:
    """The k best documents of each query so far."""

    def __init__(self, queries: Queries, k: int):
        self.k, self.least = k, queries.least.copy()
        self.scores = [np.zeros(0, np.int64)] * len(queries.keys)
        self.ids: list[list] = [[] for _ in queries.keys]

    def add(self, query: int, scores: np.ndarray, ids: list) -> None:
        new = np.flatnonzero(scores >= self.least[query])
        if not len(new):
            return
        scores, ids = np.r_[self.scores[query], scores[new]], [*self.ids[query], *(ids[i] for i in new)]
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[: self.k]
        self.scores[query], self.ids[query] = scores[order], [ids[i] for i in order]
        if len(order) == self.k:
            self.least[query] = max(self.least[query], scores[order[-1]])

    def batch(self) -> pa.RecordBatch:
        size = [len(x) for x in self.ids]
        flat = [pa.array(np.repeat(np.arange(len(size)), size)), pa.array([i for x in self.ids for i in x], pa.int64()), pa.array(np.concatenate([*self.scores, np.zeros(0, np.int64)]))]
        return pa.RecordBatch.from_arrays(flat, ["query", "doc_id", "score"])


def _seed_clusters(shared):
    """(query, chunk, cluster, bound) of the SEEDS clusters of the highest bounds in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Visitor(shared.value)
        n = len(shared.value.keys)
        best, where = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        for batch in batches:
            found = np.stack([visitor.bounds(a, b) for a, b in zip(batch.column("terms").to_pylist(), batch.column("tops").to_pylist(), strict=True)], axis=1)
            place = batch.column("chunk").to_numpy().astype(np.int64) << 32 | batch.column("cluster").to_numpy()
            best, where = np.concatenate([best, found], axis=1), np.concatenate([where, np.tile(place, (n, 1))], axis=1)
            top = np.argsort(-best, axis=1, kind="stable")[:, :SEEDS]
            best, where = np.take_along_axis(best, top, 1), np.take_along_axis(where, top, 1)
        query, rank = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(where[query, rank]), pa.array(best[query, rank])], ["query", "place", "bound"])

    return run


def _visit(shared, k: int, seeds: dict[int, list[int]] | None):
    """(query, doc_id, score) of the k best of each task. With seeds, clusters are visited for the queries named; else by bound.

    The clusters of a batch are visited from the highest bound down, query by query, until the bound falls below the k-th score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        visitor, best = Visitor(queries), Best(queries, k)
        for batch in batches:
            rows = batch.to_pylist()
            if seeds is None:
                bounds = [visitor.bounds(r["terms"], r["tops"]) for r in rows]
                order = sorted(range(len(rows)), key=lambda i: -int(bounds[i].max()))
            else:
                order = range(len(rows))
            for i in order:
                r = rows[i]
                wanted = np.flatnonzero(bounds[i] >= best.least) if seeds is None else np.array(seeds.get(r["chunk"] << 32 | r["cluster"], []), np.int64)
                if len(wanted):
                    for query, scores in zip(wanted.tolist(), visitor.scores(wanted, len(r["doc_ids"]), r["terms"], r["ends"], r["docs"], r["impacts"]), strict=True):
                        best.add(query, scores, r["doc_ids"])
        yield best.batch()

    return run


RANKED = "query long, doc_id long, score long"


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_pass(index: Index, rows: list[tuple], k: int) -> tuple[DataFrame | None, Queries]:
    spark = index.clusters.sparkSession
    queries = Queries(rows)
    if not queries.keys or not index.n_docs:
        return None, queries
    context = spark.sparkContext
    df = _summed(index.clusters.select("terms", "ends"), _frequencies(context.broadcast(queries)))
    queries.weigh(df, index.n_docs)
    shared = context.broadcast(queries)
    seeds = index.clusters.select("chunk", "cluster", "terms", "tops").mapInArrow(_seed_clusters(shared), "query long, place long, bound long")
    best = Window.partitionBy("query").orderBy(F.desc("bound"), "place")
    by_place: dict[int, list[int]] = {}
    for r in seeds.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= SEEDS).select("query", "place").collect():
        by_place.setdefault(r.place, []).append(r.query)
    wanted = spark.createDataFrame([(p >> 32, p & 0xFFFFFFFF) for p in by_place], "chunk int, cluster int")
    first = index.clusters.join(F.broadcast(wanted), ["chunk", "cluster"], "left_semi").mapInArrow(_visit(shared, k, by_place), RANKED)
    for r in _ranked(first, k).where(F.col("rank") == k).select("query", "score").collect():
        queries.least[r.query] = max(1, r.score)
    return _ranked(index.clusters.mapInArrow(_visit(context.broadcast(queries), k, None), RANKED), k), queries


def search(index: Index, queries: DataFrame, k: int = 20, key: str = "item_id", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(key, rank from 1, doc_id, score) of the k highest-scoring documents of each query with a score above 0; written.

    queries(key, text, ...): equal rows are one query; rows that share a key are queries of their own, each with its ranks. A null
    key stays null. A null or termless text finds nothing. Equal scores go by ascending doc_id, null last. Queries are read in passes
    of at most about pass_bytes of text, whose results, k rows a query, are written.
    """
    spark = index.clusters.sparkSession
    attach(spark)
    rows = queries.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    kind = rows.schema["key"].dataType.simpleString()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first()["b"]
    passes, out = max(1, math.ceil(total / pass_bytes)), None
    with held(spark, *BATCH_ROWS):
        for i in range(passes):
            part = sorted((tuple(r) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == i).collect()), key=repr)
            found, known = _search_pass(index, part, k)
            names = spark.createDataFrame([(j, x) for j, x in enumerate(known.keys)], f"query long, key {kind}")
            found = found if found is not None else spark.createDataFrame([], f"{RANKED}, rank int")
            named = materialize(found.join(F.broadcast(names), "query").select(F.col("key").alias(key), "rank", "doc_id", "score"), "ranked")
            out = out.unionByName(named) if out else named
    return out


def oracle(k: int = 20) -> str:
    """The ranking of documents for benchmark items, in SQL."""
    terms = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""
    return f"""
        WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {terms} FROM documents) GROUP BY ALL),
        sized AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized),
        lengths AS (SELECT doc_id, 75 + (25 * n * docs) // words AS m FROM sized, totals),
        weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
        asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {terms} FROM benchmark) GROUP BY ALL),
        scored AS (
            SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= {k}
    """
