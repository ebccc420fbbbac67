"""Substring dedup over paragraphs.

A text has paragraphs of two kinds. A line of at least `line` words is a paragraph, and so are the shorter lines between two such
lines or blank lines, taken together (hard-wrapped text), if they have so many words. The 5-word shingles of a paragraph give a
MinHash signature, bands of it select candidates, exact Jaccard similarity of the shingle sets decides, and components gather
what is linked. As passages also repeat inside paragraphs, the word sequence is cut, too, into content-defined pieces: a piece
begins at a word whose two-word hash is the smallest among its neighbours, or as small, so a passage is cut alike wherever it
stands. A piece is too short for several bands: its one band is the digest of all its words, and pieces that collide in it have a
similarity of 1 by their words' 128-bit BLAKE2 digest.

Of equal pieces, and of the paragraphs of a component, those of the smallest doc_id stay. In other documents such paragraphs go,
and so do runs of consecutive such pieces that have at least `run` words together.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.llm import words as W
from caravan.llm.shared import attach, discard, materialize, salted_join, text_slices
from caravan.llm.similarity import linked_components

#: Words of a paragraph; neighbours on each side of a cut, which make pieces of nine words on average.
LINE, NEIGHBOURS = 20, 4
#: Words of a run of repeated pieces; shorter repeats are left alone. The pieces at both ends of a passage are not whole.
RUN = 12
#: Rows of a band, and the recall at its ratio that the operator takes as many bands for as are needed: 10 at 0.8.
ROWS, RECALL = 3, 0.999
#: Stands for a null doc_id.
NO_ID = -(2**63)


def tune(ratio: float, recall: float, rows: int = ROWS) -> int:
    """The fewest bands of so many rows that let a pair at the ratio collide with the recall asked for."""
    if ratio <= 0:
        raise ValueError("the ratio must be above 0")
    bands = 1
    while 1 - (1 - ratio**rows) ** bands < recall:
        bands += 1
    return bands


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _single(words: bytes) -> bytes:
    """Words with one blank between them: equal words are equal bytes then."""
    words = words.strip(b" ")
    while b"  " in words:
        words = words.replace(b"  ", b" ")
    return words


def cuts(hashes: np.ndarray, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Words at which pieces begin, each text's first word among them. hashes: words of all texts; counts: of each text."""
    counts = counts[counts > 0]
    text = np.repeat(np.arange(len(counts)), counts)
    follows = np.r_[hashes[1:], np.zeros(1, np.uint64)]
    ends = np.cumsum(counts)
    follows[ends - 1] = 0
    pair = W.mix(hashes * np.uint64(3) + follows)
    at = np.arange(len(hashes)) + neighbours * (text + 1)  # texts stand apart, so that no neighbour is another text's
    padded = np.full(len(hashes) + neighbours * (len(counts) + 1), 2**64 - 1, np.uint64)
    padded[at] = pair
    low = np.ones(len(pair), bool)
    for s in range(1, neighbours + 1):
        low &= (pair <= padded[at - s]) & (pair <= padded[at + s])
    low[ends - counts] = True
    return np.flatnonzero(low)


def _digests(texts: Iterable[bytes]) -> np.ndarray:
    """16 bytes for each text, as two integers."""
    blake2b = hashlib.blake2b
    return np.frombuffer(b"".join([blake2b(t, digest_size=16).digest() for t in texts]), np.int64).reshape(-1, 2)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = [_bytes(t) for t in batch.column(1).to_pylist()]
        clean = [_single(t.translate(W.LOWER_WORDS)) for t in texts]
        data = b" ".join(filter(None, clean))
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in clean], np.int64)
        starts, _, hashes = W.word_hashes(data)
        at = cuts(hashes, counts)
        begins = starts[at].tolist()
        v = _digests([data[i : j - 1] for i, j in zip(begins, [*begins[1:], len(data) + 1], strict=False)])
        owner = np.searchsorted(np.cumsum(counts), at, side="right")
        number = np.arange(len(at)) - np.searchsorted(owner, owner)
        places = _places(texts, owner, number)
        yield pa.RecordBatch.from_arrays([pa.array(v[:, 0]), pa.array(v[:, 1]), batch.column(0).take(pa.array(owner)), pa.array(places)], ["v", "w", "doc_id", "place"])


def _places(texts: list[bytes], owner: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Numbers of paragraphs, each with a checksum of the text, which tells rows of one doc_id with different texts apart."""
    sums = np.array([zlib.crc32(t) for t in texts], np.uint64)
    return (sums[owner] << np.uint64(32) | number.astype(np.uint64)).view(np.int64)


class Paragraphs:
    """The paragraphs of a batch of texts, found at once: words and their hashes over all texts joined.

    owner: number of the text; number: of the paragraph's first line within it; begin, end: words; top, bottom: bytes.
    """

    def __init__(self, texts: list[str | None], n: int, line: int):
        encoded = [_bytes(t) for t in texts]
        self.data, self.n = b"\n".join(encoded), n
        self.words = self.data.translate(W.LOWER_WORDS)
        self.starts, self.ends, self.hashes = W.word_hashes(self.words)
        breaks = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10)
        counts = np.bincount(np.searchsorted(breaks, self.starts), minlength=len(breaks) + 1)
        per_text = np.array([t.count(b"\n") + 1 for t in encoded], np.int64)
        first = np.cumsum(per_text) - per_text
        # a paragraph opens where a line, or the one before it, is long or blank, and where a text begins
        apart = (counts >= line) | (counts == 0)
        opens = apart | np.r_[True, apart[:-1]]
        opens[first] = True
        top = np.flatnonzero(opens)
        bottom = np.r_[top[1:], len(counts)] - 1
        until = np.cumsum(counts)
        begin, end = until[top] - counts[top], until[bottom]
        chosen = end - begin >= line
        top, bottom, self.begin, self.end = top[chosen], bottom[chosen], begin[chosen], end[chosen]
        self.owner = np.searchsorted(first, top, side="right") - 1
        self.number = top - first[self.owner]
        offset = np.cumsum([0, *(len(t) + 1 for t in encoded)])[self.owner]
        self.top, self.bottom = np.r_[-1, breaks][top] + 1 - offset, np.r_[breaks, len(self.data)][bottom] - offset

    def ranges(self, values: np.ndarray, ufunc, ends: np.ndarray, fill) -> np.ndarray:
        """ufunc over values[begin:end] of each paragraph."""
        at = np.empty(2 * len(self.begin), np.int64)
        at[::2], at[1::2] = self.begin, ends
        return ufunc.reduceat(np.r_[values, np.array([fill], values.dtype)], at)[::2] if len(at) else values[:0]

    def digests(self) -> np.ndarray:
        """16 bytes for the words of each paragraph."""
        bounds = zip(self.starts[self.begin].tolist(), self.ends[self.end - 1].tolist(), strict=True)
        return _digests([_single(self.words[i:j]) for i, j in bounds])

    def shingles(self) -> np.ndarray:
        return W.shingle_hashes(self.hashes, self.n) if len(self.hashes) >= self.n else np.zeros(0, np.uint64)

    def set_sizes(self, shingles: np.ndarray) -> np.ndarray:
        """Numbers of distinct shingles."""
        length = self.end - self.begin - self.n + 1
        line = np.repeat(np.arange(len(length)), length)
        at = np.arange(len(line)) - np.repeat(np.cumsum(length) - length, length) + self.begin[line]
        keys = W.mix(shingles[at] + line.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        ordered = np.sort(keys)  # numpy sorts values much faster than places; few shingles repeat
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(again):
            return length
        several = np.flatnonzero(again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys)
        _, once = np.unique(keys[several], return_index=True)
        return length - np.bincount(line[several], minlength=len(length)) + np.bincount(line[several[once]], minlength=len(length))

    def bands(self, shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """A key of each paragraph for each band: the hash of the band's minima."""
        seeds = W.mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        mixed, ends = W.mix(shingles), self.end - self.n + 1
        keys = np.tile(np.arange(bands, dtype=np.uint64), (len(self.begin), 1))
        for i, seed in enumerate(seeds):
            low = self.ranges(mixed * seed, np.minimum, ends, 2**64 - 1) >> np.uint64(1)
            keys[:, i // rows] = W.mix(keys[:, i // rows] * np.uint64(0x9FB21C651E98DF25) + low)
        return keys


def _as_binary(digests: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(digests.tobytes())]).cast(pa.binary())


def _signatures(n: int, line: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column(1).to_pylist()
            found = Paragraphs(texts, n, line)
            shingles = found.shingles()
            place = _places([_bytes(t) for t in texts], found.owner, found.number)
            keys = found.bands(shingles, bands, rows).view(np.int64)
            listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel())
            owners = batch.column(0).take(pa.array(found.owner))
            yield pa.RecordBatch.from_arrays([owners, pa.array(place), _as_binary(found.digests()), pa.array(found.set_sizes(shingles).astype(np.int64)), listed], ["doc_id", "place", "digest", "n", "bands"])

    return run


def _texts(n: int, line: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = Paragraphs(batch.column("text").to_pylist(), n, line)
            texts = [found.data[found.starts[a] : found.ends[b - 1]].decode("utf-8", "replace") for a, b in zip(found.begin, found.end, strict=True)]
            once = dict(zip(_as_binary(found.digests()).to_pylist(), texts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.binary()), pa.array(list(once.values()), pa.string())], ["digest", "text"])

    return run


def _cut_pieces(rows: DataFrame) -> DataFrame:
    """(doc_id, place, lo) of pieces that stand in a document with a smaller doc_id, lo, as well; written.

    Texts are cut once. Map-side combined minima leave little of a hot piece; as the minima are written, the join shuffles both
    sides and adaptive execution splits the rows of hot pieces.
    """
    keyed = materialize(rows.mapInArrow(_pieces, "v long, w long, doc_id long, place long"), "pieces")
    first = keyed.groupBy("v", "w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    first = materialize(first.select("v", "w", "lo"), "first")
    found = materialize(keyed.join(first.hint("merge"), ["v", "w"]).where("doc_id <> lo").select("doc_id", "place", "lo"), "repeated")
    discard(keyed, first)
    return found


def _cut_paragraphs(rows: DataFrame, n: int, ratio: Fraction, line: int) -> DataFrame:
    """(doc_id, place, lo) of paragraphs that are linked to one of a document with a smaller doc_id, lo; written."""
    bands = tune(float(ratio), RECALL)
    found = materialize(rows.mapInArrow(_signatures(n, line, bands, ROWS), "doc_id long, place long, digest binary, n long, bands array<long>"), "paragraphs")
    # paragraphs of the same words are one class
    classes = materialize(found.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "classes")
    banded = classes.select(F.explode("bands").alias("v"), "digest", "n")
    several = materialize(banded.groupBy("v").agg(F.count("*").alias("m")).where("m > 1").select("v"), "several")
    lists = materialize(salted_join(banded, several, "v", "digest").distinct(), "bands")
    wanted = classes.join(lists.select("digest").distinct(), "digest", "left_semi").select("digest", "lo")
    wanted = materialize(wanted, "wanted")
    owners = wanted.select(F.col("lo").alias("doc_id")).distinct()
    texts = rows.join(owners.hint("merge"), "doc_id", "left_semi").mapInArrow(_texts(n, line), "digest binary, text string")
    texts = materialize(texts.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), "texts")
    roots = linked_components(lists, texts, n, ratio)
    rooted = materialize(classes.select("digest", "lo", "hi").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")), "rooted")
    first = rooted.groupBy("root").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most").select("root", F.col("least"))
    repeated = materialize(salted_join(rooted.select("digest", "root"), first, "root", "digest").select("digest", F.col("least").alias("lo")), "first")
    out = materialize(found.select("doc_id", "place", "digest").join(repeated.hint("merge"), "digest").where("doc_id <> lo").select("doc_id", "place", "lo"), "repeated")
    discard(found, classes, several, lists, wanted, texts, roots, rooted, repeated)
    return out


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, numbers and keepers of the lists of a column, by row and number."""
    row = pa.compute.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    n, lo = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in pa.compute.list_flatten(column).flatten())
    order = np.lexsort((n, row))
    return row[order], n[order], lo[order]


def _word_counts(texts: list[bytes]) -> np.ndarray:
    starts, _ = W.word_bounds(b" ".join(texts).translate(W.LOWER_WORDS))
    return np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))


#: A row, the bytes to cut from it, and the documents that keep them.
Span = tuple[int, int, int, list[int]]


def _piece_spans(texts: list[bytes], column: pa.Array, least: int) -> Iterator[Span]:
    """Runs of pieces to cut. The texts that have some are cut into pieces at once."""
    row, n, lo = _listed(column)
    if not len(row):
        return
    chosen, owner = np.unique(row, return_inverse=True)
    mine = [texts[i] for i in chosen.tolist()]
    begins, _, hashes = W.word_hashes(b" ".join(mine).translate(W.LOWER_WORDS))
    offsets = np.cumsum([0, *(len(t) + 1 for t in mine)])
    words = np.searchsorted(begins, offsets)  # of the texts before each
    at = cuts(hashes, np.diff(words))
    piece = np.searchsorted(at, words)[owner] + n
    at = np.r_[at, len(hashes)]
    opens = np.flatnonzero(np.r_[True, (np.diff(piece) != 1) | (np.diff(owner) != 0)])
    closes = np.r_[opens[1:], len(piece)]
    first, last = at[piece[opens]], at[piece[closes - 1] + 1]
    begins = np.r_[begins, 0]
    for i in np.flatnonzero(last - first >= least).tolist():
        x = int(owner[opens[i]])
        end = int(begins[last[i]] - offsets[x]) if last[i] < words[x + 1] else len(mine[x])
        yield int(chosen[x]), int(begins[first[i]] - offsets[x]), end, lo[opens[i] : closes[i]].tolist()


def _line_spans(texts: list[str | None], column: pa.Array, line: int) -> Iterator[Span]:
    """Paragraphs to cut."""
    row, n, lo = _listed(column)
    if not len(row):
        return
    chosen, owner = np.unique(row, return_inverse=True)
    mine = [texts[i] for i in chosen.tolist()]
    found = Paragraphs(mine, 1, line)
    place = found.owner << 32 | found.number  # in order
    if not len(place):
        return
    wanted = owner << 32 | n
    at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
    sizes = [len(_bytes(t)) for t in mine]
    for x, i, keeper, same in zip(owner.tolist(), at.tolist(), lo.tolist(), (place[at] == wanted).tolist(), strict=True):
        if same:
            yield int(chosen[x]), int(found.top[i]), min(int(found.bottom[i]) + 1, sizes[x]), [keeper]


CUT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _apply(width: int, least: int, line: int):
    """The last two columns of a batch, pieces and lines to cut, become new text, words left, words cut, spans and keepers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            left = [_bytes(t) for t in texts]
            spans: dict[int, list[tuple[int, int]]] = {}
            keepers: dict[int, set[int]] = {}
            for row, a, b, kept in [*_piece_spans(left, batch.column("_pieces"), least), *_line_spans(texts, batch.column("_lines"), line)]:
                spans.setdefault(row, []).append((a, b))
                keepers.setdefault(row, set()).update(kept)
            gone = np.zeros(len(texts), np.int64)
            for row, found in spans.items():
                merged: list[tuple[int, int]] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                    else:
                        merged.append((a, b))
                data, spans[row] = left[row], merged
                gone[row] = sum(len(data[a:b].translate(W.LOWER_WORDS).split()) for a, b in merged)
                left[row] = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in merged)], [*(a for a, _ in merged), len(data)], strict=True))
                texts[row] = left[row].decode("utf-8", "surrogatepass")
            names = batch.schema.names[:width]
            rest = [batch.column(i) for i in range(width)]
            if spans:
                rest[names.index("text")] = pa.array(texts, pa.string())
            cut = [[{"start": a, "end": b} for a, b in spans.get(i, ())] for i in range(len(texts))]
            kept = [[None if k == NO_ID else k for k in sorted(keepers.get(i, ()))] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(_word_counts(left)), pa.array(gone), pa.array(cut, CUT), pa.array(kept, pa.list_(pa.int64()))], [*names, "n_words_left", "n_words_cut", "cut", "keepers"])

    return run


def dedup_paragraphs(docs: DataFrame, n: int = 5, ratio: Fraction = Fraction(4, 5), line: int = LINE, run: int = RUN) -> DataFrame:
    """docs(doc_id, text, ...) with repeated paragraphs cut from text, and (n_words_left, n_words_cut, cut: spans of bytes,
    keepers: sorted doc_ids of the documents that keep what was cut).

    Keeps every row and all columns but former ones of the new names. Words are runs of characters other than ASCII white
    space, A-Z lower-cased. n: words of a shingle; ratio: similarity of linked paragraphs; line: words of a paragraph; run: words
    of a run of repeated pieces. Paragraphs repeat across documents only: what a document repeats within itself stays. Rows that
    share a doc_id are one document, null being the smallest doc_id. A null text stays null; empty and wordless texts stay as
    they are; an empty table gives an empty result.
    """
    attach(docs.sparkSession)
    docs = docs.drop("n_words_left", "n_words_cut", "cut", "keepers").withColumn("text", F.col("text").cast("string"))
    if n > line:
        raise ValueError(f"shingles have at most {line} words")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("doc_id"), "text")
    pieces, paragraphs = _cut_pieces(rows), _cut_paragraphs(rows, n, ratio, line)
    # rows that repeat a doc_id and its text name the same places, which a set holds once
    found = pieces.withColumn("piece", F.lit(True)).unionByName(paragraphs.withColumn("piece", F.lit(False)))
    at = F.struct(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n"), "lo")
    gathered = found.groupBy(F.col("doc_id").alias("_key"), F.shiftrightunsigned("place", 32).alias("_tag")).agg(
        F.collect_set(F.when(F.col("piece"), at)).alias("_pieces"), F.collect_set(F.when(~F.col("piece"), at)).alias("_lines")
    )
    gathered = materialize(gathered, "cuts")
    discard(pieces, paragraphs)
    tag = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    joined = docs.withColumn("_key", key).withColumn("_tag", tag).join(gathered.hint("merge"), ["_key", "_tag"], "left")
    rows = joined.select(*docs.columns, "_pieces", "_lines")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(_apply(len(docs.columns), run, line), f"{fields}, n_words_left long, n_words_cut long, cut array<struct<start:bigint,end:bigint>>, keepers array<bigint>")
