"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words, as numbers of a vocabulary. Patterns of one length form a group: a table
gives, for every block of two words (one word for the shortest patterns), how far the search may shift; a block that ends a pattern
has shift 0 and leads to the bucket of the patterns that end so, which are then compared with the text directly. In large buckets
a hash of the whole window selects what is compared.
"""

from __future__ import annotations

import math
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.llm import words as W
from caravan.llm.columns import filtered
from caravan.llm.shared import attach, discard, materialize, text_slices

#: Benchmark text that one broadcast may hold; a larger benchmark is searched for in several passes over the documents. Tables
#: take about 25 bytes for each of its bytes in a worker.
PASS_BYTES = 16_000_000
#: A text is searched in pieces of about so many bytes, which overlap by a window less one word.
PIECE = 1 << 20
#: Patterns of a bucket that are compared without a further hash.
BUCKET = 8


def split_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and all other non-ASCII characters; A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(W.ALPHANUMERIC_WORDS).split()


class PatternGroup:
    """Shift table and suffix buckets for patterns of m words, which are slices of the benchmark's word numbers."""

    def __init__(self, m: int, factor: int, flat: array):
        self.m, self.block, self.factor, self.flat = m, min(2, m), factor, flat
        self.shift: dict[int, int] = {}
        self.buckets: dict = {}  # last block -> starts of patterns in flat; large ones by hash of the window

    def add(self, begin: int, end: int) -> None:
        """The windows of the item whose words are flat[begin:end]."""
        m, flat = self.m, self.flat
        for at in range(begin + self.block - 1, end):
            key = flat[at - 1] * self.factor + flat[at] if self.block == 2 else flat[at]
            short = max(0, m - 1 - (at - begin))
            if short < self.shift.get(key, m):
                self.shift[key] = short
            if not short:
                self.buckets.setdefault(key, array("l")).append(at - m + 1)

    def close(self) -> None:
        for key, starts in self.buckets.items():
            if len(starts) > BUCKET:
                by_window: dict[int, array] = {}
                for start in starts:
                    by_window.setdefault(hash(self.flat[start : start + self.m].tobytes()), array("l")).append(start)
                self.buckets[key] = by_window

    def search(self, words: list[bytes], numbers: dict[bytes, int]) -> Iterator[tuple[int, list[int]]]:
        """(start, starts of the patterns in flat) of every occurrence. Only the blocks that shifts land on are looked up."""
        m, get, known, buckets, flat, factor = self.m, self.shift.get, numbers.get, self.buckets, self.flat, self.factor
        default, two = m - self.block + 1, self.block == 2
        at, n = m - 1, len(words)
        while at < n:
            key = known(words[at])
            if key is None:  # no window holds this word
                at += m
                continue
            if two:
                before = known(words[at - 1])
                if before is None:
                    at += m - 1
                    continue
                key += before * factor
            shift = get(key, default)
            if shift:
                at += shift
                continue
            window = array("i", [known(w, 0) for w in words[at - m + 1 : at + 1]])
            starts = buckets[key]
            if isinstance(starts, dict):
                starts = starts.get(hash(window.tobytes()), ())
            same = [s for s in starts if flat[s : s + m] == window]
            if same:
                yield at - m + 1, same
            at += 1


class Patterns:
    """Pattern groups of (item id, text) rows: all windows of an item, or the whole of an item of fewer words."""

    def __init__(self, items: list[tuple], window: int):
        split = [(item, split_words(text)) for item, text in items]
        self.numbers: dict[bytes, int] = {}
        flat, self.begins, self.items = array("i"), [], []
        for item, words in split:
            if words:
                self.begins.append(len(flat))
                self.items.append(item)
                flat.extend(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
        groups: dict[int, PatternGroup] = {}
        for begin, end in zip(self.begins, [*self.begins, len(flat)][1:], strict=True):
            m = min(window, end - begin)
            groups.setdefault(m, PatternGroup(m, len(self.numbers) + 1, flat)).add(begin, end)
        self.groups = list(groups.values())
        for group in self.groups:
            group.close()

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """(start, end, ids of items) of every occurrence; items without an id add none."""
        for group in self.groups:
            for start, same in group.search(words, self.numbers):
                found = {self.items[bisect_right(self.begins, s) - 1] for s in same}
                yield start, start + group.m, found - {None}


def _pieces(text: str | None, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first word, words) of pieces of a text; each repeats the last overlap words of the one before."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(W.ALPHANUMERIC_WORDS)
    at, first, carried = 0, 0, []
    while True:
        stop = len(data) if len(data) - at <= PIECE else data.rfind(b" ", at, at + PIECE)
        if stop <= at:
            stop = data.find(b" ", at + PIECE)
            stop = len(data) if stop < 0 else stop
        words = carried + data[at:stop].split()
        yield first, words
        if stop >= len(data):
            return
        carried = words[-overlap:] if overlap else []
        first += len(words) - len(carried)
        at = stop


def _search(text: str | None, patterns: Patterns, overlap: int) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, merged spans [start, end) of hit words, items."""
    n, spans, items = 0, [], set()
    for first, words in _pieces(text, overlap):
        n = first + len(words)
        for start, end, found in patterns.search(words):
            spans.append((first + start, first + end))
            items |= found
    return n, _merged(spans), items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


#: The tables that a worker has made, for its coming tasks.
_MADE: dict = {}


def _pass(patterns, window: int):
    """Adds a pass's findings to n_words, spans and items, the last three columns."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = Patterns(patterns.value, window)
        for batch in text_slices(batches):
            counts, spans, items = [], [], []
            had_spans, had_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for text, old_spans, old_items in zip(batch.column("text").to_pylist(), had_spans, had_items, strict=True):
                n, found, names = _search(text, _MADE[name], window - 1)
                counts.append(n)
                merged = _merged([*((x["start"], x["end"]) for x in old_spans), *found])
                spans.append([{"start": a, "end": b} for a, b in merged])
                items.append(sorted({*old_items, *names}))
            rest = [batch.column(i) for i in range(batch.num_columns - 3)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], batch.schema.names)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) with (n_words, spans of hit word positions, items: sorted ids of items with a window in it).

    benchmark(item_id, text, ...). Keeps every input row and all columns but former n_words, spans and items. A null, empty
    or wordless text has no words and no hits; a null or wordless item has no window; repeated items count once, repeated
    documents each; an empty benchmark hits nothing. item_id is compared and returned as a string; the windows of an item without an id hit words
    as well, but items doesn't name it. A text of any length is searched in pieces.

    The benchmark is read in passes of at most about pass_bytes of text, one broadcast each; documents are never shuffled. With
    several passes, what each has found is written before the next one begins, so that a worker holds one pass's tables.
    """
    spark = docs.sparkSession
    attach(spark)
    known = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").distinct()
    total = known.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first()["b"]
    passes = max(1, math.ceil(total / pass_bytes))
    rows = docs.drop("n_words", "spans", "items").withColumn("text", F.col("text").cast("string"))
    rows = rows.withColumn("n_words", F.lit(0).cast("long")).withColumn("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).withColumn("items", F.expr("cast(array() as array<string>)"))
    step = None
    for i in range(passes):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()
        patterns = spark.sparkContext.broadcast([tuple(x) for x in part])
        rows = rows.mapInArrow(_pass(patterns, window), rows.schema)
        if i < passes - 1:
            before, step = step, materialize(rows, "pass")
            rows = step
            if before:
                discard(before)
    return rows


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any hit, with their own columns."""
    return filtered(docs, ["n_words", "spans", "items"], lambda rows: find_contamination(rows, benchmark, window).where(F.size("spans") == 0))
