"""Components of texts linked by the Jaccard similarity of their shingle sets, found through inverted lists.

What generates the lists (retained sketch values, MinHash bands) is up to the caller; a pair is looked at if it shares one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.llm import words as W
from caravan.llm.components import connected_components
from caravan.llm.shared import discard, materialize, salted_join

#: Lists of up to SHORT members are compared as pairs. Longer ones go by blocks, of at most BLOCK members or SHINGLES shingles.
SHORT, BLOCK, SHINGLES = 48, 1000, 1_000_000


def normal(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and ASCII white space as blanks."""
    return (text or "").encode("utf-8", "surrogatepass").translate(W.LOWER_WORDS)


def shingle_set(text: str | None, n: int) -> set:
    """The distinct windows of n words, spelled out; the whole sequence where it is shorter; none without words."""
    w = normal(text).split()
    m = min(n, len(w))
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()


def _linked(left: set, right: set, numerator: int, denominator: int) -> bool:
    both = len(left & right)
    return both > 0 and denominator * both >= numerator * (len(left) + len(right) - both)


def _verifier(n: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, set()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in ((i, min(i + 256, len(a))) for i in range(0, len(a), 256)):
                left, right = batch.column(2).slice(i, j - i).to_pylist(), batch.column(3).slice(i, j - i).to_pylist()
                good = []
                for x in range(j - i):
                    if a[i + x] != last:
                        last, kept = a[i + x], shingle_set(left[x], n)
                    good.append(_linked(kept, shingle_set(right[x], n), numerator, denominator))
                yield pa.RecordBatch.from_arrays([pa.array(a[i:j], pa.binary()), pa.array(b[i:j], pa.binary())], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, n: int, ratio: Fraction) -> DataFrame:
    """Of pairs(a, b) of digests those whose full shingle sets reach the ratio."""
    left, right = texts.select(F.col("digest").alias("a"), F.col("text").alias("ta")), texts.select(F.col("digest").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return rows.mapInArrow(_verifier(n, ratio.numerator, ratio.denominator), "a binary, b binary")


def _long_lists(members: DataFrame, texts: DataFrame, n: int, ratio: Fraction) -> DataFrame:
    """links(a, b) that connect the components within long lists. members(v, digest, n, root).

    In a list, only members outside its largest component need comparing with all others: a block of them meets a block of all
    in a task. A text goes out once for each block of the other kind in each of its long lists.
    """
    held = members.groupBy("v", "root").agg(F.count("*").alias("c"), F.max("n").alias("longest"))
    lists = held.groupBy("v").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("m"), F.max("longest").alias("longest"))
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(SHINGLES) / F.col("longest"))))
    lists = lists.select("v", F.col("top.root").alias("top"), F.ceil((F.col("m") - F.col("top.c")) / size).alias("rows"), F.ceil(F.col("m") / size).alias("columns"))
    placed = salted_join(members, lists, "v", "digest")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("digest"), F.col(c))
    left = placed.where("root <> top").select("v", own("rows").alias("i"), every("columns").alias("j"), F.lit(True).alias("left"), "digest", "root")
    right = placed.select("v", every("rows").alias("i"), own("columns").alias("j"), F.lit(False).alias("left"), "digest", "root")
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), members.sparkSession.sparkContext.defaultParallelism)
    cells = left.unionByName(right).join(texts, "digest").repartition(tasks, "v", "i", "j")  # heavy for their bytes: not to be coalesced
    return cells.groupBy("v", "i", "j").applyInPandas(_cell(n, ratio.numerator, ratio.denominator), "a binary, b binary")


def _cell(n: int, numerator: int, denominator: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.unique(W.shingle_hashes(W.word_hashes(normal(t))[2], n)) for t in rows.text]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        left, right = np.flatnonzero(rows.left.to_numpy(bool)), np.flatnonzero(~rows.left.to_numpy(bool))
        both = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 2, 2048))
        for at, (i, j) in enumerate(zip(edges, [*edges[1:], len(column)], strict=True)):
            if i < j:
                part = np.zeros((len(sets), 2048), np.float32)
                part[owner[i:j], column[i:j] - 2048 * at] = 1
                both += part[left] @ part[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - both
        a, b = np.nonzero((both > 0) & (denominator * both.astype(np.float64) >= numerator * union.astype(np.float64)))
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        spelled = functools.lru_cache(64)(lambda x: shingle_set(rows.text.iloc[x], n))
        digests, roots, out = rows.digest.tolist(), rows.root.tolist(), []
        for x, y in zip(left[a].tolist(), right[b].tolist(), strict=True):
            p, q = root(roots[x]), root(roots[y])
            if p != q and _linked(spelled(x), spelled(y), numerator, denominator):  # hashes propose, words decide
                parent[p] = q
                out.append((digests[x], digests[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def linked_components(lists: DataFrame, texts: DataFrame, n: int, ratio: Fraction, likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(digest, root: smallest digest reachable), written, for every digest with a link.

    lists(v, digest, n: size of its shingle set): the members of the inverted lists. texts(digest, text): the text of each
    member. likely(pairs) may drop pairs(a, b) beforehand that can't reach the ratio. Empty tables give an empty result.

    Each list first compares its members with one of them, which joins most groups of near copies without pairing their
    members. Lists that still hold several components are compared in full, between components only: short lists as pairs,
    long ones block by block, where a task counts the intersections of two blocks and returns a spanning set of links. No list
    is cut short and no member left out.
    """
    num, den = ratio.numerator, ratio.denominator
    fits = (F.least("na", "nb") * F.lit(den) >= F.greatest("na", "nb") * F.lit(num)) & (F.col("a") != F.col("b"))

    def links_of(raw: DataFrame, tested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        pairs = raw.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        close = materialize(likely(pairs), "likely") if likely else pairs
        found = materialize(_verified(close, texts, n, ratio), "found")
        if likely:
            discard(close)
        return pairs, found

    def roots_of(links: DataFrame) -> DataFrame:
        found = connected_components(links)
        named = found.withColumnsRenamed({"id": "digest", "component": "root"})
        named.written_to = found.written_to
        return named

    # in every list, all members against one of them; which one differs from list to list
    first = lists.groupBy("v").agg(F.min(F.struct(F.xxhash64("v", "digest").alias("h"), "digest", "n")).alias("p"))
    tested, links = links_of(salted_join(lists, first, "v", "digest").select(F.col("p.digest").alias("a"), F.col("p.n").alias("na"), F.col("digest").alias("b"), F.col("n").alias("nb")), None)
    roots = roots_of(links)

    # lists that still hold several components: short ones pair what is in different components, long ones go by blocks
    rooted = materialize(lists.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")), "rooted")
    mixed = rooted.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("v", "m")
    rest = materialize(salted_join(rooted, mixed, "v", "digest"), "rest")
    short = rest.where(F.col("m") <= SHORT)
    left = short.select("v", F.col("digest").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    right = short.select("v", F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    pairs, more = links_of(left.join(right, "v").where("ra < rb"), tested)
    across = materialize(_long_lists(rest.where(F.col("m") > SHORT), texts, n, ratio), "across")
    out = roots_of(links.unionByName(more).unionByName(across))
    discard(roots, tested, links, rooted, rest, pairs, more, across)
    return out
