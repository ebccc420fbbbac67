"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.llm.shared import discard, materialize, salted_join


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return salted_join(both, smallest, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = _oriented(links)
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    return salted_join(down, smallest, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b), of any orderable type -> (id, component): the smallest id reachable, for every id that has a link; written.

    Rows with a null and links of an id to itself are ignored; an empty table gives an empty result.
    No neighbour list is ever gathered: each round is two minimum aggregations and two joins on narrow rows,
    written to the shared folder, and the round before it is removed. A node with very many links is dealt to several tasks. The
    number of rounds grows with the logarithm of the longest path.
    """
    current = materialize(_oriented(links.select("a", "b").dropna()), "links")
    state = _state(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        before, current = current, materialize(_oriented(_small_star(_large_star(current))), "links")
        discard(before)
        after = _state(current)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    found = current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("component")))
    out = materialize(found.distinct(), "components")
    discard(current)
    return out
