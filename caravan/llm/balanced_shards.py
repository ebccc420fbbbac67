"""Balanced label propagation: linked documents move to their neighbours' shards while shards stay even."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravan.llm.shared import discard, materialize, salted_join

#: Rows that a ranking task sorts at once, about.
RANKED = 20_000
#: Movers between two shards are counted in so many hash classes; one class of each pair of shards is ranked.
CLASSES = 256
#: Rounds at most, and the share of the cut edges that a round must save for another one to follow.
ROUNDS, GAIN = 10, 0.01


def ranked(df: DataFrame, rows: int, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with name: a gapless rank from 0 within by (the whole where empty), without gathering such a group in a task.

    Rows are ranked within hash classes of about RANKED rows; the counts of the classes before are added.
    """
    classes = max(1, math.ceil(rows / RANKED))
    keyed = df.withColumn("_class", F.pmod(F.xxhash64(*order), F.lit(classes)))
    counts = keyed.groupBy(*by, "_class").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")
    local = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_class").orderBy(*order)))
    return local.join(offsets, [*by, "_class"]).withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_class", "_before", "_rank")


def _in_range(rank: Column, sizes: list[int]) -> Column:
    """Index of the consecutive range of the given sizes that a rank falls into."""
    bounds, total = [], 0
    for n in sizes[:-1]:
        total += n
        bounds.append(total)
    return F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<long>"), lambda b: b <= rank)).cast("int")


def _allowed(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wished moves (from, to) may happen: exchanges, and what fits into free room."""
    out = {k: min(n, wishes.get(k[::-1], 0)) for k, n in wishes.items()}
    left = list(room)
    for (a, b), n in sorted(wishes.items()):
        more = min(n - out[a, b], left[b])
        out[a, b] += more
        left[b] -= more
    return out


def group_counts(members: DataFrame, state: DataFrame) -> DataFrame:
    """(group, shard, c): how many members of each group are in each shard."""
    return members.join(state, "node").groupBy("group", "shard").agg(F.count("*").alias("c"))


def cut_edges(counts: DataFrame) -> int:
    """Links between members of a group that run between shards, from group_counts()."""
    pairs = lambda n: (n * (n - 1) / 2).cast("double")
    groups = counts.groupBy("group").agg((pairs(F.sum("c")) - F.sum(pairs(F.col("c")))).alias("cut"))
    return int(groups.agg(F.coalesce(F.sum("cut"), F.lit(0.0)).alias("cut")).first()["cut"])


def propagate(members: DataFrame, start: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, shard), written, after rounds of moves that never put more nodes into a shard than its capacity.

    members(node, group): who is linked with whom; a link of two nodes is a group of two. start(node, shard).
    A node wishes to be in the shard that most members of its groups, itself included, are in; among equal shards the one
    that comes first by a hash of its groups and the shard, so that all members agree. Wishes from shard a to b are granted
    as far as others wish from b to a, or b has room. Rounds end when cut edges no longer fall by GAIN.

    A group votes once, however many members it has: only nodes of several groups add up their groups' counts.
    """
    shards = len(capacity)
    marks = materialize(members.groupBy("node").agg(F.min("group").alias("mark"), F.count("*").alias("groups")), "marks")
    single = marks.where("groups = 1").select("node", F.col("mark").alias("group"))
    several = members.join(marks.where("groups > 1").select("node", "mark"), "node")
    state, cut = start, math.inf
    for step in range(rounds):
        counts = materialize(group_counts(members, state), "counts")
        now = cut_edges(counts)
        if not now or now > cut * (1 - GAIN):
            discard(counts)
            break
        cut = now
        best = lambda votes, mark: F.min(F.struct((-F.col(votes)).alias("v"), F.xxhash64(mark, "shard").alias("h"), F.col("shard").alias("to")))
        voted = counts.groupBy("group").agg(best("c", "group").alias("best"))
        votes = several.join(counts, "group").groupBy("node", "mark", "shard").agg(F.sum("c").alias("votes"))
        added = votes.groupBy("node").agg(best("votes", "mark").alias("best"))
        wishes = salted_join(single, voted, "group", "node").select("node", "best.to").unionByName(added.select("node", "best.to"))
        movers = state.join(wishes, "node").withColumn("class", F.pmod(F.xxhash64(F.lit(step), "node"), F.lit(CLASSES)))
        movers = materialize(movers, "wishes")
        discard(counts)
        wished = movers.where("shard <> to").groupBy("shard", "to", "class").agg(F.count("*").alias("n")).orderBy("shard", "to", "class").collect()
        if not wished:
            break
        held = {x["shard"]: x["n"] for x in movers.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        total: dict[tuple[int, int], int] = {}
        for x in wished:
            total[x["shard"], x["to"]] = total.get((x["shard"], x["to"]), 0) + x["n"]
        allowed = _allowed(total, [capacity[s] - held.get(s, 0) for s in range(shards)])
        limits = _limits([(x["shard"], x["to"], x["class"], x["n"]) for x in wished], allowed)
        if not limits:
            break
        limited = lambda rows: F.broadcast(state.sparkSession.createDataFrame(rows, "shard int, to int, full long, quota long"))
        # of the class that may move in part, the rows up to the quota; a node stands once among the movers
        edge = movers.join(limited(limits), ["shard", "to"]).where("class = full and quota > 0")
        nth = edge.withColumn("r", F.row_number().over(Window.partitionBy("shard", "to").orderBy("node"))).where("r = quota")
        last = {(x["shard"], x["to"]): x["node"] for x in nth.select("shard", "to", "node").collect()}
        fits = state.sparkSession.createDataFrame([(a, b, full, last.get((a, b))) for a, b, full, _ in limits], "shard int, to int, full long, last long")
        go = (F.col("class") < F.col("full")) | ((F.col("class") == F.col("full")) & (F.col("node") <= F.col("last")))
        before, state = state, materialize(movers.join(F.broadcast(fits), ["shard", "to"], "left").select("node", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shards")
        discard(movers, *([before] if before is not start else []))
    discard(marks)
    return state


def _limits(wished: list[tuple[int, int, int, int]], allowed: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(from, to, class, quota): movers of lower classes go, and so many of this class; exactly as many in all as allowed.

    wished(from, to, class, n) is sorted.
    """
    out: dict[tuple[int, int], tuple[int, int]] = {}
    left = dict(allowed)
    for a, b, c, n in wished:
        k = a, b
        if k in left and left[k] < n:
            out[k] = c, left.pop(k)
        elif k in left:
            left[k] -= n
    out |= {k: (CLASSES, 0) for k in left}
    return [(*k, *v) for k, v in sorted(out.items()) if allowed[k]]


#: Rows that are alike and made by one task.
ALIKE = 65536


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with copy, a number from 0 among rows that are alike in everything, which ranks can be dealt out by.

    Such rows are counted and made again from their count, in blocks, so however many there are, no task sorts them.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    blocks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(ALIKE).cast("long"))))
    spread = blocks.repartition("_from", *rows.columns)
    return spread.select(*rows.columns, F.explode(F.sequence("_from", F.least(F.col("_n") - 1, F.col("_from") + ALIKE - 1))).alias("copy"))


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """Every row of docs(doc_id, text, ...) in a shard, by the law `rows`: the shards' counts are at most one apart.

    -> (doc_id, size: UTF-8 bytes of the text plus 8, text_crc32, law, shard, slot: gapless from 0 in each shard, grown_shard:
    null). Documents with equal texts are linked; null counts as the empty text. Rows that repeat a doc_id, null too, are
    documents of their own. Equal tables give equal results, however their rows lie in files. Texts of any length are only
    hashed and measured. An empty table gives an empty result.

    Linked documents start dealt out evenly and move by propagate(); the others then fill what room is left.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("group"))
    read = materialize(_numbered(narrow), "rows")
    total = read.count()
    rows = materialize(ranked(read, total, [], ["doc_id", "group", "copy"], "node").drop("copy"), "ranked")
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    groups = materialize(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "groups")
    members = materialize(rows.select("node", "group").join(groups, "group"), "members")
    linked = members.count()
    start = ranked(members.select("node"), linked, [], ["node"], "rank").select("node", F.pmod("rank", F.lit(shards)).cast("int").alias("shard"))
    start = materialize(start, "start")
    state = propagate(members, start, capacity, rounds)
    held = {x["shard"]: x["n"] for x in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    room = [capacity[s] - held.get(s, 0) for s in range(shards)]
    alone = ranked(rows.select("node").join(state, "node", "left_anti"), total - linked, [], ["node"], "rank").select("node", _in_range(F.col("rank"), room).alias("shard"))
    placed = materialize(rows.drop("group").join(state.unionByName(alone), "node"), "placed")
    discard(read, rows, groups, members, start, *([state] if state is not start else []))
    return ranked(placed, total, ["shard"], ["doc_id", "node"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
