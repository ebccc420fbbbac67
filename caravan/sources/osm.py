"""OpenStreetMap elements as road lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.functions import geo
from caravan.operators.relational import surrogate_key

ELEMENT = "type string, id bigint, lon double, lat double, nodes array<bigint>, tags map<string,string>"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of files with one JSON element a line."""
    return spark.read.schema(ELEMENT).json(path)


#: What changes a JSON reader's state: an escaped character, a quote, an opening brace.
_TOKEN = re.compile(r'\\.|"|\{', re.S)
#: A document's objects are within the array of its one outer object.
OUTER = 1


def _scan(piece: str, quoted: bool) -> tuple[bool, list[int]]:
    """(whether a text is open at the end, places of opening braces outside texts) of a piece that begins within a text or not."""
    opened = []
    for token in _TOKEN.finditer(piece):
        if token[0] == '"':
            quoted = not quoted
        elif token[0] == "{" and not quoted:
            opened.append(token.start())
    return quoted, opened


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        yield from zip(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True), batch.column("value").to_pylist(), strict=True)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a file, begun outside a text (0) or within one (1): whether a text is open at its end, by how much deeper
    it is there, and at its least deep place."""
    found: dict[tuple, list[list[int]]] = {}
    for key, piece in _grouped(batches):
        for state in found.setdefault(key, [[0, 0, 0], [1, 0, 0]]):
            quoted, opened = _scan(piece, bool(state[0]))
            depth = state[1] + len(opened) - (not quoted)  # a piece ends at a closing brace
            state[:] = int(quoted), depth, min(state[2], depth)
    rows = [dict(zip(_STATE, (*key, *x, *y), strict=True)) for key, (x, y) in found.items()]
    yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string() if c == "file" else pa.int64()) for c in _STATE]))


_STATE = ("file", "block", "quoted0", "depth0", "low0", "quoted1", "depth1", "low1")


def _objects(begins: dict[tuple, tuple[int, int, int]]):
    """Objects, and their parts in several blocks with the block that they began in. begins: of each block, whether a text is open,
    the depth, and the block that the open object began in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at, parts = [], None, []
        quoted, depth, owner = False, 0, None

        def put(whole: bool) -> None:
            rows.append({"file": at[0], "owner": at[1] if owner is None else owner, "block": at[1], "whole": whole, "text": "".join(parts)})
            parts.clear()

        for key, piece in _grouped(batches):
            if key != at:
                if parts:
                    put(False)
                at, (quoted, depth, owner) = key, begins[key]
                owner = owner if depth > OUTER else None  # of the object that is open at the block's begin
            quoted, opened = _scan(piece, bool(quoted))
            if depth > OUTER:
                parts.append(piece + "}")
            elif depth + len(opened) > OUTER:
                parts.append(piece[opened[OUTER - depth] :] + "}")
            depth += len(opened) - (not quoted)
            if depth <= OUTER and parts:
                put(owner is None)
                owner = None
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, OBJECTS)
                rows.clear()
        if parts:
            put(False)
        yield pa.RecordBatch.from_pylist(rows, OBJECTS)

    return run


OBJECTS = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Elements of files that are one JSON document each, {"elements": [...], ...}, as map servers answer.

    A file of any size and layout is read in blocks by many tasks: text is split at closing braces, a first pass finds for each
    block whether it begins within a text and how deep, one row a block, and a second one cuts out the elements; those that cross
    blocks are put together from their parts. Other objects of the document are left out.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    blocks: dict[str, list] = {}
    for r in pieces.mapInArrow(_summaries, ", ".join(f"{c} {'string' if c == 'file' else 'long'}" for c in _STATE)).collect():
        blocks.setdefault(r.file, []).append(r)
    begins: dict[tuple, tuple[int, int, int]] = {}
    for file, found in blocks.items():
        quoted, depth, owner = 0, 0, 0
        for r in sorted(found, key=lambda r: r.block):
            begins[file, r.block] = quoted, depth, owner
            low = depth + (r.low1 if quoted else r.low0)
            owner = owner if low > OUTER else r.block
            quoted, depth = (r.quoted1, depth + r.depth1) if quoted else (r.quoted0, depth + r.depth0)
    return _assembled(pieces.mapInArrow(_objects(begins), "file string, owner long, block long, whole boolean, text string"))


def _assembled(texts: DataFrame) -> DataFrame:
    parts = texts.where("not whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    text = texts.where("whole").select("text").unionByName(parts.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    return text.select(F.from_json("text", ELEMENT).alias("e")).select("e.*").where("type is not null")


def roads(elements: DataFrame) -> DataFrame:
    """(gid, way_id, road_type, road_name, line) of highways with at least two known nodes; null node ids and others are left out."""
    nodes = elements.where("type = 'node'").select(F.col("id").alias("node"), geo.point("lon", "lat").alias("p"))
    ways = elements.where("type = 'way'").where(F.map_contains_key("tags", "highway"))
    at = ways.select(F.col("id").alias("way_id"), F.col("tags")["highway"].alias("road_type"), F.col("tags")["name"].alias("road_name"), F.posexplode("nodes").alias("at", "node"))
    placed = at.join(nodes, "node")
    lines = placed.groupBy("way_id", "road_type", "road_name").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("_l"))
    kept = lines.withColumn("line", F.transform("_l", lambda x: x["p"])).where(F.size("line") >= 2).drop("_l")
    return surrogate_key(kept, ["way_id"])


def clip_to_box(roads: DataFrame, box: DataFrame) -> DataFrame:
    """Edges of roads(gid, line) within the one box(x1, y1, x2, y2): (gid, part, line of two points)."""
    edge = roads.select("gid", F.posexplode(geo.edges(F.col("line"))).alias("part", "e")).crossJoin(F.broadcast(box.select(F.struct("x1", "y1", "x2", "y2").alias("box"))))
    inside = edge.withColumn("t", geo.clip_edge(F.col("e.a"), F.col("e.b"), F.col("box"))).where("t is not null")
    return inside.select("gid", "part", F.array(geo.on_edge(F.col("e.a"), F.col("e.b"), F.col("t.t0")), geo.on_edge(F.col("e.a"), F.col("e.b"), F.col("t.t1"))).alias("line"))
