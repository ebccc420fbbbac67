"""Flow layers: one for each interval, as partitioned Parquet or as GeoPackage files."""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.sources.store import read_files, replace_file

#: Fixed value: the identifier in a GeoPackage file's header.
APPLICATION = 0x47504B47
#: The tables and reference systems that the GeoPackage standard asks of every file, and the one in use.
TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id));
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL UNIQUE REFERENCES gpkg_contents(table_name), column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL REFERENCES gpkg_spatial_ref_sys(srs_id), z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL), ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]', NULL), ('WGS 84 / Pseudo-Mercator', 3857, 'EPSG', 3857, 'undefined', NULL);
"""  # fmt: skip


def write_layers(flow: DataFrame, path: str) -> None:
    """Parquet, partitioned by interval_name: a reader of one layer reads that layer alone."""
    flow.write.mode("overwrite").partitionBy("interval_name").parquet(path)


def blob(line: list[dict], srs: int = 3857) -> bytes:
    """A GeoPackage geometry: its header, then the line as WKB."""
    body = struct.pack("<BII", 1, 2, len(line)) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in line)
    return b"GP" + struct.pack("<BBi", 0, 1, srs) + body


def unblob(data: bytes) -> list[dict]:
    n = struct.unpack_from("<I", data, 13)[0]
    return [dict(zip("xy", struct.unpack_from("<dd", data, 17 + 16 * i), strict=True)) for i in range(n)]


def _write(folder: str, prefix: str = "part"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scratch = tempfile.TemporaryDirectory()  # of this task alone; it goes with the task, whatever happens
        local = os.path.join(scratch.name, f"{uuid.uuid4().hex}.gpkg")
        db, layers, n = None, set(), 0
        for batch in batches:
            if db is None:
                db = sqlite3.connect(local)
                db.execute(f"PRAGMA application_id = {APPLICATION}")
                db.executescript(TABLES)
            for x in batch.to_pylist():
                layer = f"interval_{x['interval_name']}".replace('"', "")
                if layer not in layers:
                    layers.add(layer)
                    db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, gid INTEGER, value REAL)')
                    db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, 3857)", (layer, layer))
                    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'LINESTRING', 3857, 0, 0)", (layer,))
                db.execute(f'INSERT INTO "{layer}" (geom, gid, value) VALUES (?, ?, ?)', (blob(x["line"]), x["gid"], x["value"]))
                n += 1
        if db is not None:
            db.commit()
            db.close()
            fs, root = pyarrow.fs.FileSystem.from_uri(folder)
            fs.create_dir(root, recursive=True)
            name = f"{prefix}-{TaskContext.get().partitionId():06d}.gpkg"
            pyarrow.fs.copy_files(local, f"{root}/{name}.tmp", source_filesystem=pyarrow.fs.LocalFileSystem(), destination_filesystem=fs)
            fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
            scratch.cleanup()
            yield pa.RecordBatch.from_pydict({"name": [name], "rows": [n]})

    return run


def write_geopackages(flow: DataFrame, folder: str) -> list[str]:
    """flow(gid, interval_name, value, line) as GeoPackage files, one for each task, with a layer for each interval in it.

    folder is a URI that all executors share. A task that runs again replaces its file. Repartition by rows, not by interval,
    where one interval may be large: a layer's rows may stand in several files.
    """
    rows = flow.select("gid", "interval_name", "value", "line").mapInArrow(_write(folder), "name string, rows long").collect()
    return sorted(f"{folder}/{x['name']}" for x in rows)


def overwrite_layer(flow: DataFrame, folder: str, interval_name: str, attempts: int = 2) -> list[str]:
    """Replace one layer, the rows of flow(gid, value, line), under folder and leave all others as they are; its parts.

    Parts are GeoPackage files under names of their own. They take effect with the layer's list of parts, which is replaced last, and
    the former parts go after that: a reader sees the old layer or the new one. A failed attempt is made again under new names. A
    layer without rows has no parts.
    """
    spark, key = flow.sparkSession, interval_name.encode().hex()
    rows = flow.select("gid", F.lit(interval_name).alias("interval_name"), "value", "line")
    for left in range(attempts - 1, -1, -1):
        run = uuid.uuid4().hex
        try:
            parts = sorted(x["name"] for x in rows.mapInArrow(_write(folder, f"{key}-{run}"), "name string, rows long").collect())
            break
        except Exception:
            if not left:
                raise
    before = json.loads(read_files(spark, f"{folder}/_layers").get(key, "[]"))
    replace_file(spark, f"{folder}/_layers/{key}", json.dumps(parts))
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    for name in before:
        fs.delete_file(f"{root}/{name}")
    return parts


def layer_parts(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The parts of each layer that overwrite_layer() has written, as read_geopackages() takes them."""
    return {bytes.fromhex(k).decode(): [f"{folder}/{n}" for n in json.loads(v)] for k, v in read_files(spark, f"{folder}/_layers").items()}


def read_geopackages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(gid, interval_name, value, line) of all layers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                scratch = tempfile.TemporaryDirectory()
                local = os.path.join(scratch.name, "read.gpkg")
                fs, source = pyarrow.fs.FileSystem.from_uri(path)
                pyarrow.fs.copy_files(source, local, source_filesystem=fs, destination_filesystem=pyarrow.fs.LocalFileSystem())
                db = sqlite3.connect(local)
                for (layer,) in db.execute("SELECT table_name FROM gpkg_contents").fetchall():
                    cursor = db.execute(f'SELECT gid, value, geom FROM "{layer}"')
                    while rows := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_pylist(
                            [{"gid": g, "interval_name": layer.removeprefix("interval_"), "value": v, "line": unblob(b)} for g, v, b in rows],
                            pa.schema([("gid", pa.int64()), ("interval_name", pa.string()), ("value", pa.float64()), ("line", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]),
                        )
                db.close()
                scratch.cleanup()

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, "gid long, interval_name string, value double, line array<struct<x:double,y:double>>")


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options) -> DataFrame:
    """A database table by JDBC, in parts by a numeric column where one is named; the driver jar is the caller's."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()
