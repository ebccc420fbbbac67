"""GTFS feeds: zip archives in, text tables out."""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that the flow pipeline reads, by member.
SCHEMAS = {
    "routes.txt": "route_id string, agency_id string, route_long_name string, route_short_name string, route_type int",
    "trips.txt": "route_id string, service_id string, trip_headsign string, direction_id int, shape_id string, trip_id string",
    "shapes.txt": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
    "stops.txt": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "stop_times.txt": "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string",
    "frequencies.txt": "trip_id string, start_time string, end_time string, headway_secs int",
}


#: Bytes of a member that are parsed at once, 16 times as many after a record that is longer; no record is longer than the second.
BLOCK, LONGEST = 1 << 20, 1 << 24


def _records(member: str, wanted: list[str]):
    """The wanted columns of a member's records, as text; those that the header doesn't name are null."""

    def ragged(text: str, width: int) -> list[str | None]:
        fields = next(csv.reader(io.StringIO(text, newline="")), [])
        return [x or None for x in [*fields, *[""] * width][:width]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                archive = zipfile.ZipFile(pa.BufferReader(content.as_buffer()))  # no copy of its own
                if member not in archive.namelist():
                    continue
                with io.TextIOWrapper(archive.open(member), "utf-8-sig", newline="") as f:
                    header = [name.strip() for name in next(csv.reader(f), [])]
                places = [header.index(name) if name in header else None for name in wanted]
                columns = [str(i) for i in range(len(header))]
                if not header:
                    continue
                done, block = [0, 0], BLOCK  # records given out, of the header's number of fields and others
                while True:
                    try:
                        for at, rows in _parts(archive.open(member), columns, block, done):
                            given = [rows.column(i) for i in range(len(columns))] if at == 0 else [pa.array(c, pa.string()) for c in zip(*(ragged(x, len(columns)) for x in rows), strict=True)]
                            done[at] += len(rows)
                            if len(rows):
                                yield _chosen(given, len(rows), wanted, places)
                        break
                    except pa.ArrowInvalid as error:
                        if "straddl" not in str(error) or block >= LONGEST:
                            raise
                        block *= 16

    return run


def _parts(stream, columns: list[str], block: int, done: list[int]):
    """(0, batch of records) and (1, texts of records of another number of fields), without the first done[0] and done[1] of them."""
    odd, skip = [], list(done)

    def apart(row):
        if row.text.strip():
            odd.append(row.text)
        return "skip"

    # without threads, which would read several blocks ahead
    reader = pyarrow.csv.open_csv(
        stream, pyarrow.csv.ReadOptions(use_threads=False, block_size=block, column_names=columns, skip_rows_after_names=1),
        pyarrow.csv.ParseOptions(newlines_in_values=True, invalid_row_handler=apart),
        pyarrow.csv.ConvertOptions(column_types=dict.fromkeys(columns, pa.string()), check_utf8=False, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False),
    )

    def rest(at: int, rows):
        left, skip[at] = rows[skip[at] :], max(0, skip[at] - len(rows))
        return at, left

    for part in reader:
        yield rest(0, part)
        texts, odd[:] = list(odd), []
        yield rest(1, texts)
    yield rest(1, odd)


def _chosen(columns: list[pa.Array], n: int, wanted: list[str], places: list[int | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()) if i is None else columns[i] for i in places], wanted)


def read_member(spark: SparkSession, path: str, member: str, schema: str | None = None) -> DataFrame:
    """A table of one feed or of many (path may be a pattern); a missing member gives an empty table.

    Records are read as CSV: line ends, commas and doubled quotes within quotes belong to their field, a header may have any number
    of columns, and a record of fewer or more fields than the header loses no others. Columns are found by the header's names, in
    any order; absent ones are null. Fields that don't parse as their type are null; an unquoted empty field is null, a quoted one
    an empty text. Archives, of at most 2 GB each, are opened where they are read, a task each, and their members stream.
    """
    fields = [f.strip().split(" ") for f in (schema or SCHEMAS[member]).split(",")]
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_records(member, [name for name, _ in fields]), ", ".join(f"`{name}` string" for name, _ in fields))
    return rows.select(*(F.col(name).try_cast(kind).alias(name) for name, kind in fields))


def _pack(folder: str, member: str, header: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{member.removesuffix('.txt')}-{TaskContext.get().partitionId():06d}.zip"
        temporary = f"{root}/_{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temporary) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(member, "w", force_zip64=True) as f:
            f.write(f"{header}\n".encode())
            for batch in batches:
                f.write("".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode())
        fs.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def write_archives(df: DataFrame, member: str, folder: str) -> list[str]:
    """A table as the member of zip archives, one for each partition, with a header in each; their names. folder is a shared URI.

    Texts are quoted, with quotes doubled, so that nulls and empty texts differ. Rows stream into the archives, which get their names when finished; a task that runs again replaces its archive. Together
    the archives are the feed: read_member() takes a pattern.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    fields = [F.coalesce(quoted(c) if c in texts else F.col(c).cast("string"), F.lit("")) for c in df.columns]
    header = ",".join('"' + c.replace('"', '""') + '"' if re.search(r'[",\s]', c) else c for c in df.columns)
    lines = df.select(F.concat_ws(",", *fields).alias("line"))
    return sorted(x["name"] for x in lines.mapInArrow(_pack(folder, member, header), "name string").collect())


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a folder of CSV parts with a header, named as the feed's file."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of CSV parts with headers, read with a schema: fields that don't parse are null."""
    return spark.read.option("header", True).schema(schema).csv(path)
