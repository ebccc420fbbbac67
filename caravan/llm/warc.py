"""Deterministic sharded WARC output.

Records are range-sorted by page id. Counts of bytes by ranges of ids, refined where one holds too much, give exact cut points, so
the parts depend on the rows alone and not on how they lie in files or tasks. A task writes the records of its parts into files
that roll over at a compressed size, each record a gzip member of its own with headers and digests made anew. Files have temporary
names until they are finished; a manifest, renamed last, lists those that count. Equal input and settings give equal bytes.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.llm.shared import attach, commit_file, discard, materialize, storage, text_slices

FILE_BYTES = 256_000_000
#: Equal payloads below this size are all written out.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 20
#: Payload bytes of a part: this share of all, within these bounds.
SHARE, LEAST, MOST = 512, 8_000_000, 1_000_000_000
#: Ranges of ids counted at once, as powers of two: in all, and of one that holds too much.
RANGES, REFINED = 12, 8


def _uri(page_id: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    """The id of a record: rows alike in page id, url and payload are told apart by number."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps([page_id, url, digest, copy]))}>"


def _clean(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: tuple[int, str | None] | None = None, copy: int = 0) -> bytes:
    """One record: a response with its payload, or a revisit with the headers alone. refers_to: page id and url."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id, url, digest, copy)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_clean(url)}"] if url and _clean(url) else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(*refers_to, digest)}", f"X-Refers-To-Page: {refers_to[0]}"]
    lines += ["X-Page: " + ("" if page_id is None else str(page_id)), "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """Rolling files of one task."""

    def __init__(self, folder: str, part: int, limit: int):
        self.fs, self.root = storage(folder)
        self.part, self.limit, self.number, self.sink, self.done = part, limit, 0, None, []

    def add(self, data: bytes) -> None:
        if self.sink is None:
            self.fs.create_dir(self.root, recursive=True)
            self.temporary = f"{self.root}/_{uuid.uuid4().hex}.tmp"
            self.sink, self.size, self.records, self.hash = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        packed = _member(data)
        self.sink.write(packed)
        self.hash.update(packed)
        self.size += len(packed)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            name = f"part-{self.part:06d}-{self.number:04d}.warc.gz"
            commit_file(self.fs, self.temporary, f"{self.root}/{name}")
            self.done.append((name, self.records, self.size, self.hash.hexdigest()))
            self.number, self.sink = self.number + 1, None


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done = None, []
        pending: dict[str, tuple[int, str | None]] = {}  # references of the page id at hand, by digest
        at: object = run
        last, copy = None, 0
        for batch in text_slices(batches, column="html"):
            for x in batch.to_pylist():
                if files is None or x["part"] != files.part:
                    if files:
                        files.close()
                        done += files.done
                    files, at = _Files(folder, x["part"], limit), run
                if at is run or x["page_id"] != at:
                    at, pending, last = x["page_id"], {}, None
                if x["kind"] == 0:
                    pending[x["digest"]] = x["refers_to"], x["url"]
                    continue
                payload = (x["html"] or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                copy = copy + 1 if last == (x["url"], digest) else 0
                last = x["url"], digest
                files.add(record(x["page_id"], x["url"], payload, digest, len(payload), pending.get(digest), copy))
        if files:
            files.close()
            done += files.done
        columns = list(zip(*done, strict=True)) or [(), (), (), ()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "records", "bytes", "sha256"])

    return run


#: Stands for a null page id, which sorts first.
NO_ID = -(2**63)


def _key() -> Column:
    return F.coalesce("page_id", F.lit(NO_ID))


def _counted(sizes: DataFrame, limit: int) -> list[tuple[int, int, int]]:
    """(shift, prefix, bytes) of ranges of ids, in order: those whose bits above shift are prefix. sizes(page_id, bytes).

    A range of more than limit bytes is counted again by ranges within it, until it is one id. What comes to the driver is
    bounded by the number of parts, whatever the ids are.
    """
    ends = sizes.agg(F.min(_key()).alias("lo"), F.max(_key()).alias("hi")).first()
    if ends["lo"] is None:
        return []
    shift = max(0, max((ends["hi"] ^ ends["lo"]).bit_length(), 1) - RANGES) if (ends["hi"] < 0) == (ends["lo"] < 0) else 64 - RANGES
    leaves, wanted = [], None
    while wanted is None or wanted:
        rows = sizes.select(F.shiftright(_key(), shift).alias("prefix"), _key().alias("key"), "bytes")
        if wanted is not None:
            above = sizes.sparkSession.createDataFrame([(p,) for p in wanted], "above long")
            rows = rows.join(F.broadcast(above), F.shiftright("key", was) == F.col("above"))
        found = [(x["prefix"], x["b"]) for x in rows.groupBy("prefix").agg(F.sum("bytes").alias("b")).collect()]
        leaves += [(shift, p, b) for p, b in found if b <= limit or not shift]
        wanted = [p for p, b in found if b > limit] if shift else []
        was, shift = shift, max(0, shift - REFINED)
    return sorted(leaves, key=lambda x: x[1] << x[0])


def _parts(leaves: list[tuple[int, int, int]], limit: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((shift, prefix, part, ways), number of parts): consecutive ranges up to limit bytes; one id of more goes to several parts."""
    out, part, held = [], 0, 0
    for shift, prefix, size in leaves:
        if held and held + size > limit:
            part, held = part + 1, 0
        ways = max(1, math.ceil(size / limit)) if not shift else 1
        out.append((shift, prefix, part, ways))
        held += size
        if ways > 1:
            part, held = part + ways, 0
    return out, part + 1


def _placed(rows: DataFrame, parts: list[tuple[int, int, int, int]]) -> DataFrame:
    """rows with their part: one broadcast of ranges for each width of range."""
    spread, out = F.xxhash64("spread"), rows.withColumn("part", F.lit(None).cast("long"))
    for shift in sorted({x[0] for x in parts}, reverse=True):
        here = rows.sparkSession.createDataFrame([x[1:] for x in parts if x[0] == shift], "_prefix long, _part long, _ways long")
        out = out.join(F.broadcast(here), F.shiftright(_key(), shift) == F.col("_prefix"), "left")
        out = out.withColumn("part", F.coalesce("part", F.col("_part") + F.pmod(spread, F.col("_ways")))).drop("_prefix", "_part", "_ways")
    return out


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, revisit_bytes: int = REVISIT_BYTES, part_bytes: int | None = None) -> list[dict]:
    """Write pages(page_id, url, html, ...) as WARC files to folder; the manifest's file list.

    Of records with equal payloads of at least revisit_bytes the one with the smallest page_id is a response and the others
    revisit it; smaller payloads are all responses. A null html is an empty payload; a null url leaves the header out; a null
    page_id never counts as smallest unless it is alone, and such records are all responses. Rows that repeat page_id and
    payload are responses too. Every record has an id of its own. A page of any length is one record, which a task holds whole.
    An empty table gives no file.

    Payloads are shuffled once, by part. References are found on digests alone and travel as rows of their own that sort
    before the page they are for, so a group of copies of any size stays spread over the tasks.
    """
    attach(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digests = materialize(rows.select("page_id", "url", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest")), "digests")
    large = digests.where((F.col("bytes") >= revisit_bytes) & F.col("page_id").isNotNull())
    first = materialize(large.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("to"), F.count("*").alias("n")).where("n > 1").select("digest", "to"), "first")
    revisits = large.select("page_id", "digest").join(first, "digest").where("page_id <> to.page_id").distinct()
    total = digests.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    limit = part_bytes or min(MOST, max(LEAST, total // SHARE))
    parts, number = _parts(_counted(digests.select("page_id", (F.col("bytes") + 500).alias("bytes")), limit), limit)
    nothing = lambda kind: F.lit(None).cast(kind)
    # the parts of an id that goes to several are told by the payload, which references know by its digest
    references = revisits.select("page_id", F.lit(0).alias("kind"), F.col("to.url").alias("url"), nothing("string").alias("html"), "digest", F.col("to.page_id").alias("refers_to"), F.col("digest").alias("spread"))
    hot = any(x[3] > 1 for x in parts)
    records = rows.select("page_id", F.lit(1).alias("kind"), "url", "html", nothing("string").alias("digest"), nothing("long").alias("refers_to"), (F.sha2("html", 256) if hot else nothing("string")).alias("spread"))
    placed = _placed(records.unionByName(references), parts).drop("spread").repartition(number, "part").sortWithinPartitions("part", "page_id", "kind", "url", "html", "digest")
    found = placed.mapInArrow(_write(folder, file_bytes), "name string, records long, bytes long, sha256 string").collect()
    files = [x.asDict() for x in sorted(found, key=lambda x: x["name"])]
    fs, root = storage(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/_manifest.tmp") as out:
        out.write(json.dumps(files).encode())
    commit_file(fs, f"{root}/_manifest.tmp", f"{root}/manifest.json")
    for x in fs.get_file_info(pyarrow.fs.FileSelector(root)):  # what failed attempts left
        if x.base_name.startswith("_") and x.base_name.endswith(".tmp"):
            fs.delete_file(x.path)
    discard(digests, first)
    return files


def read_members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    data = stream.read(READ)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data if unpacker.eof else stream.read(READ)
        yield b"".join(parts)
        data = data or stream.read(READ)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record, its digests checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*found, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, name = storage(path)
            found, held = [], 0
            with fs.open_input_stream(name, compression=None) as stream:
                for data in read_members(stream):
                    fields, http, payload = parse(data)
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
                    found.append((int(fields["X-Page"]) if fields["X-Page"] else None, fields.get("WARC-Target-URI"), fields["WARC-Type"], int(http["Content-Length"]), digest, int(fields["X-Refers-To-Page"]) if revisit else None, None if revisit else payload))
                    held += len(payload)
                    if held > 4_000_000:
                        yield rows(found)
                        found, held = [], 0
            if found:
                yield rows(found)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload: null for revisits) of the listed files."""
    attach(spark)
    fs, root = storage(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        files = json.loads(f.read())
    rows = spark.createDataFrame([(f"{folder}/{x['name']}",) for x in files], "path string")
    return rows.repartition(max(1, len(files))).mapInArrow(_scan, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
