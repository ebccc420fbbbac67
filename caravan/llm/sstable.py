"""Token-id output as sorted-string-table shards.

A shard holds documents in ascending order of their key. File layout, integers little-endian:

    block*   zstd frame of entries: varint shared key bytes, varint other key bytes, varint value bytes, key rest, value
    index    for each block: last key (9 bytes), u64 offset, u32 length, u32 entries, u64 tokens before it in the file
    filter   u32 hash count, Bloom filter bits
    footer   u64 index offset, u64 filter offset, u64 documents, u64 tokens, u32 bytes an id, 8 bytes of magic

A key is a byte that tells null (0) from a number (1) and the number as big-endian, sign-flipped 64 bits, so that keys sort
as the numbers do, nulls first. A value is the document's ids, 2 or 4 bytes each. The first key of a block is whole. Lookup:
Bloom filter, binary search in the index, one block. Files are written under temporary names, renamed, and listed with the
token count before each in a manifest, which is renamed last.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.llm.shared import attach, commit_file, storage, text_slices
from caravan.llm.words import mix

MAGIC = b"caravSST"
BLOCK_BYTES = 64 * 1024
BITS_A_KEY, HASHES = 10, 7
FOOTER = struct.Struct("<QQQQI8s")
INDEX = struct.Struct("<9sQIIQ")
#: Parts of texts whose ids a Python worker remembers.
REMEMBERED = 300_000


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(keys: list[bytes], size: int) -> np.ndarray:
    """HASHES bit positions of each key, by double hashing."""
    numbers = np.array([int.from_bytes(k[1:], "big") + k[0] & (1 << 64) - 1 for k in keys], np.uint64)
    a, b = mix(numbers), mix(numbers ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(size)


class Writer:
    """Writes one shard from keys in ascending order."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.pack = zstandard.ZstdCompressor(level=1)
        self.at = self.tokens = self.docs = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.entries, self.last, self.before = bytearray(), 0, b"", self.tokens

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries += 1
        self.docs += 1
        self.tokens += len(value) // self.width
        self.last = key
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = self.pack.compress(bytes(self.block))
            self.sink.write(data)
            self.index.append(INDEX.pack(self.last, self.at, len(data), self.entries, self.before))
            self.at += len(data)
            self._new_block()

    def close(self) -> None:
        self._flush()
        size = max(64, BITS_A_KEY * len(self.keys) + 7 & ~7)
        bits = np.zeros(size, np.uint8)
        for i in range(0, len(self.keys), 10_000):
            bits[_bits(self.keys[i : i + 10_000], size).ravel().astype(np.int64)] = 1
        index, bloom = b"".join(self.index), struct.pack("<I", HASHES) + np.packbits(bits).tobytes()
        self.sink.write(index + bloom + FOOTER.pack(self.at, self.at + len(index), self.docs, self.tokens, self.width, MAGIC))


class Reader:
    """Looks documents up in a shard, or reads it through, a block at a time."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.index_at, self.bloom_at, self.docs, self.tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        tail = self._read(self.index_at, size - FOOTER.size - self.index_at)
        self.blocks = list(INDEX.iter_unpack(tail[: self.bloom_at - self.index_at]))
        self.bloom = np.unpackbits(np.frombuffer(tail[self.bloom_at - self.index_at + 4 :], np.uint8))
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, length, entries, _ = self.blocks[block]
        data, at, key = self.unpack.decompress(self._read(at, length)), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, tokens before it in the file, ids)."""
        for block in range(len(self.blocks)):
            before = self.blocks[block][4]
            for key, value in self._entries(block):
                ids = self._ids(value)
                yield id_of(key), before, ids
                before += len(ids)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with that doc_id."""
        key = key_of(doc_id)
        if not self.bloom[_bits([key], len(self.bloom)).astype(np.int64)].all():
            return []
        found = []
        for block in range(bisect_left(self.blocks, key, key=lambda b: b[0]), len(self.blocks)):
            for k, value in self._entries(block):
                if k == key:
                    found.append(self._ids(value))
                elif k > key:
                    return found
        return found


#: Texts of these characters alone take the short way: normalising only lower-cases them, and PART splits them as the
#: tokenizer's own pattern does. The pattern, written for these characters, and the byte alphabet's rule.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+")
PLAIN_SHAPE = [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None), ("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}), ("ByteLevel", None)]
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Parts(dict):
    """Packed ids by part of a text; the first REMEMBERED parts that come are kept."""

    def __init__(self, tokenizer, width: int):
        super().__init__()
        self.model, self.kind = tokenizer.model, f"<u{width}"

    def __missing__(self, part: str) -> bytes:
        mapped = part.encode().decode("latin-1").translate(BYTE_ALPHABET)
        packed = np.array([x.id for x in self.model.tokenize(mapped)], self.kind).tobytes()
        if len(self) < REMEMBERED:
            self[part] = packed
        return packed


@functools.lru_cache(2)
def _encoder(path: str, width: int) -> tuple:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    config = json.loads(tokenizer.to_str())
    shape = [(x["type"], x.get("pattern")) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (config[k] or {}).get(v, [])]
    known = config["model"]["type"] == "BPE" and shape == PLAIN_SHAPE
    special = [x["content"] for x in config["added_tokens"]]
    return tokenizer, special, _Parts(tokenizer, width) if known else None


def encode_texts(texts: list[str | None], path: str, width: int) -> list[bytes]:
    """Packed ids of each text, as the library's encode without special tokens gives them.

    The tokenizer never joins what its splitting separates, so the parts of a plain text go to its model one by one and the
    ids of frequent parts are remembered for as long as the worker lives. Texts with other characters or with a special
    token's string, and all texts of tokenizers of another make, go to the library whole.
    """
    tokenizer, special, parts = _encoder(path, width)
    out: list = [None] * len(texts)
    whole = []
    get = parts.__getitem__ if parts is not None else None
    for i, text in enumerate(texts):
        text = text or ""
        if get and PLAIN.fullmatch(text) and not any(x in text for x in special):
            out[i] = b"".join(map(get, PART.findall(text.lower())))
        else:
            whole.append(i)
    for i, encoded in zip(whole, tokenizer.encode_batch_fast([texts[i] or "" for i in whole], add_special_tokens=False), strict=True):
        out[i] = np.array(encoded.ids, f"<u{width}").tobytes()
    return out


def _write(folder: str, tokenizer: str, end_id: int | None, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = name = sink = first = None
        end = b"" if end_id is None else end_id.to_bytes(width, "little")
        fs, root = storage(folder)
        temporary = f"{root}/_{uuid.uuid4().hex}.tmp"
        for batch in text_slices(batches):
            ids = batch.column("doc_id").to_pylist()
            for doc_id, value in zip(ids, encode_texts(batch.column("text").to_pylist(), tokenizer, width), strict=True):
                key = key_of(doc_id)
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(temporary)
                    writer, first = Writer(sink, width), key
                writer.add(key, value + end)
        if writer is not None:
            from pyspark import TaskContext

            writer.close()
            sink.close()
            name = f"shard-{TaskContext.get().partitionId():06d}.sst"
            commit_file(fs, temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "first": [first], "docs": [writer.docs], "tokens": [writer.tokens]})

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None) -> list[dict]:
    """Encode all texts and write them to folder as shards in ascending doc_id order, nulls first; the manifest.

    docs(doc_id, text, ...); a null text counts as empty; rows that repeat a doc_id are ordered by a
    hash of their texts and may stand in several shards. An empty
    table gives an empty manifest. Each task writes one shard of a range of doc_ids; the driver sees a line for each shard.
    A task that runs again renames equal bytes to the same name. Texts of any length are coded whole.
    """
    attach(docs.sparkSession)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows of one doc_id are ranged by their texts, and those that are alike by a number, so that no id fills a task
    rows = rows.withColumns({"_text": F.xxhash64("text"), "_row": F.pmod(F.monotonically_increasing_id(), F.lit(1024))})
    placed = rows.repartitionByRange("doc_id", "_text", "_row").sortWithinPartitions("doc_id", "_text", "text").select("doc_id", "text")
    found = placed.mapInArrow(_write(folder, tokenizer, end_id, width), "name string, first binary, docs long, tokens long").collect()
    before, files = 0, []
    for x in sorted(found, key=lambda x: x["name"]):
        files.append({"path": f"{folder}/{x['name']}", "docs": x["docs"], "tokens": x["tokens"], "before": before})
        before += x["tokens"]
    fs, root = storage(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/_manifest.tmp") as out:
        out.write(json.dumps({"width": width, "files": files}).encode())
    commit_file(fs, f"{root}/_manifest.tmp", f"{root}/manifest.json")
    return files


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            held = 0
            for doc_id, start, ids in Reader(*storage(path)).scan():
                rows.append((doc_id, before + start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
                held += len(ids)
                if held > 1_000_000:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start: tokens of all documents before it, n_tokens, ids_crc32, ids packed as u32) from the listed shards."""
    attach(spark)
    fs, root = storage(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    rows = spark.createDataFrame([(x["path"], x["before"]) for x in files], "path string, before long")
    return rows.repartition(max(1, len(files))).mapInArrow(_scan, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
