"""SentencePiece encoding that keeps, for every piece, its bytes in the source text.

The text is normalised as the model says: the longest prefix that the compiled character map knows is replaced, white space
is trimmed, joined, escaped and prefixed, and for every normalised byte the source byte it came from is recorded. The
library encodes; piece lengths then walk through the normalised bytes and the record projects them to the source.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.llm.shared import attach, text_slices

MARK = "▁".encode()


class CharacterMap:
    """The compiled map: u32 size, double-array trie of that size, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest_prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that data has at a place."""
        units, found = self.units, None
        if not units:
            return None

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 1 << 9) >> 6)

        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & (1 << 31 | 0xFF) != data[i]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                value = units[node] & (1 << 31) - 1
                found = i + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)]
        return found


    def unmapped(self) -> bytes:
        """Printable ASCII characters that no entry begins with, unless a character beyond ASCII follows."""
        return bytes(b for b in range(0x20, 0x7F) if not any(self.longest_prefix(bytes([b, c]), 0) for c in range(0x80)))


class Normalizer:
    """What a model does to a text before it is cut, with the source of every byte. symbols are exempt from the map."""

    def __init__(self, charsmap: bytes, add_dummy_prefix: bool, remove_extra_whitespaces: bool, escape_whitespaces: bool, suffix: bool = False, symbols: tuple[bytes, ...] = ()):
        self.map = CharacterMap(charsmap)
        self.symbols = re.compile(b"|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None
        plain = self.map.unmapped() if self.map.units and not symbols else b""
        # runs that the map leaves as they are: a character before one beyond ASCII may combine with it
        self.plain = re.compile(b"[" + re.escape(plain) + b"]+(?![\\x80-\\xff])") if plain else None
        self.prefix, self.trim, self.escape, self.suffix = add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces, suffix

    def _mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Replaced bytes and the start and end of the source of each."""
        if not self.map.units:
            at = np.arange(len(data), dtype=np.int32)
            return np.frombuffer(data, np.uint8), at, at + np.int32(1)
        out, begins, ends, at = bytearray(), [], [], 0
        while at < len(data):
            if self.plain and (run := self.plain.match(data, at)):
                out += run[0]
                begins += range(at, run.end())
                ends += range(at + 1, run.end() + 1)
                at = run.end()
                continue
            symbol = self.symbols and self.symbols.match(data, at)
            found = None if symbol else self.map.longest_prefix(data, at)
            if symbol:
                n, new = len(symbol[0]), symbol[0]
            elif found:
                n, new = found
            else:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                new = data[at : at + n]
            out += new
            begins += [at] * len(new)
            ends += [at + n] * len(new)
            at += n
        return np.frombuffer(bytes(out), np.uint8), np.array(begins, np.int32), np.array(ends, np.int32)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them, and for their end, where its source begins."""
        data = text.encode("utf-8")
        chars, begins, ends = self._mapped(data)
        if self.trim:
            blank = chars == 32
            keep = ~blank | np.r_[False, ~blank[:-1]]
            solid = np.flatnonzero(~blank)
            keep[: solid[0] if len(solid) else None] = False
            keep[solid[-1] + 1 if len(solid) else 0 :] = False
            chars, begins, ends = chars[keep], begins[keep], ends[keep]
        if not len(chars):
            return b"", np.zeros(1, np.int32)
        if self.prefix:
            one = np.array([32], np.uint8)
            if self.suffix:
                chars, begins, ends = np.r_[chars, one], np.r_[begins, ends[-1:]], np.r_[ends, ends[-1:]]
            else:
                chars, begins, ends = np.r_[one, chars], np.r_[begins[:1], begins], np.r_[begins[:1], ends]
        bounds = np.r_[begins, ends[-1:]]
        if not self.escape:
            return chars.tobytes(), bounds
        repeat = np.where(chars == 32, len(MARK), 1)
        return chars.tobytes().replace(b" ", MARK), np.r_[np.repeat(begins, repeat), ends[-1:]]


class Encoder:
    """A model with what is needed for offsets."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        proto = sentencepiece_model_pb2.ModelProto.FromString(blob)
        spec = proto.normalizer_spec
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        symbols = tuple(p.piece.encode() for p in proto.pieces if p.type == kind.USER_DEFINED)
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix, symbols)
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN), -1)
        self.lengths = np.array([0 if p.type == kind.CONTROL else 1 if p.type == kind.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int32)

    def encode(self, texts: list[str], begin: bool, end: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
        """Ids; n + 1 source byte bounds, piece i being [bounds[i], bounds[i + 1]); decoded texts."""
        coded = self.model.encode(texts, add_bos=begin, add_eos=end, num_threads=1)
        decoded = self.model.decode(coded, num_threads=1)
        ids = [np.array(x, np.uint32) for x in coded]
        return ids, [self._bounds(t, i) for t, i in zip(texts, ids, strict=True)], decoded

    def _bounds(self, text: str, ids: np.ndarray) -> np.ndarray:
        normal, source = self.normalize(text)
        lengths = self.lengths[ids]
        if (ids == self.unknown).any():  # an unknown piece is as long as the characters it stands for
            pieces = self.model.encode(text, out_type=str)
            inner = np.flatnonzero(self.model_text_pieces(ids))
            lengths[inner] = [1 if i != self.unknown and self.lengths[i] == 1 else len(p.encode()) for p, i in zip(pieces, ids[inner], strict=True)]
        ends = np.cumsum(np.r_[0, lengths])
        if ends[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return source[ends]

    def model_text_pieces(self, ids: np.ndarray) -> np.ndarray:
        return (self.lengths[ids] > 0) | (ids == self.unknown)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _run(path: str, begin: bool, end: bool, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in text_slices(batches, 1_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, bounds, decoded = tool.encode(texts, begin, end)
            packed = lambda arrays, kind: pa.array([a.astype(kind).tobytes() for a in arrays], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(first)), pa.array(list(map(len, ids)), pa.int64()), packed(ids, "<u4"), packed(bounds, "<i4"), pa.array(decoded, pa.string())],
                [*batch.schema.names[:first], "n_tokens", "ids", "bounds", "decoded"],
            )

    return run


def encode_with_offsets(docs: DataFrame, model: str, begin: bool = True, end: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) with (n_tokens, ids: packed u32, bounds: packed i32, decoded), other columns unchanged.

    bounds has one number more than ids: piece i comes from the source bytes [bounds[i], bounds[i + 1]) of the UTF-8 text;
    control pieces are empty. A null text counts as empty; an empty one has the begin and end ids alone. Rows are neither
    moved nor merged; former columns of the new names are replaced; an empty table gives an empty result. A text is coded whole.
    """
    attach(docs.sparkSession)
    rows = docs.drop("n_tokens", "ids", "bounds", "decoded").withColumn("text", F.col("text").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_run(model, begin, end, len(rows.columns)), f"{fields}, n_tokens long, ids binary, bounds binary, decoded string")
