"""Numpy kernels over the words of texts: splitting, 64-bit word hashes, shingle hashes."""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z and turns ASCII white space into blanks.
LOWER_WORDS = bytes(0x20 if b in SPACE else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with every other ASCII character that is no letter or digit turned into a blank as well.
ALPHANUMERIC_WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0x20 for b in range(256))

#: Bytes of a text whose words are found at once; words of more than SHORT bytes are hashed by BLAKE2.
BLOCK, SHORT = 1 << 20, 32
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text whose only separators are blanks."""
    data = np.frombuffer(text, np.uint8)
    at = []
    for i in range(0, len(data), BLOCK):  # an edge is where a byte and the one before it differ in being a blank
        solid = data[max(0, i - 1) : i + BLOCK] != 32
        at.append(np.flatnonzero(solid[1:] != solid[:-1]) + (i if i else 1))
    edges = np.concatenate([np.zeros(int(len(data) > 0 and data[0] != 32), np.int64), *at, np.full(int(len(data) > 0 and data[-1] != 32), len(data), np.int64)])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a text whose only separators are blanks.

    A word's bytes go through the hash eight at a time, each eight mixed with all before them, so different words of the same length
    up to eight bytes never share a hash and no pattern of letters makes longer ones collide. Words of more than SHORT bytes have a
    BLAKE2 digest. Texts of any length go through; blocks bound what finding the words takes besides the words themselves.
    """
    starts, ends = word_bounds(text)
    sizes = ends - starts
    hashes = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return starts, ends, hashes
    eights = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))  # the eight bytes from each position on
    left = np.flatnonzero(sizes <= SHORT)
    for i in range(0, SHORT, 8):
        if i:
            left = left[sizes[left] > i]
        if not len(left):
            break
        hashes[left] = mix(hashes[left] + (eights[starts[left] + i] & _KEEP[np.minimum(sizes[left] - i, 8)]))
    # the length tells words apart that end in zero bytes
    hashes = mix(hashes * np.uint64(0x9FB21C651E98DF25) + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > SHORT).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return starts, ends, hashes


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words, in order; of the whole sequence where it is shorter; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = mix(total * np.uint64(0x9FB21C651E98DF25) + words[i : len(words) - n + 1 + i])
    return total
