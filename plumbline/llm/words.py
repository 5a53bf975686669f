"""Words of whole Arrow batches as 64-bit hashes, without a Python loop over words.

A text column is one byte buffer with offsets. Words are maximal runs of word
bytes inside a document, so their ends come from a byte table, and their hashes
from one prefix sum of ``value(byte) * base ** position``. All separators are
ASCII, so characters of several bytes are never cut.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 19
#: Longest word the prefix sum hashes.
SHORT = 64

_rng = np.random.default_rng(20240229)
#: A random odd value for every byte; a zero value would let a word vanish.
VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256)
LOWER[65:91] += 32
LOWER_VALUE = VALUE[LOWER]

#: Bytes of a word: anything but space and the controls 0x09-0x0D.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word once lower-cased: digits, letters, and anything beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of a line: anything but a line feed.
LINE = np.ones(256, bool)
LINE[0x0A] = False


@dataclass
class Texts:
    """UTF-8 bytes of several texts and where each begins (one more offset than texts)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Texts:
    """The buffers of a string column; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0]:offsets[-1]], offsets - offsets[0])


@dataclass
class Words:
    """Byte spans of words, and the first word of each text (one more entry than texts)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def find_words(texts: Texts, table: np.ndarray = WORD) -> Words:
    inside = table[texts.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    begins[edge] = inside[edge]
    edge = edge[edge > 0] - 1
    ends[edge] = inside[edge]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, texts.offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse for i below n, kept between calls."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE)
        with np.errstate(over="ignore"):
            up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            up[0] = down[0] = 1
            _powers = np.cumprod(up), np.cumprod(down)
    return _powers[0], _powers[1]


def hash_words(texts: Texts, words: Words, value: np.ndarray = VALUE) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands.

    A prefix sum serves words of up to ``SHORT`` bytes, slice by slice, so a long
    text costs a fixed amount of memory. A polynomial modulo 2 ** 64 has words of a
    thousand letters that collide whatever its values are, so longer words go
    through a cryptographic hash, one by one.
    """
    out = np.zeros(len(words.start), np.uint64)
    up, down = powers(SLICE)
    size = words.end - words.start
    with np.errstate(over="ignore"):
        i, n = 0, len(out)
        while i < n:
            base = words.start[i]
            j = int(np.searchsorted(words.end, base + SLICE - 1, "right"))
            if j <= i:
                i += 1
                continue
            s, e = words.start[i:j] - base, words.end[i:j] - base
            prefix = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(value[texts.data[base:base + e[-1]]] * up[:e[-1]], out=prefix[1:])
            out[i:j] = (prefix[e] - prefix[s]) * down[s]
            i = j
        out = mix(out)
    long = np.flatnonzero(size > SHORT)
    folded = LOWER.astype(np.uint8) if value is LOWER_VALUE else None
    for w, s, e in zip(long.tolist(), words.start[long].tolist(), words.end[long].tolist()):
        raw = texts.data[s:e] if folded is None else folded[texts.data[s:e]]
        out[w] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return out


def windows(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * np.uint64(BASE) + hashes[k:k + n]
        total = mix(total + np.uint64(size))
    last = words.first[1:][words.owner()[:n]] if n else np.zeros(0, np.int64)
    whole = np.arange(n) + size <= last
    return total[whole], np.flatnonzero(whole)


def salted(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes made different from text to text, for counting inside each of many texts at once."""
    with np.errstate(over="ignore"):
        return mix(hashes + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over the rows of each text."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[first[1:]] - run[first[:-1]]
