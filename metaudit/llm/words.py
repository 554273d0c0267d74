"""Words, lines and rolling hashes of many texts at once, in numpy over Arrow buffers.

The separators (space and U+0009 to U+000D) are single bytes in UTF-8, so texts are cut on
bytes. Hashes are 64-bit polynomials: with prefix sums over ``x[i] * B**i`` the hash of any
range is one subtraction and one product with the inverse power, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
HEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point

SLICE_BYTES = 1 << 19  # texts are worked on in slices of this size; a longer text is a slice of its own
BASE_BYTES, BASE_WORDS = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF93
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n > 2 * SLICE_BYTES:  # a rare very long text does not stay in memory
            return known
        _POWERS[base] = known
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, powers(base, len(values)), out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], from their prefix sums; equal content and length, equal hash."""
    back = powers(inverse(base), len(sums))
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * back[start] + length * np.uint64(0xA24BAED4963EE407))


@dataclass
class Texts:
    """Some texts as bytes, and their words. ``first[d]:first[d + 1]`` are the words of text d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of byte values or flags over each text."""
        return totals(flags, self.offsets)

    def word_hashes(self) -> np.ndarray:
        return range_hash(prefix(self.data, BASE_BYTES), self.starts, self.ends, BASE_BYTES)


def totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def cut(data: np.ndarray, offsets: np.ndarray) -> Texts:
    inside = ~SEPARATOR[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        heads = offsets[:-1][(offsets[:-1] < offsets[1:])]
        begins[heads] = inside[heads]
        tails = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
        ends[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return Texts(data, offsets, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def sliced(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """The texts of a column in slices of about ``limit`` bytes: first row, end row, words."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        part = data[offsets[i]:offsets[j]]
        yield i, j, cut(LOWER[part] if lower else part, offsets[i:j + 1] - offsets[i])
        i = j


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of every run of n words that lies in one text."""
    lengths = np.diff(first)
    starts = np.arange(len(hashes))[np.arange(len(hashes)) + n <= np.repeat(first[1:], lengths)]
    return starts, range_hash(prefix(hashes, BASE_WORDS), starts, starts + n, BASE_WORDS)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it stands at two places or more, and whether it stood before."""
    n = len(keys)
    many, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        later[order[1:]] = same
        many[order[1:]] = same
        many[order[:-1]] |= same
    return many, later


def in_text(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ between texts."""
    return mix(keys + mix(doc.astype(np.uint64) + np.uint64(1)))


def covered(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Which of n places lie in one of the runs."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def crc32_mod(column: str, modulus: int) -> str:
    """SQL for crc32 of an id as text, modulo."""
    return f"crc32(CAST({column} AS STRING)) % {modulus}"
