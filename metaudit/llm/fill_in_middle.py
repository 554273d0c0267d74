"""Fill-in-middle transformation with memoized content-defined chunks.

A rolling hash over the last 32 bytes ends chunks where its top bits are zero, so equal stretches of
different texts fall into equal chunks. What a chunk adds is kept in a bounded cache under its whole
content (a hit compares all bytes): its code points, and whether a sentinel lies in it. Sums of the
chunk counts give the length of a text and the chunk in which a cut lies; only that chunk is looked
into. A sentinel that spans chunks is found on the few bytes at their border.

Cuts and forms come from hashes of the id, so a recomputed task writes the same rows. One pass, no
shuffle; rows stay one to one. Null texts count as empty; an empty text is plain. A null id hashes as
the empty string, and repeated ids get equal fractions but cuts by their own text. A text is held
about four times (bytes, Arrow column, output and its column); hashes are made 1 MB at a time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metaudit.llm.words import HEAD, SLICE_BYTES, buffers, mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
BORDER = max(map(len, SENTINELS)) - 1

GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32)
REACH = 32  # bytes that the rolling hash looks back on
LEAST, MOST, TOP_BITS = 64, 8192, 10  # chunk bytes; a chunk ends once in 2**TOP_BITS bytes on average
HASH_BLOCK = 1 << 20
CACHE_BYTES = 16 << 20


def chunk_marks(data: np.ndarray) -> list[int]:
    """Places after which the rolling hash lets a chunk end."""
    found = []
    for at in range(0, len(data), HASH_BLOCK):
        begin = max(at - REACH + 1, 0)
        rolled = GEAR[data[begin:at + HASH_BLOCK]]
        for step in (1, 2, 4, 8, 16):  # sum of GEAR << distance over the last 32 bytes, by doubling
            rolled[step:] += rolled[:-step] << np.uint32(step)
        ends = np.flatnonzero(rolled >> np.uint32(32 - TOP_BITS) == 0) + begin + 1
        found.append(ends[ends > at])
    return np.concatenate(found).tolist() if found else []


def chunk_ends(marks: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of one text; they depend on nothing outside it, as LEAST exceeds REACH."""
    ends = []
    while start < end:
        place = bisect_left(marks, start + LEAST)
        stop = min(marks[place] if place < len(marks) else end, start + MOST, end)
        ends.append(stop)
        start = stop
    return ends


@dataclass
class ChunkCache:
    """Code points and sentinels of chunks, by content; emptied when it holds CACHE_BYTES."""

    known: dict[bytes, tuple[int, bool]] = field(default_factory=dict)
    held: int = 0

    def summary(self, chunk: bytes) -> tuple[int, bool]:
        found = self.known.get(chunk)
        if found is None:
            points = int(np.count_nonzero(HEAD[np.frombuffer(chunk, np.uint8)]))
            found = points, any(s in chunk for s in SENTINELS)
            if self.held > CACHE_BYTES:
                self.known.clear()
                self.held = 0
            self.known[chunk] = found
            self.held += len(chunk)
        return found


@dataclass
class Chunked:
    """A text by its chunks: byte and code point counts before each chunk, and whether a sentinel stands in it."""

    text: bytes
    byte_sums: list[int]
    point_sums: list[int]
    marked: bool

    @property
    def n(self) -> int:
        return self.point_sums[-1]

    def byte_at(self, point: int) -> int:
        """Byte place of a code point (of the end, for the number of code points)."""
        if point >= self.n:
            return len(self.text)
        chunk = bisect_right(self.point_sums, point) - 1
        first, last = self.byte_sums[chunk], self.byte_sums[chunk + 1]
        inside = point - self.point_sums[chunk]
        if self.point_sums[chunk + 1] - self.point_sums[chunk] == last - first:
            return first + inside
        return first + int(np.flatnonzero(HEAD[np.frombuffer(self.text, np.uint8, last - first, first)])[inside])


def chunked(text: bytes, ends: list[int], cache: ChunkCache) -> Chunked:
    counts, marked, start, tail = [], False, 0, b""
    for end in ends:
        chunk = text[start:end]
        points, has = cache.summary(chunk)
        border = tail + chunk[:BORDER]
        marked = marked or has or any(s in border for s in SENTINELS)
        tail = (tail + chunk[-BORDER:])[-BORDER:]
        counts.append(points)
        start = end
    return Chunked(text, [0, *ends], [0, *accumulate(counts)], marked)


def digest_words(seed: int, id_col: str) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """Per row: the id, n (code points), form, prefix_chars, middle_chars and output.

    ``form`` is plain (the text as it is: empty, with a sentinel in it, or not among ``fim_percent``),
    psm (prefix, suffix, middle) or spm (suffix, prefix, middle; ``spm_percent`` of the others). The
    counts are null for plain rows. Other columns are left out, whatever their names.
    """
    texts = docs.select(docs[id_col], docs[text_col])
    source = texts.select(F.col(id_col), *digest_words(seed, id_col), F.col(text_col))
    schema = StructType([source.schema[id_col], *StructType.fromDDL(
        "n long, form string, prefix_chars long, middle_chars long, output string").fields])

    def run(batches):
        cache = ChunkCache()
        for batch in batches:
            data, offsets = buffers(batch.column(5))
            hashes = [batch.column(i).to_numpy() for i in range(1, 5)]
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
                part, places = data[offsets[i]:offsets[j]], (offsets[i:j + 1] - offsets[i]).tolist()
                marks = chunk_marks(part)
                rows = [transformed(part[a:b].tobytes(), [e - a for e in chunk_ends(marks, a, b)], cache,
                                    *(int(h[i + d]) for h in hashes), fim_percent, spm_percent)
                        for d, (a, b) in enumerate(zip(places, places[1:]))]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(output, pa.binary()).cast(pa.string())], schema.names)
                i = j

    return source.mapInArrow(run, schema)


def transformed(raw: bytes, ends: list[int], cache: ChunkCache, h1: int, h2: int, h3: int, h4: int,
                fim_percent: int, spm_percent: int) -> tuple:
    text = chunked(raw, ends, cache)
    if not raw or text.marked or h3 % 100 >= fim_percent:
        return text.n, "plain", None, None, raw
    first, second = sorted((h1 % (text.n + 1), h2 % (text.n + 1)))
    a, b = text.byte_at(first), text.byte_at(second)
    p, s, m = SENTINELS
    if h4 % 100 < spm_percent:
        return text.n, "spm", first, second - first, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    return text.n, "psm", first, second - first, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No sentinel stands in a transformed text, so the first is the mark."""

    def parts(value, opening, inner):
        rest = F.substring_index(value, inner, -1)
        return (F.substr(F.substring_index(value, inner, 1), F.lit(len(opening) + 1)),
                F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1))

    prefix, suffix, middle = parts(output, PREFIX, SUFFIX)
    last, first, between = parts(output, SUFFIX, PREFIX)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(first, between, last)).otherwise(output))
