"""Benchmark decontamination: q-gram lemma filter with banded alignment.

Texts and benchmark items are compared as lower-cased letters, marks and digits (by code point) with single spaces.
An item is found where any ``FRAGMENT`` characters in a row of it (bytes of UTF-8), wherever they
begin, stand with at most ``EDITS`` edits; of a shorter item, the whole with fewer. Such a place
shares at least ``FRAGMENT + 1 - Q * (EDITS + 1)`` q-grams with those characters, all within a band
of diagonals. Shared q-grams are put in overlapping bands; the begins for which enough of them lie
in the fragment are regions, and each is verified by a banded alignment of all its begins at once,
all regions of a slice side by side.

The benchmark goes to the workers in blocks of at most about ``block_bytes``, each made, sent and
let go before the next; texts are searched against one block after another. An index takes some
20 bytes for a byte of its block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from metaudit.llm.shared import saved
from metaudit.llm.texts import columns_of
from metaudit.llm.words import BASE_BYTES, LOWER, Texts, buffers, prefix, range_hash, sliced

FRAGMENT, Q, EDITS = 80, 9, 7
FILTER_BITS = 22
MOST_HITS = 2_000_000
LEAST_RANGE = 8 * FRAGMENT  # two such ranges have far fewer hits than MOST_HITS
MOST_REGIONS = 2048
MOST_BEGINS = 160  # of one region; with FRAGMENT they fit a byte
OTHER = r"[^\x00-\x7f\p{L}\p{M}\p{N}]+"
KEPT = np.zeros(256, bool)
KEPT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PLAIN = np.where(KEPT, LOWER, 0x20).astype(np.uint8)


def plain(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lower-cased letters and digits with one space for whatever lies between, and each text's offset."""
    raw, offsets = texts.data, texts.offsets
    if (raw >= 0x80).any():
        raw, offsets = folded(raw, offsets)
    data = PLAIN[raw]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[heads] = data[heads] != 0x20
    places = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    return data[keep], places[offsets]


def folded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with letters of every script in one case and a space for what is no letter, mark or digit beyond ASCII."""
    raw = np.ascontiguousarray(raw)
    column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw))
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:  # broken UTF-8
        column = pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.large_string())
    # by way of capitals, so that both forms of a letter that has two small ones are one
    return buffers(pc.replace_substring_regex(pc.utf8_lower(pc.utf8_upper(column)), OTHER, " "))


def qgrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the q-grams that lie in one text."""
    if len(data) < Q:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.arange(len(data)) + Q <= np.repeat(offsets[1:], np.diff(offsets)))
    return starts, range_hash(prefix(data, BASE_BYTES), starts, starts + Q, BASE_BYTES)


@dataclass
class Index:
    """Benchmark items as one byte string, with the places of their q-grams by hash."""

    ids: list
    data: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray
    begins: np.ndarray
    places: np.ndarray
    item: np.ndarray
    bits: np.ndarray


def index(ids: list, texts: list[str | None]) -> Index:
    """Items shorter than a q-gram cannot be found and are left out by having none."""
    parts = [plain(t) for _, _, t in sliced(pa.array(texts, pa.string()))]
    data = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint8)
    offsets, at = [np.zeros(1, np.int64)], 0
    for d, o in parts:
        offsets.append(o[1:] + at)
        at += len(d)
    offsets = np.concatenate(offsets)
    starts, hashes = qgrams(data, offsets)
    order = np.argsort(hashes, kind="stable")
    keys, begins = np.unique(hashes[order], return_index=True)
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    item = np.searchsorted(offsets, starts[order], "right") - 1
    small = np.int32 if len(data) < 1 << 31 else np.int64
    return Index(ids, data, offsets, keys, np.append(begins, len(order)).astype(small), starts[order].astype(small),
                 item.astype(small), bits)


def regions(found: Index, text: np.ndarray, place: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(text, item, band, first, last): the fragments of an item that begin from first to last have enough shared q-grams
    in a band of diagonals, from hits at ``place`` of a text and ``at`` of an item."""
    diagonal = place - at + (1 << 40)
    # bands of twice the width overlap by half
    rows = np.concatenate([np.stack([text, item, diagonal // (EDITS + 1) - shift, at], axis=1) for shift in (0, 1)])
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    rows = rows[new]
    group = np.zeros(len(rows), np.int64)
    np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(1), out=group[1:])
    length = np.diff(found.offsets)[rows[:, 1]]
    own = np.minimum(length, FRAGMENT)
    least = np.maximum(own + 1 - Q * (allowed(own) + 1), 1)
    end = np.arange(len(rows)) + least - 1  # the hit that makes them enough
    good = end < len(rows)
    good[good] = group[end[good]] == group[good]
    good[good] = rows[end[good], 3] - rows[good, 3] <= (own - Q)[good]
    end, rows, group, own, length = end[good], np.column_stack([rows[good, :3], rows[end[good], 3], rows[good, 3]]), group[good], own[good], length[good]
    first, last = np.maximum(rows[:, 3] - (own - Q), 0), np.minimum(rows[:, 4], length - own)
    head = np.ones(len(rows), bool)
    head[1:] = (group[1:] != group[:-1]) | (first[1:] > last[:-1] + own[1:])
    tail = np.append(head[1:], True)[:len(rows)]
    rows, first, last = rows[head, :3], first[head], last[tail]
    pieces = (last - first) // MOST_BEGINS + 1
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(first, pieces) + piece * MOST_BEGINS
    return np.column_stack([np.repeat(rows, pieces, axis=0), first, np.minimum(first + MOST_BEGINS - 1, np.repeat(last, pieces))])


def allowed(length: np.ndarray) -> np.ndarray:
    """Edits allowed for a fragment: EDITS for a whole one, in proportion for a shorter item, which must share a q-gram."""
    return np.minimum(EDITS * length // FRAGMENT, np.maximum(length // Q - 1, 0))


def aligned(found: Index, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a fragment of each region stands there within the edits allowed."""
    own = np.minimum(np.diff(found.offsets)[rows[:, 1]], FRAGMENT)
    most = allowed(own)
    steps = rows[:, 4] - rows[:, 3] + own
    good = np.zeros(len(rows), bool)
    for edits in np.unique(most):
        which = np.flatnonzero(most == edits)
        which = which[np.argsort(-steps[which], kind="stable")]
        for k in range(0, len(which), MOST_REGIONS):
            part = which[k:k + MOST_REGIONS]
            good[part] = within(found, data, offsets, rows[part], own[part], steps[part], int(edits))
    return good


def within(found: Index, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, own: np.ndarray, steps: np.ndarray, edits: int) -> np.ndarray:
    """Banded alignment of regions, longest first, letter of the item by letter: the most letters that an alignment that
    ends there covers, for each number of edits and each diagonal. It may begin anywhere."""
    span, n = 2 * (EDITS + 1), int(steps.max(initial=0))
    left, right = offsets[rows[:, 0]], offsets[rows[:, 0] + 1]
    at = left + rows[:, 2] * (EDITS + 1) - (1 << 40) + rows[:, 3] + np.arange(n + span)[:, None]
    source = np.where((at >= left) & (at < right), np.append(data, 0)[np.clip(at, 0, len(data))], 0)  # no letter is 0
    pattern = found.data[np.minimum(found.offsets[rows[:, 1]] + rows[:, 3] + np.arange(n)[:, None], len(found.data) - 1)]
    best = np.zeros((edits + 1, span, len(rows)), np.uint8)
    good = np.zeros(len(rows), bool)
    lives = np.searchsorted(-steps, -np.arange(n), "left")  # regions with more letters than that
    for i, live in enumerate(lives):
        more = best[:, :, :live] + np.uint8(1)
        best = more * (source[i:i + span, :live] == pattern[i, :live])
        np.maximum(best[1:], more[:-1], out=best[1:])
        np.maximum(best[1:, :-1], more[:-1, 1:], out=best[1:, :-1])
        for e in range(1, edits + 1):
            np.maximum(best[e, 1:], best[e - 1, :-1], out=best[e, 1:])
        good[:live] |= best[edits].max(axis=0) >= own[:live]
    return good


def hits(texts: Texts, found: Index) -> np.ndarray:
    """Pairs (text, item) of a slice where a fragment of the item stands in the text."""
    data, offsets = plain(texts)
    starts, keys = qgrams(data, offsets)
    maybe = np.flatnonzero(found.bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    starts, keys = starts[maybe], keys[maybe]
    at = np.minimum(np.searchsorted(found.keys, keys), max(len(found.keys) - 1, 0))
    same = found.keys[at] == keys if len(found.keys) else np.zeros(0, bool)
    starts, at = starts[same], at[same]
    low, high = found.begins[at].astype(np.int64), found.begins[at + 1].astype(np.int64)
    out = [np.zeros((0, 2), np.int64)]
    # places of a common q-gram are taken in parts: all hits of some texts, or those of a range of one text and of the items
    text = np.searchsorted(offsets, starts, "right") - 1
    for a, b in in_parts(text, high - low):
        for which, begin, end in ranges(found, starts[a:b], low[a:b], high[a:b]):
            own = end - begin
            hit = np.repeat(begin, own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            place, doc = np.repeat(starts[a:b][which], own), np.repeat(text[a:b][which], own)
            rows = regions(found, doc, place - offsets[doc], found.item[hit], found.places[hit] - found.offsets[found.item[hit]])
            out.append(rows[aligned(found, data, offsets, rows)][:, :2])
    return np.unique(np.concatenate(out), axis=0)


def in_parts(text: np.ndarray, counts: np.ndarray):
    """Ranges of hits of whole texts with about MOST_HITS places each."""
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True)) + 1 if len(text) else np.zeros(0, np.int64)
    total = np.cumsum(counts)
    a = 0
    for k, b in enumerate(ends):
        last = k + 1 == len(ends)
        if last or total[ends[k + 1] - 1] - (total[a - 1] if a else 0) > MOST_HITS:
            yield a, b
            a = b


def ranges(found: Index, starts: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Hits in parts of at most MOST_HITS: which of ``starts``, and the range of places of each.

    The items are halved, down to LEAST_RANGE bytes, then the text. Halves overlap by what one
    fragment takes up, so that all its hits are in one of them.
    """
    todo = [(np.arange(len(starts)), low, high, 0, len(found.data))]
    while todo:
        which, low, high, a, b = todo.pop()
        some = high > low
        which, low, high = which[some], low[some], high[some]
        if (high - low).sum() <= MOST_HITS or (b - a <= LEAST_RANGE and len(which) <= LEAST_RANGE):
            yield which, low, high
        elif b - a > LEAST_RANGE:
            half = (a + b) // 2
            todo.append((which, first_from(found, low, high, half), high, half, b))
            todo.append((which, low, first_from(found, low, high, half + FRAGMENT), a, half + FRAGMENT))
        else:
            half = starts[which[len(which) // 2]]
            for part in (starts[which] >= half, starts[which] < half + FRAGMENT + EDITS):
                todo.append((which[part], low[part], high[part], a, b))


def first_from(found: Index, low: np.ndarray, high: np.ndarray, place: int) -> np.ndarray:
    """In each range of places, which ascend, the first from ``place`` on."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        before = found.places[middle] < place
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]
    return low


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Index]:
    """The distinct items of the benchmark, read block by block; items go to blocks by hash."""
    items = columns_of(benchmark, item_col, text_col).distinct()
    size = items.agg(F.sum(F.octet_length(text_col)).alias("n")).collect()[0]["n"] or 0
    k = max(1, -(-size // block_bytes))
    for b in range(k):
        rows = items.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(k)) == b).collect()
        yield index([r[item_col] for r in rows], [r[text_col] for r in rows])


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Per row: the id, contaminated, n_items and item_ids (sorted) of the benchmark items found in texts of its id.

    Null or empty texts and items are found nowhere and contain nothing; so are items under nine
    letters. Rows under one id are one document; rows with a null id are taken together. Other
    columns are not read.
    """
    spark = docs.sparkSession
    source = columns_of(docs, id_col, text_col)
    schema = StructType([source.schema[id_col], StructField("item", benchmark.schema[item_col].dataType)])

    def searcher(block):
        def run(batches):
            for batch in batches:
                for i, _, texts in sliced(batch.column(1)):
                    pairs = hits(texts, block.value)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(i + pairs[:, 0])),
                         pa.array([block.value.ids[x] for x in pairs[:, 1]], schema_item)], schema.names)
        return run

    from pyspark.sql.pandas.types import to_arrow_type
    schema_item = to_arrow_type(schema["item"].dataType)
    found = None
    for block in blocks(benchmark, item_col, item_text_col, block_bytes):
        part = source.mapInArrow(searcher(spark.sparkContext.broadcast(block)), schema)
        found = part if found is None else found.unionAll(part)
    by_id = found.groupBy(id_col).agg(F.sort_array(F.collect_set("item")).alias("item_ids")).withColumnRenamed(id_col, "of")
    items = F.coalesce("item_ids", F.array().cast(by_id.schema["item_ids"].dataType))
    ids = columns_of(docs, id_col)
    return ids.join(by_id, ids[id_col].eqNullSafe(by_id["of"]), "left").select(
        id_col, (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, with all columns, in whose text no benchmark item is found."""
    from metaudit.llm.texts import rows_where

    def clean(block):
        def keep(texts):
            good = np.ones(texts.n, bool)
            good[hits(texts, block.value)[:, 0]] = False
            return good
        return keep

    spark = docs.sparkSession
    for number, block in enumerate(blocks(benchmark, item_col, item_text_col, block_bytes)):
        # written between blocks, so that a task holds one block at a time
        docs = rows_where(saved(docs) if number else docs, clean(spark.sparkContext.broadcast(block)), text_col=text_col)
    return docs
