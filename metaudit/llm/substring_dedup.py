"""Substring dedup by a relative Lempel-Ziv parse over phrases that the content itself cuts.

The lowest hash among the n-grams of a window is its anchor, so equal windows have equal anchors at
equal places, wherever they stand. Consecutive windows with one anchor make a phrase. The reference is
the table of all phrases under anchor and phrase hash, each with its first place; its blocks are the
partitions by anchor, and each phrase is looked up in the one block that can hold it. So a document need
not be sent to every block of reference text, which would read all texts once for each block.

Phrases of a document that stand earlier follow one another like their references do as long as the
documents agree, and make one factor (start, words, reference). Where anchors agree but phrases differ,
at the ends of factors, the windows are checked one by one, so factors end at the exact word; repeats
within a text are factors that refer to the text itself. Overlapping factors are parsed greedily from
the left, each time the one that reaches farthest. Only factors of ``window`` words or more exist, and
what they cover goes. What goes is defined by windows, so it is the same whatever the factors.

Data sent: one row per phrase (one for seven words or so), the rows of shared anchors again,
the texts once for both the boundary check and the cut, and the windows at boundaries. Rows of
a frequent phrase are pre-aggregated or joined with skew splitting; no group is collected but
the spans of one document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from metaudit.llm.shared import saved
from metaudit.llm.words import Texts, covered, grams, in_text, mix, prefix, range_hash, repeated, sliced

BASE_PHRASE = 0x2545F4914F6CDD1D


@dataclass
class Phrases:
    """Phrases of some texts: anchor hash, phrase hash, first window and number of windows; and the windows' anchors."""

    anchor: np.ndarray
    phrase: np.ndarray
    start: np.ndarray
    windows: np.ndarray


def phrases(texts: Texts, hashes: np.ndarray, window: int, gram: int) -> Phrases:
    starts, keys = grams(hashes, texts.first, gram)
    value = np.full(len(hashes) + window, np.iinfo(np.uint64).max, np.uint64)
    value[starts] = keys
    lengths = np.diff(texts.first)
    whole = np.arange(len(hashes))[np.arange(len(hashes)) + window <= np.repeat(texts.first[1:], lengths)]
    # leftmost lowest of the window's n-grams, by doubling
    span, width = window - gram + 1, 1
    lowest = np.arange(len(hashes) + window)
    while width < span:
        step = min(width, span - width)
        other = lowest[step:]
        kept = lowest[:len(other)]
        lowest = np.where(value[kept] <= value[other], kept, other)
        width += step
    at = lowest[whole]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(whole) != 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    first, anchor = whole[head], at[head]
    sums = prefix(hashes, BASE_PHRASE)
    text = range_hash(sums, first, first + count + window - 1, BASE_PHRASE)
    return Phrases(value[anchor], mix(text + (anchor - first).astype(np.uint64)), first, count)


def phrase_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Each text's phrases, the first of equal ones; ``key`` tells texts under one id apart."""
    schema = StructType([StructField("id", docs.schema["id"].dataType),
                         *StructType.fromDDL("key long, anchor long, phrase long, at long, n int").fields])

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for i, _, texts in sliced(batch.column(2)):
                found = phrases(texts, texts.word_hashes(), window, gram)
                doc = np.searchsorted(texts.first, found.start, "right") - 1
                _, later = repeated(in_text(found.phrase ^ found.anchor, doc))
                own = np.flatnonzero(~later)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i + doc[own])), keys.take(pa.array(i + doc[own])),
                     pa.array(found.anchor[own].view(np.int64)),
                     pa.array(found.phrase[own].view(np.int64)), pa.array(found.start[own] - texts.first[doc[own]]),
                     pa.array(found.windows[own].astype(np.int32))], schema.names)

    return docs.mapInArrow(run, schema)


def spans_of(batch: pa.RecordBatch, name: str, i: int, j: int) -> tuple[np.ndarray, pa.StructArray]:
    """Row (from i) of each span of rows i to j, and the spans."""
    lists = batch.column(name).slice(i, j - i).fill_null([])
    return np.repeat(np.arange(j - i), np.diff(np.asarray(lists.offsets))), lists.flatten()


def boundary_windows(docs: DataFrame, window: int) -> DataFrame:
    """Hashes of the windows named by each row's spans, the first of equal ones in a text."""
    schema = StructType([StructField("id", docs.schema["id"].dataType),
                         *StructType.fromDDL("key long, w0 long, w1 long, at long").fields])

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("id"), batch.column("key")
            for i, j, texts in sliced(batch.column("text")):
                row, spans = spans_of(batch, "spans", i, j)
                if not len(row):
                    continue
                at, n = np.asarray(spans.field("at")), np.asarray(spans.field("n"))
                starts = np.repeat(texts.first[row] + at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                order = np.argsort(starts)
                starts, row = starts[order], row[order]
                hashes = texts.word_hashes()
                w0 = range_hash(prefix(hashes, BASE_PHRASE), starts, starts + window, BASE_PHRASE)
                w1 = range_hash(prefix(mix(hashes), 0xDA942042E4DD58B5), starts, starts + window, 0xDA942042E4DD58B5)
                own = np.flatnonzero(~repeated(in_text(w0, row))[1])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i + row[own])), keys.take(pa.array(i + row[own])),
                     pa.array(w0[own].view(np.int64)), pa.array(w1[own].view(np.int64)),
                     pa.array(starts[own] - texts.first[row[own]])], schema.names)

    return docs.mapInArrow(run, schema)


def first_places(keys: np.ndarray) -> np.ndarray:
    """For each key the place where it stands first."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return first[back]


def parsed(at: np.ndarray, n: np.ndarray, ref: np.ndarray, ref_at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy parse of one text, given runs of n windows from ``at`` on and where these stand earlier.

    Runs that go on in one reference are joined; then from the left, each time the joined run that reaches
    farthest. Factors as (start, windows, place of a run that tells the reference, start in the reference).
    """
    order = np.lexsort((at, ref_at - at, ref))
    at, end, ref, shift = at[order], (at + n)[order], ref[order], (ref_at - at)[order]
    new = np.concatenate([[True], (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] > end[:-1])])
    head = np.flatnonzero(new)
    low, high, place, shift = at[head], np.maximum.reduceat(end, head), order[head], shift[head]
    by_start = np.argsort(low, kind="stable")
    low, high, place, shift = (x[by_start].tolist() for x in (low, high, place, shift))
    factors, reached, i = [], -1, 0
    while i < len(low):
        if high[i] <= reached:
            i += 1
            continue
        start = max(low[i], reached)
        best = i
        while i < len(low) and low[i] <= start:
            if high[i] > high[best]:
                best = i
            i += 1
        factors.append((start, high[best] - start, place[best], start + shift[best]))
        reached = high[best]
    return factors


def without(texts: Texts, d: int, gone: np.ndarray) -> bytes:
    """Text d without the marked words: kept runs as they are, a line break or a space where words are gone."""
    a, b = texts.first[d], texts.first[d + 1]
    edge = np.diff(np.concatenate([[True], gone[a:b], [True]]).astype(np.int8))
    heads, tails = a + np.flatnonzero(edge == -1), a + np.flatnonzero(edge == 1) - 1
    out, last = [], None
    for h, t in zip(heads, tails, strict=True):
        if last is not None:
            out.append(b"\n" if (texts.data[last:texts.starts[h]] == 0x0A).any() else b" ")
        out.append(texts.data[texts.starts[h]:texts.ends[t]].tobytes())
        last = texts.ends[t]
    return b"".join(out)


def factors_of(texts: Texts, ids: pa.Array, row: np.ndarray, spans: pa.StructArray, own: np.ndarray, first: np.ndarray,
               window: int, kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """Parsed factors of each text, and the words they cover.

    ``row`` and ``spans`` are runs that stand earlier elsewhere; ``own`` are windows that stand earlier in
    their text, at ``first``. Both name words by their place in ``texts``, the spans by that in their text.
    """
    doc = np.searchsorted(texts.first, own, "right") - 1
    reference = pa.concat_arrays([spans.field("ref").cast(kind), ids.take(pa.array(doc)).cast(kind)])
    codes = reference.dictionary_encode().indices.fill_null(-1).to_numpy()
    text = np.concatenate([row, doc])
    at = np.concatenate([np.asarray(spans.field("at")), own - texts.first[doc]])
    n = np.concatenate([np.asarray(spans.field("n")).astype(np.int64), np.ones(len(own), np.int64)])
    ref_at = np.concatenate([np.asarray(spans.field("ref_at")), first - texts.first[doc]])
    order = np.argsort(text, kind="stable")
    bounds = np.searchsorted(text[order], np.arange(texts.n + 1))
    found, counts = [], np.zeros(texts.n + 1, np.int64)
    for d in np.flatnonzero(np.diff(bounds)):
        mine = order[bounds[d]:bounds[d + 1]]
        made = parsed(at[mine], n[mine], codes[mine], ref_at[mine])
        found += [(texts.first[d], start, size, mine[place], back) for start, size, place, back in made]
        counts[d + 1] = len(made)
    base, start, size, place, back = (np.array(c, np.int64) for c in (zip(*found) if found else [()] * 5))
    struct = pa.StructArray.from_arrays(
        [pa.array(start), pa.array(size + window - 1), reference.take(pa.array(place)), pa.array(back)], ["at", "words", "ref", "ref_at"])
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), struct)
    return lists, covered(int(texts.first[-1]), base + start, size + window - 1)


def shorten(docs: DataFrame, window: int) -> DataFrame:
    """Parse each text by its spans and its own repeats, and cut what the factors cover."""
    kind = docs.schema["id"].dataType
    schema = StructType([docs.schema["id"], docs.schema["others"], *StructType.fromDDL(
        f"text string, n_words long, n_removed long, factors array<struct<at: long, words: long, ref: {kind.simpleString()}, ref_at: long>>").fields])
    ref = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            ids, column, others = batch.column("id"), batch.column("text"), batch.column("others")
            for i, j, texts in sliced(column):
                row, spans = spans_of(batch, "spans", i, j)
                hashes = texts.word_hashes()
                starts, keys = grams(hashes, texts.first, window)
                doc = texts.doc_of_word()
                keys = in_text(keys, doc[starts])
                _, later = repeated(keys)
                earlier = starts[first_places(keys)[later]] if later.any() else starts[:0]
                factors, gone = factors_of(texts, ids.slice(i, j - i), row, spans, starts[later], earlier, window, ref)
                removed = np.bincount(doc[gone], minlength=texts.n)
                values = column.slice(i, j - i)
                if removed.any():
                    values = pa.array([without(texts, d, gone).decode() if removed[d] else values[d].as_py()
                                       for d in range(texts.n)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), others.slice(i, j - i), values.cast(pa.string()), pa.array(texts.n_words.astype(np.int64)),
                     pa.array(removed.astype(np.int64)), factors], schema.names)

    return docs.mapInArrow(run, schema)


def drop_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                           gram: int = 8) -> DataFrame:
    """Per row: the id, text without repeats, n_words and n_removed (words), factors and their number n_factors.

    A factor is a stretch of ``words`` words from word ``at`` on that also stands from word ``ref_at`` on in
    the document ``ref``; the next one begins with the first window that this one does not hold.

    The first column, ``others``, is a struct of the row's other columns.

    A word goes when it lies in ``window`` consecutive words of one text whose sequence also
    starts earlier: under a smaller id, or under the same id at an earlier word. Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged. Texts that lose nothing come back as they are, null as
    null. A null id counts as the smallest. Rows with the same id are versions of one document:
    the same place in them is not earlier, so equal rows do not remove each other, and each text
    loses only what its own windows cover. Texts under
    ``window`` words keep everything. Hashes of 128 bits stand for phrases and windows.
    """
    others = [docs[c] for c in docs.columns if c not in (id_col, text_col)]
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("key"),
                         F.struct(*others or [F.lit(None).cast("string").alias("none")]).alias("others"))
    rows = phrase_rows(source.select("id", "key", "text"), window, gram)
    shared = (rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), (F.min("phrase") != F.max("phrase")).alias("mixed"))
              .where("c > 1").drop("c"))
    known = saved(rows.join(shared, "anchor"))
    place, row = F.struct("id", "at"), F.struct("id", "at", "key")

    def after_first(found):
        return found.where(place > F.struct("first.id", "first.at"))

    firsts = known.groupBy("anchor", "phrase").agg(F.min(row).alias("first"), F.max("n").alias("n"),
                                                   F.max("mixed").alias("mixed"), F.count(F.lit(1)).alias("c"))
    copies = after_first(known.join(firsts.where("c > 1").select("anchor", "phrase", "first"), ["anchor", "phrase"]))
    reference = [F.col("first.id").alias("ref"), F.col("first.at").alias("ref_at")]
    copies = copies.select("id", "key", "at", "n", *reference)
    borders = firsts.where("mixed").select("first.id", "first.key", "first.at", "n")

    def with_spans(spans):
        """All texts with their spans; the texts' exchange is the same in each use."""
        parts = [c for c in spans.columns if c not in ("id", "key")]
        own = spans.groupBy("id", "key").agg(F.collect_list(F.struct(*parts)).alias("spans"))
        own = own.withColumnsRenamed({"id": "of", "key": "of_key"})
        return source.join(own, source["id"].eqNullSafe(own["of"]) & (source["key"] == own["of_key"]), "left").drop("of", "of_key")

    windows = boundary_windows(with_spans(borders), window)
    earliest = (windows.groupBy("w0", "w1").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
                .where("c > 1").drop("c"))
    edges = after_first(windows.join(earliest, ["w0", "w1"])).select("id", "key", "at", F.lit(1).alias("n"), *reference)
    return shorten(with_spans(copies.unionByName(edges)), window).select(
        "others", F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "n_removed", "factors",
        F.size("factors").cast("long").alias("n_factors"))
