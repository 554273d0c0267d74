"""Language-model scores from n-gram counts in a log-frequency Bloom filter.

Counts of words and word pairs are kept on a logarithmic scale: a count of level q (q is 1
for 1, 2 for 2 to 3, 3 for 4 to 7, ...) is stored as memberships (n-gram, 1) to (n-gram, q).
Probing levels until one is missing reads the quantised count back. Pair probabilities are
smoothed with word probabilities in proportion to how often the context was seen.

The filter is cut into cells by n-gram hash. Tasks count n-grams of their texts and send one
row per cell with packed keys and counts; one task per cell adds them up and builds that
cell's bits, sized to what it holds. The number of cells follows the bytes of text, so a
cell's size does not. The model goes to the workers in shards of at most ``shard_bytes``
each, one at a time; texts are scored against one shard after another, and the parts, a few numbers a
text, are written and added. Beside its shard a worker holds the word filter, about 1.3 bytes a distinct word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metaudit.llm.shared import saved
from metaudit.llm.texts import columns_of
from metaudit.llm.words import Texts, mix, sliced, totals

END = np.uint64(0x5851F42D4C957F2D)  # key of the end of a text, also the context of its first word
PROBES = 6
BITS_PER_ENTRY = 9  # with six probes about one wrong answer in eighty
BYTES_PER_CELL = 4 << 20
TASK_TOKENS = 2_000_000  # n-grams a task gathers before it sends them on
MOST_LEVELS = 64
STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words and pairs of all tokens, and the first token of each text; each text ends with END."""
    first = texts.first + np.arange(texts.n + 1)
    words = np.full(first[-1], END, np.uint64)
    words[np.arange(len(texts.starts)) + texts.doc_of_word()] = texts.word_hashes()
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1]] = END
    return words, before, first


def pairs(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * STEP + words)


def cell_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """Cells in the order of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 -> 1, 2..3 -> 2, 4..7 -> 3


def estimates(level: np.ndarray) -> np.ndarray:
    """Middle of a level's counts; 0 for level 0."""
    return np.where(level > 1, 2.0 ** (level - 1) * np.sqrt(2), level)


def positions(keys: np.ndarray, level: np.ndarray, probe: int, bits: np.ndarray) -> np.ndarray:
    """Bit of one probe for one level, below ``bits``."""
    h = mix(keys + level.astype(np.uint64) * STEP)
    return (((h >> np.uint64(32)) + np.uint64(probe) * (h & np.uint64(0xFFFFFFFF) | np.uint64(1)))
            % bits.astype(np.uint64)).astype(np.int64)


def filter_bits(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of a Bloom filter that holds every level of every key."""
    top = levels(counts)
    entry = np.repeat(np.arange(len(keys)), top)
    level = np.arange(len(entry)) - np.repeat(np.cumsum(top) - top, top) + 1
    size = max(1, -(-len(entry) * BITS_PER_ENTRY // 8))
    flags = np.zeros(size * 8, bool)
    bits = np.full(len(entry), size * 8)
    for probe in range(PROBES):
        flags[positions(keys[entry], level, probe, bits)] = True
    return np.packbits(flags, bitorder="little")


@dataclass
class Filter:
    """Cells of bits side by side; ``first`` and ``last`` cell that are held."""

    data: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    cells: int
    low: int

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key by repeated probes; keys of cells that are not held have level 0."""
        out = np.zeros(len(keys), np.int64)
        cell = cell_of(keys, self.cells) - self.low
        alive = np.flatnonzero((cell >= 0) & (cell < len(self.sizes)))
        for level in range(1, MOST_LEVELS):
            for probe in range(PROBES):
                at = cell[alive]
                bit = positions(keys[alive], np.full(len(alive), level), probe, self.sizes[at])
                alive = alive[(self.data[self.begins[at] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 > 0]
            if not len(alive):
                break
            out[alive] = level
        return out


def joined(parts: list[bytes], cells: int, low: int) -> Filter:
    sizes = np.array([len(p) for p in parts], np.int64)
    return Filter(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes * 8, cells, low)


@dataclass
class Shard:
    """Some cells of the exact word counts and of the pair filter."""

    keys: np.ndarray
    counts: np.ndarray
    pairs: Filter
    low: int
    high: int


def count_cells(training: DataFrame, text_col: str, cells: int) -> DataFrame:
    """Per cell: exact word counts, and the filters of words and of pairs."""
    def send(arrays):
        kinds = []
        for kind in (0, 1):
            keys, counts = np.unique(np.concatenate([a[kind] for a in arrays]), return_counts=True)
            ends = np.searchsorted(cell_of(keys, cells), np.arange(cells + 1))
            kinds.append((keys, counts.astype(np.uint32), ends))
        rows = [(kind, c, keys[a:b].tobytes(), counts[a:b].tobytes()) for kind, (keys, counts, ends) in enumerate(kinds)
                for c, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
            ["kind", "cell", "keys", "counts"])

    def gather(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, texts in sliced(batch.column(0), lower=True):
                words, before, _ = tokens(texts)
                held.append((words, pairs(before, words)))
                n += len(words)
                if n >= TASK_TOKENS:
                    yield send(held)
                    held, n = [], 0
        if held:
            yield send(held)

    def add(key, batches):
        keys, counts = [], []
        for batch in batches:
            keys += [np.frombuffer(x, np.uint64) for x in batch.column("keys").to_pylist()]
            counts += [np.frombuffer(x, np.uint32) for x in batch.column("counts").to_pylist()]
        own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate(counts), len(own)).astype(np.int64)
        kind = key[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
             pa.array([filter_bits(own, sums).tobytes()], pa.binary()),
             pa.array([own.tobytes() if kind == 0 else b""], pa.binary()),
             pa.array([sums.tobytes() if kind == 0 else b""], pa.binary()),
             pa.array([int(sums.sum())], pa.int64()), pa.array([len(own)], pa.int64())],
            ["kind", "cell", "bits", "keys", "counts", "total", "distinct"])

    from collections.abc import Iterator

    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    sent = columns_of(training, text_col).mapInArrow(gather, "kind int, cell int, keys binary, counts binary")
    return sent.groupBy("kind", "cell").applyInArrow(
        add, "kind int, cell int, bits binary, keys binary, counts binary, total long, distinct long")


def shard_bounds(model: DataFrame, cells: int, shard_bytes: int) -> list[tuple[int, int]]:
    """Shards of consecutive cells, each of at most ``shard_bytes``; a single cell, some MB, is the least."""
    sizes = model.groupBy("cell").agg(F.sum(F.when(F.col("kind") == 1, F.length("bits")).otherwise(0)
                                            + F.length("keys") + F.length("counts")).alias("n")).collect()
    by_cell = {r["cell"]: r["n"] for r in sizes}
    starts, held = [0], 0
    for c in range(cells):
        if held and held + by_cell.get(c, 0) > shard_bytes:
            starts.append(c)
            held = 0
        held += by_cell.get(c, 0)
    return list(zip(starts, [*starts[1:], cells], strict=True))


def word_filter(model: DataFrame, cells: int) -> Filter:
    bits = {r["cell"]: bytes(r["bits"]) for r in model.where("kind = 0").select("cell", "bits").toLocalIterator()}
    return joined([bits.get(c, b"\0") for c in range(cells)], cells, 0)


def shard(model: DataFrame, cells: int, low: int, high: int) -> Shard:
    """Read the cells from low to high."""
    pair_bits, exact = {}, {}
    own = model.where(F.col("cell").between(low, high - 1))
    for r in own.select("kind", "cell", F.when(F.col("kind") == 1, F.col("bits")).alias("bits"), "keys", "counts").toLocalIterator():
        if r["kind"] == 1:
            pair_bits[r["cell"]] = bytes(r["bits"])
        else:
            exact[r["cell"]] = (np.frombuffer(bytes(r["keys"]), np.uint64), np.frombuffer(bytes(r["counts"]), np.int64))
    order = sorted(exact)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return Shard(np.concatenate([exact[c][0] for c in order] or [none[0]]), np.concatenate([exact[c][1] for c in order] or [none[1]]),
                 joined([pair_bits.get(c, b"\0") for c in range(low, high)], cells, low), low, high)


def lm_scores(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              alpha: float = 0.1, strength: float = 20.0, shard_bytes: int = 192 << 20,
              bytes_per_cell: int = BYTES_PER_CELL) -> DataFrame:
    """Per row of ``docs``: the id, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the texts of ``training``. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased, and every text has an end token; a null or empty text is the end alone.
    ``base_score`` is the log10 probability of the words by exact counts with ``alpha`` added;
    ``score`` is that of the smoothed pair model. Without training texts, N and V are 0 and
    both scores follow from the smoothing alone. Null ids and repeated rows are kept, one row
    out for each row in; other columns are not read.
    """
    spark = docs.sparkSession
    source = columns_of(docs, id_col, text_col)
    size = training.agg(F.sum(F.octet_length(training[text_col])).alias("n")).collect()[0]["n"] or 0
    cells = max(8, -(-size // bytes_per_cell))
    model = saved(count_cells(training, text_col, cells))
    stats = model.where("kind = 0").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).collect()[0]
    n_train, n_words = stats["n"] or 0, stats["v"] or 0
    floor = n_train + alpha * (n_words + 1)

    schema = StructType([source.schema[id_col], *StructType.fromDDL(
        "n_tokens long, n_known long, train_tokens long, base_score double, score double, digest long").fields])

    def scorer(held):
        def run(batches):
            part: Shard = held.value
            known_words: Filter = words_held.value
            for batch in batches:
                ids = batch.column(0)
                for i, j, texts in sliced(batch.column(1), lower=True):
                    words, before, first = tokens(texts)
                    own, inverse = np.unique(words, return_inverse=True)
                    # exact counts of the words whose cell is here
                    cell = cell_of(own, cells)
                    here = (cell >= part.low) & (cell < part.high)
                    at = np.minimum(np.searchsorted(part.keys, own), max(len(part.keys) - 1, 0))
                    count = np.where(part.keys[at] == own, part.counts[at], 0) if len(part.keys) else np.zeros(len(own), np.int64)
                    base = np.where(here, np.log10((count + alpha) / floor), 0)[inverse]
                    # the pair model, for pairs whose cell is here
                    seen = estimates(known_words.level(own))
                    keys = pairs(before, words)
                    cell = cell_of(keys, cells)
                    mine = (cell >= part.low) & (cell < part.high)
                    context = np.searchsorted(own, before)
                    known = context < len(own)
                    context = np.where(known, context, 0)
                    total = np.where(known & (own[context] == before), seen[context], float(estimates(known_words.level(
                        np.array([END], np.uint64)))[0]))
                    together = np.minimum(estimates(part.pairs.level(keys)), total)
                    back = (seen[inverse] + alpha) / floor
                    score = np.where(mine, np.log10((together + strength * back) / (total + strength)), 0)
                    digest = [hash_of(texts, d) for d in range(texts.n)] if many else np.zeros(texts.n, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(i, j - i), pa.array(np.diff(first).astype(np.int64)),
                         pa.array(totals((here & (count > 0))[inverse], first)),
                         pa.array(np.full(texts.n, n_train, np.int64)), pa.array(sums(base, first)),
                         pa.array(sums(score, first)), pa.array(digest, pa.int64())], schema.names)
        return run

    bounds = shard_bounds(model, cells, shard_bytes)
    many = len(bounds) > 1
    words_held = spark.sparkContext.broadcast(word_filter(model, cells))
    if not many:
        return source.mapInArrow(scorer(spark.sparkContext.broadcast(shard(model, cells, *bounds[0]))), schema).drop("digest")
    together = None
    for low, high in bounds:  # one shard at a time on the driver and the workers; its parts are written
        held = spark.sparkContext.broadcast(shard(model, cells, low, high))
        part = saved(source.mapInArrow(scorer(held), schema))
        held.destroy()
        together = part if together is None else together.unionAll(part)
    words_held.destroy()
    # a row that stands m times gives m parts per shard: add up one and repeat it
    copies = (F.count(F.lit(1)) / len(bounds)).cast("int")
    return (together.groupBy(id_col, "digest", "n_tokens", "train_tokens")
            .agg(copies.alias("copies"), *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
            .select(id_col, "n_tokens", (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"), "train_tokens",
                    (F.col("base_score") / F.col("copies")).alias("base_score"),
                    (F.col("score") / F.col("copies")).alias("score"),
                    F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy"))


def hash_of(texts: Texts, d: int) -> int:
    """64 bits that tell texts with the same id apart."""
    import hashlib

    text = texts.data[texts.offsets[d]:texts.offsets[d + 1]].tobytes()
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values, each text on its own so that it does not depend on its neighbours."""
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.zeros(0)
