"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics. Per class, the mean and covariance come
from sums that Spark adds up over all labelled rows (a fixed number of values, whatever the
rows). The covariance is shrunk towards the pooled one and its diagonal, factored once by
Cholesky, and a text is scored by the difference of the classes' log densities (Mahalanobis
distances by triangular solves, log determinants from the factors).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metaudit.llm.quality_rules import SYMBOLS, gram_coverage, letters, repeated_lines
from metaudit.llm.shared import saved
from metaudit.llm.texts import columns_of, per_text, rows_where
from metaudit.llm.words import Texts, in_text, repeated, totals

FEATURES = ["log_words", "log_word_size", "word_size_spread", "distinct_words", "upper", "digits", "symbols", "marks",
            "shouts", "stops", "breaks", "beyond_ascii", "word_repeats", "gram_repeats", "line_repeats",
            "symbol_words", "adjacent_repeats"]


def table(characters: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(characters)] = True
    return flags


UPPER, DIGITS = table(bytes(range(65, 91))), table(b"0123456789")
MARKS, SHOUTS, STOPS = table(b",;:\"'()[]{}-/\\@_=+~^`"), table(b"!?"), table(b".")
WIDE = np.arange(256) >= 0xC2


def angle(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share as an angle, which steadies its variance."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def features(texts: Texts) -> np.ndarray:
    """Statistics of each text, one row each (see FEATURES); an empty text has finite values too."""
    data, n_words = texts.data, texts.n_words
    inside = letters(texts)
    chars = texts.per_doc(inside)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=heads[1:])
    sizes = heads[texts.ends] - heads[texts.starts]
    hashes, doc = texts.word_hashes(), texts.doc_of_word()
    _, later = repeated(in_text(hashes, doc))
    mean = chars / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(totals(sizes * sizes, texts.first) / np.maximum(n_words, 1) - mean * mean, 0))
    next_same = np.zeros(len(hashes), bool)
    next_same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    last = data[texts.ends - 1] if len(hashes) else np.zeros(0, np.uint8)
    share = {name: angle(texts.per_doc(flags[data]), chars) for name, flags in
             (("upper", UPPER), ("digits", DIGITS), ("symbols", SYMBOLS), ("marks", MARKS), ("shouts", SHOUTS),
              ("stops", STOPS), ("wide", WIDE))}
    return np.stack([
        np.log1p(n_words), np.log1p(mean), np.log1p(spread), angle(n_words - totals(later, texts.first), n_words),
        share["upper"], share["digits"], share["symbols"], share["marks"], share["shouts"], share["stops"],
        angle(texts.per_doc(data == 0x0A), n_words), share["wide"],
        angle(gram_coverage(texts, hashes, sizes, 3)[0], n_words),
        angle(gram_coverage(texts, hashes, sizes, 8)[0], n_words),
        angle(repeated_lines(texts)[1], chars),
        angle(totals((SYMBOLS | SHOUTS)[last], texts.first), n_words), angle(totals(next_same, texts.first), n_words),
    ], axis=1)


@dataclass
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor, and log prior less half the log determinant."""

    means: np.ndarray
    whitening: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        logs = [o - 0.5 * np.sum(((x - m) @ w.T) ** 2, axis=1)
                for m, w, o in zip(self.means, self.whitening, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def discriminant(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float,
                 diagonal: float) -> Discriminant:
    """Fit from counts (2), sums (2, d) and sums of products (2, d, d) of the classes.

    A class without rows takes the pooled moments, so the score is then 0.5 but for the prior.
    """
    d = sums.shape[1]
    pooled_n = max(counts.sum(), 1)
    centre = sums.sum(0) / pooled_n
    overall = squares.sum(0) / pooled_n - np.outer(centre, centre)
    means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centre)
    own = [squares[c] / counts[c] - np.outer(means[c], means[c]) if counts[c] else overall for c in (0, 1)]
    pooled = sum(n * s for n, s in zip(counts, own, strict=True)) / pooled_n
    target = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled) + 1e-6)
    whitening, offsets = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * own[c] + shrinkage * target + 1e-6 * np.eye(d))
        whitening.append(np.linalg.solve(factor, np.eye(d)))
        offsets.append(np.log((counts[c] + 1) / (counts.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whitening), np.array(offsets))


def moments(vectors: DataFrame, label_col: str):
    """Counts, sums and sums of products of the features per class.

    Each task sends one row per class and batch and value (1 + d + d * (d + 1) / 2 values).
    """
    d = len(FEATURES)
    upper = np.triu_indices(d)
    size = 1 + d + len(upper[0])

    def run(batches):
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            for c in (0, 1):
                own = x[label == c]
                products = (own.T @ own)[upper]
                values = np.concatenate([[len(own)], own.sum(0), products])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, c, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(values)],
                    ["class", "i", "v"])

    parts = vectors.select(F.col(label_col).cast("int").alias("class"), "x").mapInArrow(run, "class int, i int, v double")
    stats = np.zeros((2, size))
    for r in parts.groupBy("class", "i").agg(F.sum("v").alias("v")).collect():
        stats[r["class"], r["i"]] = r["v"]
    squares = np.zeros((2, d, d))
    squares[:, upper[0], upper[1]] = stats[:, 1 + d:]
    squares[:, upper[1], upper[0]] = stats[:, 1 + d:]
    return stats[:, 0], stats[:, 1:1 + d], squares


def vector_column(x: np.ndarray) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, shrinkage: float,
           diagonal: float) -> tuple[Discriminant, DataFrame]:
    """The model, and the written features of all texts."""
    marks = columns_of(labels, id_col, label_col).where(F.col(label_col).isin(0, 1))
    vectors = saved(per_text(docs, lambda texts: [vector_column(features(texts))], "x array<double>",
                             id_col=id_col, text_col=text_col))
    return discriminant(*moments(vectors.join(marks, id_col), label_col), shrinkage, diagonal), vectors


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", shrinkage: float = 0.1, diagonal: float = 0.2,
                   threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs``: the id, score (0 to 1, higher: label 1 likelier) and predicted (0 or 1).

    Fits on every row of ``labels`` (id, label 0 or 1; other labels and nulls are left out) that
    has a document. Ids with several rows count once per pair of rows. A null text is an empty
    one and gets a score. Without any labels all scores are 0.5.
    """
    model, vectors = fitted(docs, labels, id_col, text_col, label_col, shrinkage, diagonal)
    fields = StructType([vectors.schema[id_col], *StructType.fromDDL("score double, predicted int").fields])

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            scores = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], fields.names)

    return vectors.mapInArrow(run, fields)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", shrinkage: float = 0.1, diagonal: float = 0.2,
              threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is at least ``threshold`` (see quality_scores)."""
    model, _ = fitted(docs, labels, id_col, text_col, label_col, shrinkage, diagonal)
    return rows_where(docs, lambda texts: model.scores(features(texts)) >= threshold, text_col=text_col)
