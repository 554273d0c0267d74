"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Rolling hashes of several n-gram lengths are computed for a slice of texts at once; a word
counts as covered for a length when it lies in an n-gram that stands twice or more in its
text. Coverage is measured in characters (code points) of words.

Defined results: a null or empty text has no words and fails; ids may be null or repeat
(each row is judged alone); other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from metaudit.llm.texts import per_text
from metaudit.llm.words import (BASE_BYTES, HEAD, Texts, covered, grams, in_text, prefix, range_hash, repeated,
                                totals)

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

# Largest share of a text's characters that may lie in repeated n-grams of a length, and in lines that repeat.
MAX_COVERAGE = {2: 0.85, 4: 0.45, 6: 0.35, 10: 0.3}
MAX_LINE_COVERAGE = 0.3


def gram_coverage(texts: Texts, hashes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and characters of each text inside n-grams that stand twice or more in it."""
    starts, keys = grams(hashes, texts.first, n)
    many, _ = repeated(in_text(keys, texts.doc_of_word()[starts]))
    inside = covered(len(hashes), starts[many], n)
    return totals(inside, texts.first), totals(inside * sizes, texts.first)


def repeated_lines(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text that have a word and stood before in it: their number and characters in words."""
    data, offsets = texts.data, texts.offsets
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    doc = np.searchsorted(offsets, starts, "right") - 1
    # the start of the text after next belongs to an empty text or to the break at its end
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    words = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    starts, ends, doc = starts[words], ends[words], doc[words]
    keys = in_text(range_hash(prefix(data, BASE_BYTES), starts, ends, BASE_BYTES), doc)
    _, later = repeated(keys)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letters(texts), out=heads[1:])
    sizes = np.where(later, heads[ends] - heads[starts], 0)
    return (np.bincount(doc, later, texts.n).astype(np.int64), np.bincount(doc, sizes, texts.n).astype(np.int64))


def letters(texts: Texts) -> np.ndarray:
    """First bytes of code points in words."""
    steps = np.zeros(len(texts.data) + 1, np.int8)
    steps[texts.starts] += 1
    steps[texts.ends] -= 1
    return (np.cumsum(steps[:-1], dtype=np.int8) > 0) & HEAD[texts.data]


def measure(texts: Texts, max_coverage: dict[int, float], max_line_coverage: float,
            min_words: int, repeat_n: int, max_repeat_percent: int) -> list:
    inside = letters(texts)
    word_chars = texts.per_doc(inside)
    heads = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(inside, out=heads[1:])
    sizes = heads[texts.ends] - heads[texts.starts]
    hashes = texts.word_hashes()
    n_words = texts.n_words.astype(np.int64)
    n_dup_lines, line_chars = repeated_lines(texts)
    n_repeat, _ = gram_coverage(texts, hashes, sizes, repeat_n)
    failed = (n_words < min_words) | (100 * n_repeat > max_repeat_percent * n_words)
    whole = np.maximum(word_chars, 1)
    line_coverage = line_chars / whole
    kept = ~failed & (line_coverage <= max_line_coverage)
    out = []
    for n, most in max_coverage.items():
        coverage = gram_coverage(texts, hashes, sizes, n)[1] / whole
        kept &= coverage <= most
        out.append(coverage)
    return [n_words, word_chars, texts.per_doc(SYMBOLS[texts.data]), n_dup_lines, n_repeat, failed, kept,
            line_coverage, *out]


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     max_coverage: dict[int, float] = MAX_COVERAGE, max_line_coverage: float = MAX_LINE_COVERAGE,
                     min_words: int = 20, repeat_n: int = 8, max_repeat_percent: int = 30) -> DataFrame:
    """Counts, coverages and verdict of every row.

    Columns: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in
    repeated ``repeat_n``-grams), base_failed, kept, line_coverage, and coverage_<n> for each
    length. ``kept`` is false when the text has under ``min_words`` words, when more than
    ``max_repeat_percent`` of its words are in repeated ``repeat_n``-grams, or when a coverage
    is over its limit.
    """
    schema = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, line_coverage double, "
              + ", ".join(f"coverage_{n} double" for n in max_coverage))

    def work(texts):
        return measure(texts, max_coverage, max_line_coverage, min_words, repeat_n, max_repeat_percent)

    return per_text(docs, work, schema, id_col=id_col, text_col=text_col)
