"""Language identification: nearest centroid of normalised TF-IDF n-gram vectors.

Texts become vectors over hashed character n-grams (lengths 1 to 3 over the bytes of
lower-cased letters, a space for whatever lies between). Document frequencies are counted over all training texts; each
language's centroids come from spherical k-means over a bounded sample of its vectors; a text
takes the language of the centroid with the highest cosine. A text farther from every
centroid than ``reject_below`` is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaudit.llm.texts import columns_of, per_text
from metaudit.llm.words import LOWER, Texts, mix, sliced

DIMENSIONS = 1 << 12
LENGTHS = (1, 2, 3)
NONE = "und"
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
PLAIN = np.where(ASCII_LETTER | (np.arange(256) >= 0x80), LOWER, 0x20).astype(np.uint8)


def letters_only(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lower-cased letters with one space for whatever lies between, and the text of each byte."""
    data = PLAIN[texts.data]
    upper = np.flatnonzero((texts.data[:-1] == 0xC3) & (texts.data[1:] >= 0x80) & (texts.data[1:] <= 0x9E)) + 1
    data[upper] += 0x20  # accented capitals of Latin-1
    doc = np.repeat(np.arange(texts.n), np.diff(texts.offsets))
    space = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    return data[keep], doc[keep]


def gram_counts(texts: Texts) -> np.ndarray:
    """How often each hashed n-gram stands in each text (texts x DIMENSIONS)."""
    data, doc = letters_only(texts)
    wide = data.astype(np.uint64)
    counts = np.zeros(texts.n * DIMENSIONS, np.int64)
    code = wide
    for n in LENGTHS:
        if n > 1:
            code = (code[:-1] << np.uint64(8)) | wide[n - 1:]
        same = doc[:len(code)] == doc[n - 1:]
        bucket = (mix(code + np.uint64(n << 40)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
        counts += np.bincount((doc[:len(code)] * DIMENSIONS + bucket)[same], minlength=len(counts))
    return counts.reshape(texts.n, DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts).astype(np.float32) * idf
    norms = np.linalg.norm(weights, axis=1, keepdims=True)
    return weights / np.where(norms > 0, norms, 1)


def has_letter(texts: Texts) -> np.ndarray:
    """Whether each text has a letter: an ASCII one, or any code point that Unicode calls alphabetic."""
    ascii_letters = texts.per_doc(ASCII_LETTER[texts.data]) > 0
    out = ascii_letters.copy()
    for d in np.flatnonzero(~ascii_letters & (texts.per_doc(texts.data >= 0x80) > 0)):
        text = texts.data[texts.offsets[d]:texts.offsets[d + 1]].tobytes().decode("utf-8", "replace")
        out[d] = any(c.isalpha() for c in text)
    return out


def parts(texts: Texts, limit: int = 256):
    """Texts in groups whose count matrix stays small."""
    for i in range(0, texts.n, limit):
        j = min(i + limit, texts.n)
        a, b = texts.offsets[i], texts.offsets[j]
        yield Texts(texts.data[a:b], texts.offsets[i:j + 1] - a, texts.starts[:0], texts.ends[:0],
                    np.zeros(j - i + 1, np.int64))


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Texts, and texts that have each n-gram, over all rows: one row of DIMENSIONS counts per batch, added by Spark."""
    def run(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for _, _, texts in sliced(batch.column(0)):
                for part in parts(texts):
                    total += (gram_counts(part) > 0).sum(0)
                    n += part.n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())],
                                         ["bucket", "n"])

    rows = (columns_of(docs, text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket")
            .agg(F.sum("n").alias("n")).collect())
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for r in rows:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return n, df


def spherical_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of unit rows by k-means under cosine; fewer when there are fewer distinct rows."""
    x = x[np.linalg.norm(x, axis=1) > 0]
    if len(x) == 0:
        return x
    rng = np.random.default_rng(seed)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < k:  # far points first
        far = 1 - (x @ centres.T).max(1)
        if far.max() < 1e-6:
            break
        centres = np.concatenate([centres, x[[int(rng.choice(len(x), p=np.maximum(far, 0) / np.maximum(far, 0).sum()))]]])
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        sums = np.stack([x[nearest == c].sum(0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def language_ids(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", sample_per_language: int = 400, centroids: int = 4, rounds: int = 8,
                 reject_below: float = 0.15, seed: int = 17) -> DataFrame:
    """Per row of ``docs``: the id, lang_pred, score (0 to 1) and rejected.

    Learns from the rows of ``training`` whose text and language are not null: document
    frequencies from all of them, centroids from at most about ``sample_per_language`` different texts
    of each language, chosen by a hash of the text (equal texts count once; ids play no part). ``lang_pred`` is the language of the nearest
    centroid, or ``und`` (score 0) if the text is null or has no letter, or nothing was learnt.
    ``rejected`` is true where the nearest centroid's cosine is under ``reject_below``. The
    score is the share of the winner among the languages' best cosines, sharpened.
    """
    spark = docs.sparkSession
    known = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[lang_col]: r["count"] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return columns_of(docs, id_col).select(id_col, F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"),
                                               F.lit(True).alias("rejected"))
    n, df = document_frequencies(known, text_col)
    idf = (np.log((n + 1) / (df + 1)) + 0.05).astype(np.float32)

    # texts are picked by their hash against the language's share; only those picked are shuffled
    share = F.create_map(*[x for lang, size in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample_per_language / size)))])
    mark = F.xxhash64(F.col(text_col), F.lit(seed))
    picked = (known.where(F.pmod(mark, F.lit(1 << 20)) < share[F.col(lang_col)] * (1 << 20))
              .groupBy(F.col(lang_col).alias("lang"), mark.alias("mark")).agg(F.min(text_col).alias("text"))
              .select(F.struct("lang", "mark").alias("of"), "text"))

    def sparse(texts):
        counts = np.concatenate([gram_counts(p) for p in parts(texts)]) if texts.n else np.zeros((0, DIMENSIONS), np.int64)
        rows, at = np.nonzero(counts)
        ends = np.searchsorted(rows, np.arange(texts.n + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(counts[rows, at].astype(np.int32)))]

    sample: dict[str, list[tuple[int, np.ndarray]]] = {lang: [] for lang in sizes}
    for row in per_text(picked, sparse, "at array<int>, n array<int>", id_col="of").toLocalIterator():
        counts = np.zeros((1, DIMENSIONS), np.int64)
        counts[0, row["at"]] = row["n"]
        sample[row["of"]["lang"]].append((row["of"]["mark"], vectors(counts, idf)[0]))
    names, groups = [], []
    for lang in sorted(sample):
        if sample[lang]:
            ordered = [v for _, v in sorted(sample[lang], key=lambda x: x[0])]
            means = spherical_means(np.stack(ordered), centroids, rounds, seed)
            groups.append(means)
            names += [lang] * len(means)
    languages = sorted(set(names))
    owner = np.array([languages.index(x) for x in names])
    model = spark.sparkContext.broadcast((np.concatenate(groups), owner, languages, idf))

    def work(texts):
        centres, owner, languages, idf = model.value
        best = np.zeros((texts.n, len(languages)), np.float32)
        at = 0
        for part in parts(texts):
            cosines = vectors(gram_counts(part), idf) @ centres.T
            for k in range(len(languages)):
                best[at:at + part.n, k] = cosines[:, owner == k].max(1)
            at += part.n
        letter = has_letter(texts)
        choice = best.argmax(1)
        top = best.max(1)
        weight = np.exp(30 * (best - top[:, None]).astype(np.float64))
        score = np.where(letter, 1 / weight.sum(1), 0.0)
        return [pa.array(np.where(letter, np.array(languages, object)[choice], NONE), pa.string()), score,
                ~letter | (top < reject_below)]

    return per_text(docs, work, "lang_pred string, score double, rejected boolean", id_col=id_col, text_col=text_col)
