"""Scores of the fitted operators against plain loops over the same counts, moments and vectors."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metaudit.llm import language_id, ngram_lm, quality_classifier
from metaudit.llm.language_id import language_ids
from metaudit.llm.ngram_lm import lm_scores
from metaudit.llm.quality_classifier import quality_scores
from metaudit.llm.source_mixing import mix_sources
from metaudit.llm.words import sliced


def prose(rng, n, size=60):
    return " ".join(f"w{min(rng.randrange(size), rng.randrange(size))}" for _ in range(n))


def all_texts(texts, lower=False):
    """All texts as one slice."""
    return next(sliced(pa.array([t or "" for t in texts]), lower, 1 << 40))[2]


# Language model: pairs are smoothed in a plain loop, with levels read from filters that are built here.

def test_lm_score_is_the_smoothed_pair_model(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(60)) for _ in range(150)] + [None, "", "one", "ONE two"]
    texts += texts[:9] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    training = docs.where("doc_id % 10 <> 0")
    size = 2000
    found = {r.doc_id: r for r in lm_scores(docs, training, bytes_per_cell=size).collect()}

    learnt = [t or "" for i, t in enumerate(texts) if i % 10]
    words, before, _ = ngram_lm.tokens(all_texts(learnt, True))
    cells = max(8, -(-sum(len(t.encode()) for t in learnt) // size))

    def filters(keys):
        keys, counts = np.unique(keys, return_counts=True)
        cell = ngram_lm.cell_of(keys, cells)
        parts = [ngram_lm.filter_bits(keys[cell == c], counts[cell == c]).tobytes() if (cell == c).any() else b"\0" for c in range(cells)]
        return ngram_lm.joined(parts, cells, 0)

    single, double = filters(words), filters(ngram_lm.pairs(before, words))
    exact = Counter(words.tolist())
    floor = len(words) + 0.1 * (len(exact) + 1)

    def about(level):
        return 2.0 ** (level - 1) * math.sqrt(2) if level > 1 else float(level)

    for i, text in enumerate(texts):
        own, context, _ = ngram_lm.tokens(all_texts([text], True))
        score = 0.0
        for word, last in zip(own, context):
            total = about(int(single.level(np.array([last]))[0]))
            together = min(about(int(double.level(ngram_lm.pairs(np.array([last]), np.array([word])))[0])), total)
            back = (about(int(single.level(np.array([word]))[0])) + 0.1) / floor
            score += math.log10((together + 20 * back) / (total + 20))
        assert found[i].score == pytest.approx(score, abs=1e-9)
        assert found[i].base_score == pytest.approx(sum(math.log10((exact[w] + 0.1) / floor) for w in own.tolist()), abs=1e-9)
        assert (found[i].n_tokens, found[i].n_known) == (len(own), sum(w in exact for w in own.tolist()))


# Quality: moments and Cholesky factors in plain numpy, row by row.

def test_quality_score_is_the_shrunk_discriminant(spark):
    rng = random.Random(2)
    good = [prose(rng, rng.randrange(30, 90), 4000) + "." for _ in range(80)]
    bad = [("BUY!! " * rng.randrange(5, 40)) + prose(rng, rng.randrange(20)) for _ in range(60)]
    texts = good + bad + [None, "", "x"]
    labels = [(i, int(i < 80)) for i in range(140) if i % 3] + [(200, 1), (5, None), (6, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_scores(docs, marks).collect()}

    x = quality_classifier.features(all_texts(texts))
    use = {i: y for i, y in labels if y in (0, 1) and i < len(texts)}
    d, shrinkage, diagonal = x.shape[1], 0.1, 0.2
    rows = {c: np.array([x[i] for i, y in use.items() if y == c]) for c in (0, 1)}
    pooled = sum(len(r) * np.cov(r.T, bias=True) for r in rows.values()) / len(use)
    target = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled) + 1e-6)
    logs = []
    for c in (0, 1):
        covariance = (1 - shrinkage) * np.cov(rows[c].T, bias=True) + shrinkage * target + 1e-6 * np.eye(d)
        away = x - rows[c].mean(0)
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(covariance), away)
        logs.append(math.log((len(rows[c]) + 1) / (len(use) + 2)) - 0.5 * distance - 0.5 * np.linalg.slogdet(covariance)[1])
    expected = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    for i in range(len(texts)):
        assert found[i].score == pytest.approx(expected[i], abs=1e-6) and found[i].predicted == int(expected[i] >= 0.5)


def test_quality_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, "some words here " * i, i % 2, "x") for i in range(30)], "doc_id long, text string, quality int, x string")
    marks = spark.createDataFrame([(i, i % 2, "y", 1.0) for i in range(20)], "doc_id long, quality int, text string, score double")
    assert quality_scores(docs, marks).count() == 30
    assert quality_classifier.keep_good(docs, marks).columns == docs.columns


# Language: every text against every centroid, by plain cosines.

def test_language_is_the_nearest_centroid(spark, monkeypatch):
    rng = random.Random(3)
    alphabets = {"aa": "abcde ", "bb": "vwxyz ", "cc": "äöüßé "}
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(30, 200))), lang)
            for i, lang in enumerate(list(alphabets) * 60)]
    rows += [(900, None, "aa"), (901, "123", "bb"), (902, "", None), (903, "abcxyz", None), (904, rows[0][1], "aa")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, at int").repartition(4)
    kept = []
    plain = language_id.spherical_means
    monkeypatch.setattr(language_id, "spherical_means", lambda *a: kept.append(plain(*a)) or kept[-1])
    found = {r.doc_id: r for r in language_ids(docs, docs.where("doc_id % 5 <> 0"), sample_per_language=50).collect()}
    names, groups = sorted(alphabets), kept
    learnt = [t for i, t, lang in rows if i % 5 and t is not None and lang]
    counts = language_id.gram_counts(all_texts(learnt))
    idf = (np.log((len(learnt) + 1) / ((counts > 0).sum(0) + 1)) + 0.05).astype(np.float32)
    for i, text, _ in rows:
        r = found[i]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = language_id.vectors(language_id.gram_counts(all_texts([text])), idf)[0]
        best = [max(float(c @ v) for c in group) for group in groups]
        top = max(best)
        assert r.lang_pred == names[best.index(top)] and r.rejected == (top < 0.15)
        assert r.score == pytest.approx(1 / sum(math.exp(30 * (b - top)) for b in best), abs=1e-4)
    # a tie between languages goes to the first name
    same = spark.createDataFrame([(i, "abc abc", lang) for i, lang in enumerate(["bb", "aa", "bb", "aa"])], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_ids(same, same).collect()} == {"aa"}


# Mixing: a plain loop over the order of blocks and documents.

def test_mixing_is_a_budgeted_permutation(spark):
    rng = random.Random(4)
    rows = [(f"{s}{i}", prose(rng, rng.randrange(1, 30)), s) for s, n in {"big": 200, "mid": 60, "low": 15}.items() for i in range(n)]
    rows += [("void1", "", "none"), ("void2", None, "none")]
    budget = 9000
    found = mix_sources(spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(4), max_repeats=4.0,
                        budget=budget, block_tokens=100).collect()
    tokens = {i: len((t or "").split()) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += tokens[i]
    whole = sum(total.values())

    def weights(power):
        a = {s: (t / whole) ** power for s, t in total.items() if t}
        return {s: v / sum(a.values()) for s, v in a.items()}

    def most(power):
        repeats = [w / total[s] for s, w in weights(power).items()]
        return max(repeats) / min(repeats)

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if most(middle) <= 4 else (middle, high)
    expected = weights(high)
    by_source = defaultdict(list)
    for r in found:
        by_source[r.source].append(r)
        assert r.n_tokens == tokens[r.doc_id] and r.weight == pytest.approx(expected.get(r.source, 0), abs=1e-6)
    assert sorted(r.doc_id for r in by_source["none"]) == ["void1", "void2"]
    for source, t in total.items():
        if not t:
            continue
        repeats = budget * by_source[source][0].weight / t
        epochs = math.floor(round(repeats, 9))
        part = round((round(repeats, 9) - epochs) * t)
        ids = {i for i, _, s in rows if s == source}
        uses = [r for r in by_source[source] if r.epoch == epochs]
        for e in range(epochs):
            assert sorted(r.doc_id for r in by_source[source] if r.epoch == e) == sorted(ids)
        # the last epoch takes documents in its order until the budget is met, and no more
        order = sorted(uses, key=lambda r: (r.block_order, r.block, r.doc_order, r.doc_id))
        taken = [r.n_tokens for r in order]
        assert sum(taken) >= part and (not taken or sum(taken) - min(taken[-1:]) < part or sum(taken) - max(taken) < part)
        assert all(r.epoch <= epochs for r in by_source[source])
        assert len({(r.doc_id, r.epoch) for r in by_source[source]}) == len(by_source[source])
