"""Rows that share an id, null ids, renumbered ids and other partitions must not lose or change anything."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaudit.llm.jaccard_join import one_of_each, similar_groups
from metaudit.llm.language_id import language_ids
from metaudit.llm.source_mixing import mix_sources
from metaudit.llm.substring_dedup import drop_repeated_passages, parsed
from metaudit.llm.token_counts import build, long_word_count, piece_counts


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def same_in_any_partitions(make, table):
    results = [sorted(map(str, make(table.repartition(n)).collect())) for n in (1, 3, 7)]
    assert results[0] == results[1] == results[2]
    return results[0]


def test_only_the_text_with_the_window_is_cut(spark):
    rng = random.Random(1)
    passage, lead, unique = prose(rng, 40), prose(rng, 10), prose(rng, 120)
    rows = [(1, passage, 0), (5, f"{lead} {passage}", 1), (5, unique, 2), (None, f"{unique} {lead}", 3), (None, prose(rng, 60), 4), (9, unique, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row int")
    found = {r.others.row: r for r in drop_repeated_passages(table).collect()}
    assert [found[i].n_removed for i in range(6)] == [0, 40, 120, 0, 0, 120]  # a null id counts as the smallest
    assert found[1].text == lead and found[3].text == rows[3][1] and found[4].text == rows[4][1]
    same_in_any_partitions(drop_repeated_passages, table)


def test_versions_under_one_id(spark):
    rng = random.Random(2)
    passage = prose(rng, 30)
    rows = [(5, f"{passage} {prose(rng, 5)}", 0), (5, f"{prose(rng, 9)} {passage}", 1), (5, f"{passage} {prose(rng, 5)}", 2)]
    found = {r.others.row: r.n_removed for r in drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()}
    assert found == {0: 0, 1: 30, 2: 0}  # only the later word place of the same id is a repeat


def shared_texts(rng):
    """Texts made of parts of a few passages, some twice in one text, some with the start of the text before."""
    passages = [prose(rng, rng.randrange(22, 70)).split() for _ in range(6)]
    made = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 20)
            text += prose(rng, rng.randrange(40)).split() + p[a:a + rng.randrange(20, 70)]
        text += made[-1][:50] if made and i % 9 == 0 else []
        made.append(text + (text[:60] if i % 7 == 0 else []))
    return made


@pytest.mark.parametrize("named", [int, str])
def test_factors_name_where_their_words_stand_earlier(spark, named):
    texts = shared_texts(random.Random(6))
    name = (lambda i: i) if named is int else (lambda i: f"{i:03d}")
    rows = [(name(i), " ".join(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, f"doc_id {'long' if named is int else 'string'}, text string").repartition(3)
    seen, total = set(), 0
    found = {r.doc_id: r for r in drop_repeated_passages(table).collect()}
    for i, text in enumerate(texts):
        gone = set()
        for s in range(len(text) - 19):
            gone |= set(range(s, s + 20)) if tuple(text[s:s + 20]) in seen else set()
            seen.add(tuple(text[s:s + 20]))
        row, covered, last = found[name(i)], set(), -1
        for f in row.factors:
            assert f.words >= 20 and f.at > last and (f.ref, f.ref_at) < (name(i), f.at)
            assert text[f.at:f.at + f.words] == texts[int(f.ref)][f.ref_at:f.ref_at + f.words]
            covered |= set(range(f.at, f.at + f.words))
            last = f.at
        assert covered == gone and row.n_removed == len(gone) and row.n_factors == len(row.factors)
        total += row.n_factors
    assert total > 150


def test_a_parse_takes_what_reaches_farthest():
    at, n, ref, ref_at = (np.array(x) for x in ([0, 2, 1, 3, 40], [2, 3, 1, 30, 1], [7, 7, 8, 9, 7], [10, 12, 0, 100, 0]))
    assert parsed(at, n, ref, ref_at) == [(0, 5, 0, 10), (5, 28, 3, 102), (40, 1, 4, 0)]
    same = np.zeros(5000, np.int64)
    assert parsed(np.arange(5000), same + 1, same, np.arange(5000) + 9) == [(0, 5000, 0, 9)]


def test_a_long_word_takes_time_in_proportion():
    rng = random.Random(7)
    automaton = build([w.encode() for w in ("ab", "abc", "cab", "é", "xyz", "aaaa", "caba")])
    words = ["".join(rng.choice("abcéxyz") for _ in range(n)).encode() for n in (1, 500, 520, 3000)]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    one_by_one = [long_word_count(automaton, b"_" + w) for w in words]
    assert piece_counts(automaton, data, starts, ends, b"_").tolist() == one_by_one
    long = "".join(rng.choice("abcéxyz") for _ in range(400_000)).encode()
    begin = time.perf_counter()
    piece_counts(automaton, np.frombuffer(long, np.uint8), np.array([0]), np.array([len(long)]), b"_")
    assert time.perf_counter() - begin < 2


def test_one_of_each_judges_rows_not_ids(spark):
    rng = random.Random(3)
    a, b, c = (prose(rng, 30) for _ in range(3))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (6, b + " more", "x"), (None, a, "x"), (7, None, "x"), (7, "", "x"),
            (7, " ", "x"), (8, c, "x"), (8, c.upper(), "x"), (3, c + " end", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(table.repartition(4)).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (None, a), (7, None), (7, ""), (7, " "), (3, c + " end")], key=str)
    same_in_any_partitions(one_of_each, table)


def test_hot_classes_and_components(spark, monkeypatch):
    from metaudit.functions import joins
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    rng = random.Random(4)
    base = prose(rng, 60).split()
    rows = []
    for i in range(90):  # one class holds a third of the rows, one component two thirds
        words = list(base)
        if i % 3 == 1:
            words[59] = f"own{i}"
        rows.append((i, " ".join(words) if i % 3 < 2 else prose(rng, 20)))
    found = similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 0 if i % 3 < 2 else i for i in range(90)}
    assert {r.doc_id: r.n_copies for r in found} == {i: 30 if i % 3 == 0 else 1 for i in range(90)}


def test_mixing_does_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(7, prose(rng, rng.randrange(1, 40)), "a") for _ in range(300)] + [(i, prose(rng, 10), "b") for i in range(20)]
    rows += [(None, prose(rng, 5), None)] * 3 + [(i, None, "empty") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = same_in_any_partitions(lambda t: mix_sources(t, budget=9000, block_tokens=3000), table)
    assert len(found) >= len(rows)


def test_language_does_not_depend_on_ids(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10 ** 5 + i, rows[3][1], rows[3][2]) for i in range(300)]  # copies of one text count once
    results = []
    for shift, parts in ((0, 4), (10 ** 6, 3)):
        table = spark.createDataFrame([(i + shift, t, x) for i, t, x in rows], "doc_id long, text string, lang string").repartition(parts)
        training = table.where((F.col("doc_id") - shift) % 5 != 0)
        results.append({r.doc_id - shift: (r.lang_pred, r.score, r.rejected) for r in language_ids(table, training, sample_per_language=20).collect()})
    assert results[0] == results[1]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(None, "", "en", None, 0), (3, None, None, "s", None)]])
def test_pipeline_of_awkward_tables(spark, tmp_path, rows):
    """No rows, or rows without id and text: every stage runs, and rows without words are never copies."""
    import corpus_pipeline
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, str(tmp_path)).count() == len(rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(rows)
