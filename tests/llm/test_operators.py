"""The training-data operators against brute force, on small tables with awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metaudit.llm import decontamination, jaccard_join, ngram_lm, token_counts
from metaudit.llm.decontamination import contamination, drop_contaminated
from metaudit.llm.jaccard_join import CountTree, one_of_each, similar, similar_groups
from metaudit.llm.language_id import language_ids
from metaudit.llm.ngram_lm import lm_scores
from metaudit.llm.quality_classifier import keep_good, quality_scores
from metaudit.llm.quality_rules import MAX_COVERAGE, repetition_rules
from metaudit.llm.source_mixing import mix_sources
from metaudit.llm.substring_dedup import drop_repeated_passages
from metaudit.llm.url_filters import judge_urls
from metaudit.llm.words import sliced

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = ["river", "stone", "Äpfel", "blue", "corn", "é", "walk", "MIXED", "of", "the", "night,", "day.", "#tag", "x"]


def prose(rng, n, words=None):
    return " ".join(rng.choice(words or VOCABULARY) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


def awkward_texts():
    rng = random.Random(5)
    passage = prose(rng, 70)
    base = prose(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    lines = "\n".join(["one line here", "another line there", "one line here", " ", " ", "one line here\r"])
    return [
        None, "", " \n\t ", "x", "one two three four", "one two three four", base, " ".join(near), base, base + "\n",
        prose(rng, 40) + " " + passage + " " + prose(rng, 30), passage, prose(rng, 25) + "\n" + passage, "be " * 90,
        prose(rng, 3000), lines, "ééé üü ü ñ", "1234 5678 !!", "UPPER lower Upper", "a\x1cb\x0bc\x0cd", passage.upper(),
        "the of " * 30 + passage, prose(rng, 19), prose(rng, 20), prose(rng, 21),
    ]


@pytest.fixture(scope="module")
def texts():
    return awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids with a null and a repeated row, and columns whose names the operators use inside."""
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, i, "clash") for i, t in enumerate(texts)]
    rows += [rows[6], (None, "null id has a text of its own with enough words to be counted", "s1", 0, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, id string").repartition(4)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_words_are_those_of_the_pattern(texts):
    for limit in (1, 50, 1 << 20):
        found = []
        for _, _, part in sliced(pa.array(texts).slice(1), limit=limit):
            for d in range(part.n):
                at = range(part.first[d], part.first[d + 1])
                found.append([part.data[part.starts[w]:part.ends[w]].tobytes().decode() for w in at])
        assert found == [words(t) for t in texts[1:]]


def in_repeats(ws, n):
    at = {}
    for i in range(len(ws) - n + 1):
        at.setdefault(tuple(ws[i:i + n]), []).append(i)
    return {i + k for places in at.values() if len(places) > 1 for i in places for k in range(n)}


def test_quality_rules(docs, texts, empty):
    found = repetition_rules(docs).collect()
    assert len(found) == len(texts) + 2
    for i, r in by_id(found).items():
        if i is None:
            continue
        text, ws = texts[i] or "", words(texts[i])
        lines = [x for x in text.split("\n") if words(x)]
        chars = sum(map(len, ws))
        repeat = len(in_repeats(ws, 8))
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(ws), chars, repeat)
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        failed = len(ws) < 20 or 100 * repeat > 30 * len(ws)
        kept = not failed
        for n, most in MAX_COVERAGE.items():
            share = sum(len(ws[k]) for k in in_repeats(ws, n)) / max(chars, 1)
            assert r[f"coverage_{n}"] == pytest.approx(share)
            kept = kept and share <= most
        again = sum(len("".join(words(x))) * (c - 1) for x, c in Counter(lines).items()) / max(chars, 1)
        assert r["line_coverage"] == pytest.approx(again)
        assert (r["base_failed"], r["kept"]) == (failed, kept and again <= 0.3)
    assert repetition_rules(empty).count() == 0


def greedy(pieces, text):
    count, i, most = 0, 0, max(map(len, pieces))
    while i < len(text):
        size = next((k for k in range(min(most, len(text) - i), 1, -1) if text[i:i + k] in pieces), 1)
        count, i = count + 1, i + size
    return count


def test_token_counts(docs, texts, empty):
    rng = random.Random(1)
    pieces = {("▁" + w)[:k].encode() for w in VOCABULARY for k in (2, 4, 6)} | {w[a:a + k].encode() for w in VOCABULARY
                                                                          for a in range(len(w)) for k in (2, 3, 5)}
    pieces |= {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))) for _ in range(60)}
    for r in token_counts.token_counts(docs, pieces=sorted(pieces)).collect():
        if r["doc_id"] is not None:
            ws = words(texts[r["doc_id"]])
            assert r["n_words"] == len(ws)
            assert r["n_pieces"] == sum(greedy(pieces, ("▁" + w).encode()) for w in ws)
    assert token_counts.token_counts(empty, pieces=[b"a"]).count() == 0


def test_token_automaton_on_random_bytes():
    rng = random.Random(2)
    pieces = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 9))) for _ in range(40)}
    machine = token_counts.build(sorted(pieces))
    text = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    data = np.frombuffer(b"".join(text), np.uint8)
    ends = np.cumsum([len(t) for t in text])
    got = token_counts.piece_counts(machine, data, ends - [len(t) for t in text], ends, b"")
    assert got.tolist() == [greedy(pieces, t) for t in text]


@pytest.mark.parametrize("shard_bytes", [1 << 28, 4000])
def test_lm_scores(docs, texts, empty, shard_bytes):
    """Exact base scores, one row out per row, the same by one shard and by many."""
    training = docs.where("doc_id % 3 <> 0")
    chosen = [t for i, t in enumerate(texts) if i % 3] + ([] if 6 % 3 == 0 else [texts[6]])
    counts = Counter(w for t in chosen for w in [*words(t, lower=True), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    found = lm_scores(docs, training, shard_bytes=shard_bytes, bytes_per_cell=2000).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        if r["doc_id"] is None:
            continue
        tokens = [*words(texts[r["doc_id"]], lower=True), "\n"]
        assert (r["n_tokens"], r["train_tokens"]) == (len(tokens), total)
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens))
        assert -1e9 < r["score"] < 0
    whole = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in found)
    assert whole == sorted((str(r["doc_id"]), round(r["score"], 6)) for r in lm_scores(docs, training, bytes_per_cell=2000).collect())
    assert lm_scores(empty, empty).count() == 0
    assert all(math.isfinite(r["score"]) for r in lm_scores(docs, empty).collect())


def test_log_frequency_filter():
    """Quantised counts are never too low; few n-grams that were not counted are found."""
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 20000).astype(np.uint64) * np.uint64(2)
    counts = rng.geometric(0.3, 20000)
    held = ngram_lm.joined([ngram_lm.filter_bits(keys, counts).tobytes()], 1, 0)
    level = held.level(keys)
    assert (level >= ngram_lm.levels(counts)).all() and (level == ngram_lm.levels(counts)).mean() > 0.95
    assert (held.level(keys + np.uint64(1)) > 0).mean() < 0.03


def test_quality_classifier(spark, empty):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(5, 200)) if i % 3 else " ".join(["BAD!!"] * rng.randrange(5, 200))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "a null id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(7, None), (8, 5), (None, 1)],
                                   "doc_id long, quality int")
    found = quality_scores(docs, labels).collect()
    assert len(found) == 303 and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["doc_id"] is not None and 200 <= r["doc_id"] < 300]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 99
    kept = {r["doc_id"] for r in keep_good(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in found if r["predicted"]}
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_language_ids(spark):
    rng = random.Random(4)
    stems = {"aa": ["kato", "milu", "sane", "toro"], "bb": ["grücht", "schwen", "pfalk", "zwist"], "cc": ["the", "wing", "sought", "shy"]}
    rows = [(i, prose(rng, 30, stems[lang]), lang) for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", None), (902, "12 !?", "bb"), (903, "жук", None), (None, "kato milu", "aa")],
                                 "doc_id long, text string, lang string")
    found = language_ids(docs, docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), sample_per_language=30)
    rows = by_id(found.collect())
    assert len(rows) == 245
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(rows[i]["lang_pred"] == ["aa", "bb", "cc"][i % 3] for i in held) >= 0.95 * len(held)
    for i in (900, 901, 902):
        assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
    assert rows[903]["lang_pred"] in stems and rows[903]["rejected"] and not rows[0]["rejected"]
    assert {r["lang_pred"] for r in language_ids(docs, docs.limit(0)).collect()} == {"und"}
    assert language_ids(docs.limit(0), docs).count() == 0


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, "allow"))


def test_url_filters(spark):
    rng = random.Random(6)
    labels, paths = ["a", "b", "com", "ex", "ample"], ["", "/", "/a", "/a/", "/a/b", "/ab", "/é/", "/a/b/c/"]
    rules = {(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(paths)): rng.choice(["allow", "block"])
             for _ in range(40)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [rng.choice(["http", "https", "HTTP"]) + "://" + ".".join(rng.choice([*labels, "A", "x"]) for _ in range(rng.randrange(1, 5)))
            + rng.choice([*paths, "/z", "?a=/a", "#/a/b", "/a/b?q", "/a/b/c/d/\U0010ffffé"]) for _ in range(400)]
    urls += [None, "", "no scheme/a", "://", "http://", "http:///a", urls[0], urls[0], "http://a.com://b"]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block"), ("nul", None, "block"), ("x", "/", None)],
                                  "host string, path string, verdict string")
    expected = sorted(map(str, [(i if i % 50 else None, *brute_rule(u, [*rules, ("nul", "", "block")])) for i, u in enumerate(urls)]))
    for parts in (1, 5, 64):
        got = judge_urls(pages, given, parts=parts).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(str(tuple(r)) for r in got) == expected
    assert judge_urls(pages.limit(0), given).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, given.limit(0), default="block").collect()} == {"block"}


def brute_groups(texts):
    sets = {}
    for i, t in texts:
        ws = words(t, lower=True)
        sets[i] = {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[k:k + 5]) for k in range(len(ws) - 4)}
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in sets}


def families(rng):
    """Near copies of a few texts with more and more changes, a passage many share, and exact copies."""
    out, common = [], prose(rng, 30)
    for _ in range(3):
        base = prose(rng, 80).split(" ")
        for _ in range(18):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(80)] = f"new{rng.randrange(1000)}"
            out.append(" ".join(own))
    out += [common + " " + prose(rng, 40) for _ in range(20)] + out[:5]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small,block", [(64, 1024), (2, 7)])
def test_similar_groups(spark, docs, texts, empty, monkeypatch, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", small)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", block)
    expected = brute_groups(list(enumerate(texts)))
    found = similar_groups(docs).collect()
    assert len(found) == len(texts) + 2
    assert all((r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] for r in found if r["doc_id"] is not None)
    made = families(random.Random(8))
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    expected = brute_groups(list(enumerate(made)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_groups(table).collect()} == expected
    kept = [r["doc_id"] for r in one_of_each(table).collect()]
    assert sorted(kept) == sorted({low for _, low in expected.values()})
    assert similar_groups(empty).count() == 0 and one_of_each(empty).count() == 0


def test_count_tree_loses_nothing():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (500, 32)) * rng.integers(1, 4, (500, 1))
    sizes = points.sum(1)
    tree = CountTree(points, sizes)
    for q in range(0, 500, 9):
        bound = np.minimum(points, points[q]).sum(1)
        assert set(tree.search(points[q], sizes[q], 80)) == set(np.flatnonzero(similar(bound, sizes, sizes[q], 80)))


def brute_cut(rows):
    first, out = {}, {}
    for i, t in rows:
        for a in range(len(words(t)) - 19):
            key = tuple(words(t)[a:a + 20])
            first[key] = min(first.get(key, (i, a)), (i, a))
    for i, t in rows:
        ws, gone = words(t), set()
        for a in range(len(ws) - 19):
            if first[tuple(ws[a:a + 20])] < (i, a):
                gone |= set(range(a, a + 20))
        out[i] = (len(ws), len(gone), [w for k, w in enumerate(ws) if k not in gone])
    return out


def test_substring_dedup(spark, docs, texts, empty):
    for rows, table in ((list(enumerate(texts)), docs),
                        (pairs := list(enumerate(families(random.Random(9)))), spark.createDataFrame(pairs, "doc_id long, text string"))):
        expected = brute_cut(rows)
        found = drop_repeated_passages(table.repartition(5)).collect()
        assert len(found) == table.count()
        for r in found:
            if r["doc_id"] is not None:
                assert (r["n_words"], r["n_removed"], words(r["text"])) == expected[r["doc_id"]]
                if not r["n_removed"]:
                    assert r["text"] == dict(rows)[r["doc_id"]]
    assert drop_repeated_passages(empty).count() == 0


def edit_distance_inside(pattern, text):
    """Fewest edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, docs, empty):
    rng = random.Random(10)
    items = [(k, prose(rng, n)) for k, n in enumerate([40, 25, 14, 3, 60])] + [(90, None), (91, ""), (92, "ab"), (40, prose(rng, 30))]
    noise = prose(random.Random(77), 50, ["lorem", "ipsum", "dolor", "sit", "amet"])

    def edited(text, n):
        out = list(text)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice("qz")
        return "".join(out)

    made = [noise, noise + " " + items[0][1] + " " + noise, items[1][1].upper().replace(" ", "\n "), noise + edited(items[4][1], 6) + noise,
            noise + " " + items[0][1][20:170] + " " + noise, None, "", items[2][1], noise + items[0][1] + items[1][1], edited(items[4][1], 120)]
    table = spark.createDataFrame([*enumerate(made), (1, made[1]), (None, made[7])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def clean(text):
        return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", text.lower()).strip().encode()

    expected = {}
    for i, t in enumerate(made):
        hit = set()
        for k, item in items:
            p = clean(item or "")
            if len(p) < decontamination.Q or not t:
                continue
            starts = sorted({min(s, max(len(p) - 80, 0)) for s in range(0, len(p), 40)})
            size = min(len(p), 80)
            most = min(decontamination.EDITS * size // 80, max(size // decontamination.Q - 1, 0))
            if any(edit_distance_inside(p[s:s + 80], clean(t)) <= most for s in starts):
                hit.add(k)
        expected[i] = sorted(hit)
    assert expected[1] == [0] and expected[3] == [4] and expected[0] == [] and 0 in expected[4]
    for block_bytes in (1 << 20, 300):
        found = contamination(table, bench, block_bytes=block_bytes).collect()
        assert len(found) == 12
        assert all(r["item_ids"] == expected[r["doc_id"]] for r in found if r["doc_id"] is not None)
        kept = [r["doc_id"] for r in drop_contaminated(table, bench, block_bytes=block_bytes).collect()]
        assert sorted(kept) == [i for i in expected if not expected[i]]
    assert contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in contamination(docs, bench.limit(0)).collect())


def found_in(items, texts):
    """Pairs (text, item) that the search over one block gives."""
    block = decontamination.index(list(range(len(items))), items)
    return {(i + t, k) for i, _, part in sliced(pa.array(texts)) for t, k in decontamination.hits(part, block)}


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))


def with_edits(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "#", text[at] + "#"]).replace("#", rng.choice("jkqxz")) + text[at + 1:]
    return text


def test_decontamination_finds_quotes_that_begin_anywhere():
    rng = random.Random(12)
    item = letters(rng, 300)
    quotes = [item[s:s + n] for n in (80, 85, 104) for s in range(300 - n + 1)]
    texts = [letters(rng, rng.randrange(60)) + q + letters(rng, rng.randrange(60)) for q in quotes]
    assert found_in([item, letters(rng, 200)], texts) == {(t, 0) for t in range(len(texts))}
    assert found_in([item], [letters(rng, 40) + item[100:165] + letters(rng, 40)]) == set()


def test_decontamination_against_every_fragment():
    rng = random.Random(13)
    items = [letters(rng, n) for n in (110, 90, 81, 80, 60, 20, 9)] + ["be " * 33]
    made = []
    for _ in range(50):
        item = rng.choice(items)
        s = rng.randrange(max(len(item) - 80, 0) + 1)
        made.append(letters(rng, rng.randrange(30)) + with_edits(rng, item[s:s + rng.choice([80, 84])], rng.randrange(11)) + letters(rng, rng.randrange(30)))
    expected = set()
    for t, text in enumerate(made):
        for k, item in enumerate(x.strip() for x in items):
            size = min(len(item), 80)
            most = min(decontamination.EDITS * size // 80, max(size // decontamination.Q - 1, 0))
            if any(edit_distance_inside(item[s:s + 80].encode(), text.strip().encode()) <= most for s in range(len(item) - size + 1)):
                expected.add((t, k))
    assert 20 < len(expected) < 50
    assert found_in(items, made) == expected


def test_decontamination_finds_the_edited_tail_of_an_item():
    rng = random.Random(14)
    for n in (90, 95, 135, 170):
        item = letters(rng, n)
        texts = []
        for k in range(300):
            tail = list(item[n - 80:])
            for at in rng.sample(range(80), 5 + k % 3):
                tail[at] = rng.choice([c for c in "jkqxz" if c != tail[at]])
            texts.append(letters(rng, 100) + "".join(tail) + letters(rng, 20))
        assert found_in([item], texts) == {(t, 0) for t in range(300)}


def test_decontamination_splits_the_hits_of_one_text(monkeypatch):
    rng = random.Random(15)
    common = letters(rng, 60)
    items = [letters(rng, 90) + common + letters(rng, 90) for _ in range(30)] + ["be " * 60, letters(rng, 3000)]
    long = [common] * 100 + ["be " * 2000, items[31][1400:1480], items[31][-80:], with_edits(rng, items[29][:85], 4)]
    long += [x[s:s + 80] for x in items[:20] for s in (0, 30, 140, 160)]
    rng.shuffle(long)
    texts = [" ".join(long), letters(rng, 30) + items[3][20:105], " ".join([common] * 300)]
    expected = found_in(items, texts)
    assert {(0, k) for k in (*range(20), 29, 30, 31)} <= expected and (1, 3) in expected and (0, 25) not in expected
    sizes, whole = [], decontamination.regions
    monkeypatch.setattr(decontamination, "regions", lambda found, text, *a: sizes.append(len(text)) or whole(found, text, *a))
    assert found_in(items, texts) == expected
    assert max(sizes) > 40_000
    sizes.clear()
    monkeypatch.setattr(decontamination, "MOST_HITS", 40_000)
    assert found_in(items, texts) == expected
    assert max(sizes) <= 40_000


@pytest.mark.parametrize("item,copy", [
    ("It's a \"small\" river - or so they say", "It’s a “small” river — or so they say…"),
    ("великая река течет", "ВЕЛИКАЯ «РЕКА» ТЕЧЕТ"),
    ("ο μεγάλος ποταμός εδώ", "Ο ΜΕΓΆΛΟΣ ΠΟΤΑΜΌΣ ΕΔΏ"),
    ("długa żółta rzeka płynie", "DŁUGA ŻÓŁTA RZEKA PŁYNIE"),
    ("नदी बहती है", "नदी, बहती है।"),
])
def test_decontamination_sees_no_case_or_punctuation_in_any_script(item, copy):
    def same(text):
        data, offsets = decontamination.plain(next(sliced(pa.array(text)))[2])
        return [data[a:b].tobytes().strip() for a, b in zip(offsets, offsets[1:])]

    one, other = same(["", item, "x"]), same(["", copy, "x"])
    assert one == other and one[1] and one[2] == b"x"
    assert found_in([item], ["", "one two three " + copy + " four", "five"]) == {(1, 0)}


def test_decontamination_takes_broken_text():
    raw = "café ".encode() * 3 + b"\xff\xc3 river stone, blue corn"
    column = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int32)), pa.py_buffer(raw)])
    block = decontamination.index([7], ["River stone blue corn"])
    assert decontamination.hits(next(sliced(column))[2], block).tolist() == [[0, 0]]


def test_source_mixing(spark, docs, empty):
    sizes = {"big": 400, "mid": 100, "small": 20, None: 10}
    rng = random.Random(11)
    rows = [(f"{s}-{i}", prose(rng, 10), s) for s, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame([*rows, ("void", None, "none")], "doc_id string, text string, source string")
    found = mix_sources(table, max_repeats=4.0, block_tokens=200).toPandas()
    total = {s or "": 10 * n for s, n in sizes.items()}
    used = found.groupby("source").n_tokens.sum()
    weights = found.groupby("source").weight.first()
    assert set(found.doc_id) == {r[0] for r in rows} | {"void"}  # nothing is dropped
    assert weights.sum() == pytest.approx(1)
    repeats = {s: used[s] / t for s, t in total.items()}
    assert repeats["big"] == 1 and repeats[""] == pytest.approx(4, abs=0.11) and repeats["mid"] < repeats["small"] < repeats[""]
    for s, t in total.items():
        assert used[s] / used.sum() == pytest.approx(weights[s], abs=0.01), (s, t)
    assert not found.duplicated(["doc_id", "epoch"]).any()
    # an epoch is whole before the next begins, and blocks stay together in the order
    for (s, e), part in found.groupby(["source", "epoch"]):
        if e < found[found.source == s].epoch.max():
            assert part.n_tokens.sum() == total.get(s, 0)
    assert found.groupby(["source", "epoch", "block"]).block_order.nunique().max() == 1
    capped = mix_sources(table, budget=1000, target_entropy=1.0, block_tokens=50).toPandas()
    assert capped.n_tokens.sum() == pytest.approx(1000, abs=60)
    w = capped.groupby("source").weight.first()
    assert -(w[w > 0] * np.log(w[w > 0])).sum() == pytest.approx(1.0, abs=0.05)
    assert mix_sources(empty).count() == 0
    assert mix_sources(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        assert docs.columns == columns and {r["doc_id"] for r in rows} <= set(before)
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in rows}


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage, over what the one before kept: ids, texts and all other columns."""
    import corpus_pipeline

    rng = random.Random(16)
    items = [(0, letters(rng, 120)), (1, letters(rng, 40)), (2, letters(rng, 90))]
    made = families(rng)[:40] + ["BAD!! " * rng.randrange(20, 60) for _ in range(25)] + [prose(rng, n) for n in (4, 15, 60, 70)]
    passage = prose(rng, 45)
    made += [prose(rng, 20) + " " + passage + "\n" + prose(rng, 50) for _ in range(3)] + [passage]
    made += [prose(rng, 30) + " " + x + " " + prose(rng, 30) for x in (items[0][1][35:118], items[1][1].upper(), with_edits(rng, items[2][1], 5), items[0][1][:60])]
    rng.shuffle(made)
    rows = [(i, t, f"l{i % 4}", f"s{i % 3}" if i % 5 else None, len(t)) for i, t in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(not t.startswith("BAD"))) for i, t in enumerate(made)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def quality(before):
        return [r for r in before if good[r[0]]]

    def near_duplicates(before):
        low = brute_groups([r[:2] for r in before])
        return [r for r in before if low[r[0]][1] == r[0]]

    def repeated_passages(before):
        return [(r[0], cut[r[0]][2], *r[2:4]) for cut in [brute_cut([r[:2] for r in before])] for r in before]

    def decontaminate(before):
        def leaks(text, item):
            size = min(len(item), 80)
            most = min(decontamination.EDITS * size // 80, max(size // decontamination.Q - 1, 0))
            text = re.sub(r"[^a-zäé0-9]+", " ", text.lower()).encode()
            return any(edit_distance_inside(item[s:s + 80].encode(), text) <= most for s in range(0, len(item) - size + 1))
        return [r for r in before if not (set(r[1].split(" ")) & unusual and any(leaks(r[1], item) for _, item in items))]

    # the costly comparison is made only where there is a word that is not of the prose
    unusual = {w for t in made for w in t.split(" ") if len(w) > 20}
    good = {r["doc_id"]: r["predicted"] for r in quality_scores(docs, labels).collect()}
    dropped = []
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], (quality, near_duplicates, repeated_passages, decontaminate)):
        assert name == expected.__name__
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        after, wanted = [tuple(r) for r in out.collect()], expected(before)
        if name == "repeated_passages":
            assert sorted((r[0], words(r[1]), *r[2:4]) for r in after) == sorted(wanted, key=lambda r: r[0])
            assert all(r[4] == len(r[1]) for r in after)
            dropped.append(sum(len(words(r[1])) for r in before) - sum(len(words(r[1])) for r in after))
        else:
            assert sorted(after, key=lambda r: r[0]) == sorted(wanted, key=lambda r: r[0])
            dropped.append(len(before) - len(after))
        docs = spark.createDataFrame(after, docs.schema)
    assert all(dropped) and len(after) > 10
