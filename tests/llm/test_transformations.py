"""Fill-in-middle, the conversation trie and personal data, against brute force on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaudit.functions import joins
from metaudit.llm import conversation_trie
from metaudit.llm import fill_in_middle as fim
from metaudit.llm.boosting import boosted, calibrated_threshold
from metaudit.llm.conversation_trie import digested, joined_ends, prefix_trie
from metaudit.llm.personal_data import KINDS, candidates, luhn, personal_spans, rule_spans
from metaudit.llm.queries import grafted, op13_personal_data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-middle

def plain_fim(doc_id, text):
    t = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    pre, mid, suf = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return len(t), "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def fim_texts():
    rng = random.Random(3)
    letters = "abc é ß 中 😀 <P <S> M> \n"
    texts = [None, "", "x", "é", "<P>", "a<S>b", "<P", "P>", "<", "<<M", "😀" * 500, "a" * 30000, "né" * 20000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(2000))).replace("<S>", "<S ") for _ in range(40)]
    texts.append("".join(rng.choice("abcdé中 ") for _ in range(1_300_000)))  # beyond one slice and one hash block
    shared = "".join(rng.choice("abcdefgh ") for _ in range(20000))
    return texts + [shared, "xy" + shared, shared + "é"]


def test_fim_equals_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(fim_texts())]
    rows += [rows[20], (None, "a text of its own", "clash", 1), (20, "another text under that id", "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, h1 int").repartition(3)
    made = fim.fill_in_middle(docs)
    found = [tuple(r) for r in made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()]
    wanted = [(i, *plain_fim(i, t), t or "") for i, t, _, _ in rows]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_fim_of_an_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("border", range(1, 6))
def test_sentinel_across_chunks(border):
    text = b"ab<P>cd"
    assert fim.chunked(text, [border, len(text)], fim.ChunkCache()).marked
    assert not fim.chunked(b"ab<P cd", [border, 7], fim.ChunkCache()).marked
    assert fim.chunked(text, [1, 2, 3, 4, 5, 6, 7], fim.ChunkCache()).marked


def test_chunks_depend_on_content_alone_and_are_reused():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 105, 60000, dtype=np.uint8).tobytes()
    cut = lambda t: [e for e in fim.chunk_ends(fim.chunk_marks(np.frombuffer(t, np.uint8)), 0, len(t))]
    pieces = lambda t: {t[a:b] for a, b in zip([0, *cut(t)], cut(t))}
    assert len(pieces(body) & pieces(b"something before" + body)) > 0.9 * len(pieces(body))
    both = body + body  # the second copy is cut alike wherever it stands
    marks = fim.chunk_marks(np.frombuffer(both, np.uint8))
    assert fim.chunk_ends(marks, len(body), len(both)) == [e + len(body) for e in cut(body)]
    cache = fim.ChunkCache()
    fim.chunked(body, cut(body), cache)
    size = len(cache.known)
    fim.chunked(body, cut(body), cache)
    assert len(cache.known) == size


def test_cache_is_bounded_and_changes_nothing(spark, monkeypatch):
    text = "".join(random.Random(4).choice("abcé") for _ in range(50000))
    raw = text.encode()
    ends = fim.chunk_ends(fim.chunk_marks(np.frombuffer(raw, np.uint8)), 0, len(raw))
    monkeypatch.setattr(fim, "CACHE_BYTES", 5000)
    cache = fim.ChunkCache()
    found = fim.chunked(raw, ends, cache)
    assert found.n == len(text) and cache.held <= 5000 + fim.MOST
    assert all(found.byte_at(p) == len(text[:p].encode()) for p in range(0, len(text) + 1, 997))


# Conversation trie

def trie_of(convs):
    """Nodes by brute force from {conv_id: [(role, text), ...]}."""
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    worth = {p: (len(m) - 1) * (len(WORD.findall(p[-1][1])) if p else 0) for p, m in members.items()}
    leaves, saved_ = Counter(), Counter()
    for path in members:
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved_[path[:d]] += worth[path]
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved_[p],
                   sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)))) for p, m in members.items())


def nodes_of(turns, members, **options):
    nodes, ends = prefix_trie(turns, members, **options)
    ids = {(r.conv_id, r.depth): r.ids for r in joined_ends(ends, 16).collect()}
    result = []
    for r in nodes.collect():
        own = str(r.conv_id) if r.n_ends else ""
        text = own if r.n_convs == 1 else ids.get((r.conv_id, r.depth), "")
        assert r.n_ends == (len(text.split(",")) if text else 0)
        result.append((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, sha(text)))
    return sorted(result, key=lambda r: (r[0], r[1]))


def conversations(rng, n):
    """Turns with shared heads, whole copies, proper prefixes of others, ties, null turns, roles and texts."""
    heads = [[("system", f"be  {i}"), ("user", "hello\tthere")] for i in range(3)]
    rows = []
    for c in range(n):
        turns = list(rng.choice(heads))[:rng.randrange(3)]
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "", "the same text"])) for _ in range(rng.randrange(5))]
        numbers = sorted(rng.choice([None, 0, 1, 1, 2, 5]) or -1 for _ in turns)
        rows += [(c, None if k < 0 else k, r, t) for k, (r, t) in zip(numbers, turns)]
    return rows


def ordered(rows):
    """Turns by conversation: null turns first, ties by the SHA-256 of role and text."""
    convs = defaultdict(list)
    for c, k, r, t in rows:
        r, t = r or "", t or ""
        convs[c].append((k is not None, k or 0, sha(f"{len(r)}:{r}{t}"), (r, t)))
    return {c: [x[-1] for x in sorted(v)] for c, v in convs.items()}


def as_table(spark, rows):
    schema = "conv_id long, turn long, role string, text string, key string, conv int"
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], schema).repartition(5)


@pytest.mark.parametrize("options", [{}, {"sketch_cells": 16}])
def test_trie_equals_brute_force(spark, options):
    rows = conversations(random.Random(2), 90)
    turns = digested(as_table(spark, rows + [(None, 1, "user", "nobody's")]))
    found = nodes_of(turns, turns.select("conv"), **options)
    assert found == trie_of(ordered(rows))


def test_small_sketch_only_shuffles_more(spark):
    rows = [(c, k, "user", f"{c} {k}") for c in range(300) for k in range(4)]
    prefixes = conversation_trie.prefix_digests(digested(as_table(spark, rows))).cache()
    lone = [conversation_trie.screened(prefixes, bits).where("alone").count() for bits in (16, 9)]
    assert lone[0] > 1190 and lone[1] < lone[0]


def test_long_conversations_are_scanned_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 4)
    rng = random.Random(8)
    long = [("user", f"word {rng.randrange(3)}") for _ in range(30)]
    convs = {1: long, 2: long[:17], 3: long[:17] + long[:9], 4: long[:8], 5: long, 6: [("user", "word 9")], 9: long[:20] + long}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    turns = digested(as_table(spark, rows))
    assert nodes_of(turns, turns.select("conv")) == trie_of(convs)


def test_hot_prefixes(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEYS", 5)
    convs = {c: [("system", "one"), ("user", f"{c % 4}"), ("user", f"{c}")][:1 + c % 3] for c in range(200)}
    turns = digested(as_table(spark, [(c, k, r, t) for c, v in convs.items() for k, (r, t) in enumerate(v)]))
    assert nodes_of(turns, turns.select("conv")) == trie_of(convs)


def test_grafted_heads_and_turnless_conversations(spark):
    rows = [r for r in conversations(random.Random(6), 70) if r[0] != 40]  # 41 to 59 have no base
    rows += [(47, 0, "user", "only one"), (58, 0, "user", "one"), (59, 3, "user", "one")]
    own = ordered(rows)
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in convs.values())
    turns, members = grafted(digested(as_table(spark, rows)))
    assert nodes_of(turns, members) == trie_of(convs)


def test_trie_of_no_conversations(spark):
    turns = digested(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    nodes, ends = prefix_trie(turns, turns.select("conv"))
    assert nodes.collect() == [] and ends.collect() == []


# Personal data

PLAIN = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == 2 and 16 <= len(digits) <= 19 and checksum(digits) or kind == 3 and 8 <= len(digits) <= 15):
                found.append((kind, *m.span()))
    return found


def checksum(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    return next(s for s in ("".join(map(str, [*body, d])) for d in range(10)) if checksum(s))


def phone(rng):
    return f"+1 ({rng.randrange(1000):03d}) 555-{rng.randrange(10000):04d}"


def address(rng):
    return ".".join(str(rng.randrange(256)) for _ in range(4))


def sentence(rng, n=12):
    return " ".join(rng.choice(["the", "river", "is", "blue", "at", "noon", "élan", "walks."]) for _ in range(n))


MAKERS = {"email": lambda r: f"joe.{r.randrange(100)}@mail{r.randrange(9)}.example.com", "ip": address, "card": card, "phone": phone}


@pytest.fixture(scope="module")
def told(spark):
    """Texts with plain spans to learn from, spans that rules miss, and harmless numbers."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        kind = rng.choice(KINDS)
        rows.append(f"{sentence(rng)} {MAKERS[kind](rng)} {sentence(rng)}")
    for i in range(300):
        bad = card(rng)
        bad = bad[:-1] + str((int(bad[-1]) + 1 + rng.randrange(8)) % 10)
        rows.append(f"{sentence(rng)} {rng.choice([bad, str(rng.randrange(10 ** 9)), f'{rng.randrange(300, 999)}.1.2.3', '12.5', 'at noon.It'])} {sentence(rng)}")
    base = len(rows)
    hidden = {}
    for maker in (lambda: card(rng) + " " + card(rng), lambda: phone(rng) + " " + address(rng)):
        for _ in range(10):
            hidden[len(rows)] = 1
            rows.append(f"{sentence(rng)} {maker()} {sentence(rng)}")
    for form in ("joe(at)mail.example.com", "ann at mail dot example dot com", "10[.]20[.]30[.]40", "(017) 555-1234"):
        hidden[len(rows)] = 1
        rows.append(f"{sentence(rng)} {form} {sentence(rng)}")
    rows += [None, "", "no numbers here", "1" * 5000, "1.2.3.4." * 200, "@" * 300, "a@b@c.de", "+1" * 50, "é+49 (30) 1234 5678é"]
    return rows, base, hidden, spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)] + [(None, rows[0], "clash"), (0, rows[1], "clash")],
                                                     "doc_id long, text string, spans string").repartition(4)


def test_rules_equal_their_patterns():
    rng = random.Random(1)
    parts = ["1", "25", "255", "256", "007", ".", "@", "+", " ", "-", "(", ")", "a", "b.c", "@x.y", "4539578763621486",
             "4111 1111 1111 1111", "+1 (017) 555-1234", "1.2.3.4", "%", "é", "_", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert rule_spans(text)[0] == plain_spans(text), text


def test_rule_spans_stay_and_missed_ones_are_added(told):
    rows, base, hidden, docs = told
    found = personal_spans(docs, with_text=True).collect()
    assert len(found) == len(rows) + 2
    extra = Counter()
    for r in found:
        if r.doc_id is None or r.doc_id == 0:
            continue
        text = rows[r.doc_id] or ""
        spans = [(KINDS.index(s.kind), s.start, s.end) for s in r.spans]
        assert spans == sorted(spans)
        assert [s for s, x in zip(spans, r.spans) if x.by == "rule"] == plain_spans(text)
        extra[r.doc_id] = sum(s.by == "model" for s in r.spans)
        for s in r.spans:
            if s.by == "model":
                assert not any(s.start < e and b < s.end for _, b, e in plain_spans(text))
        assert ("[CARD]" in r.redacted) == any(s.kind == "card" for s in r.spans)
        if not r.spans:
            assert r.redacted == text
    assert sum(extra[i] for i in range(base)) == 0  # nothing but rules' spans in plain and harmless texts
    assert sum(extra[i] > 0 for i in hidden) >= 0.9 * len(hidden)


def test_nothing_depends_on_ids_order_or_partitions(spark, told):
    rows, _, _, docs = told
    other = spark.createDataFrame([(i + 10 ** 6, t) for i, t in reversed(list(enumerate(rows)))], "doc_id long, text string").repartition(7)
    first, second = ({r.doc_id: r.spans for r in personal_spans(d).collect()} for d in (docs, other))
    assert all(first[i] == second[i + 10 ** 6] for i in range(1, len(rows)))


def test_query_of_personal_data(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op13_personal_data(spark, sf).collect():
        spans = plain_spans(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        named = [f"{KINDS[k]}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == sha(",".join(named)) and set(named) <= set(r.spans.split(",")) | {""}


def test_no_texts_and_no_matches(spark):
    assert personal_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    quiet = spark.createDataFrame([(1, "nothing to see"), (2, "call (017) 555-1234 now")], "doc_id long, text string")
    assert all(r.spans == [] for r in personal_spans(quiet).collect())


def test_candidates_are_linear():
    assert len(candidates("1 " * 20000)) < 40 * 20000
    assert candidates("1" * 100000) == [] and luhn("4539578763621486")


def test_trees_learn_a_conjunction_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 8, (3000, 5))
    y = ((x[:, 1] > 3) & (x[:, 3] == 2)).astype(float)
    trees = boosted(x[:2000], y[:2000], rounds=30, depth=3)
    score = trees.score(x[2000:])
    least = calibrated_threshold(score, y[2000:], 0.98)
    assert ((score >= least) == (y[2000:] > 0)).mean() > 0.99
    assert calibrated_threshold(np.array([1.0, 2.0]), np.array([0.0, 0.0]), 0.9) == float("inf")
    assert calibrated_threshold(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]), 0.9) == 4.0
    assert boosted(x[:10], np.zeros(10)).score(x[:3]).tolist() == [boosted(x[:10], np.zeros(10)).start] * 3
