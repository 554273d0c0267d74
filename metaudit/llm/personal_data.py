"""Personal data by candidate gradient boosting: rules, generators of more spans, boosted trees, thresholds.

Rules find mail addresses, IP addresses, card numbers and phone numbers in their plain forms, exactly
and in linear time. Generators with high recall then propose overlapping spans for what rules miss:
parts of longer number runs (a number next to another makes one run that no rule takes), other
separators, bracketed or spelled dots and ats. Boosted trees judge each span by its format and context,
and those above the threshold of their kind that meet no rule's span become spans too, best first.

There are no labels. The trees learn from windows around matches of the rules and around refused
candidates: a candidate that is a rule's span counts as 1, any other as 0, unless its format is valid,
which proves nothing. Disguised, glued and spoiled copies of the spans, made in place, teach what the
generators are for. Windows are taken per stratum (the kind of the rule, or none) in the order of a hash
of their content, ``per_stratum`` at most, equal ones once: a bounded sample that depends on the texts
alone. A fifth of it calibrates: the threshold of a kind is the lowest score at which the share of
true spans, made monotone, is ``precision``.

Two passes over the texts, no shuffle but of windows. Null texts count as empty; ids may be null or
repeat, rows stay one to one; other columns are left out, whatever their names. Without any match the
trees add nothing. Texts are handled one by one as Python strings (one to four bytes a character).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metaudit.llm.boosting import BINS, Boosted, boosted, calibrated_threshold

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
Span = tuple[int, int, int]  # kind, start, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

RUN = re.compile(r"[0-9]++(?:[ ().\[\]\-/_\u00a0]{1,3}[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")
DOT = r"(?:\.|\s?[\[({]\s?(?:[dD][oO][tT]|\.)\s?[\])}]\s?|\s[dD][oO][tT]\s)"
AT = r"(?:@|\s?[\[({]\s?(?:[aA][tT]|@)\s?[\])}]\s?|\s(?:[aA][tT]|@)\s)"
ADDRESS = re.compile(rf"{AT}(?=([A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++))")
DOT_PLACE = re.compile(DOT)
MOST_LABELS, PHONE_DIGITS, CARD_DIGITS = 6, (8, 15), (16, 19)

CONTEXT = 64  # characters of a window on each side
MOST_WINDOW = 256  # longer stretches of candidates are scored, but not learned from
CUES = {PHONE: "phone tel telefon teléfono mobile cell call fax dial whatsapp sms", CARD: "card visa mastercard amex credit karte tarjeta carte",
        IP: "ip host server address gateway dns ping subnet", EMAIL: "mail email e-mail contact write kontakt correo"}
CUE_OF = {word: kind + 1 for kind, words in CUES.items() for word in words.split()}
OTHER_CUES = frozenset("order invoice version token id ref isbn page date no number build key rev article total".split())
WORDS_BEFORE = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(GROUP.findall(text))


def part_fits(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in LOCAL:
        at -= 1
    return at


def rule_spans(text: str) -> tuple[list[Span], list[Span]]:
    """What the rules find, by kind and start: the spans that hold, and matches that fail a check."""
    good, bad = [], []
    end, at = 0, text.find("@")
    while at >= 0:
        start, domain = local_start(text, at, end), DOMAIN.match(text, at + 1)
        if domain and start < at:
            end = domain.end()
            good.append((EMAIL, start, end))
        at = text.find("@", max(at + 1, end))
    for run in DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            parts = list(GROUP.finditer(text, run.start(), run.end()))
            for four in zip(*[iter(parts)] * 4):
                fits = all(part_fits(p.group()) for p in four)
                (good if fits else bad).append((IP, four[0].start(), four[3].end()))
    for run in DIGITS.finditer(text):
        if run.end() - run.start() >= CARD_DIGITS[0]:
            digits = digits_of(run.group())
            fits = CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
            (good if fits else bad).append((CARD, *run.span()))
    for match in PLUS.finditer(text):
        fits = PHONE_DIGITS[0] <= len(digits_of(match.group())) <= PHONE_DIGITS[1]
        (good if fits else bad).append((PHONE, *match.span()))
    return good, bad


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data, a bounded number from each place."""
    found = []
    for at in ADDRESS.finditer(text):
        start = local_start(text, at.start(), 0)
        if start < at.start():
            dots = list(DOT_PLACE.finditer(text, at.start(1), at.end(1)))[:MOST_LABELS]
            ends = [d.start() for d in dots[1:]] + [at.end(1)] * (len(dots) < MOST_LABELS)
            found += [(EMAIL, start, end) for end in ends]
    for run in RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [g.span() for g in GROUP.finditer(text, run.start(), run.end())]
        for i, (start, _) in enumerate(groups):
            begin = start - (start > 0 and text[start - 1] == "(")
            begin -= begin > 0 and text[begin - 1] == "+"
            digits = 0
            for j in range(i, min(i + CARD_DIGITS[1], len(groups))):
                digits += groups[j][1] - groups[j][0]
                if digits > CARD_DIGITS[1]:
                    break
                if PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]:
                    found.append((PHONE, begin, groups[j][1]))
                elif digits >= CARD_DIGITS[0]:
                    found.append((CARD, start, groups[j][1]))
            if len(groups) >= i + 4 and all(text[a[1]:b[0]].strip(" []()") == "." for a, b in zip(groups[i:i + 3], groups[i + 1:i + 4])):
                found.append((IP, start, groups[i + 3][1]))
    return found


def neighbour(text: str, at: int, step: int) -> int:
    """Class of the character at a border; 6 where another number follows beyond a separator."""
    if not 0 <= at < len(text) or text[at] == "\n":
        return 0
    c = text[at]
    if c in "0123456789":
        return 3
    beyond = at + step
    if c in " -./()_" and 0 <= beyond < len(text) and text[beyond] in "0123456789":
        return 6
    return 1 if c.isspace() else 2 if c.isalpha() else 5 if c in "\"'=`" else 4


def features(text: str, span: Span) -> list[int]:
    """Format and context of a candidate as small whole numbers."""
    kind, start, end = span
    body = text[start:end]
    groups = GROUP.findall(body)
    lengths = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    gaps = [g for g in re.split(r"[0-9]+", body)[1:-1]] if groups else []
    gap = ("none", " ", "-", ".", "/", "_").index(gaps[0]) if gaps and gaps[0] in (" ", "-", ".", "/", "_") else 6 if gaps else 0
    cue = other = 0
    for word in WORDS_BEFORE.findall(text[max(0, start - 24):start].lower()):
        cue, other = CUE_OF.get(word, cue), other or word in OTHER_CUES
    date = lengths in ([4, 2, 2], [2, 2, 4], [4, 2, 2, 2, 2], [4, 2, 2, 2, 2, 2])
    values = [kind, len(digits), len(groups), max(lengths), min(lengths), lengths[0], lengths[-1],
              body.startswith("+"), "(" in body, len(set(gaps)), gap, len(digits) >= 12 and luhn(digits),
              sum(not part_fits(g) for g in groups), sum(len(g) > 1 and g[0] == "0" for g in groups), len(set(digits)), date,
              neighbour(text, start - 1, -1), neighbour(text, end, 1), cue, other, 0, 0, 0, 0, 0, 0]
    if kind == EMAIL:
        at = re.search(AT, body)
        dots = DOT_PLACE.findall(body, at.end())
        labels = DOT_PLACE.split(body[at.end():])
        style = {"@": 1}.get(at.group(), 4 if "@" in at.group() else 2 if re.search(r"[\[({]", at.group()) else 3)
        dotted = 1 if all(d == "." for d in dots) else 2 if all(re.search(r"[\[({]", d) for d in dots) else 3
        values[-6:] = [style, dotted, at.start(), len(labels), len(labels[-1]), labels[-1].isalpha() and labels[-1].islower()]
    return [min(int(v), BINS - 1) for v in values]


def valid(text: str, span: Span) -> bool:
    """Whether a candidate could be true by its format alone."""
    kind, start, end = span
    body = text[start:end]
    if kind == CARD:
        return luhn(digits_of(body))
    if kind == IP:
        return all(part_fits(p) for p in GROUP.findall(body))
    return kind == EMAIL or body[0] in "+(" or body.startswith("00")


def overlaps(span: Span, others: list[Span]) -> bool:
    return any(span[1] < e and s < span[2] for _, s, e in others)


def windows(text: str) -> list[tuple[int, str, int, int]]:
    """Stretches of matches and candidates with their surroundings: stratum, window, and the stretch in it."""
    good, bad = rule_spans(text)
    found = sorted([*good, *bad, *candidates(text)], key=lambda s: s[1:])
    result, i = [], 0
    while i < len(found):
        low, high, j = found[i][1], found[i][2], i + 1
        while j < len(found) and found[j][1] < high:
            high = max(high, found[j][2])
            j += 1
        i = j
        if high - low <= MOST_WINDOW:
            inside = [k for k, s, e in good if low <= s and e <= high]
            begin = max(0, low - CONTEXT)
            result.append((min(inside, default=len(KINDS)), text[begin:high + CONTEXT], low - begin, high - begin))
    return result


def disguised(kind: int, body: str, rng: random.Random) -> str:
    """Another way to write what a rule finds."""
    if kind == EMAIL:
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", "."), ("@", "(dot)"), (" (at) ", " dot ")])
        local, domain = body.split("@")
        return local + at + domain.replace(".", dot)
    if kind == IP:
        return body.replace(".", rng.choice(["[.]", "(.)", " . "]))
    digits = digits_of(body)
    if kind == CARD:
        return rng.choice([".", "/", "_", "  ", " - "]).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    return rng.choice([f"({last[:3]}) {last[3:6]}-{last[6:]}", "00" + body[1:], f"00{digits}"])


def spoiled(kind: int, body: str, rng: random.Random) -> str:
    """Something that looks alike and is not personal data."""
    if kind == EMAIL:
        return f"{body.split('@')[0]} at {rng.choice(['noon', 'home', 'last'])}.{rng.choice(['Then', 'It', 'We'])}"
    if kind == IP:
        parts = body.split(".")
        parts[rng.randrange(4)] = str(rng.randrange(256, 1000))
        return rng.choice([".", "[.]"]).join(parts)
    digits = digits_of(body)
    if kind == CARD:
        place = rng.randrange(len(digits))
        changed = digits[:place] + str((int(digits[place]) + rng.randrange(1, 10)) % 10) + digits[place + 1:]
        step = rng.choice([4, len(digits)])
        return rng.choice([" ", "-", "."]).join(changed[i:i + step] for i in range(0, len(changed), step))
    return rng.choice([f"{2000 + rng.randrange(30)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)} {rng.randrange(10, 24)}.{rng.randrange(10, 60)}",
                       digits, f"{digits[:3]}/{digits[3:]}", "-".join(digits[i:i + 3] for i in range(0, len(digits), 3))])


def examples(window: str, low: int, high: int, rng: random.Random, pool: list[tuple[int, str]]) -> list[tuple[list[int], int]]:
    """Labelled candidates of a window and of its disguised, glued and spoiled copies."""
    good, _ = rule_spans(window)
    good = [s for s in good if low <= s[1] and s[2] <= high]
    result = [(features(window, c), int(c in good)) for c in candidates(window)
              if low <= c[1] and c[2] <= high and (c in good or not valid(window, c) or overlaps(c, [g for g in good if g[0] == c[0]]))]
    for kind, start, end in good:
        body = window[start:end]
        mate_kind, mate = rng.choice(pool or [(kind, body)])
        variants = [([(kind, disguised(kind, body, rng))], 1), ([(kind, spoiled(kind, body, rng))], 0),
                    ([(kind, body), (mate_kind, mate)], 1), ([(mate_kind, mate), (kind, body)], 1)]
        for pieces, label in variants:
            filled = " ".join(p for _, p in pieces)
            text, place, true = window[:start] + filled + window[end:], start, []
            for piece_kind, piece in pieces:
                true.append((piece_kind, place, place + len(piece)))
                place += len(piece) + 1
            result += [(features(text, c), int(label and c in true)) for c in candidates(text) if overlaps(c, true)]
    return result


@dataclass
class Judge:
    """The trees and the lowest log odds of each kind at which a candidate is taken."""

    trees: Boosted
    least: list[float]

    def added(self, texts: list[str], found: list[list[Span]]) -> list[list[tuple[Span, float]]]:
        """Per text the candidates that are taken beside the spans found: best first, none overlapping."""
        open_ = [[c for c in dict.fromkeys(candidates(t)) if not overlaps(c, near(c, rules))] for t, rules in zip(texts, found)]
        rows = [features(t, c) for t, spans in zip(texts, open_) for c in spans]
        if not rows:
            return [[] for _ in texts]
        scores = iter(self.trees.score(np.array(rows, np.int64)).tolist())
        result = []
        for spans in open_:
            wanted = sorted(((-s, c[1] - c[2], c[1], c) for c, s in zip(spans, scores) if s >= self.least[c[0]]))
            taken, chosen = set(), []  # characters in use
            for minus, _, _, c in wanted:
                if taken.isdisjoint(range(c[1], c[2])):
                    taken.update(range(c[1], c[2]))
                    chosen.append((c, -minus))
            result.append(chosen)
        return result


def near(span: Span, ordered: list[Span]) -> list[Span]:
    """Spans of each kind (sorted by kind and start, none overlapping in a kind) that can meet ``span``."""
    result = []
    for kind in range(len(KINDS)):
        place = bisect_left(ordered, (kind, span[1]))
        result += [s for s in ordered[max(place - 1, 0):place] if s[0] == kind]
        while place < len(ordered) and ordered[place][0] == kind and ordered[place][1] < span[2]:
            result.append(ordered[place])
            place += 1
    return result


def training_windows(docs: DataFrame, per_stratum: int, text_col: str) -> list:
    """At most ``per_stratum`` windows of each stratum, by the hash of their content."""

    def run(batches):
        for batch in batches:
            rows = {}
            for value in batch.column(0):
                text = value.as_py()
                for stratum, window, low, high in windows(text) if text else ():
                    mark = hashlib.blake2b(f"{low}:{high}:{window}".encode(), digest_size=8).digest()
                    rows[mark] = (int.from_bytes(mark, "little", signed=True), stratum, window, low, high)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows.values())], ["mark", "stratum", "window", "low", "high"])

    found = docs.select(docs[text_col]).mapInArrow(run, "mark long, stratum long, window string, low long, high long")
    once = found.groupBy("stratum", "mark").agg(F.min("window").alias("window"), F.min("low").alias("low"), F.min("high").alias("high"))
    first = F.row_number().over(Window.partitionBy("stratum").orderBy("mark"))
    return once.withColumn("place", first).where(F.col("place") <= per_stratum).orderBy("stratum", "mark").collect()


def trained(docs: DataFrame, *, per_stratum: int = 1500, precision: float = 0.98, text_col: str = "text") -> Judge:
    """Trees and thresholds from the windows of ``docs``; at most ``per_stratum`` of each of five strata."""
    rows = training_windows(docs, per_stratum, text_col)
    pool = [(r["stratum"], r["window"][s:e]) for r in rows if r["stratum"] < len(KINDS)
            for k, s, e in rule_spans(r["window"])[0] if k == r["stratum"] and r["low"] <= s and e <= r["high"]]
    x, y, fold = [], [], []
    for r in rows:
        made = examples(r["window"], r["low"], r["high"], random.Random(r["mark"]), pool)
        x += [f for f, _ in made]
        y += [label for _, label in made]
        fold += [r["mark"] % 5 == 0] * len(made)
    if not x:
        return Judge(boosted(np.zeros((0, 1), np.int64), np.zeros(0), rounds=0), [float("inf")] * len(KINDS))
    x, y, fold = np.array(x, np.int64), np.array(y, float), np.array(fold)
    trees = boosted(x[~fold], y[~fold])
    score = trees.score(x[fold])
    return Judge(trees, [calibrated_threshold(score[x[fold][:, 0] == k], y[fold][x[fold][:, 0] == k], precision)
                         for k in range(len(KINDS))])


def personal_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_stratum: int = 1500,
                   precision: float = 0.98, with_text: bool = False) -> DataFrame:
    """Per row: the id and spans (kind, start, end in code points, by: rule or model, score), by kind and start.

    ``with_text`` adds ``redacted``, the text with each span replaced by its kind in brackets. Scores are
    probabilities of the trees; those of rules are 1.
    """
    judge = trained(docs, per_stratum=per_stratum, precision=precision, text_col=text_col)
    source = docs.select(docs[id_col], docs[text_col])
    span_type = "array<struct<kind: string, start: long, end: long, by: string, score: double>>"
    schema = StructType([source.schema[id_col],
                         *StructType.fromDDL(f"spans {span_type}" + ", redacted string" * with_text).fields])
    arrow_spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                      ("by", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [v.as_py() or "" for v in part.column(1)]
                rules = [rule_spans(t)[0] for t in texts]
                rows = []
                for found, extra in zip(rules, judge.added(texts, rules)):
                    spans = [(s, "rule", 1.0) for s in found]
                    spans += [(s, "model", float(1 / (1 + np.exp(-score)))) for s, score in extra]
                    rows.append([{"kind": KINDS[s[0]], "start": s[1], "end": s[2], "by": by, "score": score}
                                 for s, by, score in sorted(spans)])
                columns = [part.column(0), pa.array(rows, arrow_spans)]
                if with_text:
                    columns.append(pa.array([redacted(t, r) for t, r in zip(texts, rows)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def redacted(text: str, spans: list[dict]) -> str:
    """The text with spans replaced by their kind; of overlapping ones (rules of two kinds) the earlier names both."""
    parts, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= at:
            parts += [text[at:span["start"]], f"[{span['kind'].upper()}]"]
        at = max(at, span["end"])
    return "".join([*parts, text[at:]])
