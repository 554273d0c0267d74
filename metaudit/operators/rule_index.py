"""User rules by the thousand: an index of text that a rule's matches must contain.

From each regular expression the longest run of plain characters that no match can lack is taken, one
per alternative, and of each run one trigram. A value is looked up by its trigrams, so only rules with a
trigram in it are tried: first their run, then their expression. Rules without such a run are walked one
by one. The index is a constant of one projection: neither a join nor a shuffle, and the plan stays the
same size whatever the number of rules.
"""

import json
import re
import zlib
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaudit.functions.findings import Items, finding, let
from metaudit.schema import FINDING

GRAM = 3
BUCKETS = 256
_QUANTIFIER = re.compile(r"(?:([*?+])|\{(\d+)(?:,\d*)?\})[+?]?")
_ONE_CHARACTER = "tnrfae"


def required_runs(regex: str) -> list[str] | None:
    """Lower-cased ASCII runs, one of which every match contains (in lower case); None if there is no such run.

    Anything but plain sequences, escapes, classes, groups and quantifiers gives None.
    """
    flags = re.match(r"\(\?([a-zA-Z]+)\)", regex)
    if flags:
        if set(flags.group(1)) - set("ismd"):  # folding beyond ASCII is not lower case
            return None
        regex = regex[flags.end():]
    branches: list[list[str]] = [[""]]
    i = 0
    while i < len(regex):
        c = regex[i]
        if c == "|":
            branches.append([""])
            i += 1
            continue
        if c in "()[{" or c == "\\":
            end, plain = _atom(regex, i)
            if end is None:
                return None
        else:
            end, plain = i + 1, "" if c in "^$.*+?" else c
        if c in "*+?":
            return None
        runs = branches[-1]
        times = _QUANTIFIER.match(regex, end)
        if times:
            end = times.end()
            needed = times.group(1) == "+" or (times.group(2) or "0").lstrip("0") != ""
            if plain and needed:
                runs[-1] += plain
            runs.append("")
        elif plain and plain.isascii():
            runs[-1] += plain
        else:
            runs.append("")
        i = end
    found = [max((part for run in runs for part in re.split(r"[^\x00-\x7f]+", run)), key=len).lower() for runs in branches]
    return found if all(len(run) >= GRAM for run in found) else None


def _atom(regex: str, i: int) -> tuple[int | None, str]:
    """End of the escape, class or group at i, and the character it stands for, if any; None if not understood."""
    c = regex[i]
    if c == "\\":
        following = regex[i + 1:i + 2]
        if not following or following in "QE":
            return None, ""
        if not following.isalnum():
            return i + 2, following
        longer = re.compile(r"\\(?:[pPN]\{[^}]*\}|[pP].|x\{[^}]*\}|x..|u....|k<[^>]*>|c.|0[0-7]+|[1-9]\d*)").match(regex, i)
        return (longer.end() if longer else i + 2), ""
    if c == "[":
        return _closing_bracket(regex, i), ""
    if c == "(":
        if re.match(r"\(\?[a-zA-Z]*-?[a-zA-Z]*\)", regex[i:]):  # flags for the rest
            return None, ""
        depth, j = 0, i
        while j < len(regex):
            if regex[j] == "\\":
                if regex[j + 1:j + 2] in ("Q", "E", ""):
                    return None, ""
                j += 2
                continue
            if regex[j] == "[":
                j = _closing_bracket(regex, j)
                if j is None:
                    return None, ""
                continue
            depth += {"(": 1, ")": -1}.get(regex[j], 0)
            j += 1
            if depth == 0:
                return j, ""
    return None, ""


def _closing_bracket(regex: str, i: int) -> int | None:
    """Place after a character class, classes inside it included."""
    depth, j = 0, i
    while j < len(regex):
        if regex[j] == "\\":
            if regex[j + 1:j + 2] in ("Q", "E", ""):
                return None
            j += 2
            continue
        if regex[j] == "[":
            depth += 1
            if regex[j + 1:j + 2] == "^":
                j += 1
            if regex[j + 1:j + 2] == "]":
                return None  # engines differ on a bracket that comes first
        elif regex[j] == "]":
            depth -= 1
            if depth == 0:
                return j + 1
        j += 1
    return None


def bucket_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _constant(value, kind: str) -> Column:
    """A nested constant, parsed once by the optimizer."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v: {kind}>")["v"]


def rule_matches(entries: Column, rules: list) -> Column:
    """``array<struct<no, field>>``: which rules match the value of which field (``entries`` of field and value)."""
    runs = [required_runs(r["regex"]) for r in rules]
    usage = Counter(run[k:k + GRAM] for found in runs if found for run in found for k in range(len(run) - GRAM + 1))
    buckets: list[dict[str, list]] = [{} for _ in range(BUCKETS)]
    for no, found in enumerate(runs):
        for run in found or ():
            gram = min((run[k:k + GRAM] for k in range(len(run) - GRAM + 1)), key=lambda g: (usage[g], g))
            rule = {"no": no, "run": run, "regex": rules[no]["regex"], "field_like": rules[no].get("field_like")}
            buckets[bucket_of(gram)].setdefault(gram, []).append(rule)
    walked = [{"no": no, "run": "", "regex": r["regex"], "field_like": r.get("field_like")}
              for no, (r, found) in enumerate(zip(rules, runs)) if found is None]
    rule_type = "struct<no: int, run: string, regex: string, field_like: string>"
    indexed = _constant([[{"gram": g, "rules": found} for g, found in b.items()] for b in buckets],
                        f"array<array<struct<gram: string, rules: array<{rule_type}>>>>")
    grams = _constant(sorted(g for b in buckets for g in b), "array<string>")
    match = "array<struct<no: int, field: string>>"

    def wanted(entry, rule):
        named = rule["field_like"].isNull() | F.like(entry["field"], rule["field_like"])
        return named & F.rlike(entry["value"], rule["regex"])

    def found_in(entry):
        def tried(small):
            own = F.array_intersect(F.regexp_extract_all(small, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)), grams)
            near = F.flatten(F.transform(own, lambda g: F.flatten(F.transform(
                F.filter(F.get(indexed, F.pmod(F.crc32(g), F.lit(BUCKETS)).cast("int")), lambda x: x["gram"] == g),
                lambda x: x["rules"]))))
            return F.filter(near, lambda r: F.contains(small, r["run"]) & wanted(entry, r))

        # a rule may be near by several of its alternatives
        return F.array_distinct(F.transform(let(F.lower(entry["value"]), tried), lambda r: F.struct(r["no"], entry["field"].alias("field"))))

    by_index = F.flatten(F.transform(entries, lambda e: F.coalesce(found_in(e), F.array()).cast(match)))
    by_walk = F.flatten(F.transform(_constant(walked, f"array<{rule_type}>"), lambda r: F.transform(
        F.filter(entries, lambda e: wanted(e, r)), lambda e: F.struct(r["no"], e["field"].alias("field"))).cast(match)))
    parts = ([by_index] if len(walked) < len(rules) else []) + ([by_walk] if walked else [])
    return F.concat(*[F.coalesce(p, F.array().cast(match)) for p in parts], F.array().cast(match))


def rule_findings(entries: Column, rules: list) -> Column:
    """Findings of the rules that match, in the order of the rules, each with the fields it matched."""
    kind = "array<struct<rule: string, type: string, severity: string>>"
    told = _constant([{"rule": r["rule"], "type": r.get("type", "security"), "severity": r.get("severity", "medium")}
                      for r in rules], kind)

    def listed(found):
        def one(no):
            rule = F.get(told, no)
            fields = F.sort_array(F.transform(F.filter(found, lambda m: m["no"] == no), lambda m: m["field"]))
            return finding(rule["rule"], rule["type"], rule["severity"], F.concat(F.lit("Matched rule "), rule["rule"]),
                           fields=Items(fields))

        return F.transform(F.sort_array(F.array_distinct(F.transform(found, lambda m: m["no"]))), one)

    return let(rule_matches(entries, rules), listed).cast(f"array<{FINDING.simpleString()}>")
