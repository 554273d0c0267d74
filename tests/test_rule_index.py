"""User rules through the index against rules tried one by one."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from metaudit.operators.audit import match_rules
from metaudit.operators.rule_index import required_runs


@pytest.mark.parametrize("regex,runs", [
    ("license", ["license"]), ("(?i)LICENSE", ["license"]), (r"^src1\d*$", ["src1"]), (r"\d{9,}", None), ("ab", None),
    ("abc?d", None), ("abcd?ef", ["abc"]), ("abc+def", ["abc"]), ("abc*def", ["def"]), ("abcd{2}xy", ["abcd"]), ("abcd{0,2}xyz", ["abc"]),
    ("foo1|bar22", ["foo1", "bar22"]), ("foo1|b.r", None), ("(foo|bar)bazz", ["bazz"]), ("[abc]defg[^x]h", ["defg"]),
    (r"a\.b\.c", ["a.b.c"]), (r"key\s*=\s*secret", ["secret"]), (r"\Qa.b\E", None), ("naïveté", ["vet"]), ("(?iu)secret", None), ("caféteria", ["teria"]),
    ("(?x)a b c d", None), ("abc(?i)def", None), (r"\p{Lu}abc", ["abc"]), (r"\x41bcd", ["bcd"]), (r"(?:a(b|c)\))defg", ["defg"]),
    ("[]abc]def", None), ("", None), ("abc(", None), ("abc.def*?", ["abc"]), ("a{3}bcd", ["bcd"]), ("x++abc", ["abc"]),
])
def test_required_runs(regex, runs):
    assert required_runs(regex) == runs


def test_every_match_contains_a_required_run():
    rng = random.Random(1)
    pieces = ["a", "b", "c", "ab", "cab", "[ab]", "(a|bc)", "(?:ab)+", ".", r"\w", r"\.", "x?", "y*", "z+", "c{2}", "c{0,1}", "|", "a??", "(b[c(]c)"]
    checked = 0
    for _ in range(4000):
        regex = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8)))
        runs = required_runs(regex)
        if runs is None:
            continue
        for _ in range(30):
            text = "".join(rng.choice(["a", "b", "c", "ab", "cab", "cc", "abab", "z", "."]) for _ in range(rng.randrange(4, 14)))
            if re.search(regex, text):
                checked += 1
                assert any(run in text for run in runs), (regex, text, runs)
    assert checked > 300


def plainly(rows, names, rules):
    """Findings of each row: rule, type, severity and the fields whose value the rule matches."""
    def like(pattern, name):
        return re.fullmatch(re.escape(pattern).replace("%", ".*").replace("_", "."), name)

    result = []
    for row in rows:
        found = []
        for r in rules:
            fields = sorted(n for n, v in zip(names, row) if v is not None and re.search(r["regex"], v)
                            and (not r.get("field_like") or like(r["field_like"], n)))
            if fields:
                found.append((r["rule"], r.get("type", "security"), r.get("severity", "medium"), f"Matched rule {r['rule']}", fields))
        result.append(found)
    return result


def found_by(out):
    return [[(f.rule, f.type, f.severity, f.description, f.evidence["fields"]) for f in r.findings] for r in out]


def test_rules_equal_plain_matching(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "Gamma", "delta9", "über", "k=v", "a.b", "secret", "token", "x"]
    rows = [tuple(rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(6)))]) for _ in range(3)) for _ in range(60)]
    regexes = ["alpha", "(?i)ALPHA", "beta|gamma", "secret|token|beta", r"\d", "Gamma", r"a\.b", "ber", "über", "k=v", "^alpha", "token$",
               "(alpha|beta) (token|x)", "nothing here", "x", r"\bx\b", "secret token", "delta[0-9]", "e"]
    rules = [{"rule": f"r{i}", "regex": x, "field_like": rng.choice([None, "%e", "on_", "three"]), "severity": rng.choice(["low", "high"])}
             for i, x in enumerate(regexes * 2)]
    names = ["one", "three", "tree"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, one string, three string, tree string")
    entries = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names])
    assert found_by(match_rules(df, entries, rules).orderBy("i").collect()) == plainly(rows, names, rules)
    for some in (rules[:1], rules[4:5], []):  # only indexed, only walked, none
        assert found_by(match_rules(df, entries, some).orderBy("i").collect()) == plainly(rows, names, some)
    nothing = df.withColumn("none", F.lit(None).cast("array<struct<field:string,value:string>>"))
    assert found_by(match_rules(nothing, F.col("none"), rules).collect()) == [[]] * 60


def test_thousands_of_rules(spark):
    rng = random.Random(3)
    names = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(10 ** 6):06d}" for _ in range(5000)]
    rules = [{"rule": n, "regex": rf"(?i)\b{n}\b"} for n in names]
    rows = [(" ".join(rng.sample(names, 3)) + " and other words that stand between " * 5 + rng.choice(names).upper(),) for _ in range(200)]
    df = spark.createDataFrame(rows, "text string").repartition(4)
    entries = F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("value")))
    begin = time.perf_counter()
    out = match_rules(df, entries, rules)
    out._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - begin < 5
    place = {n: i for i, n in enumerate(names)}
    for r in out.collect():
        expected = sorted({w.lower() for w in r.text.split() if w.lower() in place}, key=place.get)
        assert [f.rule for f in r.findings] == expected
