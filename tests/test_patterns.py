"""Detectors over flattened metadata, with exact expectations."""

import json

import pytest

from metaudit.operators.audit import audit, match_rules
from metaudit.operators.flatten import flatten_entries
from metaudit.operators.pattern_rules import detect, text_entries
from pyspark.sql import functions as F

CASES = {
    "emails": (
        {"text_info": {"content": "Write to desk@harbor.net, or lena_k@quay.org"},
         "document_info": {"author": "m.osei@ferry.co.uk"}},
        {"email": ["desk@harbor.net", "lena_k@quay.org", "m.osei@ferry.co.uk"],
         "domains": ["ferry.co.uk", "harbor.net", "m.osei", "quay.org"]}),
    "phones": (
        {"crew": {"desk": "312-555-0188", "bridge": "(646) 555-0147"}},
        {"phone": ["312-555-0188", "646) 555-0147"]}),
    "ssn": ({"payroll": {"number": "219-09-9999"}}, {"ssn": ["219-09-9999"]}),
    "urls": (
        {"links": {"home": "https://docs.harbor.net/a?b=1", "more": "see http://quay.org then"}},
        {"urls": ["http://quay.org", "https://docs.harbor.net/a?b=1"], "domains": ["docs.harbor.net", "quay.org"]}),
    "clean": ({"page": {"heading": "Tides and moorings", "body": "Low water at noon"}}, {}),
    "cards": (
        {"till": {"dashed": "4012-8888-8888-1881", "plain": "paid with 4012888888881881 today"}},
        {"credit_cards": ["XXXX-XXXX-XXXX-1881"]}),
    "addresses": (
        {"hosts": {"inner": "192.168.7.9", "outer": "203.0.113.77", "seen": "peer 10.20.30.40 left"}},
        {"ip_addresses": ["203.0.113.77"], "domains": ["0.113.77", "10.20.30.40", "192.168"]}),
    "mixed": (
        {"mixed_data": {"content": "k@harbor.net 312-555-0188 192.168.44.5 4012-8888-8888-1881"}},
        {"email": ["k@harbor.net"], "phone": ["312-555-0188"], "domains": ["192.168.44", "harbor.net"]}),
    "gps": ({"a": "GPS", "b": "my Location", "c": "location"}, {"gps_data": ["GPS", "Location", "location"]}),
    "keys": (
        {"api_key": "abcdefghijklmnopqrstuvwxyz0123", "plain": "abcdefghijklmnopqrstuvwxyz0123",
         "author": "ZYXWVUTSRQPONMLKJIHGFEDCBA ZYXWVUTSRQPONMLKJIHGFEDCBA"},
        {"api_keys": ["api_key: abc...123", "author: ZYX...CBA", "author: ZYX...CBA"]}),
    "ipv6": ({"a": "2001:0db8:85a3:0000:0000:8a2e:0370:7334"},
             {"ip_addresses": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]}),
}
KEY = {"email": "matches", "phone": "matches", "ssn": "matches", "gps_data": "matches", "domains": "domains",
       "urls": "urls", "credit_cards": "credit_cards", "ip_addresses": "ip_addresses", "api_keys": "api_keys"}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(n, json.dumps(m)) for n, (m, _) in CASES.items()], "file_path string, metadata string")
    rows = audit(df.withColumns({"file_type": F.lit("other"), "file_size": F.lit(500)}))
    return {r["file_path"]: r["findings"] for r in rows.select("file_path", "findings").collect()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(found, name):
    got = {f["rule"]: sorted(f["evidence"][KEY[f["rule"]]]) for f in found[name]}
    assert got == {k: sorted(v) for k, v in CASES[name][1].items()}


def test_severities_and_descriptions(found):
    by_rule = {f["rule"]: f for fs in found.values() for f in fs}
    assert by_rule["email"]["severity"] == "high" and by_rule["email"]["type"] == "privacy"
    assert by_rule["phone"]["severity"] == "medium"
    assert by_rule["urls"]["description"] == "Found 2 URLs in metadata"
    assert by_rule["api_keys"]["type"] == "security"
    assert {f["severity"] for fs in found.values() for f in fs} <= {"low", "medium", "high"}


def test_unicode_boundaries(spark):
    rows = spark.createDataFrame([("é555-123-4567",), ("x 555-123-4567",)], "note string")
    sizes = [len(r["findings"]) for r in detect(rows, ["note"], ["phone"]).collect()]
    assert sizes == [0, 1]  # a letter right before the number is no boundary


def test_null_text_gives_nothing(spark):
    rows = spark.createDataFrame([(None,)], "note string")
    assert detect(rows, ["note"]).first()["findings"] == []


FLAT = {
    "level1": {"level2": {"value": "test"}, "simple": "data"}, "list_data": ["item1", "item2"], "direct": "value",
    "none": None, "mixed": [1, None, {"a": {"b": 2}}, ["x", 1]], "empty": {}, "nothing": [], "flag": True, "num": 1.0,
}


def test_flatten(spark):
    df = spark.createDataFrame([(json.dumps(FLAT),)], "j string").select(
        flatten_entries(F.parse_json("j")).alias("e"))
    assert {e["field"]: e["value"] for e in df.first()["e"]} == {
        "level1.level2.value": "test", "level1.simple": "data", "list_data": "item1, item2", "direct": "value",
        "none": "", "mixed.0": "1", "mixed.1": "None", "mixed.2.a.b": "2", "mixed.3": '["x",1]', "nothing": "",
        "flag": "True", "num": "1.0"}


def test_flatten_any_depth(spark):
    deep = leaf = {}
    for _ in range(40):
        leaf["k"] = {}
        leaf = leaf["k"]
    leaf["end"] = "x"
    df = spark.createDataFrame([(json.dumps(deep),)], "j string").select(flatten_entries(F.parse_json("j")).alias("e"))
    assert [(e["field"], e["value"]) for e in df.first()["e"]] == [(".".join(["k"] * 40 + ["end"]), "x")]


def test_match_rules(spark):
    rows = spark.createDataFrame([("a1", "zz"), ("b", "a2")], "one string, two string")
    rules = [{"rule": "digit", "regex": r"\d", "field_like": None}, {"rule": "two", "regex": "a", "field_like": "tw_"}]
    out = match_rules(rows, text_entries(rows, ["one", "two"]), rules).collect()
    assert [[(f["rule"], f["evidence"]["fields"]) for f in r["findings"]] for r in out] == [
        [("digit", ["one"])], [("digit", ["two"]), ("two", ["two"])]]
