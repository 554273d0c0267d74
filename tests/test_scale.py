"""What a row costs: work that rows must not repeat."""

import os

from pyspark.sql import functions as F

from metaudit.operators import compare, normalize, redact, video_rules
from metaudit.operators.audit import run_rule


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_core_properties_are_parsed_once(spark):
    xml = ('<cp:p xmlns:cp="c" xmlns:dc="d"><dc:title>A &amp; <b>B</b></dc:title><dc:creator/><x><dc:modified>m, 1</dc:modified></x>'
           '<dc:title>second</dc:title></cp:p>')
    df = spark.createDataFrame([(0, xml), (1, None), (2, ""), (3, "<p><created> c|d </created><creator>é\n</creator></p>")], "id int, xml string")
    found = df.select("id", normalize.ooxml_core_props(F.col("xml")).alias("p"))
    assert {r.id: r.p for r in found.collect()} == {
        0: {"title": "A & B", "modified": "m, 1"}, 1: {}, 2: {}, 3: {"created": " c|d ", "creator": "é\n"}}
    assert plan_of(found).count("xpath_string(") + plan_of(found).count("XPathString") == 1


def test_redaction_finds_the_kind_of_a_record_once(spark):
    df = spark.createDataFrame([("a/x.PDF", '{"document_info":{"Title":"t","Author":"a"},"z":1}'), ("b.wav", "{bad"), ("c.mp3", "{bad"),
                                ("d.jpg", '{"exif":{"Make":"m"},"basic":{"color_profile":"x","w":"1"}}'), (None, "{}")],
                               "file_path string, metadata string")
    done = redact.redact_fields(df, ["Title"])
    assert {r.file_path: (r.metadata, r.redaction) for r in done.collect()} == {
        "a/x.PDF": ('{"document_info":{"Title":"t"},"z":1}', "redacted"), "b.wav": ("{bad", "copied"), "c.mp3": (None, "redacted"),
        "d.jpg": ('{"basic":{"w":"1"},"exif":{}}', "redacted"), None: ("{}", "copied")}
    patterns = plan_of(done.select("metadata")).count(r"(\.[^./]*)\z")
    assert patterns <= 3  # one for the kind, one each where the tags of images and audio ask


def test_comparison_sorts_no_input_split(spark):
    """All records lie in one split; sorts come after the rows are dealt."""
    df = spark.range(2000).coalesce(1).selectExpr("id % 2 AS g", "CAST(id AS STRING) AS file_path", "'t' AS file_type",
                                                 "CAST(id AS STRING) AS mime_type", "id AS file_size", "NULL AS creation_time",
                                                 "'m' AS modification_time", "NULL AS access_time", "map('md5', 'x') AS hashes")
    found = compare.comparison_status(df, "g")
    rows = {(r.group_id, r.field): (r.n_values, r.status, r.value) for r in found.collect()}
    assert rows[0, "file_type"] == (1000, "same", "t") and rows[1, "mime_type"] == (1000, "different", None)
    assert rows[0, "creation_time"] == (0, "different", None) and rows[1, "md5"] == (1000, "same", "x") and len(rows) == 14
    plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    lowest = max(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert any("Repartition" in line or "Exchange" in line for line in plan[lowest:])


def test_files_are_flushed_together(spark, tmp_path, monkeypatch):
    from metaudit.sources.folders import FileWriter

    calls = []
    monkeypatch.setattr(os, "fsync", lambda f: calls.append("file"))
    monkeypatch.setattr(os, "sync", lambda: calls.append("all"))
    rows = [(str(tmp_path / f"o/{i}"), str(i)) for i in range(20)]
    assert FileWriter(str(tmp_path / "o/.s"), str(tmp_path), 0, 1).write(iter(rows)).files == 20
    assert calls == ["all"] and {p.name: p.read_text() for p in (tmp_path / "o").iterdir() if p.is_file()} == {str(i): str(i) for i in range(20)}


def test_terms_in_keys_need_no_pattern(spark):
    metadata = '{"video_properties":{"MAKE":"m","Camera_Model":null,"geo.x":"1","codec":"h264","Duration":"1"}}'
    df = spark.createDataFrame([("v.mp4", "video", metadata), ("w.mp4", "video", '{"video_properties":{"codec":"h264"}}')],
                               "file_path string, file_type string, metadata string")
    found = run_rule(df, video_rules.PACK.rules["video_device"])
    assert {r.file_path: [f.evidence["device_info"] for f in r.findings or []] for r in found.collect()} == {
        "v.mp4": [["Camera_Model: None", "MAKE: m"]], "w.mp4": []}
    assert "RLIKE" not in plan_of(found).upper()
