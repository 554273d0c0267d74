"""Rules at, below and above their thresholds; presence of null keys; missing sections; broken values."""

import json

import pytest
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.operators import audit as A

CASES = [
    # (file type, metadata, rules expected to fire, rules expected not to)
    ("audio", {"audio_properties": {"channels": 2, "sample_rate": 48000, "bitrate": 320000, "duration": 7200}}, [],
     ["audio_channels", "audio_sample_rate", "audio_bitrate", "audio_long"]),
    ("audio", {"audio_properties": {"channels": 3, "sample_rate": 48001, "bitrate": 320001, "duration": 7200.5}},
     ["audio_channels", "audio_sample_rate", "audio_bitrate", "audio_long"], []),
    ("audio", {"tags": {"artist": None, "GeoTag": None}, "pictures": []}, ["audio_geo"], ["audio_personal", "audio_pictures"]),
    ("video", {"video_properties": {"width": 3840, "height": 2159, "bit_rate": 15000000, "duration": "7200"}},
     ["video_resolution"], ["video_bitrate", "video_long", "video_aspect"]),
    ("video", {"video_properties": {"width": 1919, "height": 1080}}, [], ["video_resolution"]),
    ("video", {"video_properties": {"width": 100, "height": 201}}, ["video_aspect"], []),
    ("video", {"video_properties": {"width": 300, "height": 100}}, [], ["video_aspect"]),
    ("video", {"audio_streams": [{"language": "en"}, {"tags": {"language": "fr"}}], "chapters": [1]},
     ["video_multi_audio", "video_languages", "video_chapters"], ["video_subtitles"]),
    ("video", {"audio_streams": [{"language": "en"}]}, [], ["video_multi_audio", "video_languages"]),
    ("executable", {"sections": [{"name": ".text", "entropy": 7.0}]}, [], ["exe_high_entropy", "exe_section_names"]),
    ("executable", {"sections": [{"name": "", "entropy": 7.01}]}, ["exe_high_entropy", "exe_section_names"], ["exe_signature"]),
    ("executable", {"signatures": {}}, ["exe_signature"], []),
    ("image", {"exif": {"GPS": None, "Make": None}}, ["image_gps", "image_device"], ["image_dates"]),
    ("image", {"exif": {"Software": "GIMP"}, "xmp": {"CreatorTool": "Camera"}}, [], ["image_edited"]),
    ("image", {"basic": {"color_profile": "None"}}, [], ["image_color_profile"]),
    ("document", {"document_info": {"Author": None, "CreationDate": "x"}}, ["doc_author"], ["doc_dates", "doc_software"]),
    ("document", {"document_info": {"CreationDate": "x", "ModDate": "y"}}, ["doc_dates"], ["doc_author"]),
    ("document", {"security": {"encrypted": False, "permissions": {"copy": False}}}, ["doc_restricted_permissions"],
     ["doc_encrypted", "doc_macros"]),
    ("other", {"archive_info": {"compression_ratio": 1.0}, "text_info": {"encoding": "ascii", "line_count": 10000}}, [],
     ["archive_ratio_anomaly", "odd_text_encoding", "large_text_file"]),
    ("other", {"archive_info": {"compression_ratio": 0.99, "extensions": {".EXE": 2}},
               "text_info": {"encoding": "utf-16", "line_count": 10001}},
     ["archive_ratio_anomaly", "archive_has_executables", "odd_text_encoding", "large_text_file"], []),
    ("other", {"exif": {"GPS": 1}}, [], ["image_gps"]),
]


@pytest.fixture(scope="module")
def fired(spark):
    rows = [(i, t, json.dumps(m)) for i, (t, m, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, file_type string, metadata string")
    return {r["id"]: {f["rule"] for f in r["findings"]} for r in A.audit(df).select("id", "findings").collect()}


@pytest.mark.parametrize("index", range(len(CASES)))
def test_case(fired, index):
    _, _, expected, excluded = CASES[index]
    assert set(expected) <= fired[index]
    assert not set(excluded) & fired[index]


def test_broken_value_fails_one_pack_only(spark):
    metadata = json.dumps({"video_properties": {"duration": "long", "gps": "1"}, "note": "a@b.co"})
    row = A.audit(spark.createDataFrame([("v.mp4", "video", metadata)], "file_path string, file_type string, metadata string")).first()
    assert {f["rule"] for f in row["findings"]} == {"email", "domains"}
    assert [e["error_type"] for e in row["errors"]] == ["AnalysisError"]


def test_failed_extraction_is_not_analyzed(spark):
    row = A.audit(spark.createDataFrame(
        [("other", 0, json.dumps({"extraction_failed": True, "note": "a@b.co"}))],
        "file_type string, file_size long, metadata string")).first()
    assert row["findings"] == []


SIZES = [("a.bin", 0, ["empty_file"]), ("a.bin", 99, ["tiny_file"]), ("a.txt", 99, []), ("a.bin", 100, []),
         ("a.bin", 2 ** 30, []), ("a.bin", 2 ** 30 + 1, ["huge_file"])]


def test_sizes(spark):
    df = spark.createDataFrame([(p, s, {"md5": "d41d8cd98f00b204e9800998ecf8427e"}) for p, s, _ in SIZES],
                               "file_path string, file_size long, hashes map<string,string>")
    for row, (_, size, rules) in zip(A.audit(df).collect(), SIZES):
        assert [f["rule"] for f in row["findings"]] == rules + (["empty_hash_conflict"] if size else [])


TIMES = [
    (("2020-01-02", "2020-01-01", None), ["created_after_modified"]),
    (("2020-01-01", "2020-01-01", None), []),
    (("2031-01-01", "2032-01-01", "2033-01-01"), ["future_timestamp"] * 3),
    (("1999-12-31T23:59:59", "2000-01-01", None), ["very_old_timestamp"]),
    (("1999-01-01", None, None), []),
    (("nonsense", "2031-01-01", None), ["bad_timestamp"]),
    (("2031-01-01", "2032-01-01", "nonsense"), ["future_timestamp"] * 2 + ["bad_timestamp"]),
    ((None, "2031-01-01", "nonsense"), ["future_timestamp", "bad_timestamp"]),
    (("2024-05-02T00:00:00Z", "2024-05-02T01:00:00+02:00", None), ["created_after_modified"]),
    (("2024-05-02T00:00:00Z", "2024-05-02T03:00:00+02:00", None), []),
    (("2024-05-02T00:00:00+00:00", "2031-05-02T03:00:00-05:00", None), ["future_timestamp"]),
    (("2024-13-02T00:00:00Z", "2024-05-02T03:00:00Z", None), ["bad_timestamp"]),
]


def test_times(spark):
    df = spark.createDataFrame([t for t, _ in TIMES], "creation_time string, modification_time string, access_time string")
    rows = A.audit(df, now=F.lit("2030-01-01").cast("timestamp_ntz")).collect()
    assert [[f["rule"] for f in r["findings"]] for r in rows] == [e for _, e in TIMES]


def test_custom_pack(spark):
    from metaudit.functions.findings import finding, fires
    rule = lambda rec: fires(rec.size > 10, finding("big", "custom", "low", "Big", size=rec.size))
    A.register_rule_pack("sizes", None, {"big": rule})
    A.register_rule_pack("sizes", None, {})       # taken: ignored
    A.register_rule_pack("generic", None, {"big": rule})  # built in: ignored
    try:
        row = A.audit(spark.createDataFrame([(500,)], "file_size long")).first()
        assert [f["rule"] for f in row["findings"]] == ["big"]
    finally:
        A.CUSTOM.clear()


def test_skip_analysis(spark):
    row = A.audit(spark.createDataFrame([(0,)], "file_size long"), skip_analysis=True).first()
    assert row["findings"] is None


def test_audit_and_report_keep_the_metadata(spark):
    """What goes out is what came in, sections that no rule knows and nested lists included."""
    from metaudit.operators.audit import audit
    from metaudit.operators.report import file_report
    from pyspark.sql import functions as F

    text = '{"content_stats":{"chars":4},"pages":[{"rotation":90}],"text_info":{"content":"a@b.org","word_count":2}}'
    rows = spark.createDataFrame([("/a.txt", "text", 9, text)], "file_path string, file_type string, file_size long, metadata string")
    for df in (rows, rows.withColumn("metadata", F.parse_json("metadata"))):
        for out in (audit(df), file_report(audit(df)), audit(df, skip_analysis=True)):
            assert out.schema["metadata"].dataType == df.schema["metadata"].dataType
            assert out.select(F.to_json("metadata") if df is not rows else F.col("metadata")).first()[0] == text


def test_text_stats_separators(spark):
    from metaudit.operators.classify import text_stats
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a\x1cb\x1fc d",)], "t string").select(text_stats(F.col("t")).alias("s")).first()
    assert row["s"]["word_count"] == 4


def test_corpus_totals_come_from_the_job_that_writes(spark, tmp_path):
    from metaudit.operators.report import corpus_report, corpus_summary_severity, corpus_summary_type, write_audit
    from metaudit.operators.pattern_rules import detect

    df = spark.createDataFrame([(f"a{i}.txt", "text", f"mail a{i}@b.example and 10.0.0.{i}" if i % 2 else "") for i in range(20)]
                               + [("x", "odd", "4539578763621486")], "file_path string, file_type string, note string")
    audited = detect(df, ["note"])
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("once", "once")
    totals = write_audit(audited, str(tmp_path / "a"))
    assert len(jobs.getJobIdsForGroup("once")) == 1
    back = spark.read.parquet(str(tmp_path / "a"))
    severity = {r.severity: r.n_findings for r in corpus_summary_severity(back).collect()}
    types = {r.type: r.n_findings for r in corpus_summary_type(back).collect()}
    assert {k: n for (m, k), n in totals.items() if m == "severity"} == severity
    assert {k: n for (m, k), n in totals.items() if m == "type" and n} == types
    assert totals["records", "total"] == 21 and totals["file_type", "others"] == 21
    report = {(r.measure, r.key): r.n for r in corpus_report(back).collect()}
    assert {k: n for (m, k), n in report.items() if m == "severity"} == severity
    assert {k: n for (m, k), n in report.items() if m == "type"} == types
    assert report["file_type", "text"] == 20 and report["errors", "total"] == 0
    assert corpus_report(back)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    none = {(r.measure, r.key): r.n for r in corpus_report(back.limit(0)).collect()}
    assert none["severity", "total"] == 0 == none["records", "total"]


@pytest.mark.parametrize("query", ["compare_fields", "field_differences", "compare_hashes"])
def test_comparisons_scan_once(spark, query):
    from metaudit.plans import QUERIES
    out = QUERIES[query](spark, "/root/testdata/sf0.001")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_a_hot_field_is_spread(spark):
    from metaudit.operators import compare
    rows = [("g", f"f{i}", '{"hot": "%d", "rare": "x"}' % (i % 3) if i else '{"hot": "0", "lone": "y"}') for i in range(600)]
    df = spark.createDataFrame(rows, "g string, file_path string, metadata string")
    long = compare._dealt(compare._metadata_long(df, "g", "file_path"), "group_id", "field")
    assert long.where("field = 'hot'").select("salt").distinct().count() == compare.SALTS
    found = compare.compare_fields(df, "g").collect()
    assert len(found) == 600 + 599 and {r.field for r in found} == {"hot", "rare"}
    assert {r.field for r in compare.field_differences(df, "g").collect()} == {"hot"}


def test_archive_section_reaches_the_rules(spark):
    from metaudit.operators.archive import archive_info, with_archive_info
    rows = [("a.zip", "x.EXE", 5, 10, False), ("a.zip", "d/", 0, 0, True), ("a.zip", "y.txt", 1, 700, False), ("b.zip", "plain", 5, 5, False),
            ("c.zip", "z.dll", 1, 1000, False), ("c.zip", "z2.dll", 0, None, False), ("d.zip", "dir.exe/", 0, 0, True)]
    members = spark.createDataFrame(rows, "file_id string, member string, compressed long, uncompressed long, is_dir boolean")
    info = {r.file_id: (r.archive_info.compression_ratio, r.archive_info.extensions) for r in archive_info(members).collect()}
    assert info == {"a.zip": (0.85, {".exe": 1, ".txt": 1}), "b.zip": (100.0, {}), "c.zip": (0.1, {".dll": 2}), "d.zip": (None, {})}
    records = spark.createDataFrame([("a.zip",), ("b.zip",), ("c.zip",), ("e.txt",)], "file_path string")
    meta = F.struct(F.struct(F.lit("ascii").alias("encoding")).alias("text_info"))
    for df in (records, records.withColumn("metadata", meta), records.withColumn("metadata", F.when(F.col("file_path") != "a.zip", meta))):
        told = with_archive_info(df, members)
        found = {r.file_path: {f.rule for f in r.findings} for r in A.audit(told).collect()}
        assert {k: v & {"archive_ratio_anomaly", "archive_has_executables"} for k, v in found.items()} == {
            "a.zip": {"archive_ratio_anomaly", "archive_has_executables"}, "b.zip": set(),
            "c.zip": {"archive_ratio_anomaly"} | ({"archive_has_executables"} if ".dll" in K.ARCHIVE_EXECUTABLE_EXTENSIONS else set()),
            "e.txt": set()}
    with pytest.raises(ValueError):
        with_archive_info(records.withColumn("metadata", F.lit("{}")), members)


def test_a_stored_hash_list_is_not_shuffled(spark, tmp_path):
    from metaudit.operators.generic_rules import bad_hash_findings, store_hash_list
    bad = spark.createDataFrame([(f"{i:032x}",) for i in range(0, 300, 3)] + [(None,)], "md5 string")
    listed = store_hash_list(bad.union(bad), "bad_hashes_of_a_test", str(tmp_path / "bad"), 4)
    assert listed.count() == 100
    records = spark.createDataFrame([(i, f"{i % 30:032x}" if i else None, "{}") for i in range(200)], "id int, md5 string, metadata string")
    out = bad_hash_findings(records.withColumn("hashes", F.create_map(F.lit("md5"), "md5")), listed, "id")
    assert {r.id for r in out.collect()} == {i for i in range(1, 200) if i % 30 % 3 == 0}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert plan.count("metadata") == 1  # in the scan of the test's rows alone
    spark.sql("DROP TABLE bad_hashes_of_a_test")


def test_flatten_does_not_serialise(spark):
    from metaudit.operators.flatten import flatten_entries
    deep = "{\"a\":" * 120 + "[{\"b\": [1, {\"c\": []}]}, [2, [3]]]" + "}" * 120
    df = spark.createDataFrame([(deep,), ("{}",), ("[1, 2]",), ("3",), (None,)], "j string").select(flatten_entries(F.parse_json("j")).alias("e"))
    rows = [[(x.field, x.value) for x in r.e] if r.e is not None else None for r in df.collect()]
    path = ".".join(["a"] * 120)
    assert rows[0][0] == (f"{path}.0.b.0", "1") and rows[0][-1] == (f"{path}.1", "[2,[3]]") and rows[1] == []
