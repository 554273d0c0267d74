"""Folders of real files: scan, describe, audit, redact, write reports, stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from metaudit.functions.paths import extension, glob_match
from metaudit.operators import classify, redact, report
from metaudit.operators.audit import audit
from metaudit.sources import registry
from metaudit.sources.files import filter_by_size, limit_files, scan_files
from metaudit.sources.records import parse_records, read_records, write_findings_csv, write_report_json
from metaudit.streaming import audit_stream, latest_severities, stream_records

DOCUMENT = "Quarterly notes\nMail jane.roe@example.com or call 555-123-4567.\nID 123-45-6789\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "document.txt").write_text(DOCUMENT)
    (root / "readme.txt").write_text("Nothing here.\nSecond line")
    (root / "empty.txt").write_text("")
    (root / "latin.txt").write_bytes(b"caf\xe9 one\r\ntwo\rthree")
    (root / "sub").mkdir()
    (root / "sub" / "photo.jpg").write_bytes(b"\xff\xd8\xff\xe0" + b"0" * 200)
    return str(root)


def scan_all(spark, folder, recursive=False):
    """The scan, with the empty file from an inventory."""
    listing = [(os.path.join(folder, n), os.path.getsize(os.path.join(folder, n)), "2020-01-01T00:00:00")
               for n in os.listdir(folder) if n.endswith(".txt")]
    return scan_files(spark, folder, recursive, inventory=spark.createDataFrame(
        listing, "file_path string, file_size long, modification_time string"))


def test_scan(spark, folder):
    assert scan_files(spark, folder).count() == 3  # Spark lists no empty files
    assert scan_all(spark, folder).count() == 4
    assert scan_all(spark, folder, recursive=True).count() == 5
    assert scan_files(spark, folder, recursive=True, include="*.jpg").count() == 1
    limited = scan_files(spark, folder, max_content_bytes=30)
    assert limited.count() == 3 and limited.where("content IS NULL").select("file_size").collect() == [(len(DOCUMENT),)]
    assert limit_files(scan_all(spark, folder, True), 2).count() == 2
    assert filter_by_size(scan_all(spark, folder, True), 1, 100).count() == 3


def test_inventory_completes_the_scan(spark, tmp_path):
    for name, text in {".env": "KEY=1", "_b.txt": "b", "a.txt": "a", "none.txt": ""}.items():
        (tmp_path / name).write_text(text)
    listing = spark.createDataFrame([(f"file:{p}", p.stat().st_size, None) for p in tmp_path.iterdir()],
                                    "file_path string, file_size long, modification_time string")
    rows = {os.path.basename(r["file_path"]): r for r in scan_files(spark, str(tmp_path), inventory=listing).collect()}
    assert set(rows) == {".env", "_b.txt", "a.txt", "none.txt"}
    assert {n: (r["content"], len(r["errors"])) for n, r in rows.items()} == {
        ".env": (None, 1), "_b.txt": (None, 1), "a.txt": (b"a", 0), "none.txt": (b"", 0)}
    only = scan_files(spark, str(tmp_path), include="*.txt", inventory=listing)
    assert only.count() == 3


def test_describe_and_audit(spark, folder):
    files = scan_all(spark, folder, recursive=True).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    described = classify.describe_files(files)
    rows = {os.path.basename(r["file_path"]): r for r in audit(described, text_fields=["text"]).collect()}
    assert set(rows["document.txt"]["hashes"]) == {"md5", "sha1", "sha256", "sha512"}
    assert rows["document.txt"]["mime_type"] == "text/plain" and rows["photo.jpg"]["file_type"] == "image"
    assert {"email", "phone", "ssn"} <= {f["rule"] for f in rows["document.txt"]["findings"]}
    assert rows["readme.txt"]["findings"] == []
    assert [f["rule"] for f in rows["empty.txt"]["findings"]] == ["empty_file"]
    assert all(not r["errors"] for r in rows.values())


def test_text_stats(spark, folder):
    described = classify.describe_files(scan_all(spark, folder), skip_hashes=True)
    got = {os.path.basename(r["file_path"]): r["metadata"]["text_info"] for r in described.collect()}
    assert [got["readme.txt"][c] for c in ("line_count", "word_count", "character_count")] == [2, 4, 25]
    assert [got["empty.txt"][c] for c in ("line_count", "word_count", "character_count")] == [0, 0, 0]
    assert [got["latin.txt"][c] for c in ("line_count", "word_count", "character_count")] == [3, 4, 18]
    assert {n: r["encoding"] for n, r in got.items() if r} == {
        "readme.txt": "ascii", "document.txt": "ascii", "empty.txt": "ascii", "latin.txt": "iso-8859-1"}
    assert described.where("hashes IS NOT NULL").count() == 0


CONTENTS = [("a.txt", b"%PDF-1.7", "application/pdf"), ("a.docx", b"PK\x03\x04..", classify.guess_mime),
            ("a.bin", b"PK\x03\x04..", "application/zip"), ("a.mp3", b"\0\0\0\x18ftypM4A ", classify.guess_mime),
            ("a", b"\0\0\0\x18ftypisom", "video/mp4"), ("a.so", b"\x7fELF\2", classify.guess_mime),
            ("a.txt", b"MZ\x90\0", "application/x-msdownload"), ("a.txt", None, "text/plain"), ("a.txt", b"", "text/plain")]


def test_mime_of_content(spark):
    df = spark.createDataFrame([(p, c) for p, c, _ in CONTENTS], "p string, c binary")
    rows = df.select(classify.mime_of_content(F.col("c"), F.col("p")).alias("m"), classify.guess_mime(F.col("p")).alias("g")).collect()
    assert [r["m"] for r in rows] == [r["g"] if callable(w) else w for r, (_, _, w) in zip(rows, CONTENTS)]


def test_encodings(spark):
    texts = {"\ufeffab c".encode("utf-16-le"): ("utf-16", 4), "\ufeffab c".encode("utf-16-be"): ("utf-16", 4), "\ufeff😀\r\né 𝄞".encode("utf-16-le"): ("utf-16", 5),
             b"\xfe\xff\xd8\x3d\xde\x00\x00a": ("utf-16", 2), b"\xff\xfe\x3d\xd8": ("utf-16", None), b"\xff\xfe\x00\xdea\x00": ("utf-16", None),
             b"\xfe\xff\xd8\x3d\xd8\x3d\xde\x00": ("utf-16", None), b"\xff\xfe\x3d\xd8\x00\xde\x00\xde": ("utf-16", None), b"\xff\xfe": ("utf-16", 0),
             "\ufeffÿØ￾".encode("utf-16-be"): ("utf-16", 3), "\ufeffab c".encode("utf-8"): ("utf-8-sig", 4),
             "é b".encode("utf-8"): ("utf-8", 3), "é b".encode("latin-1"): ("iso-8859-1", 3), b"a b": ("ascii", 3), b"\xff\xfea": ("utf-16", None)}
    df = spark.createDataFrame([(f"{i}.txt", bytearray(b)) for i, b in enumerate(texts)], "file_path string, content binary")
    rows = classify.describe_files(df).select("metadata.text_info.*").collect()
    assert [(r["encoding"], r["character_count"]) for r in rows] == list(texts.values())


def test_file_hashes(spark):
    row = spark.range(1).select(classify.file_hashes(F.lit(b"abc")).alias("h")).first()["h"]
    assert row["sha512"].startswith("ddaf35a193617abacc417349ae20413112e6fa4e89a97ea2") and row["sha512"].endswith("a54ca49f")


def test_missing_file(spark, folder):
    scanned = classify.describe_files(scan_files(spark, folder))
    expected = scanned.select("file_path").union(spark.createDataFrame([("/nonexistent/file.txt",)], "file_path string"))
    errors = classify.record_errors(expected, scanned)
    assert errors.where(F.size("errors") > 0).select("file_path", "file_type").collect() == [("/nonexistent/file.txt", "unknown")]
    assert report.error_summary(errors).first()["total_errors"] == 1


def test_redact_text(spark):
    row = spark.createDataFrame([(DOCUMENT,)], "t string").select(redact.redact_text(F.col("t")).alias("t")).first()
    assert "jane.roe@example.com" not in row["t"] and "555-123-4567" not in row["t"]
    assert "[EMAIL]" in row["t"] and "123-45-6789" in row["t"]


def test_redact_fields_keep(spark):
    metadata = json.dumps({"exif": {"Make": "a", "GPS": "b"}, "iptc": {"Credit": "c"}, "tags": {"Artist": "d", "Track": "e"}})
    df = spark.createDataFrame([("x.jpg", metadata), ("x.mp3", metadata), ("x.bin", metadata)], "file_path string, metadata string")
    rows = redact.redact_fields(df, ["exif", "Make", "art"]).collect()
    image, audio, other = (json.loads(r["metadata"]) for r in rows)
    assert image["exif"] == {"Make": "a"} and image["iptc"] == {}
    assert audio["tags"] == {"Artist": "d"} and rows[1]["redaction"] == "redacted"
    assert other["tags"] == {"Artist": "d", "Track": "e"} and rows[2]["redaction"] == "copied"
    dropped = redact.redact_fields(df, ["Make"]).first()
    assert json.loads(dropped["metadata"])["exif"] == {}  # exif itself is not kept


def test_redaction_keeps_the_rest(spark):
    """Sections that no rule knows stay, in every type of metadata; a copied record is untouched."""
    text = ('{"exif":{"Make":"a","n":{"x":[1,null]}},"iptc":"odd","pages":[{"rotation":90}],'
            '"text_info":{"line_count":3,"word_count":2}}')
    df = spark.createDataFrame([("x.jpg", text), ("x.txt", text), ("y.jpg", "{broken"), ("z.jpg", None)],
                               "file_path string, metadata string")
    done = {r["file_path"]: r["metadata"] for r in redact.redact_fields(df).collect()}
    redacted = {"exif": {}, "iptc": {}, **{k: json.loads(text)[k] for k in ("pages", "text_info")}}
    assert json.loads(done["x.jpg"]) == redacted and done["x.txt"] == text and done["y.jpg"] is done["z.jpg"] is None
    variant = redact.redact_fields(df.withColumn("metadata", F.try_parse_json("metadata")))
    shown = {r["file_path"]: r["m"] for r in variant.select("file_path", F.to_json("metadata").alias("m")).collect()}
    assert json.loads(shown["x.jpg"]) == redacted and json.loads(shown["x.txt"]) == json.loads(text)
    shape = "exif struct<Make: string, Model: string>, made timestamp, pages array<struct<rotation: int>>"
    typed = df.limit(2).withColumn("metadata", F.from_json("metadata", shape).withField("made", F.lit("2020-01-01").cast("timestamp")))
    image, copied = redact.redact_fields(typed, ["exif", "Make"]).collect()
    assert image["metadata"] == copied["metadata"] and image["metadata"]["made"] is not None
    assert redact.redact_fields(typed).first()["metadata"]["exif"]["Make"] is None
    assert redact.redact_fields(typed).schema["metadata"].dataType == typed.schema["metadata"].dataType


def test_report_files(spark, folder, tmp_path):
    files = scan_all(spark, folder, True).withColumn("text", F.col("content").cast("string"))
    audited = audit(classify.describe_files(files.where("file_path NOT LIKE '%latin%'")), text_fields=["text"])
    write_findings_csv(report.findings_report(audited), str(tmp_path / "csv"))
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert rows.where("description = 'No findings'").count() == 2
    write_report_json(report.file_report(audited), str(tmp_path / "json"))
    docs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(docs) == 4 and all("creation_time" in d["timestamps"] for d in docs)
    found = next(d for d in docs if d["file_name"] == "document.txt")["findings"]
    assert found["count"]["by_severity"]["high"] == 2 and found["count"]["total"] == len(found["details"])


def records_folder(tmp_path):
    path = tmp_path / "records"
    path.mkdir()
    lines = [
        {"file_path": "/a.mp3", "file_type": "audio", "file_size": 1000, "hashes": {"md5": "x"},
         "metadata": {"tags": {"artist": "Jane", "comment": "jane@example.com"}}},
        {"file_path": "/b.txt", "file_type": "other", "file_size": 0, "metadata": {}},
    ]
    (path / "part.json").write_text("\n".join(json.dumps(x) for x in lines))
    return str(path)


def test_records(spark, tmp_path):
    records = read_records(spark, records_folder(tmp_path))
    got = {r["file_path"]: {f["rule"] for f in r["findings"]} for r in audit(records).collect()}
    assert got == {"/a.mp3": {"audio_personal", "email", "domains"}, "/b.txt": {"empty_file"}}


def test_stream(spark, tmp_path):
    records = stream_records(spark, records_folder(tmp_path))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    audit_stream(records, out, checkpoint).awaitTermination(120)
    got = {r["file_path"]: [f["rule"] for f in r["findings"]] for r in spark.read.parquet(out).collect()}
    assert got == {"/a.mp3": ["audio_personal", "email", "domains"], "/b.txt": ["empty_file"]}
    query = latest_severities(audit(stream_records(spark, str(tmp_path / "records")))).writeStream \
        .format("memory").queryName("severities").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["severity"]: r["n_findings"] for r in spark.table("severities").collect()} == {
        "medium": 2, "high": 1, "low": 1}


def test_registry(spark, folder):
    registry.register_source("names", lambda s, path: scan_files(s, path).select("file_path"))
    registry.register_source("NAMES", lambda s, path: None)  # taken: ignored
    assert registry.load(spark, "Names", folder).count() == 3
    seen = []
    registry.register_sink("Count", lambda df: seen.append(df.count()))
    registry.get_sink("COUNT")(registry.load(spark, "names", folder))
    assert seen == [3] and registry.get_sink("nothing") is None
    registry.SOURCES.pop("names"), registry.SINKS.pop("count")


PATHS = {"a/b.TXT": ".txt", ".bashrc": "", "a.b/c": "", "x.tar.gz": ".gz", "..a.b": ".b", "d/...": "", "e.": ".", "": ""}
GLOBS = [("a.jpg", "*.jpg", True), ("a.jpgx", "*.jpg", False), ("a1", "a[0-9]", True), ("a1", "a[!0-9]", False),
         ("a]", "a[]]", True), ("a[", "a[", True), ("a\nb", "a?b", True), ("a.b", "a?b", True), ("axb", "a.b", False)]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", extension(F.col("p")).alias("e"))
    assert {r["p"]: r["e"] for r in df.collect()} == PATHS
    for name, pattern, expected in GLOBS:
        assert spark.range(1).select(glob_match(F.lit(name), pattern).alias("m")).first()["m"] is expected, pattern


MIMES = {"a.tar.gz": "application/x-tar", "a.tgz": "application/x-tar", "a.gz": "application/octet-stream",
         "a.JPG": "image/jpeg", "noext": "application/octet-stream", "a.txt": "text/plain"}


def test_mime(spark):
    df = spark.createDataFrame([(p,) for p in MIMES], "p string").select("p", classify.guess_mime(F.col("p")).alias("m"))
    assert {r["p"]: r["m"] for r in df.collect()} == MIMES


def test_parse_bad_record(spark):
    row = parse_records(spark.createDataFrame([("{broken",)], "value string")).first()
    assert row["file_path"] is None
