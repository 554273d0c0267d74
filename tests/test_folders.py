"""Complete listings, content of every file, and files written one by one."""

import json
import os

import pytest
from pyspark.sql import functions as F

from metaudit.operators.classify import describe_files
from metaudit.operators.redact import mark_clashes, redact_batch, write_redacted
from metaudit.operators.report import file_report
from metaudit.operators.audit import audit
from metaudit.sources import folders
from metaudit.sources.folders import FolderReader, list_folder, local_path, scan_folder, write_files
from metaudit.sources.records import write_report_files


@pytest.fixture
def tree(tmp_path):
    """Hidden, empty, nested, linked and unreadable entries."""
    files = {".env": b"KEY=1", "_b.txt": b"b", "a.txt": b"a" * 50, "none.txt": b"", "x/y/.z/deep.JPG": b"\xff\xd8", "x/e": b"",
             "x/y/f.txt": b"f", "sp ace/\u00e9.txt": b"u"}
    for name, data in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.utime(tmp_path / "a.txt", (1_000_000_000, 1_100_000_000))
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "broken").symlink_to(tmp_path / "nothing")
    os.mkfifo(tmp_path / "pipe")
    return tmp_path, files


def names(df, root):
    return {os.path.relpath(r.file_path, root): r for r in df.collect()}


def test_listing_is_complete(spark, tree):
    root, files = tree
    found = names(list_folder(spark, str(root), recursive=True), root)
    assert set(found) == set(files) | {"link.txt", "broken"}
    assert {n: found[n].file_size for n in files} == {n: len(d) for n, d in files.items()}
    a = found["a.txt"]
    assert a.access_time == "2001-09-09T01:46:40.000000" and a.modification_time == "2004-11-09T11:33:20.000000"
    assert all(r.creation_time > "2020" for n, r in found.items() if n != "broken")
    assert found["link.txt"].file_size == 50 and found["broken"].file_size is None
    assert [n for n, r in found.items() if r.errors] == ["broken"]
    top = names(list_folder(spark, f"file:{root}"), root)
    assert set(top) == {".env", "_b.txt", "a.txt", "none.txt", "link.txt", "broken"}
    assert set(names(list_folder(spark, str(root), True, include="*.JPG"), root)) == {"x/y/.z/deep.JPG", "broken"}


@pytest.mark.parametrize("wanted", [1, 2, 4, 100])
def test_every_folder_is_in_one_partition(tree, wanted):
    root, files = tree
    reader = FolderReader(str(root), True, wanted)
    parts = reader.partitions()
    paths = [p for part in parts for batch in reader.read(part) for p in batch.column(0).to_pylist()]
    assert len(paths) == len(set(paths)) == len(files) + 2
    assert len(parts) >= min(wanted, 5)


def test_unreadable_folder_is_told(tree, monkeypatch):
    root, _ = tree
    scan = os.scandir

    def refused(path):
        if str(path).endswith("/x"):
            raise PermissionError(13, "Permission denied")
        return scan(path)

    monkeypatch.setattr(folders.os, "scandir", refused)
    reader = FolderReader(str(root), True, 1)
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [r["file_path"] for r in rows if r["problem"] and "listed" in r["problem"]] == [f"{root}/x"]
    with pytest.raises(ValueError):
        FolderReader(str(root / "a.txt"), True, 1).partitions()


def test_schemes():
    assert local_path("file:///a/b") == local_path("file:/a/b") == local_path("/a/b") == "/a/b"
    assert local_path("a:b/c") == "a:b/c" and local_path("rel/x") == "rel/x"
    with pytest.raises(ValueError):
        local_path("s3a://bucket/x")


def test_content_of_every_file(spark, tree, monkeypatch):
    monkeypatch.setattr(folders, "CONTENT_BYTES", 20)
    root, files = tree
    found = names(scan_folder(spark, str(root), recursive=True), root)
    assert {n: bytes(found[n].content) for n in files} == files and found["broken"].content is None
    limited = names(scan_folder(spark, str(root), recursive=True, max_content_bytes=10), root)
    assert limited["a.txt"].content is None and limited["a.txt"].file_size == 50 and limited[".env"].content == b"KEY=1"
    described = describe_files(scan_folder(spark, str(root), recursive=True).where("content IS NOT NULL"))
    rules = {os.path.basename(r.file_path): {f.rule for f in r.findings} for r in audit(described).collect()}
    assert "empty_file" in rules["none.txt"] and "empty_file" not in rules[".env"]


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"{tmp_path}/out/{i % 3}/f{i}", "x" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "file_path string, content string").repartition(4)
    bad = df.withColumn("content", F.when(F.col("file_path").endswith("f17"), F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        write_files(bad, f"{tmp_path}/out")
    left = [os.path.join(r, f) for r, _, fs in os.walk(tmp_path / "out") for f in fs]
    assert all(open(p).read() == dict(rows)[p] for p in left) and f"{tmp_path}/out/2/f17" not in left
    assert write_files(df, f"{tmp_path}/out").count() == 0  # again, after the failure
    assert write_files(df, f"file:{tmp_path}/out").count() == 0  # and once more
    found = {os.path.join(r, f): open(os.path.join(r, f)).read() for r, _, fs in os.walk(tmp_path / "out") for f in fs}
    assert found == dict(rows)


def test_files_stay_below_the_folder(spark, tmp_path):
    for path in (f"{tmp_path}/elsewhere", f"{tmp_path}/out/../x", f"{tmp_path}/out/a/..", f"{tmp_path}/outside/x"):
        with pytest.raises(Exception, match="not below"):
            write_files(spark.createDataFrame([(path, "x")], "file_path string, content string"), f"{tmp_path}/out")


def test_files_that_cannot_be_written_are_told(spark, tmp_path):
    (tmp_path / "out" / "taken").mkdir(parents=True)
    (tmp_path / "out" / "taken" / "inside").write_text("kept")
    rows = [(f"{tmp_path}/out/taken", "x"), (f"{tmp_path}/out/free", "y")]
    failed = write_files(spark.createDataFrame(rows, "file_path string, content string"), f"{tmp_path}/out").collect()
    assert [r.file_path for r in failed] == [rows[0][0]]
    assert (tmp_path / "out" / "free").read_text() == "y" and (tmp_path / "out" / "taken" / "inside").read_text() == "kept"


def records(spark):
    meta = json.dumps({"exif": {"Make": "M"}, "notes": [1]})
    rows = [("d1/a.jpg", meta, 0), ("d2/a.jpg", meta, 0), ("d3/b.pdf", meta, 0), ("d4/c.txt", meta, 0), ("d5/d.txt", "{broken", 0)]
    return spark.createDataFrame(rows, "file_path string, metadata string, n int")


def test_redacted_records_are_written(spark, tmp_path):
    done = {r.file_path: r for r in write_redacted(records(spark), str(tmp_path / "o"), suffix="clean").collect()}
    assert {p: r.status for p, r in done.items()} == {
        "d1/a.jpg": "successful", "d2/a.jpg": "failed", "d3/b.pdf": "successful", "d4/c.txt": "successful", "d5/d.txt": "successful"}
    assert sorted(os.listdir(tmp_path / "o")) == ["a_clean.jpg", "b_clean.pdf", "c_clean.txt", "d_clean.txt"]
    first = json.loads((tmp_path / "o" / "a_clean.jpg").read_text())
    assert first["file_path"] == "d1/a.jpg" and first["metadata"] == {"exif": {}, "notes": [1]} and first["redaction"] == "redacted"
    assert done["d2/a.jpg"].output_path is None and done["d1/a.jpg"].output_path == f"{tmp_path}/o/a_clean.jpg"


def test_clash_has_an_error(spark):
    marked = {r.file_path: r for r in mark_clashes(redact_batch(records(spark), "out")).collect()}
    assert [e.error_type for e in marked["d2/a.jpg"].errors] == ["OutputError"] and not marked["d1/a.jpg"].errors
    assert len(marked) == 5 and marked["d2/a.jpg"].metadata is not None


def test_one_report_per_file(spark, tmp_path):
    reports = file_report(audit(records(spark)))
    assert write_report_files(reports, str(tmp_path / "r")).count() == 0
    found = [json.loads((tmp_path / "r" / n).read_text()) for n in os.listdir(tmp_path / "r")]
    assert sorted(d["file_path"] for d in found) == [f"d{i}/{n}" for i, n in enumerate(["a.jpg", "a.jpg", "b.pdf", "c.txt", "d.txt"], 1)]
    assert all("errors" in d and "mime_type" in d for d in found)
