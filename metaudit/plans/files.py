"""File listings, classification, consistency rules and archive aggregates."""

from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.findings import combine
from metaudit.functions.paths import basename
from metaudit.operators import archive, classify, executable_rules, generic_rules
from metaudit.operators import pattern_rules as P
from metaudit.operators.audit import run_rule
from metaudit.operators.report import explode_findings, file_report, findings_report
from metaudit.plans.base import as_json, choose, derive, derive_sql, in_list, quoted, register, table
from metaudit.plans.text import DETECTOR_SQL
from metaudit.plans.typed import rule_sql
from metaudit.sources import files as S
from metaudit.sources.folders import list_folder, write_files
from metaudit.sources.folders import scan_folder as read_folder
from metaudit.sources.records import parse_records, recorded_findings, write_findings_csv, write_report_json
from metaudit.sources.scratch import scratch_path

EXTENSIONS = [
    ".jpg", ".PDF", ".docx", ".mp3", ".mp4", ".exe", ".txt", ".csv", ".tar.gz", ".zip", ".md", "", ".JSON", ".py",
    ".png", ".doc", ".wav", ".mkv", ".so", ".html", ".json", ".c", ".tgz", ".xlsx", ".jpeg", ".", ".h",
]
MIMES = [
    "image/jpeg", "image/png", "application/pdf", "text/plain", "application/msword", None, "audio/mpeg", "video/mp4",
    "application/x-executable", "application/zip", "text/html",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
]
FILES = {
    "id": "doc_id",
    "file_path": "source || '/' || CASE WHEN doc_id % 40 = 0 THEN '.' ELSE 'doc_' END || CAST(doc_id AS STRING) || "
                 + choose("doc_id", EXTENSIONS),
    "file_size": "n_chars",
    "mime_type": choose("doc_id", MIMES),
    "folder": "source",
}
FILES_SQL = derive_sql("documents", FILES)
NAME = "regexp_extract(file_path, '[^/]*$')"
# extension by position of the last dot; a name whose only dots lead it has none
EXT = (f"CASE WHEN instr(ltrim({NAME}, '.'), '.') > 0 THEN lower('.' || list_last(string_split(ltrim({NAME}, '.'), '.'))) ELSE '' END")


def files(spark, sf_dir):
    return derive(table(spark, sf_dir, "documents"), FILES)


LISTED = {"id": "doc_id", "file_path": "'file:/d/' || CASE WHEN doc_id % 7 = 0 THEN '.env' ELSE 'f' END || CAST(doc_id AS STRING)",
          "file_size": "CASE WHEN doc_id % 5 = 0 THEN CAST(0 AS BIGINT) ELSE n_chars END",
          "modification_time": "'2020-01-01T00:00:00'"}


@register("scan_files",
          "SELECT regexp_replace(file_path, '^file:', '') AS file_path, file_size, CASE WHEN file_size = 0 THEN 0 WHEN id % 7 <> 0 "
          "THEN n_bytes END AS n_bytes, CASE WHEN file_size > 0 AND id % 7 = 0 THEN 'ReadError' END AS error "
          f"FROM (SELECT *, text_bytes AS n_bytes FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in LISTED.items())}, "
          "octet_length(encode(text)) AS text_bytes FROM documents))")
def scan_files(spark, sf_dir):
    """A scan that saw neither empty nor hidden files, completed from the inventory of all documents."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    listing = docs.selectExpr(*[f"{e} AS {n}" for n, e in LISTED.items()], "CAST(text AS BINARY) AS content")
    none = F.lit(None).cast("string")
    scanned = listing.where("file_size > 0 AND id % 7 <> 0").select(
        F.regexp_replace("file_path", "^file:", "").alias("file_path"), "file_size", none.alias("creation_time"),
        "modification_time", none.alias("access_time"), "content")
    found = S.complete_scan(scanned, listing.select("file_path", "file_size", "modification_time"))
    return found.select("file_path", "file_size", F.octet_length("content").alias("n_bytes"),
                        F.get("errors", F.lit(0))["error_type"].alias("error"))


@register("scan_table_files", "SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes, true AS with_hidden "
                              "FROM documents WHERE source IS NOT NULL GROUP BY source")
def scan_table_files(spark, sf_dir):
    """Documents written as text files by source, and their folders listed: sizes, and the hidden checksum files too."""
    path = scratch_path(spark)
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.coalesce("text", F.lit("")).alias("text"), "source")
    docs.write.partitionBy("source").text(path)
    listed = list_folder(spark, path, recursive=True).withColumn("source", F.regexp_extract("file_path", "/source=([^/]*)/", 1))
    plain = F.col("file_path").endswith(".txt")
    return listed.where("source <> ''").groupBy("source").agg(
        F.sum(F.when(plain, F.col("file_size"))).alias("n_bytes"),
        (F.count_if(plain) == F.count_if(basename(F.col("file_path")).startswith("."))).alias("with_hidden"))


@register("scan_folder", f"SELECT CAST(doc_id AS VARCHAR) AS name, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS file_size, "
                         "true AS timed, 0 AS n_errors FROM documents WHERE source IS NOT NULL")
def scan_folder(spark, sf_dir):
    """Documents written as files of their own, some hidden, some empty, and scanned with their content."""
    path = scratch_path(spark)
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    mark = F.when(F.col("doc_id") % 3 == 0, ".").when(F.col("doc_id") % 3 == 1, "_").otherwise("f")
    name = F.concat(F.lit(f"{path}/"), F.col("source"), F.lit("/"), mark, F.col("doc_id").cast("string"))
    write_files(docs.select(name.alias("file_path"), F.coalesce("text", F.lit("")).alias("content")), path)
    found = read_folder(spark, path, recursive=True)
    timed = F.least("creation_time", "modification_time", "access_time") > "2020-01-01"
    return found.select(F.regexp_extract("file_path", r"[^/0-9]([0-9]+)\z", 1).alias("name"), F.sha2("content", 256).alias("sha256"),
                        "file_size", timed.alias("timed"), F.size("errors").alias("n_errors"))


@register("filter_files", f"SELECT file_path FROM ({FILES_SQL}) WHERE regexp_matches({NAME}, '^doc_.*[0-9]\\.[jp].*$') "
                          f"AND NOT regexp_matches({NAME}, '^.*[13]\\..*$')")
def filter_files(spark, sf_dir):
    return S.filter_files(files(spark, sf_dir), "doc_*[0-9].[jp]*", "*[13].*").select("file_path")


@register("limit_files", f"SELECT file_path FROM ({FILES_SQL}) ORDER BY file_path LIMIT 100")
def limit_files(spark, sf_dir):
    return S.limit_files(files(spark, sf_dir).select("file_path"), 100)


@register("filter_by_size", f"SELECT file_path, file_size FROM ({FILES_SQL}) WHERE file_size BETWEEN 100 AND 5000")
def filter_by_size(spark, sf_dir):
    return S.filter_by_size(files(spark, sf_dir), 100, 5000).select("file_path", "file_size")


@register("group_by_extension", f"SELECT {EXT} AS extension, file_path FROM ({FILES_SQL})")
def group_by_extension(spark, sf_dir):
    return S.group_by_extension(files(spark, sf_dir))


@register("extension_counts", f"SELECT {EXT} AS extension, count(*) AS n_files FROM ({FILES_SQL}) GROUP BY 1")
def extension_counts(spark, sf_dir):
    return S.extension_counts(files(spark, sf_dir))


@register("read_records", "SELECT 'data/' || source AS file_path, 'other' AS file_type, n_chars AS file_size, "
                          "doc_id AS meta_id, lang AS meta_lang, 2 AS n_tags FROM documents")
def read_records(spark, sf_dir):
    """Record JSON in, typed columns and VARIANT metadata out."""
    docs = table(spark, sf_dir, "documents")
    json = docs.select(F.to_json(F.struct(
        F.concat(F.lit("data/"), "source").alias("file_path"), F.lit("other").alias("file_type"),
        F.col("n_chars").alias("file_size"),
        F.struct("doc_id", F.struct("lang", F.array("lang", "source").alias("tags")).alias("info")).alias("metadata"),
    )).alias("value"))
    records = parse_records(json)
    return records.select(
        "file_path", "file_type", "file_size",
        F.try_variant_get("metadata", "$.doc_id", "bigint").alias("meta_id"),
        F.try_variant_get("metadata", "$.info.lang", "string").alias("meta_lang"),
        F.size(F.try_variant_get("metadata", "$.info.tags", "array<string>")).alias("n_tags"))


_SAVED = "source || '/' || CAST(doc_id AS STRING)"


@register("recorded_findings",
          f"SELECT {_SAVED} AS file_path, 'none' AS finding_type, 'none' AS severity, 'No findings' AS description, '' AS data "
          "FROM documents WHERE doc_id % 3 = 0 UNION ALL "
          f"SELECT {_SAVED}, 'privacy', 'high', 'Language', 'lang=' || coalesce(lang, 'None') || ', ' || coalesce(source, 'None') "
          f"FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT {_SAVED}, 'information', 'low', 'Size', "
          "'size=' || CAST(n_chars AS STRING) FROM documents WHERE doc_id % 3 = 2")
def saved_findings(spark, sf_dir):
    """Reports over records that were saved with their findings, as JSON."""
    def saved(type_, severity, description, data):
        return F.struct(F.lit(type_).alias("type"), F.lit(severity).alias("severity"),
                        F.lit(description).alias("description"), F.to_json(data).alias("data"))

    language = saved("privacy", "high", "Language", F.struct(F.array("lang", "source").alias("lang")))
    size = saved("information", "low", "Size", F.struct(F.col("n_chars").alias("size")))
    kept = F.slice(F.array(language, size), 1, F.pmod("doc_id", F.lit(3)).cast("int"))
    json = table(spark, sf_dir, "documents").select(
        F.to_json(F.struct(F.expr(_SAVED).alias("file_path"), kept.alias("findings"))).alias("value"))
    return findings_report(recorded_findings(parse_records(json))).select(
        "file_path", "finding_type", "severity", "description", "data")


FOUND = {"id": "doc_id", "file_path": "source || '/' || CAST(doc_id AS STRING) || '.txt'", "file_size": "n_chars",
         "secret_note": "text"}
_FOUND_SQL = derive_sql("documents", FOUND)
SINK_DETECTORS = ["email", "credit_cards", "api_keys"]
_SINK_FINDINGS = " UNION ALL ".join(DETECTOR_SQL[d](_FOUND_SQL, "secret_note") for d in SINK_DETECTORS)


def _audited(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "documents"), FOUND)
    found = P.detect(rows, ["secret_note"], SINK_DETECTORS)
    return found.select(
        "id", "file_path", F.lit("other").alias("file_type"), "file_size", F.lit("text/plain").alias("mime_type"),
        F.create_map(F.lit("sha256"), F.sha2("secret_note", 256)).alias("hashes"),
        *[F.lit(None).cast("string").alias(c) for c in ("creation_time", "modification_time", "access_time")],
        "findings", F.expr("CAST(array() AS ARRAY<STRING>)").alias("errors"))


@register("write_findings_csv",
          "SELECT d.file_path, coalesce(f.type, 'none') AS finding_type, coalesce(f.severity, 'none') AS severity, "
          "coalesce(f.description, 'No findings') AS description, coalesce(f.data, '') AS data, "
          "CAST(d.file_size AS VARCHAR) AS file_size, sha256(d.secret_note) AS sha256 "
          f"FROM ({_FOUND_SQL}) d LEFT JOIN ({_SINK_FINDINGS}) f ON d.id = f.id")
def findings_csv(spark, sf_dir):
    """Write the findings report as CSV and read it back."""
    path = scratch_path(spark)
    write_findings_csv(findings_report(_audited(spark, sf_dir)).drop("file_type"), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.fillna({"data": ""})


@register("write_report_json",
          "SELECT d.file_path, d.file_size, count(f.id) AS total, count(f.id) FILTER (f.severity = 'high') AS high, "
          "count(f.id) FILTER (f.type = 'security') AS security "
          f"FROM ({_FOUND_SQL}) d LEFT JOIN ({_SINK_FINDINGS}) f ON d.id = f.id GROUP BY d.id, d.file_path, d.file_size")
def report_json(spark, sf_dir):
    """Write one JSON document per file and read the figures back."""
    path = scratch_path(spark)
    write_report_json(file_report(_audited(spark, sf_dir)), path)
    back = spark.read.schema(
        "file_path STRING, file_size BIGINT, findings STRUCT<count: STRUCT<total: BIGINT, "
        "by_severity: STRUCT<high: BIGINT>, by_type: MAP<STRING,BIGINT>>>").json(path)
    count = F.col("findings.count")
    return back.select("file_path", "file_size", count["total"].alias("total"),
                       count["by_severity"]["high"].alias("high"),
                       F.coalesce(count["by_type"]["security"], F.lit(0)).alias("security"))


# --- classification ----------------------------------------------------------
_TYPE_SQL = "CASE " + " ".join(f"WHEN {EXT} IN {in_list(e)} THEN '{t}'" for t, e in K.FILE_TYPES.items()) + " ELSE 'other' END"


@register("classify_file_type", f"SELECT id, {_TYPE_SQL} AS file_type FROM ({FILES_SQL})")
def classify_file_type(spark, sf_dir):
    return files(spark, sf_dir).select("id", classify.classify_file_type(F.col("file_path")).alias("file_type"))


# MIME types of the extensions that occur (fixed values)
_MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".pdf": "application/pdf", ".mp3": "audio/mpeg", ".mp4": "video/mp4",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".txt": "text/plain", ".csv": "text/csv", ".zip": "application/zip", ".md": "text/markdown",
    ".json": "application/json", ".py": "text/x-python", ".png": "image/png", ".doc": "application/msword",
    ".wav": "audio/x-wav", ".html": "text/html", ".c": "text/plain", ".h": "text/plain", ".mkv": "video/matroska",
}
_known = K.mime_table()
_MIME_SQL = ("CASE WHEN file_path LIKE '%_.tar.gz' OR file_path LIKE '%_.tgz' THEN 'application/x-tar' "
             + " ".join(f"WHEN {EXT} = '{e}' THEN '{_known.get(e, m)}'" for e, m in _MIME.items() if e in _known)
             + f" WHEN {EXT} = '.exe' THEN '{_known.get('.exe', 'application/octet-stream')}' ELSE 'application/octet-stream' END")


@register("guess_mime", f"SELECT id, {_MIME_SQL} AS mime FROM ({FILES_SQL})")
def guess_mime(spark, sf_dir):
    return files(spark, sf_dir).select("id", classify.guess_mime(F.col("file_path")).alias("mime"))


@register("file_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, 128 AS sha512_length FROM documents")
def file_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", classify.file_hashes(F.col("text").cast("binary")).alias("h"))
    return rows.select("doc_id", "h.md5", "h.sha1", "h.sha256", F.length("h.sha512").alias("sha512_length"))


@register("file_timestamps",
          "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS creation_time, "
          "strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') AS modification_time FROM events")
def file_timestamps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", classify.file_timestamps(
        F.col("ts"), F.col("ts") + F.expr("INTERVAL 1 DAY"), F.lit(None).cast("timestamp")).alias("t"))
    return rows.select("event_id", "t.creation_time", "t.modification_time")


def _mime_like(parts):
    return "(" + " OR ".join(f"coalesce(mime_type, '') LIKE '%{p}%'" for p in parts) + ")"


_ROUTE_SQL = (
    f"CASE WHEN {EXT} IN {in_list(K.IMAGE_EXTENSIONS)} OR mime_type LIKE 'image/%' THEN 'image' "
    f"WHEN {EXT} IN {in_list(K.DOCUMENT_EXTENSIONS)} OR {_mime_like(K.DOCUMENT_MIMES)} THEN 'document' "
    f"WHEN {EXT} IN {in_list(K.AUDIO_EXTENSIONS)} OR mime_type LIKE 'audio/%' THEN 'audio' "
    f"WHEN {EXT} IN {in_list(K.VIDEO_EXTENSIONS)} OR mime_type LIKE 'video/%' THEN 'video' "
    f"WHEN {EXT} IN {in_list(K.EXECUTABLE_EXTENSIONS)} OR {_mime_like(K.EXECUTABLE_MIMES)} THEN 'executable' ELSE 'generic' END")


@register("route_extractor", f"SELECT id, {_ROUTE_SQL} AS extractor FROM ({FILES_SQL})")
def route_extractor(spark, sf_dir):
    return files(spark, sf_dir).select(
        "id", classify.route_extractor(F.col("file_path"), F.col("mime_type")).alias("extractor"))


@register("route_analyzers",
          f"SELECT id, CASE WHEN t = 'other' THEN '' ELSE t || ',' END || 'generic,pattern' AS packs FROM "
          f"(SELECT id, {_TYPE_SQL} AS t FROM ({FILES_SQL}))")
def route_analyzers(spark, sf_dir):
    kind = classify.classify_file_type(F.col("file_path"))
    return files(spark, sf_dir).select("id", F.array_join(classify.route_analyzers(kind), ",").alias("packs"))


HEADERS = {"id": "p_partkey", "path": "'bin/' || p_name",
           "header": choose("p_partkey", ["4D5A9000", "7F454C46", "FEEDFACE", "CAFEBABE", "FEEDFACF", "504B0304", "00"])
                     + " || hex(p_name)"}


@register("executable_format",
          "SELECT id, t AS type, CASE WHEN t = 'Unknown executable format' THEN lower(left(header, 32)) END AS magic_bytes FROM ("
          "SELECT id, header, CASE WHEN header LIKE '4D5A%' THEN 'Windows PE' WHEN header LIKE '7F454C46%' THEN 'Linux ELF' "
          "WHEN left(header, 8) IN ('FEEDFACE', 'FEEDFACF', 'CAFEBABE') THEN 'macOS Mach-O' "
          f"ELSE 'Unknown executable format' END AS t FROM ({derive_sql('part', HEADERS)}))")
def executable_format(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "part"), HEADERS)
    return rows.select("id", classify.executable_format(F.unhex("header")).alias("f")).select("id", "f.*")


@register("is_zip_based",
          f"SELECT id, {EXT} IN {in_list(K.ZIP_EXTENSIONS)} OR {_mime_like(K.ZIP_MIMES)} OR id % 9 = 0 AS zip_based FROM ({FILES_SQL})")
def is_zip_based(spark, sf_dir):
    content = F.when(F.col("id") % 9 == 0, F.unhex(F.lit("504B030414"))).otherwise(F.unhex(F.lit("00")))
    return files(spark, sf_dir).select(
        "id", classify.is_zip_based(F.col("file_path"), F.col("mime_type"), content).alias("zip_based"))


_UNIFIED = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"


@register("text_stats",
          "SELECT doc_id, len(t) - len(replace(t, chr(10), '')) + CASE WHEN t <> '' AND right(t, 1) <> chr(10) THEN 1 ELSE 0 END "
          "AS line_count, len(regexp_extract_all(t, '[^\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{3000}]+')) "
          f"AS word_count, len(t) AS character_count FROM (SELECT doc_id, {_UNIFIED} AS t FROM documents)")
def text_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", classify.text_stats(F.col("text")).alias("s"))
    return rows.select("doc_id", "s.line_count", "s.word_count", "s.character_count")


@register("text_format", "SELECT id, CASE " + " ".join(
    f"WHEN lower(file_path) LIKE '%{e}' THEN '{n}'" for e, n in K.TEXT_FORMATS.items()) + f" END AS format FROM ({FILES_SQL})")
def text_format(spark, sf_dir):
    return files(spark, sf_dir).select("id", classify.text_format(F.col("file_path")).alias("format"))


@register("record_errors",
          "SELECT 'doc/' || d.doc_id AS file_path, CASE WHEN l.doc_id IS NULL THEN 'FileNotFoundError' WHEN toxic = 1 THEN 'PathError' "
          "WHEN quality = 0 THEN 'ExtractionError' END AS error_type, CASE WHEN l.doc_id IS NULL OR toxic = 1 THEN 0 ELSE quality + 10 END "
          "AS file_size, coalesce(quality = 0, FALSE) AS extraction_failed "
          "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def record_errors(spark, sf_dir):
    """All documents are expected; those with a label were scanned."""
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path")
    expected = table(spark, sf_dir, "documents").select(path)
    scanned = table(spark, sf_dir, "labels").select(
        path, (F.col("quality") + 10).cast("bigint").alias("file_size"), (F.col("toxic") == 1).alias("is_directory"),
        F.when(F.col("quality") == 0, "unreadable").alias("extraction_error"))
    out = classify.record_errors(expected, scanned)
    return out.select("file_path", F.get("errors", F.lit(0))["error_type"].alias("error_type"), "file_size", "extraction_failed")


@register("audit_options", f"SELECT id, {_TYPE_SQL} AS file_type, TRUE AS no_hashes, {_MIME_SQL} LIKE 'text/%' AS has_text_info FROM ({FILES_SQL})")
def audit_options(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        *[f"{e} AS {n}" for n, e in FILES.items() if n != "mime_type"], "CAST(text AS BINARY) AS content")
    described = classify.describe_files(docs, skip_hashes=True)
    return described.select("id", "file_type", F.col("hashes").isNull().alias("no_hashes"),
                            F.col("metadata.text_info").isNotNull().alias("has_text_info"))


CONTENTS = {"id": "doc_id", "file_path": "'d/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 6 = 5 THEN '.exe' ELSE '.txt' END",
            "head": choose("doc_id", ["", "FFD8FFE0", "EFBBBF", "FFFE", "E92C", "4D5A"])}
_CONTENTS_SQL = derive_sql("documents", CONTENTS)


@register("describe_content",
          f"SELECT id, 'mime_ext_mismatch' AS rule FROM ({_CONTENTS_SQL}) WHERE id % 6 = 1 UNION ALL "
          f"SELECT id, 'odd_text_encoding' AS rule FROM ({_CONTENTS_SQL}) WHERE id % 6 IN (2, 3, 4) UNION ALL "
          f"SELECT id, 'exe_type' AS rule FROM ({_CONTENTS_SQL}) WHERE id % 6 = 5")
def describe_content(spark, sf_dir):
    """Findings that rest on the bytes of a file: its type, the encoding of its text, its header."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        *[f"{e} AS {n}" for n, e in CONTENTS.items()], "CAST(coalesce(text, '') AS BINARY) AS content")
    files = docs.withColumn("content", F.concat(F.unhex("head"), F.col("content"))).drop("head")
    described = classify.describe_files(files, skip_hashes=True)
    rules = [(generic_rules.PACK, "mime_ext_mismatch"), (generic_rules.PACK, "odd_text_encoding"), (executable_rules.PACK, "exe_type")]
    found = run_rule(described, lambda rec: combine(pack.rules[name](rec) for pack, name in rules))
    return explode_findings(found, "id").select("id", "rule")


# --- consistency rules -------------------------------------------------------
NOW = "2001-06-01 00:00:00"
STAMPS = {
    "id": "l_orderkey * 8 + l_linenumber",
    "creation_time": "CASE WHEN l_partkey % 50 = 0 THEN 'yesterday' WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS STRING) END",
    "modification_time": "CASE WHEN l_partkey % 60 = 1 THEN 'soon' WHEN l_suppkey % 9 = 0 THEN '' ELSE CAST(l_shipdate AS STRING) END",
    "access_time": "CASE WHEN l_suppkey % 11 = 0 THEN '31/12/1999' WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_shipdate AS STRING) END",
    "file_path": "'f/' || CAST(l_orderkey AS STRING)",
}
_TIMES = ["creation_time", "modification_time", "access_time"]
_STAMPS_SQL = (
    "SELECT *, try_cast(creation_time AS TIMESTAMP) AS c, try_cast(modification_time AS TIMESTAMP) AS m, "
    "try_cast(access_time AS TIMESTAMP) AS a, coalesce(creation_time, '') <> '' AS hc, coalesce(modification_time, '') <> '' AS hm, "
    "coalesce(access_time, '') <> '' AS ha FROM (" + derive_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", STAMPS) + ")")
_ENOUGH = "(CASE WHEN hc THEN 1 ELSE 0 END + CASE WHEN hm THEN 1 ELSE 0 END + CASE WHEN ha THEN 1 ELSE 0 END) >= 2"
_EARLY = "(hc AND hm AND (c IS NULL OR m IS NULL))"
_RAW = ("array_to_string([x for x in [CASE WHEN hc THEN 'creation_time: ' || creation_time END, CASE WHEN hm THEN 'modification_time: ' "
        "|| modification_time END, CASE WHEN ha THEN 'access_time: ' || access_time END] if x IS NOT NULL], ', ')")
_OK = {"c": "TRUE", "m": "(NOT hc OR c IS NOT NULL)", "a": "(NOT hc OR c IS NOT NULL) AND (NOT hm OR m IS NOT NULL)"}
_ALL_OK = "(NOT hc OR c IS NOT NULL) AND (NOT hm OR m IS NOT NULL) AND (NOT ha OR a IS NOT NULL)"
_STAMP_RULES = {
    "created_after_modified": ("consistency", "medium", [(
        "hc AND hm AND c > m", "'File creation time is after modification time (suspicious)'", f"'timestamps=' || {_RAW}")]),
    "future_timestamp": ("consistency", "medium", [(
        f"{_ENOUGH} AND NOT {_EARLY} AND h{t} AND {t} > TIMESTAMP '{NOW}' AND {_OK[t]}",
        f"'File {n.replace('_', ' ')} is in the future'", f"'timestamp=' || {n}") for t, n in zip("cma", _TIMES)]),
    "very_old_timestamp": ("information", "low", [(
        f"{_ENOUGH} AND {_ALL_OK} AND h{t} AND year({t}) < 2000",
        f"'File {n.replace('_', ' ')} is very old'", f"'timestamp=' || {n}") for t, n in zip("cma", _TIMES)]),
    "bad_timestamp": ("error", "low", [(
        f"{_ENOUGH} AND NOT ({_ALL_OK})", "'Error analyzing timestamps'",
        "'error=Invalid isoformat string: ' || CASE WHEN hc AND c IS NULL THEN creation_time WHEN hm AND m IS NULL THEN modification_time "
        f"ELSE access_time END || '; timestamps=' || {_RAW}")]),
}


def _stamped(rule):
    @register(rule, rule_sql(_STAMPS_SQL, rule, *_STAMP_RULES[rule]))
    def run(spark, sf_dir):
        joined = table(spark, sf_dir, "lineitem").join(
            table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        records = derive(joined, STAMPS)
        now = F.lit(NOW).cast("timestamp_ntz")
        return explode_findings(run_rule(records, generic_rules.PACK.rules[rule], now), "id")


for _rule in _STAMP_RULES:
    _stamped(_rule)

ZONED = {"id": "o_orderkey", "creation_time": "left(CAST(o_orderdate AS STRING), 10) || 'T00:30:00Z'",
         "modification_time": "left(CAST(o_orderdate AS STRING), 10) || " + choose(
             "o_custkey", ["T01:00:00+02:00", "T03:00:00+02:00", "T00:10:00Z", "T00:10:00-01:30", "T24:61:00Z"])}
_ZONED_SQL = ("SELECT *, try_cast(creation_time AS TIMESTAMPTZ) AS c, try_cast(modification_time AS TIMESTAMPTZ) AS m "
              f"FROM ({derive_sql('orders', ZONED)})")


@register("zoned_timestamps",
          f"SELECT id, 'created_after_modified' AS rule FROM ({_ZONED_SQL}) WHERE c > m UNION ALL "
          f"SELECT id, 'bad_timestamp' AS rule FROM ({_ZONED_SQL}) WHERE c IS NULL OR m IS NULL")
def zoned_timestamps(spark, sf_dir):
    """Times with a zone: compared as moments, and not bad in themselves."""
    records = derive(table(spark, sf_dir, "orders"), ZONED)
    rules = [generic_rules.PACK.rules[n] for n in ("created_after_modified", "bad_timestamp")]
    found = run_rule(records, lambda rec: combine(rule(rec) for rule in rules))
    return explode_findings(found, "id").select("id", "rule")


SIZED = {**FILES, "md5": f"CASE WHEN doc_id % 12 = 0 THEN '{K.EMPTY_MD5}' ELSE md5(text) END",
         "file_size": "CASE doc_id % 8 WHEN 0 THEN 0 WHEN 1 THEN n_chars * 100000 WHEN 2 THEN n_chars % 200 ELSE n_chars END",
         "ratio": "CAST(n_chars % 40 AS DOUBLE) / 20",
         "n_exe": "n_chars % 3", "n_dll": "n_chars % 2", "encoding": choose("doc_id", ["utf-8", "latin-1", "ascii", None, "utf-16"]),
         "lines": "n_chars"}
_SIZED_SQL = derive_sql("documents", SIZED)
_GIB = 1024 ** 3
_matching = " ".join(f"WHEN mime_type = '{m}' THEN '{', '.join(e)}'" for m, e in K.MIME_TO_EXTENSIONS.items())
_EXPECTED = f"CASE {_matching} END"
_FILE_RULES = {
    "mime_ext_mismatch": ("consistency", "medium", [(
        f"NOT list_contains(string_split({_EXPECTED}, ', '), {EXT})",
        f"'File extension ''' || {EXT} || ''' does not match MIME type ''' || mime_type || ''' (expected: ' || {_EXPECTED} || ')'",
        f"'mime_type=' || mime_type || '; extension=' || {EXT} || '; expected_extensions=' || {_EXPECTED}")]),
    "empty_file": ("consistency", "medium", [("file_size = 0", "'File size is zero bytes (empty file)'", "'size=0'")]),
    "tiny_file": ("consistency", "low", [(
        f"file_size > 0 AND file_size < 100 AND {EXT} NOT IN ('.txt', '.md', '.csv', '.json')",
        "'File is unusually small (' || file_size || ' bytes)'", "'size=' || file_size")]),
    "huge_file": ("information", "low", [(
        f"file_size > {_GIB}", f"'File is very large (' || printf('%.2f', file_size / {_GIB}.0::DOUBLE) || ' GB)'", "'size=' || file_size")]),
    "empty_hash_conflict": ("consistency", "high", [(
        f"md5 = '{K.EMPTY_MD5}' AND file_size > 0", "'File hash matches empty file but size is not zero'",
        "'hash=' || md5 || '; size=' || file_size")]),
    "archive_ratio_anomaly": ("information", "low", [(
        "ratio < 1.0", "'Archive has unusual compression ratio: ' || CAST(ratio AS VARCHAR) || '%'",
        "'compression_ratio=' || CAST(ratio AS VARCHAR)")]),
    "archive_has_executables": ("security", "medium", [(
        "n_exe > 0 OR n_dll > 0", "'Archive contains executable files'",
        "'executables=' || array_to_string([x for x in [CASE WHEN n_dll > 0 THEN '.dll: ' || n_dll END, "
        "CASE WHEN n_exe > 0 THEN '.exe: ' || n_exe END] if x IS NOT NULL], ', ')")]),
    "odd_text_encoding": ("information", "low", [(
        "encoding NOT IN ('utf-8', 'ascii')", "'Text file uses non-standard encoding: ' || encoding", "'encoding=' || encoding")]),
    "large_text_file": ("information", "low", [(
        "lines > 10000", "'Text file is very large (' || lines || ' lines)'", "'line_count=' || lines")]),
}


def _sized_records(spark, sf_dir):
    metadata = F.struct(
        F.struct(F.col("ratio").alias("compression_ratio"),
                 F.expr("map_filter(map('.exe', n_exe, '.dll', n_dll, '.txt', 5L), (k, v) -> v > 0)").alias("extensions"))
        .alias("archive_info"),
        F.struct(F.col("encoding"), F.col("lines").alias("line_count")).alias("text_info"))
    rows = derive(table(spark, sf_dir, "documents"), SIZED)
    return rows.select("id", "file_path", "file_size", "mime_type", F.create_map(F.lit("md5"), "md5").alias("hashes"),
                       as_json(metadata))


def _sized(rule):
    @register(rule, rule_sql(_SIZED_SQL, rule, *_FILE_RULES[rule]))
    def run(spark, sf_dir):
        return explode_findings(run_rule(_sized_records(spark, sf_dir), generic_rules.PACK.rules[rule]), "id")


for _rule in _FILE_RULES:
    _sized(_rule)


@register("known_bad_hash",
          "SELECT doc_id AS id, 'known_bad_hash' AS rule, 'high' AS severity, 'hash=' || md5(text) AS data FROM documents "
          "WHERE md5(text) IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def known_bad_hash(spark, sf_dir):
    """Hashes of texts labelled toxic, searched in all documents."""
    docs = table(spark, sf_dir, "documents")
    bad = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select(F.md5("text").alias("md5"))
    records = docs.select(F.col("doc_id").alias("id"), F.create_map(F.lit("md5"), F.md5("text")).alias("hashes"))
    return explode_findings(generic_rules.known_bad_hash(records, bad), "id").select("id", "rule", "severity", "data")


@register("bad_hash_findings",
          "SELECT doc_id AS id, 'known_bad_hash' AS rule, 'high' AS severity, md5(text) AS md5 FROM documents "
          "WHERE md5(text) IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def bad_hash_findings(spark, sf_dir):
    """The same through a list that is stored in buckets of the digest."""
    docs = table(spark, sf_dir, "documents")
    bad = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select(F.md5("text").alias("md5"))
    path = scratch_path(spark)
    listed = generic_rules.store_hash_list(bad, "bad_" + path[-32:], path)
    records = docs.select(F.col("doc_id").alias("id"), "text", F.create_map(F.lit("md5"), F.md5("text")).alias("hashes"))
    return generic_rules.bad_hash_findings(records, listed, "id").select(
        "id", "finding.rule", "finding.severity", F.get(F.col("finding.evidence")["hash"], F.lit(0)).alias("md5"))


# --- archives: one archive per order, one member per line --------------------
MEMBERS = {
    "file_id": "l_orderkey",
    "member": "CASE WHEN l_partkey % 12 = 0 THEN '[Content_Types].xml' WHEN l_partkey % 12 = 1 THEN 'word/document.xml' "
              "WHEN l_partkey % 12 = 2 THEN 'xl/workbook.xml' WHEN l_partkey % 12 = 3 THEN 'ppt/presentation.xml' "
              "WHEN l_partkey % 24 = 4 THEN 'META-INF/MANIFEST.MF' WHEN l_partkey % 24 = 16 THEN 'WEB-INF/' "
              "WHEN l_partkey % 36 = 5 THEN 'AndroidManifest.xml' WHEN l_partkey % 12 = 6 THEN 'mimetype' "
              "WHEN l_partkey % 12 = 7 THEN 'ppt/slides/slide' || CAST(l_linenumber AS STRING) || '.xml' "
              "WHEN l_partkey % 12 = 8 THEN 'lib/' ELSE 'a/f' || CAST(l_linenumber AS STRING) || '.' || "
              "CASE WHEN l_linenumber % 2 = 0 THEN 'EXE' ELSE 'txt' END END",
    "compressed": "CAST(l_quantity AS BIGINT)",
    "uncompressed": "CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * l_linenumber END",
    "is_dir": "l_partkey % 12 = 8 OR l_partkey % 24 = 16",
    "mimetype": choose("l_suppkey", ["application/vnd.oasis.opendocument.text", "application/epub+zip",
                                     "application/vnd.oasis.opendocument.spreadsheet"]),
}
_MEMBERS_SQL = derive_sql("lineitem", MEMBERS)


def members(spark, sf_dir):
    return derive(table(spark, sf_dir, "lineitem"), MEMBERS)


@register("archive_summary",
          "SELECT file_id, count(*) AS file_count, CAST(sum(compressed) AS BIGINT) AS compressed_size, "
          "CAST(sum(uncompressed) AS BIGINT) AS uncompressed_size, CASE WHEN sum(uncompressed) > 0 THEN "
          "round(sum(compressed)::DOUBLE / sum(uncompressed)::DOUBLE * 100, 2) END AS compression_ratio "
          f"FROM ({_MEMBERS_SQL}) GROUP BY file_id")
def archive_summary(spark, sf_dir):
    return archive.archive_summary(members(spark, sf_dir))


_EXT_OF_MEMBER = EXT.replace("file_path", "member")
_ARCHIVE_RULES_SQL = (
    "WITH m AS (" + _MEMBERS_SQL + "), a AS (SELECT file_id, CASE WHEN sum(uncompressed) > 0 THEN "
    "round(sum(compressed)::DOUBLE / sum(uncompressed)::DOUBLE * 100, 2) END AS ratio, "
    f"count(*) FILTER (NOT is_dir AND {_EXT_OF_MEMBER} = '.exe') AS n_exe FROM m GROUP BY file_id) "
    "SELECT file_id AS id, 'archive_ratio_anomaly' AS rule, 'compression_ratio=' || CAST(ratio AS VARCHAR) AS data FROM a WHERE ratio < 1.0 "
    "UNION ALL SELECT file_id, 'archive_has_executables', 'executables=.exe: ' || n_exe FROM a WHERE n_exe > 0")


@register("archive_rules", _ARCHIVE_RULES_SQL)
def archive_rules(spark, sf_dir):
    """Archive rules over records whose archive section is filled from their members."""
    found = members(spark, sf_dir)
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    told = archive.with_archive_info(records, found, "id")
    rules = [generic_rules.PACK.rules[n] for n in ("archive_ratio_anomaly", "archive_has_executables")]
    return explode_findings(run_rule(told, lambda rec: combine(rule(rec) for rule in rules)), "id").select("id", "rule", "data")


@register("archive_extensions",
          f"SELECT file_id, e AS extension, count(*) AS n FROM (SELECT file_id, "
          f"{EXT.replace('file_path', 'member')} AS e FROM ({_MEMBERS_SQL}) WHERE NOT is_dir) WHERE e <> '' GROUP BY file_id, e")
def archive_extensions(spark, sf_dir):
    return archive.archive_extensions(members(spark, sf_dir))


@register("archive_type",
          "SELECT file_id, CASE WHEN apk THEN 'Android Package (APK)' WHEN jar AND war THEN 'Web Application Archive (WAR)' "
          "WHEN jar THEN 'Java Archive (JAR)' WHEN odf LIKE '%opendocument.text%' THEN 'OpenDocument Text (ODT)' "
          "WHEN odf LIKE '%opendocument.spreadsheet%' THEN 'OpenDocument Spreadsheet (ODS)' "
          "WHEN ct AND doc THEN 'Microsoft Word Document (DOCX)' WHEN ct AND xl THEN 'Microsoft Excel Workbook (XLSX)' "
          "WHEN ct AND ppt THEN 'Microsoft PowerPoint Presentation (PPTX)' ELSE 'ZIP-based' END AS archive_type FROM ("
          "SELECT file_id, bool_or(member = 'AndroidManifest.xml') AS apk, bool_or(member = 'META-INF/MANIFEST.MF') AS jar, "
          "bool_or(member = 'WEB-INF/') AS war, max(CASE WHEN member = 'mimetype' THEN mimetype END) AS odf, "
          "bool_or(member = '[Content_Types].xml') AS ct, bool_or(member = 'word/document.xml') AS doc, "
          "bool_or(member = 'xl/workbook.xml') AS xl, bool_or(member = 'ppt/presentation.xml') AS ppt "
          f"FROM ({_MEMBERS_SQL}) GROUP BY file_id)")
def archive_type(spark, sf_dir):
    return archive.archive_type(members(spark, sf_dir))


@register("slide_count", f"SELECT file_id, count(*) FILTER (member LIKE 'ppt/slides/slide%') AS slide_count FROM ({_MEMBERS_SQL}) GROUP BY file_id")
def slide_count(spark, sf_dir):
    return archive.slide_count(members(spark, sf_dir))
