"""Reports, redaction of fields, normalizers, flattening, comparison and similarity."""

from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.findings import Items, finding
from metaudit.operators import compare, normalize, redact, report, similar
from metaudit.operators import pattern_rules as P
from metaudit.operators.audit import audit
from metaudit.operators.classify import classify_file_type, error_struct, record_errors
from metaudit.operators.flatten import flatten_for_compare, flatten_metadata
from metaudit.operators.records import conform
from metaudit.plans.base import choose, derive, derive_sql, quoted, register, section, table
from metaudit.plans.files import FILES, FILES_SQL, _TYPE_SQL
from metaudit.plans.text import DETECTOR_SQL, patterns_sql
from metaudit.sources.folders import local_path, scan_folder
from metaudit.sources.scratch import scratch_path

DETECTORS = ["email", "phone", "domains", "ip_addresses", "credit_cards", "api_keys"]
DOCS = {**FILES, "secret_note": "text", "creation": "lang"}
DOCS_SQL = derive_sql("documents", DOCS)
FOUND_SQL = patterns_sql(DOCS_SQL, "secret_note", DETECTORS)
ORDER_SQL = "CASE rule " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(DETECTORS)) + " END"


def audited(spark, sf_dir):
    """Documents with detector findings and a file type."""
    rows = derive(table(spark, sf_dir, "documents"), DOCS)
    found = P.detect(rows, ["secret_note"], DETECTORS)
    return found.withColumns({
        "file_type": classify_file_type(F.col("file_path")),
        "hashes": F.create_map(F.lit("sha256"), F.sha2("secret_note", 256)),
        "creation_time": F.lit(None).cast("string"), "modification_time": F.lit(None).cast("string"),
    })


@register("findings_report",
          "SELECT d.file_path, coalesce(f.type, 'none') AS finding_type, coalesce(f.severity, 'none') AS severity, "
          "coalesce(f.description, 'No findings') AS description, coalesce(f.data, '') AS data, d.file_size, "
          f"d.t AS file_type, sha256(d.secret_note) AS sha256 FROM (SELECT *, {_TYPE_SQL} AS t FROM ({DOCS_SQL})) d "
          f"LEFT JOIN ({FOUND_SQL}) f ON d.id = f.id")
def findings_report(spark, sf_dir):
    return report.findings_report(audited(spark, sf_dir))


_COUNTS = ", ".join(f"count(f.id) FILTER (f.severity = '{s}') AS n_{s}" for s in K.SEVERITIES) + ", count(f.id) AS n_total"


@register("file_summary",
          "SELECT d.file_path, any_value(d.t) AS file_type, any_value(d.file_size) AS file_size, any_value(d.mime_type) AS mime_type, "
          f"'' AS creation_time, '' AS modification_time, any_value(sha256(d.secret_note)) AS sha256, {_COUNTS} "
          f"FROM (SELECT *, {_TYPE_SQL} AS t FROM ({DOCS_SQL})) d LEFT JOIN ({FOUND_SQL}) f ON d.id = f.id GROUP BY d.id, d.file_path")
def file_summary(spark, sf_dir):
    return report.file_summary(audited(spark, sf_dir))


@register("file_report",
          f"SELECT d.file_path, {_COUNTS}, count(f.id) FILTER (f.type = 'privacy') AS n_privacy "
          f"FROM ({DOCS_SQL}) d LEFT JOIN ({FOUND_SQL}) f ON d.id = f.id GROUP BY d.id, d.file_path")
def file_report(spark, sf_dir):
    rows = audited(spark, sf_dir).withColumns({
        "access_time": F.lit(None).cast("string"), "errors": F.expr("CAST(array() AS ARRAY<STRING>)")})
    docs = report.file_report(rows)
    count = F.col("findings.count")
    return docs.select(
        "file_path", *[count["by_severity"][s].alias(f"n_{s}") for s in K.SEVERITIES], count["total"].alias("n_total"),
        F.coalesce(F.try_element_at(count["by_type"], F.lit("privacy")), F.lit(0)).alias("n_privacy"))


@register("corpus_summary_severity",
          " UNION ALL ".join(f"SELECT '{s}' AS severity, count(*) FILTER (severity = '{s}') AS n_findings FROM ({FOUND_SQL})"
                             for s in K.SEVERITIES + ["other"])
          + f" UNION ALL SELECT 'total' AS severity, count(*) AS n_findings FROM ({FOUND_SQL})")
def corpus_summary_severity(spark, sf_dir):
    return report.corpus_summary_severity(audited(spark, sf_dir))


@register("corpus_summary_type", f"SELECT type, count(*) AS n_findings FROM ({FOUND_SQL}) GROUP BY type")
def corpus_summary_type(spark, sf_dir):
    return report.corpus_summary_type(audited(spark, sf_dir))


@register("corpus_file_types", f"SELECT t AS file_type, count(*) AS n_files FROM (SELECT {_TYPE_SQL} AS t FROM ({FILES_SQL})) GROUP BY t")
def corpus_file_types(spark, sf_dir):
    return report.corpus_file_types(audited(spark, sf_dir))


_TOTALS_SQL = (
    "SELECT 'severity' AS measure, s AS key, CAST((SELECT count(*) FROM (" + FOUND_SQL + ") f WHERE s = 'total' OR f.severity = s) AS BIGINT) AS n "
    "FROM (VALUES " + ", ".join(f"('{s}')" for s in K.SEVERITIES + ["other", "total"]) + ") v(s) "
    "UNION ALL SELECT 'records', 'total', count(*) FROM documents UNION ALL SELECT 'errors', 'total', 0 ")


@register("corpus_report", _TOTALS_SQL +
          f"UNION ALL SELECT 'type', type, count(*) FROM ({FOUND_SQL}) GROUP BY type "
          f"UNION ALL SELECT 'file_type', t, count(*) FROM (SELECT {_TYPE_SQL} AS t FROM ({FILES_SQL})) GROUP BY t")
def corpus_report(spark, sf_dir):
    """All totals in one pass over the audit."""
    return report.corpus_report(audited(spark, sf_dir))


@register("write_audit", _TOTALS_SQL +
          f"UNION ALL SELECT 'type', k, (SELECT count(*) FROM ({FOUND_SQL}) f WHERE f.type = k) "
          "FROM (VALUES " + ", ".join(f"('{t}')" for t in [*K.FINDING_TYPES, "other"]) + ") v(k) "
          f"UNION ALL SELECT 'file_type', k, (SELECT count(*) FROM (SELECT {_TYPE_SQL} AS t FROM ({FILES_SQL})) f WHERE f.t = k) "
          "FROM (VALUES " + ", ".join(f"('{t}')" for t in [*K.FILE_TYPES, "other", "unknown", "others"]) + ") v(k) "
          f"UNION ALL SELECT 'written', 'findings', count(*) FROM ({FOUND_SQL})")
def write_audit(spark, sf_dir):
    """Totals observed while the findings were written, and the number of findings that were."""
    path = scratch_path(spark)
    totals = report.write_audit(audited(spark, sf_dir), path)
    totals[("written", "findings")] = spark.read.parquet(path).agg(F.sum(F.size("findings"))).first()[0]
    return spark.createDataFrame([(m, k, n) for (m, k), n in totals.items()], "measure string, key string, n bigint")


_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@register("ranked_findings",
          f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY {_RANK}, {ORDER_SQL}) AS rank, rule, type, severity, description "
          f"FROM ({FOUND_SQL})")
def ranked_findings(spark, sf_dir):
    return report.ranked_findings(audited(spark, sf_dir), "id")


@register("evidence_sample",
          "SELECT id, 'words' AS rule, 'words: ' || array_to_string(m[1:5], ', ') || CASE WHEN len(m) > 5 THEN ' (and ' || (len(m) - 5) "
          "|| ' more)' ELSE '' END AS sample FROM (SELECT doc_id AS id, string_split(text, ' ') AS m FROM documents)")
def evidence_sample(spark, sf_dir):
    """Samples of a long evidence list: the words of each document."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.array(finding("words", "information", "low", "Words", words=Items(F.split("text", " ")))).alias("findings"))
    return report.evidence_samples(rows, "id")


@register("file_risk",
          f"SELECT d.id, CASE WHEN r = 0 THEN 'high' WHEN r = 1 THEN 'medium' WHEN r = 2 THEN 'low' ELSE 'none' END AS risk, "
          f"CASE WHEN r = 0 THEN 'red' WHEN r = 1 THEN 'yellow' ELSE 'none' END AS color FROM ({DOCS_SQL}) d LEFT JOIN "
          f"(SELECT id, min({_RANK}) AS r FROM ({FOUND_SQL}) GROUP BY id) f ON d.id = f.id")
def file_risk(spark, sf_dir):
    return report.file_risk(audited(spark, sf_dir), "id")


@register("error_summary",
          "SELECT count(*) AS total_errors FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
          "WHERE l.doc_id IS NULL OR toxic = 1")
def error_summary(spark, sf_dir):
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path")
    scanned = table(spark, sf_dir, "labels").select(path, (F.col("toxic") == 1).alias("is_directory"))
    return report.error_summary(record_errors(table(spark, sf_dir, "documents").select(path), scanned))


@register("findings_filter", f"SELECT id, rule FROM ({FOUND_SQL}) WHERE severity = 'high' AND type = 'privacy'")
def findings_filter(spark, sf_dir):
    kept = report.findings_filter(audited(spark, sf_dir), "high", "privacy")
    return report.explode_findings(kept, "id").select("id", "rule")


# --- the whole audit ---------------------------------------------------------
# Records with metadata as JSON: the text, nested, with tags and sizes for the type packs.
@register("audit",
          f"SELECT rule, severity, count(*) AS n FROM ("
          f"SELECT rule, severity FROM ({FOUND_SQL}) "
          f"UNION ALL SELECT 'doc_author', 'medium' FROM ({FILES_SQL}) WHERE {_TYPE_SQL} = 'document' "
          f"UNION ALL SELECT 'audio_personal', 'medium' FROM ({FILES_SQL}) WHERE {_TYPE_SQL} = 'audio' "
          f"UNION ALL SELECT 'audio_channels', 'low' FROM ({FILES_SQL}) WHERE {_TYPE_SQL} = 'audio' AND id % 4 > 2 "
          f"UNION ALL SELECT 'video_codec', 'low' FROM ({FILES_SQL}) WHERE {_TYPE_SQL} = 'video' "
          f"UNION ALL SELECT 'empty_file', 'medium' FROM ({FILES_SQL}) WHERE file_size = 0 "
          f"UNION ALL SELECT 'tiny_file', 'low' FROM (SELECT *, regexp_extract(file_path, '[^/]*$') AS nm FROM ({FILES_SQL})) "
          "WHERE file_size BETWEEN 1 AND 99 AND NOT regexp_matches(lower(nm), '^\\.*[^.].*\\.(txt|md|csv|json)$')"
          ") GROUP BY rule, severity")
def audit_records(spark, sf_dir):
    """Mixed records with JSON metadata through routing, type packs, generic rules and detectors."""
    rows = derive(table(spark, sf_dir, "documents"), {**FILES, "text": "text", "lang": "lang"})
    metadata = F.to_json(F.struct(
        F.struct(F.col("text").alias("secret_note")).alias("content"),
        F.struct(F.col("lang").alias("author")).alias("document_properties"),
        F.struct(F.col("lang").alias("artist")).alias("tags"),
        F.struct((F.col("id") % 4).alias("channels")).alias("audio_properties"),
        F.struct(F.lit("theora").alias("codec")).alias("video_properties")))
    records = rows.select("id", "file_path", "file_size", classify_file_type(F.col("file_path")).alias("file_type"),
                          metadata.alias("metadata"))
    found = audit(records).select(F.explode(F.transform("findings", lambda f: F.struct(
        f["rule"].alias("rule"), f["severity"].alias("severity")))).alias("f"))
    return found.groupBy("f.rule", "f.severity").agg(F.count("*").alias("n"))


# --- flattening --------------------------------------------------------------
PARTS = {"id": "p_partkey", "name": "p_name", "size": "p_size", "kind": "p_type",
         "flag": "p_size > 25", "note": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END"}
_PARTS_SQL = derive_sql("part", PARTS)


def _part_json(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "part"), PARTS)
    json = F.to_json(F.struct(
        F.struct(F.col("name"), F.struct("size", "flag").alias("deep")).alias("basic"),
        F.array("kind", "name").alias("words"),
        F.array(F.struct(F.col("size").alias("w"), F.col("kind").alias("k")), F.struct(F.lit(1).alias("w"), F.col("name").alias("k"))).alias("pages"),
        F.col("note"), F.array().cast("array<string>").alias("empty")), {"ignoreNullFields": "false"})
    return rows.select("id", json.alias("metadata"))


def _fields(pairs) -> str:
    return " UNION ALL ".join(f"SELECT id, '{f}' AS field, {v} AS value FROM ({_PARTS_SQL})" for f, v in pairs)


_TRUE = "CASE WHEN flag THEN 'True' ELSE 'False' END"


@register("flatten_metadata", _fields([
    ("basic.name", "name"), ("basic.deep.size", "CAST(size AS VARCHAR)"), ("basic.deep.flag", _TRUE),
    ("words", "kind || ', ' || name"), ("pages.0.w", "CAST(size AS VARCHAR)"), ("pages.0.k", "kind"), ("pages.1.w", "'1'"), ("pages.1.k", "name"),
    ("note", "coalesce(note, '')"), ("empty", "''")]))
def flatten(spark, sf_dir):
    return flatten_metadata(_part_json(spark, sf_dir), "id")


@register("flatten_for_compare", _fields([
    ("basic.name", "name"), ("basic.deep.size", "CAST(size AS VARCHAR)"), ("basic.deep.flag", _TRUE),
    ("words", "'[\"' || kind || '\",\"' || name || '\"]'"), ("pages", "'[{\"k\":\"' || kind || '\",\"w\":' || size || '},{\"k\":\"' || name || '\",\"w\":1}]'"),
    ("note", "note"), ("empty", "'[]'")]))
def flatten_compare(spark, sf_dir):
    return flatten_for_compare(_part_json(spark, sf_dir), "id")


@register("flatten_event_props", "SELECT event_id AS id, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events")
def flatten_event_props(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("metadata"))
    return flatten_metadata(events, "id")


# --- comparison: the customers of a nation are the files of a group -----------
CUSTOMERS = {
    "group_key": "c_nationkey", "file_path": "c_name",
    "file_type": "CASE WHEN c_nationkey % 2 = 0 THEN 'document' ELSE c_mktsegment END", "mime_type": "c_mktsegment",
    "file_size": "CAST(floor(c_acctbal) AS BIGINT)",
    "creation_time": "CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE '2020-01-01' END",
    "modification_time": "CASE WHEN c_custkey % 5 = 0 THEN '2021-01-01' END", "access_time": "c_mktsegment",
    "custkey": "c_custkey", "author": "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END",
    "lone": "CASE WHEN c_custkey % 1000 = 7 THEN c_name END", "fixed": "'same'",
}
_CUSTOMERS_SQL = derive_sql("customer", CUSTOMERS)


def _customers(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "customer"), CUSTOMERS)
    return rows.withColumns({
        "hashes": F.expr("map_filter(map('md5', md5(mime_type), 'sha1', IF(custkey % 4 = 0, sha1(file_path), NULL)), (k, v) -> v IS NOT NULL)"),
        "metadata": F.to_json(F.struct(F.struct("author", "lone").alias("info"), F.col("fixed"))),
    })


def _long(columns: dict, section: str) -> str:
    return " UNION ALL ".join(
        f"SELECT group_key AS group_id, file_path AS file_id, '{section}' AS section, '{f}' AS field, CAST({v} AS VARCHAR) AS value "
        f"FROM ({_CUSTOMERS_SQL})" for f, v in columns.items())


_BASIC = _long({n: n for n in ("file_type", "mime_type", "file_size")}, "basic_info")
_STAMP = _long({n: n for n in ("creation_time", "modification_time", "access_time")}, "timestamps")
_HASH = {"md5": "md5(mime_type)", "sha1": "CASE WHEN custkey % 4 = 0 THEN sha1(file_path) END"}
_META = {"info.author": "author", "info.lone": "lone", "fixed": "fixed"}
_META_LONG = f"SELECT * FROM ({_long(_META, 'metadata_fields')}) WHERE value IS NOT NULL"


@register("compare_basic", _BASIC)
def compare_basic(spark, sf_dir):
    return compare.compare_basic(_customers(spark, sf_dir), "group_key")


@register("compare_timestamps", _STAMP)
def compare_timestamps(spark, sf_dir):
    return compare.compare_timestamps(_customers(spark, sf_dir), "group_key")


@register("compare_hashes",
          f"SELECT * FROM ({_long(_HASH, 'hashes')}) h WHERE EXISTS (SELECT 1 FROM ({_long(_HASH, 'hashes')}) o "
          "WHERE o.group_id = h.group_id AND o.field = h.field AND o.value IS NOT NULL)")
def compare_hashes(spark, sf_dir):
    return compare.compare_hashes(_customers(spark, sf_dir), "group_key")


def _kept(having):
    return (f"SELECT group_id, field, file_id, value FROM ({_META_LONG}) l WHERE (group_id, field) IN "
            f"(SELECT (group_id, field) FROM ({_META_LONG}) GROUP BY group_id, field HAVING {having})")


@register("compare_fields", _kept("count(*) > 1"))
def compare_fields(spark, sf_dir):
    return compare.compare_fields(_customers(spark, sf_dir), "group_key")


@register("field_differences", _kept("count(*) > 1 AND count(DISTINCT value) > 1"))
def field_differences(spark, sf_dir):
    return compare.field_differences(_customers(spark, sf_dir), "group_key")


@register("comparison_status",
          "SELECT group_id, section, field, count(value) AS n_values, CASE WHEN count(DISTINCT value) = 1 THEN 'same' ELSE 'different' END AS status, "
          "CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value FROM ("
          f"{_BASIC} UNION ALL {_STAMP} UNION ALL SELECT * FROM ({_long(_HASH, 'hashes')}) WHERE value IS NOT NULL UNION ALL {_META_LONG}) "
          "GROUP BY group_id, section, field HAVING section <> 'metadata_fields' OR count(value) > 1")
def comparison_status(spark, sf_dir):
    return compare.comparison_status(_customers(spark, sf_dir), "group_key")


@register("exact_duplicates", "SELECT sha256(text) AS digest, count(*) AS n_files, min(doc_id) AS first_file FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return compare.exact_duplicates(table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id")


# --- similarity --------------------------------------------------------------
def _pairs_sql(threshold: int, group: str = "") -> str:
    """Exact scores of all pairs of distinct contents that share a shingle."""
    key, on = (f"{group} AS g, ", "a.g = b.g AND ") if group else ("0 AS g, ", "")
    return (
        f"WITH u AS (SELECT {key}min(doc_id) AS rep, count(*) AS copies, text FROM documents WHERE regexp_matches(text, '\\S') "
        f"GROUP BY text{', ' + group if group else ''}), "
        "w AS (SELECT g, rep, copies, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM u), "
        "s AS (SELECT g, rep, copies, list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, greatest(len(w) - 2, 1) + 1)]) AS s FROM w), "
        "x AS (SELECT g, rep, len(s) AS n, unnest(s) AS h FROM s), "
        f"p AS (SELECT a.g, a.rep AS file1, b.rep AS file2, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON {on}a.h = b.h AND a.rep < b.rep "
        "GROUP BY ALL), "
        "r AS (SELECT g, file1, file2, CAST(round(100.0::DOUBLE * (i::DOUBLE / (na + nb - i))) AS INT) AS similarity FROM p), "
        f"q AS (SELECT r.*, c.copies AS copies1, d.copies AS copies2 FROM r JOIN u c ON r.file1 = c.rep AND r.g = c.g "
        f"JOIN u d ON r.file2 = d.rep AND r.g = d.g WHERE similarity >= {threshold}) ")


# Every pair of files, so copies are named each and pair with one another.
@register("pairwise_similarity", _pairs_sql(50, "source") +
          ", m AS (SELECT g, doc_id AS file_id, rep, copies FROM documents JOIN u ON documents.text = u.text AND source = g), "
          "f AS (SELECT q.g, least(x.file_id, y.file_id) AS file1, greatest(x.file_id, y.file_id) AS file2, similarity, "
          "CASE WHEN x.file_id < y.file_id THEN copies1 ELSE copies2 END AS copies1, "
          "CASE WHEN x.file_id < y.file_id THEN copies2 ELSE copies1 END AS copies2 "
          "FROM q JOIN m x ON q.file1 = x.rep AND q.g = x.g JOIN m y ON q.file2 = y.rep AND q.g = y.g UNION ALL "
          "SELECT x.g, x.file_id, y.file_id, 100, x.copies, y.copies FROM m x JOIN m y ON x.g = y.g AND x.rep = y.rep AND x.file_id < y.file_id) "
          "SELECT g AS group_id, file1, file2, similarity, copies1, copies2, CASE WHEN similarity < 50 THEN 'low' "
          "WHEN similarity < 80 THEN 'medium' ELSE 'high' END AS band FROM f")
def pairwise_similarity(spark, sf_dir):
    index = similar.text_index(table(spark, sf_dir, "documents"), "doc_id", "text", 50, "source")
    return similar.pairwise_similarity(index, each_file=True)


@register("find_similar", _pairs_sql(70) +
          ", m AS (SELECT doc_id AS file_id, rep, copies FROM documents JOIN u USING (text)) "
          "SELECT file_id, rep AS similar_to, 100 AS similarity, copies - 1 AS n_files FROM m WHERE copies > 1 UNION ALL "
          "SELECT file_id, file2, similarity, copies2 FROM m JOIN q ON rep = file1 UNION ALL "
          "SELECT file_id, file1, similarity, copies1 FROM m JOIN q ON rep = file2")
def find_similar(spark, sf_dir):
    return similar.find_similar(similar.text_index(table(spark, sf_dir, "documents"), "doc_id", "text"))


@register("similar_clusters", _pairs_sql(70).replace("WITH u AS", "WITH RECURSIVE u AS", 1) +
          ", t AS (SELECT text, min(doc_id) AS rep, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text), "
          "e AS (SELECT file1 AS a, file2 AS b FROM q UNION ALL SELECT file2, file1 FROM q), "
          "reach AS (SELECT rep AS a, rep AS b FROM t UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), "
          "c AS (SELECT a AS rep, min(b) AS cluster FROM reach GROUP BY a), "
          "z AS (SELECT cluster, sum(copies) AS n_files FROM t JOIN c USING (rep) GROUP BY cluster) "
          "SELECT doc_id AS file_id, coalesce(cluster, doc_id) AS cluster, CAST(coalesce(n_files, 1) AS BIGINT) AS n_files "
          "FROM documents LEFT JOIN t USING (text) LEFT JOIN c USING (rep) LEFT JOIN z USING (cluster)")
def similar_clusters(spark, sf_dir):
    return similar.similar_clusters(similar.text_index(table(spark, sf_dir, "documents"), "doc_id", "text"))


@register("similarity_band", "SELECT part AS score, CASE WHEN part < 50 THEN 'low' WHEN part < 80 THEN 'medium' ELSE 'high' END AS band, "
                             "count(*) AS n FROM (SELECT CAST(l_quantity AS INT) * 2 AS part FROM lineitem) GROUP BY 1, 2")
def similarity_band(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") * 2).alias("score"))
    return scored.groupBy("score", similar.similarity_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


# --- field redaction ---------------------------------------------------------
KEEP = ["exif", "Make", "Title", "author", "art"]
REDACTED = {
    "id": "p_partkey",
    "file_path": "'d/' || CAST(p_partkey AS STRING) || " + choose(
        "p_partkey", [".jpg", ".png", ".pdf", ".docx", ".xlsx", ".mp3", ".wav", ".txt", ".flac"]),
    "make": "p_brand", "model": "p_name", "title": "p_name", "author": "p_brand", "artist": "p_type",
}
_REDACTED_SQL = derive_sql("part", REDACTED)


def _redactable(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "part"), REDACTED)
    return rows.withColumn("metadata", F.to_json(F.struct(
        section({"Make": "make", "Model": "model"}).alias("exif"),
        section({"Title": "title", "Author": "author"}).alias("document_info"),
        section({"author": "author", "creator": "author", "title": "title", "comments": "title", "description": "title",
                 "revision": "make"}).alias("document_properties"),
        F.struct(F.array(F.col("make"), F.lit(None).cast("string"), F.lit("z")).alias("deep"), F.col("id").alias("size")).alias("notes"),
        section({"Artist": "artist", "TITLE": "title", "Track": "make"}).alias("tags")))) \
        .withColumn("errors", F.when(F.col("id") % 10 == 0, F.array(error_struct("ExtractionError", "unreadable")))
                    .otherwise(F.array()))


def _shown(column):
    """Entries of a map as sorted text."""
    return F.array_join(F.sort_array(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")


def _text_of(*pairs) -> str:
    """SQL of the same text from (key, value SQL, condition or '') triples."""
    items = ", ".join(
        f"CASE WHEN {condition or 'TRUE'} THEN '{key}=' || {value} END" for key, value, condition in pairs)
    return f"array_to_string(list_sort([x for x in [{items}] if x IS NOT NULL]), '|')"


_DOCX, _XLSX = "file_path LIKE '%.docx'", "file_path LIKE '%.xlsx'"
_PROPS = _text_of(
    ("author", "author", ""), ("creator", "author", ""),
    ("title", f"CASE WHEN {_DOCX} OR {_XLSX} THEN '' ELSE title END", ""),
    ("comments", f"CASE WHEN {_DOCX} THEN '' ELSE title END", ""),
    ("description", f"CASE WHEN {_XLSX} THEN '' ELSE title END", ""), ("revision", "make", ""))
_REDACTIONS = {
    "redact_image_fields": ("exif", _text_of(
        ("Make", "make", "file_path NOT LIKE '%.png'"), ("Model", "model", "file_path NOT LIKE '%.png' AND file_path NOT LIKE '%.jpg'"))),
    "redact_pdf_fields": ("document_info", _text_of(("Title", "title", ""), ("Author", "author", "file_path NOT LIKE '%.pdf'"))),
    "redact_audio_fields": ("tags", _text_of(
        ("Artist", "artist", ""),
        ("TITLE", "title", ""),
        ("Track", "make", "file_path NOT LIKE '%.mp3' AND file_path NOT LIKE '%.flac'"))),
    "redact_docx_fields": ("document_properties", _PROPS),
}


def _redaction(name, column, sql):
    @register(name, f"SELECT id, {sql} AS fields FROM ({_REDACTED_SQL})")
    def run(spark, sf_dir):
        done = conform(redact.redact_fields(_redactable(spark, sf_dir), KEEP))
        return done.select("id", _shown(F.col("metadata")[column]).alias("fields"))


for _n, (_c, _s) in _REDACTIONS.items():
    _redaction(_n, _c, _s)


@register("redact_xlsx_fields", f"SELECT id, {_text_of(('creator', quoted(''), ''), ('title', 'title', ''), ('description', quoted(''), ''), ('revision', 'make', ''))} AS fields FROM ({_REDACTED_SQL})")
def redact_xlsx_fields(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "part"), REDACTED)
    properties = section({"creator": "author", "title": "title", "description": "title", "revision": "make"})
    return rows.select("id", _shown(redact.redact_xlsx_fields(properties, ["title"])).alias("fields"))


_COPIED = "regexp_matches(file_path, '\\.(wav|txt)$')"


def _object(*pairs) -> str:
    """SQL of a JSON object from (key, value SQL, condition or '') triples."""
    items = ", ".join(
        f"CASE WHEN {condition or 'TRUE'} THEN '\"{key}\":' || to_json({value}) END" for key, value, condition in pairs)
    return f"'{{' || array_to_string([x for x in [{items}] if x IS NOT NULL], ',') || '}}'"


_NOT = "file_path NOT LIKE '%{}'".format
_WHOLE = " || ".join([
    "'{\"document_info\":'", _object(("Author", "author", _NOT(".pdf")), ("Title", "title", "")),
    "',\"document_properties\":'", _object(
        ("author", "author", ""), ("comments", f"CASE WHEN {_DOCX} THEN '' ELSE title END", ""), ("creator", "author", ""),
        ("description", f"CASE WHEN {_XLSX} THEN '' ELSE title END", ""), ("revision", "make", ""),
        ("title", f"CASE WHEN {_DOCX} OR {_XLSX} THEN '' ELSE title END", "")),
    "',\"exif\":'", _object(("Make", "make", _NOT(".png")), ("Model", "model", f"{_NOT('.png')} AND {_NOT('.jpg')}")),
    "',\"notes\":{\"deep\":[' || to_json(make) || ',null,\"z\"],\"size\":' || id || '},\"tags\":'", _object(
        ("Artist", "artist", ""), ("TITLE", "title", ""), ("Track", "make", f"{_NOT('.mp3')} AND {_NOT('.flac')}")), "'}'"])


@register("redact_fields", f"SELECT id, CASE WHEN {_COPIED} THEN 'copied' ELSE 'redacted' END AS redaction, {_WHOLE} AS metadata "
                           f"FROM ({_REDACTED_SQL})")
def redact_fields(spark, sf_dir):
    """The whole metadata after redaction, with keys sorted; ``notes`` is a section that no rule knows."""
    done = redact.redact_fields(_redactable(spark, sf_dir), KEEP)
    return done.select("id", "redaction", F.to_json(F.parse_json("metadata")).alias("metadata"))


@register("redact_batch",
          "SELECT file_path, CASE WHEN id % 10 <> 0 THEN 'out/' || regexp_replace(regexp_extract(file_path, '[^/]*$'), "
          "'(\\.[a-z0-9]+)$', '_clean\\1') END AS output_path, "
          f"CASE WHEN id % 10 = 0 THEN 'failed' ELSE 'successful' END AS status, {_WHOLE} AS metadata FROM ({_REDACTED_SQL})")
def redact_batch(spark, sf_dir):
    done = redact.redact_batch(_redactable(spark, sf_dir), "out/", KEEP, "clean")
    return done.select("file_path", "output_path", "status", F.to_json(F.parse_json("metadata")).alias("metadata"))


@register("write_redacted",
          f"SELECT f.file_path, CASE WHEN id % 10 = 0 THEN 'failed' ELSE 'successful' END AS status, "
          f"CASE WHEN id % 10 <> 0 THEN {_WHOLE} END AS metadata FROM ({_REDACTED_SQL}) f")
def write_redacted(spark, sf_dir):
    """Redacted records written one file each, and read back from a scan of the folder."""
    folder = f"{local_path(scratch_path(spark))}/out"
    done = redact.write_redacted(_redactable(spark, sf_dir), folder, KEEP)
    back = scan_folder(spark, folder).select(
        F.col("file_path").alias("output_path"),
        F.to_json(F.try_variant_get(F.parse_json(F.col("content").cast("string")), "$.metadata", "variant")).alias("metadata"))
    return done.join(back, "output_path", "left").select("file_path", "status", "metadata")


CLASHING = {"id": "p_partkey", "file_path": "'d' || CAST(p_partkey % 7 AS STRING) || '/f' || CAST(p_size AS STRING) || '.txt'"}


@register("redact_clashes",
          "WITH f AS (" + derive_sql("part", CLASHING) + "), g AS (SELECT regexp_extract(file_path, '[^/]*$') AS name, min(file_path) AS first FROM f GROUP BY 1) "
          "SELECT id, CASE WHEN file_path = first THEN 'successful' ELSE 'failed' END AS status, "
          "CASE WHEN file_path = first THEN 'out/' || name END AS output_path, "
          "CASE WHEN file_path <> first THEN 'The output path is taken by ' || first END AS message "
          "FROM f JOIN g ON name = regexp_extract(file_path, '[^/]*$')")
def redact_clashes(spark, sf_dir):
    """Files of one name in several folders: the first keeps the output path, the others have failed."""
    marked = redact.mark_clashes(redact.redact_batch(derive(table(spark, sf_dir, "part"), CLASHING).withColumn(
        "metadata", F.lit("{}")), "out"))
    return marked.select("id", "status", "output_path", F.get("errors", F.lit(0))["message"].alias("message"))


@register("redact_batch_summary", "SELECT count(*) AS total, count(*) FILTER (p_partkey % 10 <> 0) AS successful, "
                                  "count(*) FILTER (p_partkey % 10 = 0) AS failed FROM part")
def redact_batch_summary(spark, sf_dir):
    return redact.redact_batch_summary(redact.redact_batch(_redactable(spark, sf_dir), "out", KEEP))
