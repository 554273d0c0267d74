"""Consistency rules for every file: times, MIME type, size, hashes, archives, text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.findings import Items, finding, fires, fires_on, let
from metaudit.functions.numbers import fixed
from metaudit.operators.rulebook import Pack

PACK = Pack("generic")
GIB = 1024 ** 3


def parse_time(value: Column) -> Column:
    """ISO text as a zone-less timestamp; null when it does not parse.

    A time with a zone is brought to the session's time zone, in which times without one, and
    the clock of the audit, are read.
    """
    zoned = value.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)$")
    return F.when(zoned, value.try_cast("timestamp").cast("timestamp_ntz")).otherwise(value.try_cast("timestamp_ntz"))


def _stamps(rec) -> Column:
    """Non-empty timestamps in fixed order, as (name, raw, parsed)."""
    every = F.array(*[
        F.struct(F.lit(n.replace("_", " ")).alias("name"), c.alias("raw"), parse_time(c).alias("at"))
        for n, c in rec.times.items()
    ])
    return F.filter(every, lambda s: F.coalesce(s["raw"], F.lit("")) != "")


def _given(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _readable(rec, stamps: Column) -> Column:
    """The stamps judged before the first unreadable one stops the check.

    When creation and modification are both given they are compared first, so one of them
    being unreadable stops everything.
    """
    first_bad = F.array_position(F.transform(stamps, lambda s: s["at"].isNull()), F.lit(True))
    both_given = _given(rec.times["creation_time"]) & _given(rec.times["modification_time"])
    count = F.when(both_given & first_bad.between(1, 2), 0).when(first_bad == 0, F.size(stamps)).otherwise(first_bad - 1)
    return F.when(F.size(stamps) >= 2, F.slice(stamps, F.lit(1), count.cast("int")))


def _raw_times(rec) -> Items:
    return Items(F.filter(F.array(*[
        F.when(_given(c), F.concat(F.lit(n + ": "), c)) for n, c in rec.times.items()
    ]), lambda t: t.isNotNull()))


@PACK.rule
def created_after_modified(rec) -> Column:
    created, modified = (parse_time(rec.times[n]) for n in ("creation_time", "modification_time"))
    return fires(created > modified, finding(
        "created_after_modified", "consistency", "medium",
        "File creation time is after modification time (suspicious)", timestamps=_raw_times(rec)))


@PACK.rule
def future_timestamp(rec) -> Column:
    late = F.filter(let(_stamps(rec), lambda stamps: _readable(rec, stamps)), lambda s: s["at"] > rec.now)
    return F.transform(late, lambda s: finding(
        "future_timestamp", "consistency", "medium",
        F.concat(F.lit("File "), s["name"], F.lit(" is in the future")), timestamp=s["raw"]))


@PACK.rule
def very_old_timestamp(rec) -> Column:
    def judged(stamps):
        return F.when((F.size(stamps) >= 2) & ~F.exists(stamps, lambda s: s["at"].isNull()), stamps)

    old = F.filter(let(_stamps(rec), judged), lambda s: F.year(s["at"]) < 2000)
    return F.transform(old, lambda s: finding(
        "very_old_timestamp", "information", "low",
        F.concat(F.lit("File "), s["name"], F.lit(" is very old")), timestamp=s["raw"]))


@PACK.rule
def bad_timestamp(rec) -> Column:
    def first_bad(stamps):
        return F.when(F.size(stamps) >= 2, F.get(F.filter(stamps, lambda s: s["at"].isNull()), F.lit(0))["raw"])

    return fires_on(let(_stamps(rec), first_bad), lambda raw: raw.isNotNull(), lambda raw: finding(
        "bad_timestamp", "error", "low", "Error analyzing timestamps",
        error=F.concat(F.lit("Invalid isoformat string: "), raw), timestamps=_raw_times(rec)))


@PACK.rule
def mime_ext_mismatch(rec) -> Column:
    table = F.create_map(*[
        x for mime, exts in K.MIME_TO_EXTENSIONS.items() for x in (F.lit(mime), F.array(*map(F.lit, exts)))
    ])
    expected = F.try_element_at(table, rec.mime)
    return fires(~F.array_contains(expected, rec.extension), finding(
        "mime_ext_mismatch", "consistency", "medium",
        F.concat(F.lit("File extension '"), rec.extension, F.lit("' does not match MIME type '"), rec.mime,
                 F.lit("' (expected: "), F.array_join(expected, ", "), F.lit(")")),
        mime_type=rec.mime, extension=rec.extension, expected_extensions=Items(expected)))


@PACK.rule
def empty_file(rec) -> Column:
    return fires(rec.size == 0, finding(
        "empty_file", "consistency", "medium", "File size is zero bytes (empty file)", size=rec.size))


@PACK.rule
def tiny_file(rec) -> Column:
    tiny = rec.size.between(1, 99) & ~rec.extension.isin(K.SMALL_TEXT_EXTENSIONS)
    return fires(tiny, finding(
        "tiny_file", "consistency", "low",
        F.concat(F.lit("File is unusually small ("), rec.size.cast("string"), F.lit(" bytes)")), size=rec.size))


@PACK.rule
def huge_file(rec) -> Column:
    return fires(rec.size > GIB, finding(
        "huge_file", "information", "low",
        F.concat(F.lit("File is very large ("), fixed(rec.size / F.lit(GIB), 2), F.lit(" GB)")), size=rec.size))


@PACK.rule
def empty_hash_conflict(rec) -> Column:
    md5 = rec.hashes["md5"]
    return fires((md5 == K.EMPTY_MD5) & (rec.size > 0), finding(
        "empty_hash_conflict", "consistency", "high",
        "File hash matches empty file but size is not zero", hash=md5, size=rec.size))


@PACK.rule
def archive_ratio_anomaly(rec) -> Column:
    ratio = rec.section("archive_info")["compression_ratio"]
    return fires(ratio < 1.0, finding(
        "archive_ratio_anomaly", "information", "low",
        F.concat(F.lit("Archive has unusual compression ratio: "), ratio.cast("string"), F.lit("%")),
        compression_ratio=ratio))


@PACK.rule
def archive_has_executables(rec) -> Column:
    found = F.map_filter(
        rec.section("archive_info")["extensions"],
        lambda ext, n: F.lower(ext).isin(K.ARCHIVE_EXECUTABLE_EXTENSIONS))
    return fires(F.size(found) > 0, finding(
        "archive_has_executables", "security", "medium", "Archive contains executable files",
        executables=Items(F.sort_array(F.transform(
            F.map_entries(found), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))))))


@PACK.rule
def odd_text_encoding(rec) -> Column:
    encoding = rec.section("text_info")["encoding"]
    return fires(~encoding.isin(K.PLAIN_ENCODINGS), finding(
        "odd_text_encoding", "information", "low",
        F.concat(F.lit("Text file uses non-standard encoding: "), encoding), encoding=encoding))


@PACK.rule
def large_text_file(rec) -> Column:
    lines = rec.section("text_info")["line_count"]
    return fires(lines > 10000, finding(
        "large_text_file", "information", "low",
        F.concat(F.lit("Text file is very large ("), lines.cast("string"), F.lit(" lines)")), line_count=lines))


def known_bad_hash(df: DataFrame, hashes: DataFrame, into="findings") -> DataFrame:
    """Add a finding to records whose md5 is in a supplied table (column ``md5``).

    The list is reduced to distinct digests and joined by digest. Its size is not known
    here, so the planner picks broadcast or shuffle from run-time statistics, and a digest
    shared by many records is split by the adaptive skew join.
    """
    bad = hashes.select(F.col("md5").alias("_bad_md5")).where(F.col("_bad_md5").isNotNull()).distinct()
    keyed = df.withColumn("_md5", F.col("hashes")["md5"])
    joined = keyed.join(bad, keyed["_md5"] == bad["_bad_md5"], "left")
    found = fires(F.col("_bad_md5").isNotNull(), finding(
        "known_bad_hash", "security", "high", "File hash matches known malicious file", hash=F.col("_md5")))
    if into in df.columns:
        found = F.concat(F.coalesce(F.col(into), F.array().cast(df.schema[into].dataType)),
                         F.coalesce(found, F.array().cast(df.schema[into].dataType)))
    return joined.withColumn(into, found).drop("_md5", "_bad_md5")


def store_hash_list(hashes: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """Write a list of digests (column ``md5``) once, as a table in buckets of the digest; gives the table."""
    (hashes.select("md5").where("md5 IS NOT NULL").distinct().write.mode("overwrite").format("parquet")
     .bucketBy(buckets, "md5").sortBy("md5").option("path", path).saveAsTable(table))
    return hashes.sparkSession.table(table)


def bad_hash_findings(df: DataFrame, listed: DataFrame, *keys: str) -> DataFrame:
    """Keys and finding of the records whose md5 is in a list that ``store_hash_list`` wrote.

    Only keys and digests move, to the buckets of the list; neither the list nor metadata is shuffled. Copies
    of a digest that many records share meet one row of the list.
    """
    narrow = df.select(*keys, F.col("hashes")["md5"].alias("_md5")).where("_md5 IS NOT NULL")
    found = narrow.join(listed.hint("merge"), narrow["_md5"] == listed["md5"])
    return found.select(*keys, finding(
        "known_bad_hash", "security", "high", "File hash matches known malicious file", hash=F.col("_md5")).alias("finding"))
