"""Aggregates over archive member tables: file_id, member, compressed, uncompressed, is_dir.

Members are pre-aggregated per task before the shuffle, so one huge archive costs one
small row per task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metaudit.functions.paths import extension

# Marker members and the type they stand for (fixed values). Later rows win.
OFFICE_MARKERS = {
    "word/document.xml": "Microsoft Word Document (DOCX)",
    "xl/workbook.xml": "Microsoft Excel Workbook (XLSX)",
    "ppt/presentation.xml": "Microsoft PowerPoint Presentation (PPTX)",
}
ODF_TYPES = {
    "application/vnd.oasis.opendocument.text": "OpenDocument Text (ODT)",
    "application/vnd.oasis.opendocument.spreadsheet": "OpenDocument Spreadsheet (ODS)",
    "application/vnd.oasis.opendocument.presentation": "OpenDocument Presentation (ODP)",
}


def archive_summary(members: DataFrame) -> DataFrame:
    """Member count (directories included), sizes, and compressed size in percent."""
    totals = members.groupBy("file_id").agg(
        F.count("*").alias("file_count"),
        F.sum("compressed").alias("compressed_size"),
        F.sum("uncompressed").alias("uncompressed_size"))
    ratio = F.round(F.try_divide(F.col("compressed_size"), F.col("uncompressed_size")) * 100, 2)
    return totals.withColumn("compression_ratio", F.when(F.col("uncompressed_size") > 0, ratio))


def archive_extensions(members: DataFrame) -> DataFrame:
    """Histogram of member extensions per archive; directories and bare names excluded."""
    return (members.where(~F.col("is_dir"))
            .select("file_id", extension(F.col("member")).alias("extension"))
            .where(F.col("extension") != "")
            .groupBy("file_id", "extension").agg(F.count("*").alias("n")))


def archive_type(members: DataFrame) -> DataFrame:
    """Archive type by marker members. ``mimetype`` holds the text of the mimetype member, if any."""
    def has(name):
        return F.bool_or(F.col("member") == name)

    odf = F.max(F.when(F.col("member") == "mimetype", F.coalesce(F.col("mimetype"), F.lit("")))) \
        if "mimetype" in members.columns else F.max(F.lit(None).cast("string"))
    flags = members.groupBy("file_id").agg(
        has("[Content_Types].xml").alias("office"), has("META-INF/MANIFEST.MF").alias("jar"),
        has("WEB-INF/").alias("war"), has("AndroidManifest.xml").alias("apk"), odf.alias("odf"),
        *[has(m).alias(f"m{i}") for i, m in enumerate(OFFICE_MARKERS)])
    kind = F.when(F.col("apk"), "Android Package (APK)") \
        .when(F.col("jar") & F.col("war"), "Web Application Archive (WAR)") \
        .when(F.col("jar"), "Java Archive (JAR)")
    for mime, name in ODF_TYPES.items():
        kind = kind.when(F.col("odf").contains(mime), name)
    for i, name in enumerate(OFFICE_MARKERS.values()):
        kind = kind.when(F.col("office") & F.col(f"m{i}"), name)
    return flags.select("file_id", kind.otherwise("ZIP-based").alias("archive_type"))


def slide_count(members: DataFrame) -> DataFrame:
    return members.groupBy("file_id").agg(
        F.count_if(F.col("member").startswith("ppt/slides/slide")).alias("slide_count"))


def archive_info(members: DataFrame) -> DataFrame:
    """Per archive the section that rules read: compression ratio, and number of members by extension.

    One aggregation by (archive, extension), then one by archive; an archive's extensions are gathered, not
    its members.
    """
    ext = F.when(~F.col("is_dir"), F.nullif(extension(F.col("member")), F.lit("")))
    parts = members.groupBy("file_id", ext.alias("extension")).agg(
        F.count("*").alias("n"), F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"))
    counted = F.collect_list(F.when(F.col("extension").isNotNull(), F.struct(F.col("extension").alias("key"), F.col("n").alias("value"))))
    whole = parts.groupBy("file_id").agg(F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"),
                                         counted.alias("counted"))
    ratio = F.round(F.try_divide(F.col("compressed"), F.col("uncompressed")) * 100, 2)
    return whole.select("file_id", F.struct(
        F.when(F.col("uncompressed") > 0, ratio).cast("double").alias("compression_ratio"),
        F.map_from_entries("counted").alias("extensions")).alias("archive_info"))


def with_archive_info(records: DataFrame, members: DataFrame, key: str = "file_path") -> DataFrame:
    """Records whose ``metadata`` (a struct, or none yet) holds the ``archive_info`` of their members.

    ``members`` names the record in ``file_id``. Records without members have a null section.
    """
    kind = records.schema["metadata"].dataType if "metadata" in records.columns else StructType()
    if not isinstance(kind, StructType):
        raise ValueError("metadata must be a struct of sections, as scans give it")
    info = archive_info(members).withColumnsRenamed({"file_id": "_archive", "archive_info": "_info"})
    sections = [F.col("metadata")[n].alias(n) for n in kind.names if n != "archive_info"]
    joined = records.join(info, records[key] == info["_archive"], "left")
    return joined.withColumn("metadata", F.struct(*sections, F.col("_info").alias("archive_info"))).drop("_archive", "_info")
