"""File listings as tables, and selections over them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaudit.functions.paths import basename, extension, glob_match
from metaudit.operators.classify import error_struct
from metaudit.schema import ERROR


def scan_files(spark: SparkSession, directory: str, recursive: bool = False, include: str | None = None,
               max_content_bytes: int | None = None, inventory: DataFrame | None = None) -> DataFrame:
    """One row per file of a directory: file_path, file_size, modification_time, content.

    ``content`` is read only when a later step uses it. Files above ``max_content_bytes`` keep
    their row with a null content, which is then not read. Creation and access times are not
    exposed by the source and stay null. Spark's file listing leaves out empty files and names
    that start with a dot or underscore: see ``complete_scan`` for what an ``inventory`` adds.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if include:
        reader = reader.option("pathGlobFilter", include)
    files = reader.load(directory)

    def shaped(rows, content):
        return rows.select(
            _plain(F.col("path")).alias("file_path"), F.col("length").alias("file_size"),
            F.lit(None).cast("string").alias("creation_time"),
            F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("modification_time"),
            F.lit(None).cast("string").alias("access_time"), content)

    whole = F.col("content")
    if max_content_bytes is None:
        scanned = shaped(files, whole)
    else:  # two scans: the size limit reaches the first, and the second reads no content
        scanned = shaped(files.where(F.col("length") <= max_content_bytes), whole).unionAll(
            shaped(files.where(F.col("length") > max_content_bytes), F.lit(None).cast("binary").alias("content")))
    if inventory is None:
        return scanned
    if include:
        inventory = inventory.where(glob_match(basename(F.col("file_path")), include))
    return complete_scan(scanned, inventory)


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"\Afile:/*", "/")


def complete_scan(scanned: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add the files of an inventory that a scan did not return, and a column ``errors``.

    ``inventory`` is a listing with file_path, file_size and modification_time, such as storage
    systems export. Empty files get empty content; others a null content and an error, so that
    an audit shows what it could not read.
    """
    unseen = inventory.withColumn("file_path", _plain(F.col("file_path"))).join(
        scanned.select("file_path"), "file_path", "left_anti")
    no_errors = F.array().cast(T.ArrayType(ERROR))
    unread = error_struct("ReadError", F.concat(F.lit("Listed, but not returned by the scan: "), F.col("file_path")))
    added = unseen.select(
        "file_path", F.col("file_size").cast("bigint").alias("file_size"),
        F.lit(None).cast("string").alias("creation_time"),
        F.col("modification_time").cast("string").alias("modification_time"),
        F.lit(None).cast("string").alias("access_time"),
        F.when(F.col("file_size") == 0, F.lit(b"")).alias("content"),
        F.when(F.col("file_size") == 0, no_errors).otherwise(F.array(unread)).alias("errors"))
    return scanned.withColumn("errors", no_errors).unionByName(added)


def filter_files(df: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Keep base names matching one glob and drop those matching another."""
    name = basename(F.col("file_path"))
    if include:
        df = df.where(glob_match(name, include))
    if exclude:
        df = df.where(~glob_match(name, exclude))
    return df


def limit_files(df: DataFrame, max_files: int = 0) -> DataFrame:
    """The first files by path; 0 keeps all."""
    return df.orderBy("file_path").limit(max_files) if max_files > 0 else df


def size_between(minimum: int | None = None, maximum: int | None = None, column: str = "file_size") -> Column:
    test = F.col(column).isNotNull()
    if minimum is not None:
        test &= F.col(column) >= minimum
    if maximum is not None:
        test &= F.col(column) <= maximum
    return test


def filter_by_size(df: DataFrame, minimum: int | None = None, maximum: int | None = None) -> DataFrame:
    """Inclusive size bounds; unknown sizes are dropped."""
    return df.where(size_between(minimum, maximum))


def group_by_extension(df: DataFrame) -> DataFrame:
    """Files by lower-cased extension as a long table ``(extension, file_path)``.

    One extension may hold most of the files, so the list of a group is kept as rows
    (write it with ``partitionBy("extension")`` to get one folder per group).
    """
    return df.select(extension(F.col("file_path")).alias("extension"), "file_path")


def extension_counts(df: DataFrame) -> DataFrame:
    """Files per extension, pre-aggregated before the shuffle."""
    return group_by_extension(df).groupBy("extension").agg(F.count("*").alias("n_files"))
