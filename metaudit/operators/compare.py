"""Compare the records of a group (a folder, a batch, a set of versions).

Values are kept as a long table ``(group_id, section, field, file_id, value)`` instead of
one list per field, so a group of any size spreads over tasks. Whether values differ is
decided by min and max, which combine on the map side; no distinct set is ever built.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaudit.operators.flatten import compare_entries
from metaudit.operators.records import TIMES

SALTS = 32  # tasks that one group or field is spread over; a power of two
ENTRY = "array<struct<section:string,field:string,value:string>>"


def _entries(section: str, columns: dict) -> Column:
    return F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(n).alias("field"), c.cast("string").alias("value"))
        for n, c in columns.items()
    ]).cast(ENTRY)


def _keys(group: str, file: str):
    return F.col(group).alias("group_id"), F.col(file).alias("file_id")


def basic_entries() -> Column:
    return _entries("basic_info", {n: F.col(n) for n in ("file_type", "mime_type", "file_size")})


def time_entries() -> Column:
    return _entries("timestamps", {n: F.col(n) for n in TIMES})


def hash_entries() -> Column:
    return F.coalesce(F.transform(F.map_entries("hashes"), lambda e: F.struct(
        F.lit("hashes").alias("section"), e["key"].alias("field"), e["value"].alias("value"))),
        F.array()).cast(ENTRY)


def metadata_entries(metadata: Column) -> Column:
    return F.transform(compare_entries(metadata), lambda e: F.struct(
        F.lit("metadata_fields").alias("section"), e["field"].alias("field"), e["value"].alias("value"))).cast(ENTRY)


def _variant(df: DataFrame) -> Column:
    kind = df.schema["metadata"].dataType.typeName()
    return F.col("metadata") if kind == "variant" else F.try_parse_json("metadata")


def compare_basic(df: DataFrame, group: str, file: str = "file_path") -> DataFrame:
    """File type, MIME type and size of each file of a group."""
    return df.select(*_keys(group, file), F.inline(basic_entries()))


def compare_timestamps(df: DataFrame, group: str, file: str = "file_path") -> DataFrame:
    return df.select(*_keys(group, file), F.inline(time_entries()))


def compare_hashes(df: DataFrame, group: str, file: str = "file_path") -> DataFrame:
    """Every hash kind seen in the group, for each of its files; null where a file lacks it.

    The kinds of a group are a handful of algorithm names, gathered with map-side combine.
    """
    rows = _dealt(df.select(*_keys(group, file), "hashes"), "group_id")
    kinds = (rows.select("group_id", "salt", F.explode(F.map_keys(_whole_row("hashes"))).alias("kind"))
             .groupBy("group_id", "salt").agg(F.collect_set("kind").alias("kinds"))
             .groupBy("group_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds")))
    joined = rows.join(_on_every_salt(kinds), ["group_id", "salt"])
    return joined.select("group_id", "file_id", F.lit("hashes").alias("section"), F.explode("kinds").alias("field"),
                         "hashes").select(
        "group_id", "file_id", "section", "field", F.try_element_at("hashes", F.col("field")).alias("value"))


def _metadata_long(df: DataFrame, group: str, file: str) -> DataFrame:
    return df.select(*_keys(group, file), F.inline(metadata_entries(_variant(df))))


def _spread(long: DataFrame) -> DataFrame:
    """Per group and field: how many values there are, and the smallest and largest.

    The smallest text is found by a sort, so rows are dealt first: a task sorts its share of them, however
    the table lies in files.
    """
    keys = ["group_id", "section", "field"]
    parts = _dealt(long, *keys).groupBy(*keys, "salt").agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n_values"), F.min("low").alias("_low"), F.max("high").alias("_high"))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key and a salt of the file: a group or field that most rows share lies in SALTS tasks.

    Both the figures of a key and the rows that they choose are read from this one exchange.
    """
    return rows.withColumn("salt", F.xxhash64("file_id").bitwiseAND(F.lit(SALTS - 1))).repartition(*keys, "salt")


def _whole_row(value: str) -> Column:
    """The value, read so that the file stays in the exchange; with a column less it could not be shared."""
    return F.when(F.col("file_id").isNull(), F.col(value)).otherwise(F.col(value))


def _on_every_salt(facts: DataFrame) -> DataFrame:
    return facts.withColumn("salt", F.explode(F.sequence(*[F.lit(n).cast("bigint") for n in (0, SALTS - 1)])))


def _fields_where(df: DataFrame, group: str, file: str, test: str) -> DataFrame:
    """Rows of the metadata fields whose figures over the group pass the test."""
    long = _dealt(_metadata_long(df, group, file).drop("section"), "group_id", "field")
    parts = long.groupBy("group_id", "field", "salt").agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("file_id").alias("last"))
    spread = parts.groupBy("group_id", "field").agg(
        F.sum("n").alias("n_values"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("last").alias("last"))
    # the last file is asked for so that both readers of the exchange need all its columns
    chosen = spread.where(f"{test} AND (last IS NOT NULL OR n_values > 0)").select("group_id", "field")
    # an inner join with unique keys: a semi join would be pushed below the exchange
    return (long.join(_on_every_salt(chosen), ["group_id", "field", "salt"])
            .select("group_id", "field", "file_id", "value"))


def compare_fields(df: DataFrame, group: str, file: str = "file_path") -> DataFrame:
    """Values of the metadata fields that more than one file of the group has."""
    return _fields_where(df, group, file, "n_values > 1")


def field_differences(df: DataFrame, group: str, file: str = "file_path") -> DataFrame:
    """Values of the metadata fields whose values differ within the group."""
    return _fields_where(df, group, file, "n_values > 1 AND low <> high")


def comparison_status(df: DataFrame, group: str, file: str = "file_path") -> DataFrame:
    """Each compared field of a group: same in all files that have it (with the value), or different."""
    sections = [basic_entries(), time_entries(), hash_entries()]
    if "metadata" in df.columns:
        sections.append(metadata_entries(_variant(df)))
    long = df.select(*_keys(group, file), F.inline(F.concat(*sections)))
    spread = _spread(long).where("section <> 'metadata_fields' OR n_values > 1")
    same = F.coalesce(F.col("_low") == F.col("_high"), F.lit(False))
    return spread.select(
        "group_id", "section", "field", "n_values",
        F.when(same, "same").otherwise("different").alias("status"),
        F.when(same, F.col("_low")).alias("value"))


def exact_duplicates(df: DataFrame, digest: Column | None = None, file: str = "file_path") -> DataFrame:
    """Contents held by more than one file: digest, number of files, first file.

    Copies are counted on the map side, so a digest shared by most files stays cheap.
    """
    digest = F.col("hashes")["sha256"] if digest is None else digest
    return (df.select(digest.alias("digest"), F.col(file).alias("_f")).where(F.col("digest").isNotNull())
            .groupBy("digest").agg(F.count("*").alias("n_files"), F.min("_f").alias("first_file"))
            .where("n_files > 1"))
