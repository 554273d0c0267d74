"""Metadata records as JSON rows, and report sinks."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaudit.functions.paths import basename
from metaudit.operators.records import conform
from metaudit.schema import FINDING, RECORD_COLUMNS
from metaudit.sources.folders import write_files

RECORD_DDL = ", ".join(f"{n} {k}" for n, k in RECORD_COLUMNS.items()) + ", metadata STRING, " \
    "findings ARRAY<STRUCT<type: STRING, description: STRING, severity: STRING, data: STRING>>, " \
    "errors ARRAY<STRUCT<error_type: STRING, message: STRING, details: STRING, suggestions: ARRAY<STRING>>>"


def parse_records(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON text of records -> record columns, with ``metadata`` as VARIANT."""
    other = [c for c in df.columns if c != column]
    parsed = df.select(*other, F.from_json(column, RECORD_DDL).alias("_r"))
    return parsed.select(
        *other, *[F.col("_r")[n].alias(n) for n in RECORD_COLUMNS],
        F.try_parse_json(F.col("_r")["metadata"]).alias("metadata"),
        F.col("_r")["findings"].alias("recorded_findings"), F.col("_r")["errors"].alias("errors"))


def _evidence(data: Column) -> Column:
    """JSON text of a finding's data as lists of texts by key; text that is no JSON object stands under ``data``."""
    def texts(_, v):
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
        return F.when(F.schema_of_variant(v).startswith("ARRAY"), items).otherwise(F.array(F.try_variant_get(v, "$", "string")))

    opened = F.try_variant_get(F.try_parse_json(data), "$", "map<string,variant>")
    plain = F.when(data.isNotNull(), F.create_map(F.lit("data"), F.array(data)))
    return F.coalesce(F.transform_values(opened, texts), plain)


def recorded_findings(df: DataFrame, column: str = "recorded_findings", into: str = "findings") -> DataFrame:
    """Findings that came with saved records, in the type that audits give, so that reports run over them.

    Saved findings do not name their rule, which is null. A record without any has an empty list.
    """
    found = F.transform(column, lambda f: F.struct(
        F.lit(None).cast("string").alias("rule"), f["type"].alias("type"), f["severity"].alias("severity"),
        f["description"].alias("description"), _evidence(f["data"]).alias("evidence")))
    kind = T.ArrayType(FINDING)
    return df.withColumn(into, F.coalesce(found.cast(kind), F.array().cast(kind))).drop(*{column} - {into})


def read_records(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """Records from JSON lines. ``typed`` turns metadata into section structs at once."""
    records = parse_records(spark.read.text(path))
    return conform(records) if typed else records


def write_findings_csv(report: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists") -> None:
    """A findings or summary report as CSV with a header; quotes inside cells are doubled."""
    (report.write.mode(mode).option("header", True).option("sep", delimiter)
     .option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path))


def write_report_json(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per file; nulls are written, so every key is always present."""
    reports.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_report_files(reports: DataFrame, directory: str) -> DataFrame:
    """One JSON file per audited file: its base name, and a mark of its path so that none overwrites another.

    Returns what could not be written: file_path (of the report) and problem.
    """
    name = F.concat(basename(F.col("file_path")), F.lit("-"), F.substring(F.sha2("file_path", 256), 1, 16), F.lit(".json"))
    document = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return write_files(reports.select(F.concat(F.lit(directory.rstrip("/") + "/"), name).alias("file_path"), document.alias("content")),
                       directory)
