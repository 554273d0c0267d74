"""Registry of queries over the given tables, and helpers to shape those tables.

``register`` keeps a query with its SQL twin. The portable column expressions in the
other modules are plain SQL that both engines read the same way; they only derive input
columns from the tables. What is tested is computed twice, once by the operators and once
by the SQL.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def keep(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(df: DataFrame, columns: dict) -> DataFrame:
    """Select portable SQL expressions under their names."""
    return df.selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])


def derive_sql(source: str, columns: dict) -> str:
    return "SELECT " + ", ".join(f"{expression} AS {name}" for name, expression in columns.items()) + f" FROM {source}"


def choose(key: str, values) -> str:
    """Portable CASE that spreads constants over a key; None gives NULL."""
    count = len(values)
    whens = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + str(v).replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE ({key}) % {count} {whens} END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def section(columns: dict):
    """Map of the columns that are not null; the text '<null>' becomes a present null."""
    pairs = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN named_struct('key', {quoted(k)}, 'value', nullif(CAST({c} AS STRING), '<null>')) END"
        for k, c in columns.items())
    return F.expr(f"map_from_entries(array_compact(array({pairs})))")


def as_json(metadata):
    """Metadata as the JSON text that record files hold."""
    return F.to_json(metadata, {"ignoreNullFields": "false"}).alias("metadata")
