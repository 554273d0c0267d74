"""The audit on a stream of record files: rules are row-local, so no state is kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metaudit.operators.audit import audit
from metaudit.operators.report import each
from metaudit.sources.records import parse_records


def stream_records(spark: SparkSession, directory: str) -> DataFrame:
    """Records from JSON-lines files as they arrive in a folder."""
    return parse_records(spark.readStream.text(directory))


def audit_stream(records: DataFrame, output: str, checkpoint: str, now=None) -> StreamingQuery:
    """Append audited records to parquet until the folder is drained; restartable from its checkpoint."""
    audited = audit(records, now=now).select(
        "file_path", "file_type", "file_size", "mime_type", "findings", "errors")
    return (audited.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_severities(records: DataFrame) -> DataFrame:
    """Running number of findings by severity, for update or complete output."""
    return (records.select(F.explode(each("severity")).alias("severity"))
            .groupBy("severity").agg(F.count("*").alias("n_findings")))
