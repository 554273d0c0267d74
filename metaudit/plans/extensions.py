"""User-defined rule packs, sources and sinks."""

from pyspark.sql import functions as F

from metaudit.functions.findings import finding, fires
from metaudit.operators import audit as A
from metaudit.operators.report import explode_findings
from metaudit.plans.base import register, table
from metaudit.plans.text import DETECTOR_SQL, redact_sql
from metaudit.sources import registry
from metaudit.sources.scratch import scratch_path
from metaudit.sources.sql_functions import register_sql


def long_text(rec):
    return fires(rec.size > 20000, finding(
        "long_text", "information", "low", F.concat(F.lit("Long text in "), F.col("lang")), size=rec.size))


@register("register_rule_pack",
          "SELECT doc_id AS id, 'long_text' AS rule, 'low' AS severity, 'Long text in ' || lang AS description, 'size=' || n_chars AS data "
          "FROM documents WHERE n_chars > 20000")
def register_rule_pack(spark, sf_dir):
    """A pack added at run time, through the audit."""
    records = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("file_size"))
    A.register_rule_pack("lengths", None, {"long_text": long_text})
    try:
        found = explode_findings(A.audit(records), "id")
    finally:
        A.CUSTOM.pop("lengths")
    return found.where("rule = 'long_text'").select("id", "rule", "severity", "description", "data")


@register("register_source_and_sink", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def register_source_and_sink(spark, sf_dir):
    """Documents read by a registered source and written by a registered sink."""
    registry.register_source("documents", lambda s, folder: table(s, folder, "documents"))
    registry.register_sink("parquet", lambda df, path: df.write.parquet(path))
    path = scratch_path(spark)
    registry.get_sink("parquet")(registry.load(spark, "documents", sf_dir).select("doc_id", "lang"), path)
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@register("sql_functions",
          f"SELECT id, data FROM ({DETECTOR_SQL['email']('SELECT doc_id AS id, text AS note FROM documents', 'note')}) "
          f"UNION ALL SELECT id, data FROM ({DETECTOR_SQL['credit_cards']('SELECT doc_id AS id, text AS note FROM documents', 'note')}) "
          f"UNION ALL SELECT doc_id, md5({redact_sql('text', ['email', 'phone'])}) FROM documents")
def sql_functions(spark, sf_dir):
    """Detectors and redaction called from SQL."""
    register_sql(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_as_given")
    return spark.sql(
        "SELECT doc_id AS id, 'matches=' || array_join(detect_email(text), ', ') || '; pattern=email' AS data FROM documents_as_given "
        "WHERE size(detect_email(text)) > 0 UNION ALL "
        "SELECT doc_id, 'credit_cards=' || array_join(detect_credit_cards(text), ', ') FROM documents_as_given "
        "WHERE size(detect_credit_cards(text)) > 0 UNION ALL SELECT doc_id, md5(redact_text(text)) FROM documents_as_given")
