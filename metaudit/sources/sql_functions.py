"""Detectors and redaction as SQL functions, and the library's data sources by name, for use from SQL.

The functions are plain SQL expressions, inlined by the optimizer: no Python worker runs. They are
temporary functions of the session::

    register_sql(spark)
    spark.sql("SELECT doc_id, detect_email(text) FROM documents WHERE size(detect_email(text)) > 0")
"""

from pyspark.sql import SparkSession

from metaudit.functions import constants as K
from metaudit.operators.redact import MASKS
from metaudit.sources.folders import FileSink, FolderListing


def quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str, group: int, guard: str) -> str:
    found = f"regexp_extract_all(value, {quoted('(?U)' + pattern)}, {group})"
    return f"CASE WHEN {guard} THEN sort_array(array_distinct({found})) ELSE CAST(array() AS ARRAY<STRING>) END"


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# body of each function over ``value``; null and texts without a match give an empty list
DETECTORS = {
    "detect_gps_terms": _matches("(?i)" + K.GPS_TERMS_PATTERN, 0, "value RLIKE r'(?i)gps|geotag|location'"),
    "detect_email": _matches(K.EMAIL_PATTERN, 1, "contains(value, '@')"),
    "detect_phone": _matches(K.PHONE_PATTERN, 0, r"value RLIKE r'(?U)\d{4}'"),
    "detect_ssn": _matches(K.SSN_PATTERN, 0, r"value RLIKE r'(?U)-\d\d-'"),
    "detect_domains": "filter(" + _matches(K.DOMAIN_PATTERN, 1, r"value RLIKE r'[-a-zA-Z0-9]\.[a-zA-Z0-9]{2}'")
                      + f", d -> lower(d) NOT IN ({_names(K.COMMON_DOMAINS)}))",
    "detect_ip": "concat(filter(" + _matches(K.IPV4_PATTERN, 0, r"value RLIKE r'[0-9]\.[0-9]{1,3}\.[0-9]'")
                 + r", a -> NOT (CAST(split(a, r'\.')[0] AS INT) IN (10, 127) OR startswith(a, '192.168.') OR (startswith(a, '172.') "
                   r"AND CAST(split(a, r'\.')[1] AS INT) BETWEEN 16 AND 31))), "
                 + _matches(K.IPV6_PATTERN, 0, "value RLIKE r'[0-9a-fA-F]:[0-9a-fA-F]{1,4}:[0-9a-fA-F]'") + ")",
    "detect_credit_cards": "sort_array(transform(" + _matches(K.CARD_PATTERN, 0, "value RLIKE r'[0-9]{13}'")
                           + ", c -> concat('XXXX-XXXX-XXXX-', right(c, 4))))",
    "detect_urls": _matches(K.URL_PATTERN, 0, "contains(value, 'http')"),
}


def _masked() -> str:
    value = "value"
    for name, (pattern, tag) in MASKS.items():
        replaced = f"regexp_replace({value}, {quoted('(?U)' + pattern)}, '{tag}')"
        value = f"CASE WHEN array_contains(kinds, '{name}') THEN {replaced} ELSE {value} END"
    return value


def register_sql(spark: SparkSession) -> None:
    """Make ``detect_*``, ``redact_text`` and the sources ``folder`` and ``files`` known to the session."""
    for name, body in DETECTORS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS ARRAY<STRING> "
                  f"RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION redact_text(value STRING, kinds ARRAY<STRING> DEFAULT array('email', 'phone')) "
              f"RETURNS STRING RETURN {_masked()}")
    for source in (FolderListing, FileSink):
        spark.dataSource.register(source)
