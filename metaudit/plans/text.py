"""Detectors and text operators over documents, conversations, pages, orders and events."""

from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.operators import audit as audit_ops
from metaudit.operators import pattern_rules as P
from metaudit.operators import redact
from metaudit.operators.report import explode_findings
from metaudit.plans.base import derive, derive_sql, quoted, register, table

# A field name that the API-key detector looks into.
DOCUMENT_TEXT = {"id": "doc_id", "secret_note": "text"}
# Reference numbers with the shape of an SSN, from order keys.
ORDER_NOTE = {
    "id": "o_orderkey",
    "note": "'ref ' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '-' || "
            "lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || '-' || "
            "lpad(CAST(o_orderkey % 10000 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 4 END, '0') || ' ' || o_orderpriority",
}
# Event notes with location terms and with full-form IPv6 addresses.
EVENT_NOTE = {
    "id": "event_id",
    "note": "event_type || CASE WHEN event_id % 5 = 0 THEN ' GPS fix' WHEN event_id % 7 = 0 THEN ' Location: geotag location' "
            "ELSE ' at ' || CAST(user_id AS STRING) END",
}
EVENT_ADDRESS = {
    "id": "event_id",
    "note": "'from 2001:db8:' || CAST(event_id % 1000 AS STRING) || ':' || CAST(user_id % 100 AS STRING) || ':0:0:0' || "
            "CASE WHEN event_id % 4 = 0 THEN '' ELSE ':1' END || ' via ' || CAST(event_id % 256 AS STRING) || '.' || "
            "CAST(user_id % 300 AS STRING) || '.0.1, ' || "
            "CASE event_id % 5 WHEN 0 THEN '10.' WHEN 1 THEN '172.' ELSE '8.' END || CAST(user_id % 40 AS STRING) || '.3.4'",
}


def distinct_matches(pattern: str, group: int, field: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({field}, {quoted(pattern)}, {group})))"


def _finding_sql(source: str, rule: str, type_: str, severity: str, description: str, data: str, matches: str) -> str:
    return (
        f"SELECT id, {quoted(rule)} AS rule, {quoted(type_)} AS type, {quoted(severity)} AS severity, "
        f"{description} AS description, {data} AS data FROM (SELECT id, {matches} AS m FROM ({source})) WHERE len(m) > 0")


def _privacy_sql(rule, severity, pattern, group):
    def build(source, field):
        return _finding_sql(source, rule, "privacy", severity, quoted(f"Found {rule} in metadata"),
                            f"'matches=' || array_to_string(m, ', ') || '; pattern={rule}'",
                            distinct_matches(pattern, group, field))
    return build


def _counted_sql(rule, type_, severity, what, key, matches, shown="m"):
    def build(source, field):
        return _finding_sql(source, rule, type_, severity, f"'Found ' || len(m) || ' {what} in metadata'",
                            f"'{key}=' || array_to_string({shown}, ', ')", matches(field))
    return build


# The domain pattern without lookaround: it starts and ends with an ASCII letter or digit, so
# plain word boundaries say the same, once other word characters are turned into '_' and
# other characters into spaces.
_DOMAIN_RE2 = (
    r"\b(?:https?://)?(?:www\.)?([a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z0-9]{2,}(?:\.[a-zA-Z0-9]{2,})*)\b"
)


def _domains(field):
    ascii_only = (f"regexp_replace(regexp_replace({field}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}\\p{{M}}]', ' ', 'g'), "
                  "'[^\\x00-\\x7F]', '_', 'g')")
    common = ", ".join(quoted(d) for d in K.COMMON_DOMAINS)
    return f"[d for d in {distinct_matches(_DOMAIN_RE2, 1, ascii_only)} if lower(d) NOT IN ({common})]"


def _ips(field):
    v4, v6 = distinct_matches(K.IPV4_PATTERN, 0, field), distinct_matches(K.IPV6_PATTERN, 0, field)
    public = (
        "NOT (split_part(ip, '.', 1)::INT IN (10, 127) OR (split_part(ip, '.', 1)::INT = 192 AND split_part(ip, '.', 2)::INT = 168) "
        "OR (split_part(ip, '.', 1)::INT = 172 AND split_part(ip, '.', 2)::INT BETWEEN 16 AND 31))")
    return f"list_concat([ip for ip in {v4} if {public}], {v6})"


def _api_keys(field):
    return (f"[{quoted(field)} || ': ' || left(k, 3) || '...' || right(k, 3) "
            f"for k in regexp_extract_all({field}, {quoted(K.API_KEY_PATTERN)}, 1)]")


DETECTOR_SQL = {
    "gps_data": _privacy_sql("gps_data", "medium", "(?i)" + K.GPS_TERMS_PATTERN, 0),
    "email": _privacy_sql("email", "high", K.EMAIL_PATTERN, 1),
    "phone": _privacy_sql("phone", "medium", K.PHONE_PATTERN, 0),
    "ssn": _privacy_sql("ssn", "high", K.SSN_PATTERN, 0),
    "domains": _counted_sql("domains", "information", "low", "domain names", "domains", _domains),
    "ip_addresses": _counted_sql("ip_addresses", "privacy", "medium", "IP addresses", "ip_addresses", _ips),
    "credit_cards": _counted_sql(
        "credit_cards", "privacy", "high", "potential credit card numbers", "credit_cards",
        lambda f: distinct_matches(K.CARD_PATTERN, 0, f),
        "list_sort(['XXXX-XXXX-XXXX-' || right(c, 4) for c in m])"),
    "api_keys": _counted_sql(
        "api_keys", "security", "high", "potential API keys or tokens", "api_keys", _api_keys),
    "urls": _counted_sql("urls", "information", "low", "URLs", "urls", lambda f: distinct_matches(K.URL_PATTERN, 0, f)),
}

# query name -> (detector, table, derived columns)
SINGLE = {
    "detect_gps_terms": ("gps_data", "events", EVENT_NOTE),
    "detect_email": ("email", "documents", DOCUMENT_TEXT),
    "detect_phone": ("phone", "documents", DOCUMENT_TEXT),
    "detect_ssn": ("ssn", "orders", ORDER_NOTE),
    "detect_domains": ("domains", "documents", DOCUMENT_TEXT),
    "detect_ip": ("ip_addresses", "documents", DOCUMENT_TEXT),
    "detect_ipv6": ("ip_addresses", "events", EVENT_ADDRESS),
    "detect_credit_cards": ("credit_cards", "documents", DOCUMENT_TEXT),
    "detect_api_keys": ("api_keys", "documents", DOCUMENT_TEXT),
    "detect_urls": ("urls", "pages", {"id": "page_id", "page_url": "url"}),
}


def _register_single(name, detector, source, columns):
    field = list(columns)[1]

    @register(name, DETECTOR_SQL[detector](derive_sql(source, columns), field))
    def run(spark, sf_dir):
        rows = derive(table(spark, sf_dir, source), columns)
        return explode_findings(P.detect(rows, [field], [detector]), "id")


for _name, (_detector, _source, _columns) in SINGLE.items():
    _register_single(_name, _detector, _source, _columns)


def patterns_sql(source: str, field: str, detectors=None) -> str:
    return " UNION ALL ".join(DETECTOR_SQL[d](source, field) for d in (detectors or DETECTOR_SQL))


@register("detect_patterns", patterns_sql(derive_sql("documents", DOCUMENT_TEXT), "secret_note"))
def detect_patterns(spark, sf_dir):
    return explode_findings(P.detect(derive(table(spark, sf_dir, "documents"), DOCUMENT_TEXT), ["secret_note"]), "id")


CONVERSATION_TEXT = {"id": "conv_id * 1000 + turn", "secret_note": "text"}


@register("detect_patterns_conversations", patterns_sql(derive_sql("conversations", CONVERSATION_TEXT), "secret_note"))
def detect_patterns_conversations(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "conversations"), CONVERSATION_TEXT)
    return explode_findings(P.detect(rows, ["secret_note"]), "id")


# --- text redaction ----------------------------------------------------------
def redact_sql(field: str, kinds) -> str:
    expression = field
    for name, (pattern, tag) in redact.MASKS.items():
        if name in kinds:
            expression = f"regexp_replace({expression}, {quoted(pattern)}, {quoted(tag)}, 'g')"
    return expression


_ALL_KINDS = list(redact.MASKS)


@register("redact_text", (
    "SELECT doc_id, md5(t) AS redacted_md5, len(t) AS n_chars FROM "
    f"(SELECT doc_id, {redact_sql('text', _ALL_KINDS)} AS t FROM documents)"))
def redact_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", redact.redact_text(F.col("text"), _ALL_KINDS).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("redacted_md5"), F.length("t").alias("n_chars"))


def _counts_sql(field: str, side: str) -> str:
    source = f"SELECT doc_id AS id, {field} AS secret_note FROM documents"
    return f"SELECT rule, '{side}' AS side FROM ({patterns_sql(source, 'secret_note')})"


@register("verify_redaction", (
    "SELECT rule, count(*) FILTER (side = 'before') AS n_before, count(*) FILTER (side = 'after') AS n_after FROM ("
    + _counts_sql("text", "before") + " UNION ALL " + _counts_sql(redact_sql("text", ["email", "phone"]), "after")
    + ") GROUP BY rule"))
def verify_redaction(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    before = rows.select(F.col("doc_id").alias("id"), F.col("text").alias("secret_note"))
    after = before.withColumn("secret_note", redact.redact_text(F.col("secret_note")))
    return redact.verify_redaction(before, after, text_fields=["secret_note"])


# --- user rules --------------------------------------------------------------
USER_RULES = [
    {"rule": "license_line", "regex": r"(?i)license", "field_like": "%note", "type": "information", "severity": "low"},
    {"rule": "long_number", "regex": r"\d{9,}", "field_like": None, "type": "privacy", "severity": "medium"},
    {"rule": "source_one", "regex": r"^src1\d*$", "field_like": "source", "type": "information", "severity": "low"},
]
RULE_TEXT = {"id": "doc_id", "secret_note": "text", "source": "source"}


def _rule_sql() -> str:
    parts = []
    for r in USER_RULES:
        fields = []
        for f in ("secret_note", "source"):
            like = f"'{f}' LIKE {quoted(r['field_like'])}" if r["field_like"] else "TRUE"
            fields.append(f"CASE WHEN {like} AND regexp_matches({f}, {quoted(r['regex'])}) THEN '{f}' END")
        listed = "[x for x in [" + ", ".join(fields) + "] if x IS NOT NULL]"
        parts.append(
            f"SELECT id, {quoted(r['rule'])} AS rule, {quoted(r['type'])} AS type, {quoted(r['severity'])} AS severity, "
            f"{quoted('Matched rule ' + r['rule'])} AS description, 'fields=' || array_to_string(m, ', ') AS data "
            f"FROM (SELECT id, {listed} AS m FROM ({derive_sql('documents', RULE_TEXT)})) WHERE len(m) > 0")
    return " UNION ALL ".join(parts)


@register("match_rules", _rule_sql())
def match_rules(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "documents"), RULE_TEXT)
    entries = P.text_entries(rows, ["secret_note", "source"])
    return explode_findings(audit_ops.match_rules(rows, entries, USER_RULES), "id")
