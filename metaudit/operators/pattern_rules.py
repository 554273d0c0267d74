"""Personal-data and secret detectors.

Input is an array of ``(field, value)`` entries: flattened metadata, or text columns
taken as they are. Each detector reports the distinct matches over all values. A cheap
test on each value runs before the costly expression, so most text is passed over once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.findings import Items, combine, finding, fires

# Unicode classes, so that \w, \d and word boundaries also cover non-ASCII letters.
UNICODE = "(?U)"


def text_entries(df: DataFrame, fields) -> Column:
    """Entries taken from plain columns; a null column counts as the empty string."""
    return F.array(*[
        F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value"))
        for f in fields
    ])


def _matches(entries: Column, pattern: str, group: int, guard) -> Column:
    """Sorted distinct matches over the values that pass the guard."""
    values = F.filter(F.transform(entries, lambda e: e["value"]), guard)
    found = F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(UNICODE + pattern), F.lit(group)))
    return F.sort_array(F.array_distinct(F.flatten(found)))


def gps_term_matches(entries: Column) -> Column:
    return _matches(entries, "(?i)" + K.GPS_TERMS_PATTERN, 0, lambda v: v.rlike("(?i)gps|geotag|location"))


def email_matches(entries: Column) -> Column:
    return _matches(entries, K.EMAIL_PATTERN, 1, lambda v: v.contains("@"))


def phone_matches(entries: Column) -> Column:
    return _matches(entries, K.PHONE_PATTERN, 0, lambda v: v.rlike(UNICODE + r"\d{4}"))


def ssn_matches(entries: Column) -> Column:
    return _matches(entries, K.SSN_PATTERN, 0, lambda v: v.rlike(UNICODE + r"-\d\d-"))


def domain_matches(entries: Column) -> Column:
    """Host-like names, without the common ones."""
    found = _matches(entries, K.DOMAIN_PATTERN, 1, lambda v: v.rlike(r"[-a-zA-Z0-9]\.[a-zA-Z0-9]{2}"))
    return F.filter(found, lambda d: ~F.lower(d).isin(K.COMMON_DOMAINS))


def ip_matches(entries: Column) -> Column:
    """Public IPv4 addresses, then full-form IPv6 addresses."""
    v4 = _matches(entries, K.IPV4_PATTERN, 0, lambda v: v.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]"))
    v6 = _matches(entries, K.IPV6_PATTERN, 0, lambda v: v.rlike(r"[0-9a-fA-F]:[0-9a-fA-F]{1,4}:[0-9a-fA-F]"))

    def public(ip):
        octets = F.split(ip, r"\.")
        first, second = octets[0].cast("int"), octets[1].cast("int")
        private = (
            first.isin(10, 127)
            | ((first == 192) & (second == 168))
            | ((first == 172) & second.between(16, 31))
        )
        return ~private

    return F.concat(F.filter(v4, public), v6)


def card_matches(entries: Column) -> Column:
    return _matches(entries, K.CARD_PATTERN, 0, lambda v: v.rlike(r"[0-9]{13}"))


def api_key_matches(entries: Column) -> Column:
    """``field: abc...xyz`` for long tokens in fields with a telling name; repeats are kept."""
    telling = F.filter(entries, lambda e: F.lower(e["field"]).rlike("|".join(K.API_KEY_FIELDS)))
    telling = F.filter(telling, lambda e: e["value"].rlike("[a-zA-Z0-9]{20}"))
    masked = F.transform(telling, lambda e: F.transform(
        F.regexp_extract_all(e["value"], F.lit(UNICODE + K.API_KEY_PATTERN), F.lit(1)),
        lambda m: F.concat(e["field"], F.lit(": "), F.left(m, F.lit(3)), F.lit("..."), F.right(m, F.lit(3))),
    ))
    return F.flatten(masked)


def url_matches(entries: Column) -> Column:
    return _matches(entries, K.URL_PATTERN, 0, lambda v: v.contains("http"))


def mask_card(number: Column) -> Column:
    return F.concat(F.lit("XXXX-XXXX-XXXX-"), F.right(number, F.lit(4)))


# detector -> (match function, how a non-empty match array is reported)
def _privacy(name, severity):
    return lambda m: finding(
        name, "privacy", severity, f"Found {name} in metadata", matches=Items(m), pattern=name
    )


def _counted(rule, type_, severity, what, key, render=lambda m: m):
    return lambda m: finding(
        rule, type_, severity,
        F.concat(F.lit("Found "), F.size(m), F.lit(f" {what} in metadata")),
        **{key: Items(render(m))},
    )


DETECTORS = {
    "gps_data": (gps_term_matches, _privacy("gps_data", "medium")),
    "email": (email_matches, _privacy("email", "high")),
    "phone": (phone_matches, _privacy("phone", "medium")),
    "ssn": (ssn_matches, _privacy("ssn", "high")),
    "domains": (domain_matches, _counted("domains", "information", "low", "domain names", "domains")),
    "ip_addresses": (ip_matches, _counted("ip_addresses", "privacy", "medium", "IP addresses", "ip_addresses")),
    "credit_cards": (card_matches, _counted(
        "credit_cards", "privacy", "high", "potential credit card numbers", "credit_cards",
        lambda m: F.sort_array(F.transform(m, mask_card)))),
    "api_keys": (api_key_matches, _counted(
        "api_keys", "security", "high", "potential API keys or tokens", "api_keys")),
    "urls": (url_matches, _counted("urls", "information", "low", "URLs", "urls")),
}


def report(name: str, matches: Column) -> Column:
    """Findings of one detector, given its computed match array."""
    return fires(F.size(matches) > 0, DETECTORS[name][1](matches))


def with_matches(df: DataFrame, entries: Column, detectors=None) -> DataFrame:
    """Add one ``_m_<detector>`` array column per detector: each expression runs once per row."""
    names = list(detectors or DETECTORS)
    return df.withColumns({f"_m_{n}": DETECTORS[n][0](entries) for n in names})


def pattern_findings(df: DataFrame, entries: Column, detectors=None, into="findings") -> DataFrame:
    """Run detectors over the entries of each row; adds one array-of-findings column."""
    names = list(detectors or DETECTORS)
    matched = with_matches(df, entries, names)
    # Each match column is read several times below, so the optimizer keeps this projection
    # apart instead of copying the expression into every place it is read from.
    out = matched.withColumn(into, combine(report(n, F.col(f"_m_{n}")) for n in names))
    return out.drop(*[f"_m_{n}" for n in names])


def detect(df: DataFrame, fields, detectors=None, into="findings") -> DataFrame:
    """Detectors over text columns."""
    return pattern_findings(df, text_entries(df, fields), detectors, into)
