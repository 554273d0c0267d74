"""Reports over audited records (a ``findings`` array per row).

Per-file figures are computed inside the row; only corpus totals shuffle, and those are
pre-aggregated to a few rows per task.
"""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.paths import basename


def evidence_text(evidence: Column) -> Column:
    """``k=a, b; k2=c`` rendering of a finding's evidence."""
    return F.array_join(F.transform(
        F.map_entries(evidence),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ", ", "None"))), "; ")


def each(field: str) -> Column:
    """One field of every finding, as an expression: see :func:`explode_findings`."""
    return F.transform("findings", lambda f: f[field])


def explode_findings(df: DataFrame, *keys: str) -> DataFrame:
    """One row per finding: keys, rule, type, severity, description, data text.

    The generator reads an expression, not the bare column: for a bare column the optimizer
    adds a ``size(findings) > 0`` filter and pushes it to the scan with every rule inside,
    which would evaluate all rules twice.
    """
    rendered = F.transform("findings", lambda f: F.struct(
        f["rule"].alias("rule"), f["type"].alias("type"), f["severity"].alias("severity"),
        f["description"].alias("description"), evidence_text(f["evidence"]).alias("data")))
    return df.select(*keys, F.inline(rendered))


def findings_report(df: DataFrame) -> DataFrame:
    """Row per finding; a file without findings gives one ``none`` row."""
    rows = df.select("file_path", "file_type", "file_size", "hashes", F.explode_outer("findings").alias("_f"))
    none = F.col("_f").isNull()
    return rows.select(
        "file_path", "file_type",
        F.when(none, "none").otherwise(F.col("_f.type")).alias("finding_type"),
        F.when(none, "none").otherwise(F.col("_f.severity")).alias("severity"),
        F.when(none, "No findings").otherwise(F.col("_f.description")).alias("description"),
        F.when(none, "").otherwise(evidence_text(F.col("_f.evidence"))).alias("data"),
        "file_size",
        F.coalesce(F.col("hashes")["sha256"], F.lit("")).alias("sha256"))


def findings_brief(df: DataFrame) -> DataFrame:
    """The five leading columns of :func:`findings_report`."""
    return findings_report(df).select("file_path", "file_type", "finding_type", "severity", "description")


def _of_severity(findings: Column, severity: str) -> Column:
    return F.size(F.filter(findings, lambda f: F.lower(f["severity"]) == severity))


def severity_counts(findings: Column) -> dict:
    """high / medium / low / other / total as Columns; case-insensitive."""
    counts = {s: _of_severity(findings, s) for s in K.SEVERITIES}
    total = F.size(findings)
    counts["other"] = total - sum(list(counts.values())[1:], counts["high"])
    counts["total"] = total
    return counts


def file_summary(df: DataFrame) -> DataFrame:
    counts = severity_counts(F.coalesce(F.col("findings"), F.array().cast(df.schema["findings"].dataType)))
    return df.select(
        "file_path", "file_type", "file_size", "mime_type",
        F.coalesce("creation_time", F.lit("")).alias("creation_time"),
        F.coalesce("modification_time", F.lit("")).alias("modification_time"),
        F.coalesce(F.col("hashes")["sha256"], F.lit("")).alias("sha256"),
        counts["high"].alias("n_high"), counts["medium"].alias("n_medium"), counts["low"].alias("n_low"),
        counts["total"].alias("n_total"))


def file_report(df: DataFrame, include_metadata: bool = True) -> DataFrame:
    """Nested report document per file."""
    findings = F.coalesce(F.col("findings"), F.array().cast(df.schema["findings"].dataType))
    counts = severity_counts(findings)
    types = F.transform(findings, lambda f: F.lower(f["type"]))
    by_type = F.map_from_entries(F.transform(
        F.sort_array(F.array_distinct(types)),
        lambda t: F.struct(t.alias("key"), F.size(F.filter(types, lambda x: x == t)).alias("value"))))
    details = F.transform(findings, lambda f: F.struct(
        f["type"].alias("type"), f["description"].alias("description"), f["severity"].alias("severity"),
        f["evidence"].alias("data")))
    columns = [
        "file_path", basename(F.col("file_path")).alias("file_name"), "file_type", "mime_type", "file_size", "hashes",
        F.struct("creation_time", "modification_time", "access_time").alias("timestamps"),
        F.struct(
            F.struct(
                counts["total"].alias("total"),
                F.struct(*[counts[s].alias(s) for s in K.SEVERITIES + ["other"]]).alias("by_severity"),
                by_type.alias("by_type")).alias("count"),
            details.alias("details")).alias("findings"),
        "errors",
    ]
    if include_metadata and "metadata" in df.columns:
        columns.append("metadata")
    return df.select(*columns)


def corpus_summary_severity(df: DataFrame) -> DataFrame:
    """Findings by severity bucket, all four present, and the total."""
    names = K.SEVERITIES + ["other", "total"]
    counts = severity_counts(F.coalesce(F.col("findings"), F.array().cast(df.schema["findings"].dataType)))
    per_row = df.select(*[counts[n].alias(n) for n in names])
    totals = per_row.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("severity"), F.col(n).alias("n_findings")) for n in names])))


def corpus_summary_type(df: DataFrame) -> DataFrame:
    types = df.select(F.explode(each("type")).alias("type"))
    return types.groupBy(F.lower("type").alias("type")).agg(F.count("*").alias("n_findings"))


def corpus_file_types(df: DataFrame) -> DataFrame:
    return df.groupBy("file_type").agg(F.count("*").alias("n_files"))


def _measures(df: DataFrame) -> list[tuple[str, str, Column]]:
    """(measure, key, value of a record) of the figures whose keys are known beforehand."""
    counts = severity_counts(F.coalesce(F.col("findings"), F.array().cast(df.schema["findings"].dataType)))
    errors = F.coalesce(F.size("errors"), F.lit(0)) if "errors" in df.columns else F.lit(0)
    return [("severity", n, counts[n]) for n in K.SEVERITIES + ["other", "total"]] + [("records", "total", F.lit(1)), ("errors", "total", errors)]


def _count_of(values: Column, name: str) -> Column:
    return F.size(F.filter(values, lambda v: v == name))


def corpus_report(df: DataFrame) -> DataFrame:
    """All totals of a corpus from one pass: measure, key, n.

    Measures: severity (each bucket and the total), type, file_type, records and errors. A record gives
    its figures as a few rows, which are added up before the shuffle. Keys known beforehand are there
    with 0, for an empty table too.
    """
    known = _measures(df)
    own = [F.struct(F.lit(m).alias("measure"), F.lit(k).alias("key"), v.cast("bigint").alias("n")) for m, k, v in known]
    types = F.transform(F.coalesce(each("type"), F.array().cast("array<string>")), lambda t: F.struct(
        F.lit("type").alias("measure"), F.lower(t).alias("key"), F.lit(1).cast("bigint").alias("n")))
    if "file_type" in df.columns:
        own.append(F.struct(F.lit("file_type").alias("measure"), F.col("file_type").alias("key"), F.lit(1).cast("bigint").alias("n")))
    rows = df.select(F.inline(F.concat(F.array(*own), types)))
    none = df.sparkSession.createDataFrame([(m, k, 0) for m, k, _ in known], "measure string, key string, n bigint")
    return rows.unionAll(none).groupBy("measure", "key").agg(F.sum("n").alias("n"))


def write_audit(audited: DataFrame, path: str, mode: str = "errorifexists") -> dict:
    """Write audited records as Parquet and return the totals that were observed on the way.

    One job reads, judges, writes and counts. Keys are (measure, key) as in ``corpus_report``: severity,
    records and errors, and the finding and file types that the library knows; what else there is counts as
    ``other`` (type) or ``others`` (file type).
    """
    figures = [(m, k, F.sum(v)) for m, k, v in _measures(audited)]
    types = F.transform(F.coalesce(each("type"), F.array().cast("array<string>")), F.lower)
    figures += [("type", name, F.sum(_count_of(types, name))) for name in K.FINDING_TYPES]
    figures.append(("type", "other", F.sum(F.size(F.filter(types, lambda t: ~t.isin(K.FINDING_TYPES))))))
    if "file_type" in audited.columns:
        kind, known = F.col("file_type"), [*K.FILE_TYPES, "other", "unknown"]
        figures += [("file_type", name, F.count_if(kind == name)) for name in known]
        figures.append(("file_type", "others", F.count_if(~kind.isin(known) | kind.isNull())))
    observation = Observation()
    named = [v.alias(f"{m}.{k}") for m, k, v in figures]
    audited.observe(observation, *named).write.mode(mode).parquet(path)
    found = observation.get
    return {(m, k): found[f"{m}.{k}"] or 0 for m, k, _ in figures}


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(K.SEVERITIES))
    for i, name in enumerate(K.SEVERITIES):
        rank = F.when(F.lower(severity) == name, i).otherwise(rank)
    return rank


def ranked_findings(df: DataFrame, *keys: str) -> DataFrame:
    """Findings of each file from high to low, stable within a severity; sorted inside the row."""
    numbered = F.transform("findings", lambda f, i: F.struct(
        severity_rank(f["severity"]).alias("rank"), i.alias("position"),
        F.struct(f["rule"].alias("rule"), f["type"].alias("type"), f["severity"].alias("severity"),
                 f["description"].alias("description")).alias("finding")))
    rows = df.select(*keys, F.posexplode(F.sort_array(numbered)).alias("_pos", "_f"))
    return rows.select(*keys, (F.col("_pos") + 1).alias("rank"), "_f.finding.rule", "_f.finding.type",
                       "_f.finding.severity", "_f.finding.description")


def evidence_sample(evidence: Column) -> Column:
    """``key: first five items (and N more)`` for each key of the evidence."""
    def line(e):
        sample = F.array_join(F.slice(e["value"], 1, 5), ", ", "None")
        more = F.size(e["value"]) - 5
        return F.concat(e["key"], F.lit(": "), sample,
                        F.when(more > 0, F.concat(F.lit(" (and "), more, F.lit(" more)"))).otherwise(""))

    return F.transform(F.map_entries(evidence), line)


def evidence_samples(df: DataFrame, *keys: str) -> DataFrame:
    lines = F.transform("findings", lambda f: F.struct(
        f["rule"].alias("rule"), F.array_join(evidence_sample(f["evidence"]), "\n").alias("sample")))
    return df.select(*keys, F.inline(lines))


def file_risk(df: DataFrame, *keys: str) -> DataFrame:
    """Highest severity of a file, and its colour: red, yellow, or none."""
    best = F.array_min(F.transform("findings", lambda f: severity_rank(f["severity"])))
    highest = F.get(F.array(*map(F.lit, K.SEVERITIES)), best)
    return df.select(
        *keys, F.coalesce(highest, F.lit("none")).alias("risk"),
        F.when(best == 0, "red").when(best == 1, "yellow").otherwise("none").alias("color"))


def error_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("total_errors"))


def findings_filter(df: DataFrame, severity: str | None = None, type_: str | None = None) -> DataFrame:
    """Keep only the findings of a severity and/or type (case-insensitive)."""
    def test(f):
        keep = F.lit(True)
        if severity is not None:
            keep = keep & (F.lower(f["severity"]) == severity.lower())
        if type_ is not None:
            keep = keep & (F.lower(f["type"]) == type_.lower())
        return keep

    return df.withColumn("findings", F.filter("findings", test))
