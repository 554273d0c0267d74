"""User-defined sources and sinks by name."""

from metaudit.sources.files import scan_files
from metaudit.sources.folders import scan_folder, write_files
from metaudit.sources.records import read_records, write_findings_csv, write_report_files, write_report_json

SOURCES = {"files": scan_files, "folder": scan_folder, "records": read_records}
SINKS = {"csv": write_findings_csv, "json": write_report_json, "files": write_files, "report_files": write_report_files}


def register_source(name: str, function) -> None:
    """``function(spark, **options) -> DataFrame``; a name that is taken keeps its source."""
    SOURCES.setdefault(name.lower(), function)


def register_sink(name: str, function) -> None:
    """``function(df, **options)``; a later sink replaces an earlier one of the same name."""
    SINKS[name.lower()] = function


def load(spark, name: str, *args, **options):
    return SOURCES[name.lower()](spark, *args, **options)


def get_sink(format_name: str):
    return SINKS.get(format_name.lower())
