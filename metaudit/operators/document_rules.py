"""Rules over PDF and Office metadata."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.findings import (
    Items, entries_text, finding, fires, fires_on, keep_keys, listing, nonempty, override, truthy,
)
from metaudit.operators.rulebook import Pack

PACK = Pack("document", "document")
SECTIONS = ("document_info", "document_properties")


@PACK.rule
def doc_author(rec) -> Column:
    found = override(
        keep_keys(rec.section("document_info"), K.PDF_AUTHOR_KEYS),
        keep_keys(rec.section("document_properties"), K.OFFICE_AUTHOR_KEYS))
    return listing("doc_author", "privacy", "medium", "Author information found", "author_fields", found)


@PACK.rule
def doc_software(rec) -> Column:
    def first_of(section):
        return F.coalesce(*[nonempty(section[k]) for k in K.DOCUMENT_SOFTWARE_KEYS])

    software = F.coalesce(first_of(rec.section("document_properties")), first_of(rec.section("document_info")))
    return fires_on(software, lambda s: s.isNotNull(), lambda s: finding(
        "doc_software", "information", "low", F.concat(F.lit("Document created with "), s), software=s))


@PACK.rule
def doc_encrypted(rec) -> Column:
    return fires(truthy(rec.section("security")["encrypted"]), finding(
        "doc_encrypted", "security", "medium", "Document is encrypted/password-protected", encryption=True))


@PACK.rule
def doc_restricted_permissions(rec) -> Column:
    denied = F.map_filter(rec.section("security")["permissions"], lambda k, v: ~truthy(v))
    return fires_on(denied, lambda d: F.size(d) > 0, lambda d: finding(
        "doc_restricted_permissions", "security", "low", "Document has restricted permissions",
        restricted_permissions=Items(F.sort_array(F.map_keys(d)))))


@PACK.rule
def doc_macros(rec) -> Column:
    return fires(truthy(rec.section("security")["macros_present"]), finding(
        "doc_macros", "security", "high", "Document contains macros", macros=True))


@PACK.rule
def doc_dates(rec) -> Column:
    def dated(section):
        return F.map_filter(keep_keys(section, K.DOCUMENT_DATE_KEYS), lambda k, v: F.coalesce(v, F.lit("")) != "")

    found = override(*[dated(rec.section(s)) for s in SECTIONS])
    return fires_on(found, lambda m: F.size(m) > 1, lambda m: finding(
        "doc_dates", "information", "low", "Document timestamp information", dates=Items(entries_text(m))))


@PACK.rule
def doc_hidden_content(rec) -> Column:
    hidden = F.filter(rec.section("page_info")["pages"], lambda p: truthy(p["optional_content"]))
    return F.transform(hidden, lambda p: finding(
        "doc_hidden_content", "security", "medium", "Document contains optional/hidden content",
        page=F.coalesce(p["index"], F.lit("unknown"))))


@PACK.rule
def doc_revisions(rec) -> Column:
    def revisions(section):
        listed = F.array(*[
            F.struct(F.lit(k).alias("key"), section[k].alias("value")) for k in K.REVISION_KEYS
        ])
        return F.filter(listed, lambda e: F.coalesce(e["value"], F.lit("")) != "")

    found = F.concat(*[revisions(rec.section(s)) for s in SECTIONS])
    return F.transform(found, lambda e: finding(
        "doc_revisions", "information", "low", "Document contains revision information",
        revision_info=F.concat(e["key"], F.lit(": "), e["value"])))


@PACK.rule
def doc_custom_properties(rec) -> Column:
    custom = rec.section("custom_properties")
    return listing("doc_custom_properties", "privacy", "low", "Document contains custom properties",
                   "custom_properties", custom)


@PACK.rule
def doc_embedded_files(rec) -> Column:
    embedded = rec.section("embedded_files")
    return fires(F.size(embedded) > 0, finding(
        "doc_embedded_files", "security", "high", "Document contains embedded files",
        embedded_files_count=F.size(embedded)))


@PACK.rule
def doc_javascript(rec) -> Column:
    return fires(truthy(rec.section("document_info")["has_javascript"]), finding(
        "doc_javascript", "security", "high", "Document contains JavaScript", javascript=True))
