"""Redaction of metadata fields and of text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaudit.functions import constants as K
from metaudit.functions.findings import let
from metaudit.functions.paths import basename, extension, raw_extension, stem
from metaudit.operators.audit import audit
from metaudit.operators.classify import error_struct
from metaudit.operators.records import conform
from metaudit.operators.report import each
from metaudit.sources.folders import write_files

KINDS = ["image", "pdf", "docx", "xlsx", "tags"]


def _names(keep) -> list:
    return list(keep or [])


def redact_kind(path: Column) -> Column:
    """How a file is redacted: image, pdf, docx, xlsx, tags (audio), or copied."""
    return let(extension(path), lambda ext: (
        F.when(ext.isin(K.IMAGE_EXTENSIONS), "image").when(ext == ".pdf", "pdf").when(ext == ".docx", "docx")
        .when(ext == ".xlsx", "xlsx").when(ext.isin(".mp3", ".flac", ".ogg"), "tags").otherwise("copied")))


def _nothing_of(entries: Column) -> Column:
    """An empty map of the same type."""
    return F.map_filter(entries, lambda k, v: F.lit(False))


def redact_image_fields(exif: Column, path: Column, keep=None) -> Column:
    """Image tags left: none, or for JPEG the kept names, when ``exif`` itself is kept."""
    keep = _names(keep)
    if not keep or "exif" not in keep:
        return _nothing_of(exif)
    jpeg = extension(path).isin(".jpg", ".jpeg")
    return F.map_filter(exif, lambda k, v: jpeg & k.isin(keep))


def redact_pdf_fields(info: Column, keep=None) -> Column:
    return F.map_filter(info, lambda k, v: k.isin(_names(keep)))


def _blank(properties: Column, names, empty) -> Column:
    return F.transform_values(properties, lambda k, v: F.when(k.isin(names), empty).otherwise(v))


def _office_names(owner: str, blanked, keep) -> list:
    keep = set(_names(keep))
    names = [n for n in blanked if n not in keep]
    return names if keep & {"author", "creator"} else [owner] + names


def redact_docx_fields(properties: Column, keep=None, empty="") -> Column:
    """Blank the descriptive properties that are not kept; others stay. ``empty`` is a blank in the map's type."""
    return _blank(properties, _office_names("author", K.DOCX_BLANKED, keep), empty)


def redact_xlsx_fields(properties: Column, keep=None, empty="") -> Column:
    return _blank(properties, _office_names("creator", K.XLSX_BLANKED, keep), empty)


def redact_audio_fields(tags: Column, path: Column, keep=None) -> Column:
    """MP3, FLAC and OGG keep the tags whose name contains a kept entry; other audio is unchanged."""
    keep = _names(keep)
    handled = extension(path).isin(".mp3", ".flac", ".ogg")

    def kept(k):
        test = k.isin(keep)
        for entry in keep:
            test = test | F.lower(k).contains(entry.lower())
        return test

    left = F.map_filter(tags, lambda k, v: kept(k)) if keep else _nothing_of(tags)
    return F.when(handled, left).otherwise(tags)


REDACTED_SECTIONS = ("exif", "iptc", "xmp", "basic", "document_info", "document_properties", "tags")


def _redacted(section: Column, value: Column, path: Column, kind: Column, keep) -> Column:
    """A metadata section (VARIANT) after redaction; sections of other names or kinds of file stay."""
    entries = F.try_variant_get(value, "$", "map<string,variant>")
    empty = F.parse_json(F.lit('""'))
    # a section that should be an object and is not is emptied
    known = F.coalesce(entries, F.from_json(F.lit("{}"), "map<string,variant>"))

    def wrote(new):
        return F.to_variant_object(new)

    return (F.when((kind == "image") & (section == "exif"), wrote(redact_image_fields(known, path, keep)))
            .when((kind == "image") & section.isin("iptc", "xmp"), wrote(_nothing_of(known)))
            .when((kind == "image") & (section == "basic") & entries.isNotNull(),
                  wrote(F.map_filter(known, lambda k, v: k != "color_profile")))
            .when((kind == "pdf") & (section == "document_info"), wrote(redact_pdf_fields(known, keep)))
            .when((kind == "docx") & (section == "document_properties"), wrote(redact_docx_fields(known, keep, empty)))
            .when((kind == "xlsx") & (section == "document_properties"), wrote(redact_xlsx_fields(known, keep, empty)))
            .when((kind == "tags") & (section == "tags"), wrote(redact_audio_fields(known, path, keep)))
            .otherwise(value))


def redact_fields(df: DataFrame, keep=None) -> DataFrame:
    """Redact the metadata of each record; ``redaction`` tells redacted from copied.

    The metadata comes out whole and in the type it came in (JSON text, VARIANT or a struct):
    sections and fields that no rule names stay, and that of a copied record is untouched. JSON
    text of a redacted record has its keys sorted; unreadable text of one becomes null, so that
    nothing leaks.
    """
    df = conform(df, typed=False)
    path, old, given = F.col("file_path"), F.col("metadata"), df.schema["metadata"].dataType
    if isinstance(given, T.VariantType):
        opened = old
    else:
        opened = F.try_parse_json(old if isinstance(given, T.StringType) else F.to_json(old))
    sections = F.try_variant_get(opened, "$", "map<string,variant>")

    def new(kind):
        edited = F.to_variant_object(F.transform_values(sections, lambda k, v: _redacted(k, v, path, kind, keep)))
        if isinstance(given, T.StringType):
            return F.to_json(edited)
        if isinstance(given, T.VariantType):
            return edited
        back = F.from_json(F.to_json(edited), given)
        return F.when(old.isNotNull(), F.struct(*[
            (back if n in REDACTED_SECTIONS else old)[n].alias(n) for n in given.fieldNames()]))

    # the kind is found once for all sections
    return df.withColumns({
        "metadata": let(redact_kind(path), lambda kind: F.when(kind == "copied", old).otherwise(new(kind))),
        "redaction": F.when(redact_kind(path) == "copied", "copied").otherwise("redacted"),
    })


def output_path(path: Column, output_dir: str, suffix: str | None = None) -> Column:
    name = basename(path)
    if suffix is not None:
        name = F.concat(stem(name), F.lit(f"_{suffix}"), raw_extension(name))
    return F.concat(F.lit(output_dir.rstrip("/") + "/"), name)


def redact_batch(df: DataFrame, output_dir: str, keep=None, suffix: str | None = None) -> DataFrame:
    """Redacted records with output path and status; records with errors count as failed."""
    done = redact_fields(df, keep)
    failed = F.size("errors") > 0
    return done.withColumns({
        "output_path": F.when(~failed, output_path(F.col("file_path"), output_dir, suffix)),
        "status": F.when(failed, "failed").otherwise("successful"),
    })


def mark_clashes(batch: DataFrame) -> DataFrame:
    """Rows whose output path a row with a smaller file path takes too have failed, with an error.

    Only the paths that are taken twice are joined with the rows.
    """
    taken = (batch.where("output_path IS NOT NULL").groupBy("output_path")
             .agg(F.min("file_path").alias("_first"), F.max("file_path").alias("_last")).where("_first <> _last").drop("_last"))
    clash = F.col("_first").isNotNull() & (F.col("file_path") != F.col("_first"))
    error = F.array(error_struct("OutputError", F.concat(F.lit("The output path is taken by "), "_first")))
    marked = batch.join(taken, "output_path", "left").withColumns({
        "errors": F.when(clash, F.concat("errors", error)).otherwise(F.col("errors")),
        "status": F.when(clash, "failed").otherwise(F.col("status")),
        "output_path": F.when(~clash, F.col("output_path"))})
    return marked.select(*batch.columns)


def write_redacted(df: DataFrame, output_dir: str, keep=None, suffix: str | None = None) -> DataFrame:
    """Write each redacted record as a JSON file at its output path; returns file_path, output_path, status.

    Records with errors, records whose output path another one takes, and files that cannot be written have
    failed; the others are there, whole. Runs one job; when it is run again each file is there once.
    """
    batch = mark_clashes(redact_batch(df, output_dir, keep, suffix))
    kept = [F.try_parse_json(c).alias(c) if c == "metadata" and isinstance(batch.schema[c].dataType, T.StringType) else F.col(c)
            for c in batch.columns if c not in ("output_path", "status")]
    record = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})
    failed = write_files(batch.where("status = 'successful'").select(F.col("output_path").alias("file_path"), record.alias("content")),
                         output_dir)
    failed = failed.select(F.col("file_path").alias("output_path"), F.lit(True).alias("_unwritten"))
    result = batch.select("file_path", "output_path", "status").join(failed, "output_path", "left")
    return result.select(
        "file_path", F.when(F.col("_unwritten").isNull(), F.col("output_path")).alias("output_path"),
        F.when(F.col("_unwritten"), "failed").otherwise(F.col("status")).alias("status"))


def redact_batch_summary(batch: DataFrame) -> DataFrame:
    return batch.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "successful").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"))


# What each kind of match is replaced by, in the order the replacements run.
MASKS = {
    "email": (K.EMAIL_PATTERN, "[EMAIL]"),
    "card": (K.CARD_PATTERN, "[CARD]"),
    "ssn": (K.SSN_PATTERN, "[SSN]"),
    "ip": (K.IPV4_PATTERN, "[IP]"),
    "phone": (K.PHONE_PATTERN, "[PHONE]"),
}


def redact_text(text: Column, kinds=("email", "phone")) -> Column:
    """Text with its personal data replaced by tags. Whole text, one pass per kind."""
    for name, (pattern, tag) in MASKS.items():
        if name in kinds:
            text = F.regexp_replace(text, "(?U)" + pattern, tag)
    return text


def verify_redaction(before: DataFrame, after: DataFrame, **options) -> DataFrame:
    """Findings per rule before and after redaction, from an audit of both tables."""
    def rules(df, side):
        return audit(df, **options).select(F.explode(each("rule")).alias("rule"), F.lit(side).alias("side"))

    both = rules(before, "before").unionByName(rules(after, "after"))
    return both.groupBy("rule").agg(
        F.count_if(F.col("side") == "before").alias("n_before"),
        F.count_if(F.col("side") == "after").alias("n_after"))
