"""Classification and per-record projections."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.paths import basename, extension, raw_extension, stem
from metaudit.schema import ERROR


def lookup(table: dict, key: Column) -> Column:
    """Constant table as a map literal; null when the key is missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def classify_file_type(path: Column) -> Column:
    ext = extension(path)
    kind = F.lit("other")
    for name, extensions in reversed(K.FILE_TYPES.items()):
        kind = F.when(ext.isin(extensions), name).otherwise(kind)
    return kind


def guess_mime(path: Column) -> Column:
    """MIME type by extension; compression suffixes are looked through."""
    long_form = lookup(K.mime_suffixes(), extension(path))
    path = F.when(long_form.isNotNull(), F.concat(stem(path), long_form)).otherwise(path)
    compressed = raw_extension(path).isin(list(K.mime_encodings()))
    plain = F.when(compressed, stem(path)).otherwise(path)
    return F.coalesce(lookup(K.mime_table(), extension(plain)), F.lit("application/octet-stream"))


def mime_of_content(content: Column, path: Column) -> Column:
    """MIME type by the first bytes; by extension where they tell nothing.

    Packages and media containers share their first bytes, so a type by extension that uses
    the container is taken.
    """
    head, guessed = F.hex(F.substring(content, 1, 12)), guess_mime(path)
    kind = F.lit(None).cast("string")
    for magic, mime in reversed(K.CONTENT_MAGICS.items()):
        kind = F.when(head.startswith(magic), mime).otherwise(kind)
    kind = F.when(F.substring(head, 9, 8) == K.MP4_BRAND, F.when(guessed.rlike("^(audio|video)/"), guessed).otherwise("video/mp4")) \
        .otherwise(kind)
    packed = (kind == "application/zip") & extension(path).isin(K.ZIP_EXTENSIONS)
    program = kind.isin(K.EXECUTABLE_MIMES) & extension(path).isin(K.FILE_TYPES["executable"])
    return F.coalesce(F.when(packed | program, guessed).otherwise(kind), guessed)


def text_encoding(content: Column) -> Column:
    """Encoding of text by its byte-order mark, else ascii, utf-8 or, for other bytes, iso-8859-1."""
    head = F.hex(F.substring(content, 1, 3))
    text = content.cast("string")
    return (F.when(head == "EFBBBF", "utf-8-sig").when(F.left(head, F.lit(4)).isin("FFFE", "FEFF"), "utf-16")
            .when(~F.is_valid_utf8(text), "iso-8859-1")
            .when(F.char_length(text) == F.octet_length(content), "ascii").otherwise("utf-8"))


def valid_utf16(content: Column) -> Column:
    """Whether bytes after a byte-order mark are whole UTF-16 units with no half of a pair alone."""
    little = F.hex(F.substring(content, 1, 2)) == "FFFE"
    units = F.regexp_replace(F.hex(content), F.lit("(..)(..)"), F.when(little, " $2$1").otherwise(" $1$2"))
    alone = units.rlike(" D[89AB]..(?! D[C-F])|(?<! D[89AB].{2}) D[C-F]")
    return (F.octet_length(content) % 2 == 0) & ~alone


def decoded(content: Column, encoding: Column) -> Column:
    """Text of the content; null for broken UTF-16, which cannot be read without failing."""
    return F.when(encoding == "iso-8859-1", F.decode(content, "ISO-8859-1")) \
        .when(encoding == "utf-8-sig", F.make_valid_utf8(F.substring(content, 4, 2 ** 31 - 1).cast("string"))) \
        .when((encoding == "utf-16") & valid_utf16(content), F.decode(content, "UTF-16")) \
        .when(encoding != "utf-16", content.cast("string"))


def file_hashes(content: Column) -> Column:
    """Hex digests of the whole content."""
    return F.create_map(
        F.lit("md5"), F.md5(content), F.lit("sha1"), F.sha1(content),
        F.lit("sha256"), F.sha2(content, 256), F.lit("sha512"), F.sha2(content, 512))


def file_timestamps(created: Column, modified: Column, accessed: Column) -> Column:
    def iso(t):
        return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")

    return F.struct(iso(created).alias("creation_time"), iso(modified).alias("modification_time"),
                    iso(accessed).alias("access_time"))


def route_extractor(path: Column, mime: Column) -> Column:
    """First matching family, by extension or MIME type."""
    ext, mime = extension(path), F.coalesce(mime, F.lit(""))

    def mentions(fragments):
        return mime.rlike("|".join(f.replace(".", r"\.") for f in fragments))

    return (
        F.when(ext.isin(K.IMAGE_EXTENSIONS) | mime.startswith("image/"), "image")
        .when(ext.isin(K.DOCUMENT_EXTENSIONS) | mentions(K.DOCUMENT_MIMES), "document")
        .when(ext.isin(K.AUDIO_EXTENSIONS) | mime.startswith("audio/"), "audio")
        .when(ext.isin(K.VIDEO_EXTENSIONS) | mime.startswith("video/"), "video")
        .when(ext.isin(K.EXECUTABLE_EXTENSIONS) | mentions(K.EXECUTABLE_MIMES), "executable")
        .otherwise("generic"))


def route_analyzers(file_type: Column) -> Column:
    """Rule packs that apply to a file type, in order."""
    own = F.lower(file_type)
    return F.concat(
        F.when(own.isin(list(K.FILE_TYPES)), F.array(own)).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("generic"), F.lit("pattern")))


def executable_format(content: Column) -> Column:
    """Header type, and the first 16 bytes in hex when it is unknown."""
    head = F.hex(F.substring(content, 1, 16))
    kind = (
        F.when(head.startswith(K.PE_MAGIC), "Windows PE")
        .when(head.startswith(K.ELF_MAGIC), "Linux ELF")
        .when(F.left(head, F.lit(8)).isin(K.MACHO_MAGICS), "macOS Mach-O")
        .otherwise("Unknown executable format"))
    return F.struct(
        kind.alias("type"),
        F.when(kind == "Unknown executable format", F.lower(head)).alias("magic_bytes"))


def is_zip_based(path: Column, mime: Column, content: Column) -> Column:
    mentioned = F.coalesce(mime, F.lit("")).rlike("|".join(m.replace(".", r"\.") for m in K.ZIP_MIMES))
    signed = F.coalesce(F.hex(F.substring(content, 1, 4)) == K.ZIP_MAGIC, F.lit(False))
    return extension(path).isin(K.ZIP_EXTENSIONS) | mentioned | signed


def text_stats(text: Column, mime: Column | None = None, encoding: str | Column = "utf-8") -> Column:
    """Line, word and character counts. Line ends are unified first; null for non-text MIME."""
    unified = F.regexp_replace(text, r"\r\n?", "\n")
    lines = F.regexp_count(unified, F.lit("\n")) + F.when(unified.rlike(r"[^\n]\z"), 1).otherwise(0)
    stats = F.struct(
        (encoding if isinstance(encoding, Column) else F.lit(encoding)).alias("encoding"),
        lines.cast("bigint").alias("line_count"),
        F.regexp_count(unified, F.lit(r"(?U)[^\s\x1C-\x1F]+")).cast("bigint").alias("word_count"),
        F.length(unified).cast("bigint").alias("character_count"))
    return stats if mime is None else F.when(mime.startswith("text/"), stats)


def text_format(path: Column) -> Column:
    """Format name by suffix of the base name; a name that is only a suffix counts too."""
    suffix = F.regexp_extract(F.lower(basename(path)), r"(\.[^./]*)\z", 1)
    return lookup(K.TEXT_FORMATS, suffix)


def error_struct(error_type, message, details=None, suggestions=()) -> Column:
    def as_text(x):
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    return F.struct(
        as_text(error_type).alias("error_type"), as_text(message).alias("message"), as_text(details).alias("details"),
        F.array(*map(F.lit, suggestions)).cast("array<string>").alias("suggestions")).cast(ERROR)


# Advice shown with each kind of error.
MISSING_ADVICE = ["Check the path for typing errors", "Make sure the file exists and can be read"]
NOT_A_FILE_ADVICE = ["Give the path of a file, not of a directory"]
EXTRACTION_ADVICE = ["Check that the file is complete and of a supported format"]


def record_errors(expected: DataFrame, scanned: DataFrame) -> DataFrame:
    """One record per expected path, with an error for missing files, directories and failed extraction.

    ``expected`` has ``file_path``; ``scanned`` has record columns and optionally
    ``is_directory`` and ``extraction_error``. Failed rows get ``extraction_failed`` set,
    which keeps the rules from running on them.
    """
    wanted = expected.select("file_path").distinct()
    have = scanned.withColumns({
        "_found": F.lit(True),
        "_dir": F.col("is_directory") if "is_directory" in scanned.columns else F.lit(False),
        "_bad": F.col("extraction_error") if "extraction_error" in scanned.columns else F.lit(None).cast("string"),
    })
    joined = wanted.join(have, "file_path", "left")
    path = F.col("file_path")
    error = (
        F.when(F.col("_found").isNull(), error_struct(
            "FileNotFoundError", F.concat(F.lit("Could not find or access file: "), path),
            suggestions=MISSING_ADVICE))
        .when(F.col("_dir"), error_struct(
            "PathError", F.concat(F.lit("Path exists but is not a file: "), path), suggestions=NOT_A_FILE_ADVICE))
        .when(F.col("_bad").isNotNull(), error_struct(
            "ExtractionError", F.concat(F.lit("Failed to extract metadata from "), path), F.col("_bad"),
            suggestions=EXTRACTION_ADVICE)))
    absent = F.col("_found").isNull() | F.coalesce(F.col("_dir"), F.lit(False))
    out = joined.withColumns({
        "errors": F.array_compact(F.array(error)),
        "extraction_failed": F.col("_bad").isNotNull(),
    })
    defaults = {"file_type": F.lit("unknown"), "mime_type": F.lit("unknown"), "file_size": F.lit(0).cast("bigint")}
    out = out.withColumns({
        n: F.when(absent, v).otherwise(F.col(n)) if n in scanned.columns else v for n, v in defaults.items()
    })
    return out.drop("_found", "_dir", "_bad", "is_directory", "extraction_error")


def describe_files(files: DataFrame, skip_hashes: bool = False, skip_extraction: bool = False) -> DataFrame:
    """Record columns for scanned files: type, MIME, hashes, text statistics, header of executables.

    MIME type and encoding are read from the content. Broken UTF-16 has an encoding and no counts.
    A null content (not read) has the type of its extension, no hashes and no metadata. Skipped
    stages leave nulls, so the optimizer drops their inputs (content is then not read, and the
    MIME type is that of the extension).
    """
    path, content = F.col("file_path"), F.col("content")
    kind = classify_file_type(path)
    mime = guess_mime(path) if skip_extraction else mime_of_content(content, path)
    columns = {
        "file_type": kind,
        "mime_type": mime,
        "hashes": F.lit(None).cast("map<string,string>") if skip_hashes else F.when(content.isNotNull(), file_hashes(content)),
    }
    if skip_extraction:
        return files.withColumns(columns).drop("content")
    is_text = F.col("mime_type").startswith("text/") & content.isNotNull()
    opened = files.withColumns(columns).withColumn("_encoding", F.when(is_text, text_encoding(content)))
    header = F.struct(executable_format(content)["type"].alias("type"))
    return opened.withColumn("metadata", F.struct(
        F.when(is_text, text_stats(decoded(content, F.col("_encoding")), encoding=F.col("_encoding"))).alias("text_info"),
        F.when((kind == "executable") & content.isNotNull(), header).alias("file_headers"))).drop("content", "_encoding")
