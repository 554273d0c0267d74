"""Schemas of records, findings, errors and metadata sections."""

from pyspark.sql import types as T

FINDING = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("evidence", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])

ERROR = T.StructType([
    T.StructField("error_type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("suggestions", T.ArrayType(T.StringType())),
])

# Metadata sections and their Spark types. Every section is optional.
METADATA_SECTIONS = {
    "extraction_failed": "BOOLEAN",
    "basic": "MAP<STRING,STRING>",
    "exif": "MAP<STRING,STRING>",
    "iptc": "MAP<STRING,STRING>",
    "xmp": "MAP<STRING,STRING>",
    "document_info": "MAP<STRING,STRING>",
    "document_properties": "MAP<STRING,STRING>",
    "custom_properties": "MAP<STRING,STRING>",
    "page_info": "STRUCT<page_count: BIGINT, pages: ARRAY<STRUCT<index: STRING, optional_content: STRING>>>",
    "security": "STRUCT<encrypted: STRING, permissions: MAP<STRING,STRING>, macros_present: STRING>",
    "embedded_files": "ARRAY<STRING>",
    "audio_properties": "MAP<STRING,STRING>",
    "tags": "MAP<STRING,STRING>",
    "pictures": "ARRAY<STRING>",
    "video_properties": "MAP<STRING,STRING>",
    "audio_streams": "ARRAY<STRUCT<tags: MAP<STRING,STRING>, language: STRING>>",
    "subtitle_streams": "ARRAY<STRUCT<language: STRING, codec: STRING>>",
    "chapters": "ARRAY<STRING>",
    "file_headers": "STRUCT<type: STRING, compile_time: STRING, sections: ARRAY<STRUCT<name: STRING, entropy: DOUBLE>>>",
    "sections": "ARRAY<STRUCT<name: STRING, entropy: DOUBLE>>",
    "libraries": "ARRAY<STRUCT<name: STRING>>",
    "imports": "ARRAY<STRUCT<name: STRING, imports: ARRAY<STRING>>>",
    "signatures": "STRUCT<signed: BOOLEAN, verified: BOOLEAN>",
    "pe_info": "STRUCT<compile_time: STRING, is_dotnet: BOOLEAN>",
    "resources": "ARRAY<STRING>",
    "dynamic": "ARRAY<STRUCT<type: STRING, name: STRING, value: STRING>>",
    "macho_info": "STRUCT<headers: ARRAY<STRUCT<cpu_type: STRING>>>",
    "text_info": "STRUCT<encoding: STRING, line_count: BIGINT>",
    "archive_info": "STRUCT<compression_ratio: DOUBLE, extensions: MAP<STRING,BIGINT>>",
}

# Columns every record has; metadata may be JSON text, VARIANT or (part of) METADATA.
RECORD_COLUMNS = {
    "file_path": "string",
    "file_type": "string",
    "file_size": "bigint",
    "mime_type": "string",
    "hashes": "map<string,string>",
    "creation_time": "string",
    "modification_time": "string",
    "access_time": "string",
}
