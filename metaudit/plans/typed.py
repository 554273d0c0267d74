"""Rule packs over typed metadata, derived by arithmetic from part, orders, lineitem and customer."""

from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.operators import (
    audio_rules, document_rules, executable_rules, image_rules, video_rules,
)
from metaudit.operators.audit import run_pack, run_rule
from metaudit.operators.report import explode_findings
from metaudit.plans.base import as_json, choose, derive, derive_sql, in_list, quoted, register, section, table

KEYS = ["rule", "type", "severity", "description", "data"]


def some(key: str, every: int, value: str) -> str:
    """The value on every n-th key, else NULL (an absent entry)."""
    return f"CASE WHEN ({key}) % {every} = 0 THEN {value} END"


def shown(*pairs) -> str:
    """SQL text of the sorted ``key: value`` list of the non-null columns."""
    items = ", ".join(f"{quoted(k + ': ')} || {c}" for k, c in pairs)
    return (f"replace(array_to_string(list_sort([x for x in [{items}] if x IS NOT NULL]), ', '), '<null>', 'None')")


def any_of(*columns) -> str:
    return "(" + " OR ".join(f"{c} IS NOT NULL" for c in columns) + ")"


def rule_sql(source, rule, type_, severity, cases) -> str:
    """cases: (condition, description SQL, data SQL), one finding each."""
    sev = severity if severity.startswith("CASE") else quoted(severity)
    return " UNION ALL ".join(
        f"SELECT id, {quoted(rule)} AS rule, {quoted(type_)} AS type, {sev} AS severity, {d} AS description, {data} AS data "
        f"FROM ({source}) WHERE {c}" for c, d, data in cases)


def _register(pack, source_table, columns, build, oracles, readable="TRUE"):
    """One query per rule of a pack, and one for the whole pack.

    ``readable`` holds for the records a whole pack can judge; others get an error instead.
    """
    source = derive_sql(source_table, columns)

    def one(rule):
        @register(rule, rule_sql(source, rule, *oracles[rule]))
        def run(spark, sf_dir):
            records = build(derive(table(spark, sf_dir, source_table), columns))
            return explode_findings(run_rule(records, pack.rules[rule]), "id")

    for rule in oracles:
        one(rule)
    missing = set(pack.rules) - set(oracles)
    if missing:
        raise ValueError(f"rules without a query: {missing}")

    judged = f"SELECT * FROM ({source}) WHERE {readable}"
    every = " UNION ALL ".join(rule_sql(judged, r, *oracles[r]) for r in oracles)

    @register(f"{pack.name}_rules", f"SELECT rule, severity, count(*) AS n FROM ({every}) GROUP BY rule, severity")
    def run_all(spark, sf_dir):
        records = build(derive(table(spark, sf_dir, source_table), columns))
        found = run_pack(records, pack).select(F.inline(F.transform("findings", lambda f: F.struct(
            f["rule"].alias("rule"), f["severity"].alias("severity")))))
        return found.groupBy("rule", "severity").agg(F.count("*").alias("n"))


# --- images: from part -------------------------------------------------------
k = "p_partkey"
IMAGE = {
    "id": k,
    "file_path": f"'img/' || CAST({k} AS STRING) || '.jpg'",
    "gpsinfo": some(k, 5, "p_name"), "gps": some(k, 7, "'<null>'"),
    "make": f"CASE WHEN {k} % 33 = 0 THEN '<null>' WHEN {k} % 3 = 0 THEN p_brand END",
    "model_exif": some(k, 4, "p_type"), "model_basic": some(k, 6, "p_name"),
    "software": f"CASE {k} % 6 WHEN 0 THEN 'Adobe Photoshop ' || CAST(p_size AS STRING) WHEN 1 THEN 'GIMP 2' WHEN 2 THEN 'Camera 1' END",
    "taken_exif": some(k, 2, "'2020:01:' || CAST(10 + p_size % 20 AS STRING)"), "taken_iptc": some(k, 9, "'2021:02:03'"),
    "byline": some(k, 8, "p_name"), "contact": some(k, 11, "p_brand"),
    "tool": f"CASE {k} % 10 WHEN 0 THEN 'Affinity Photo' WHEN 1 THEN '<null>' WHEN 2 THEN 'Scanner' END",
    "raw": some(k, 3, f"CASE WHEN {k} % 2 = 0 THEN '<x xmpMM:History=\"1\"/>' ELSE '<x/>' END"),
    "color_profile": f"CASE {k} % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'icc' WHEN 2 THEN '<null>' END",
}


def image_records(df):
    metadata = F.struct(
        section({"GPSInfo": "gpsinfo", "GPS": "gps", "Make": "make", "Model": "model_exif", "Software": "software",
                 "DateTime": "taken_exif"}).alias("exif"),
        section({"Model": "model_basic", "color_profile": "color_profile"}).alias("basic"),
        section({"DateTime": "taken_iptc", "By-line": "byline", "Contact": "contact"}).alias("iptc"),
        section({"CreatorTool": "tool", "raw": "raw"}).alias("xmp"))
    return df.select("id", "file_path", F.lit("image").alias("file_type"), as_json(metadata))


# what the editor rule sees: the xmp tool if there is one (even null), else the exif software
_editor = "CASE WHEN tool IS NOT NULL THEN tool ELSE software END"
_register(image_rules.PACK, "part", IMAGE, image_records, {
    "image_gps": ("privacy", "high", [
        ("gpsinfo IS NOT NULL", "'GPS location data found in EXIF metadata'", "'source=EXIF; field=GPSInfo'"),
        ("gps IS NOT NULL", "'GPS location data found in EXIF metadata'", "'source=EXIF; field=GPS'")]),
    "image_device": ("privacy", "medium", [(
        any_of("make", "model_exif", "model_basic", "software"), "'Device/software information found'",
        "'device_info=' || " + shown(("Make", "make"), ("Model", "coalesce(model_basic, model_exif)"), ("Software", "software")))]),
    "image_dates": ("information", "low", [(
        any_of("taken_exif", "taken_iptc"), "'Image creation/modification timestamps found'",
        "'dates=' || " + shown(("DateTime", "coalesce(taken_iptc, taken_exif)")))]),
    "image_contact": ("privacy", "medium", [(
        any_of("byline", "contact"), "'Creator/contact information found in IPTC data'",
        "'contact_info=' || " + shown(("By-line", "byline"), ("Contact", "contact")))]),
    "image_edited": ("authenticity", "medium", [(
        f"regexp_matches(lower({_editor}), 'photoshop|gimp|lightroom|affinity')",
        f"'Image edited with ' || {_editor}", f"'software=' || {_editor}")]),
    "image_xmp_history": ("authenticity", "medium", [(
        "raw LIKE '%xmpMM:History%'", "'XMP edit history found'", "'edit_history=XMP history entries present'")]),
    "image_color_profile": ("information", "low", [(
        "color_profile <> 'None'", "'Embedded color profile found'", "'color_profile=Present'")]),
})

# --- documents: from orders --------------------------------------------------
k = "o_orderkey"
DOCUMENT = {
    "id": k,
    "file_path": f"'doc/' || CAST({k} AS STRING) || '.pdf'",
    "author_info": f"CASE WHEN {k} % 21 = 0 THEN '<null>' WHEN {k} % 3 = 0 THEN 'clerk ' || CAST(o_custkey AS STRING) END",
    "creator_info": f"CASE {k} % 8 WHEN 0 THEN 'Writer' WHEN 1 THEN '' WHEN 2 THEN '<null>' END",
    "producer_info": some(k, 5, "'Printer ' || o_orderstatus"),
    "author_prop": some(k, 7, "o_orderpriority"),
    "application": some(k, 11, "'Office ' || o_orderstatus"),
    "created_info": some(k, 2, "'D:' || CAST(o_custkey AS STRING)"),
    "modified_info": some(k, 4, f"CASE WHEN {k} % 8 = 0 THEN '' ELSE 'D:' || CAST({k} AS STRING) END"),
    "created_prop": some(k, 6, "'2001-01-01'"),
    "version": some(k, 9, f"CASE WHEN {k} % 2 = 0 THEN '' ELSE 'v' || CAST({k} % 10 AS STRING) END"),
    "revision_prop": some(k, 10, "CAST(o_custkey % 50 AS STRING)"),
    "javascript": choose(k, [None, "True", "False", "", None, "1"]),
    "encrypted": choose(k, [None, "true", "false", None]),
    "macros": choose(k, ["true", None, "false", None, None, None, None]),
    "no_print": f"CASE WHEN {k} % 3 = 1 THEN 'false' ELSE 'true' END",
    "no_copy": choose(k, [None, "false", "true", "false", None]),
    "n_pages": f"{k} % 4",
    "custom": some(k, 12, "o_orderpriority"),
    "n_embedded": f"CASE WHEN {k} % 13 = 0 THEN {k} % 3 END",
}


def document_records(df):
    page = F.transform(
        F.sequence(F.lit(0), F.col("n_pages").cast("int")), lambda i: F.struct(
            i.cast("string").alias("index"),
            F.when((i + F.col("id")) % 3 == 0, "layer").otherwise(F.lit(None)).alias("optional_content")))
    embedded = F.transform(F.sequence(F.lit(0), F.col("n_embedded").cast("int")), lambda i: i.cast("string"))
    metadata = F.struct(
        section({"Author": "author_info", "Creator": "creator_info", "Producer": "producer_info",
                 "CreationDate": "created_info", "ModDate": "modified_info", "version": "version",
                 "has_javascript": "javascript"}).alias("document_info"),
        section({"author": "author_prop", "application": "application", "created": "created_prop",
                 "revision": "revision_prop"}).alias("document_properties"),
        section({"Project": "custom"}).alias("custom_properties"),
        F.struct(F.size(page).cast("bigint").alias("page_count"), page.alias("pages")).alias("page_info"),
        F.struct(F.col("encrypted"), section({"printing": "no_print", "copy": "no_copy"}).alias("permissions"),
                 F.col("macros").alias("macros_present")).alias("security"),
        F.when(F.col("n_embedded") > 0, F.slice(embedded, F.lit(1), F.col("n_embedded").cast("int"))).alias("embedded_files"))
    return df.select("id", "file_path", F.lit("document").alias("file_type"), as_json(metadata))


_software = ("coalesce(application, nullif(nullif(creator_info, ''), '<null>'), producer_info)")
_given = [f"nullif({c}, '')" for c in ("created_info", "modified_info", "created_prop")]
_register(document_rules.PACK, "orders", DOCUMENT, document_records, {
    "doc_author": ("privacy", "medium", [(
        any_of("author_info", "creator_info", "producer_info", "author_prop"), "'Author information found'",
        "'author_fields=' || " + shown(("Author", "author_info"), ("Creator", "creator_info"),
                                       ("Producer", "producer_info"), ("author", "author_prop")))]),
    "doc_software": ("information", "low", [(
        f"{_software} IS NOT NULL", f"'Document created with ' || {_software}", f"'software=' || {_software}")]),
    "doc_encrypted": ("security", "medium", [(
        "encrypted = 'true'", "'Document is encrypted/password-protected'", "'encryption=True'")]),
    "doc_restricted_permissions": ("security", "low", [(
        "no_print = 'false' OR no_copy = 'false'", "'Document has restricted permissions'",
        "'restricted_permissions=' || array_to_string([x for x in [CASE WHEN no_copy = 'false' THEN 'copy' END, "
        "CASE WHEN no_print = 'false' THEN 'printing' END] if x IS NOT NULL], ', ')")]),
    "doc_macros": ("security", "high", [("macros = 'true'", "'Document contains macros'", "'macros=True'")]),
    "doc_dates": ("information", "low", [(
        "(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in _given) + ") > 1",
        "'Document timestamp information'",
        "'dates=' || " + shown(("CreationDate", _given[0]), ("ModDate", _given[1]), ("created", _given[2])))]),
    "doc_hidden_content": ("security", "medium", [(
        f"n_pages >= {i} AND (id + {i}) % 3 = 0", "'Document contains optional/hidden content'", f"'page={i}'") for i in range(4)]),
    "doc_revisions": ("information", "low", [
        ("version <> ''", "'Document contains revision information'", "'revision_info=version: ' || version"),
        ("revision_prop <> ''", "'Document contains revision information'", "'revision_info=revision: ' || revision_prop")]),
    "doc_custom_properties": ("privacy", "low", [(
        "custom IS NOT NULL", "'Document contains custom properties'", "'custom_properties=Project: ' || custom")]),
    "doc_embedded_files": ("security", "high", [(
        "n_embedded > 0", "'Document contains embedded files'", "'embedded_files_count=' || n_embedded")]),
    "doc_javascript": ("security", "high", [(
        "javascript IN ('True', '1')", "'Document contains JavaScript'", "'javascript=True'")]),
})

# --- audio: from customer ----------------------------------------------------
k = "c_custkey"
AUDIO = {
    "id": k,
    "file_path": f"'audio/' || CAST({k} AS STRING) || '.mp3'",
    "artist": f"CASE WHEN {k} % 10 = 0 THEN '' WHEN {k} % 2 = 0 THEN c_name END",
    "composer": some(k, 7, "'<null>'"),
    "encoder": some(k, 3, "'LAME ' || c_mktsegment"),
    "geo": some(k, 11, "'12.5,' || CAST(c_nationkey AS STRING)"),
    "location": some(k, 13, "'<null>'"),
    "source_media": some(k, 5, "c_mktsegment"),
    "rights": some(k, 4, "'(c) ' || c_name"),
    "isrc": some(k, 6, "'ISRC' || CAST(c_nationkey AS STRING)"),
    "lyrics": some(k, 9, "'la la'"), "context": some(k, 17, "'live'"),
    "channels": f"{k} % 5",
    "sample_rate": f"CASE {k} % 4 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 2 THEN 48001 ELSE 96000 END",
    "bitrate": f"CASE {k} % 3 WHEN 0 THEN 320000 WHEN 1 THEN 320001 ELSE 128000 + {k} * 997 % 500000 END",
    "duration": f"CASE {k} % 5 WHEN 0 THEN '7200' WHEN 1 THEN '7200.5' WHEN 2 THEN 'long' ELSE CAST(60 + {k} * 7 % 9000 AS STRING) END",
    "n_pictures": f"CASE WHEN {k} % 3 = 0 THEN {k} % 4 END",
}
AUDIO_TAGS = {"artist": "artist", "Composer": "composer", "encoder": "encoder", "Geo": "geo", "LOCATION": "location",
              "sourcemedia": "source_media", "rights": "rights", "isrc": "isrc", "Lyrics": "lyrics", "Context": "context"}


def audio_records(df):
    pictures = F.transform(F.sequence(F.lit(1), F.col("n_pictures").cast("int")), lambda i: i.cast("string"))
    metadata = F.struct(
        section(AUDIO_TAGS).alias("tags"),
        section({n: n for n in ("channels", "sample_rate", "bitrate", "duration")}).alias("audio_properties"),
        F.when(F.col("n_pictures") > 0, pictures).alias("pictures"))
    return df.select("id", "file_path", F.lit("audio").alias("file_type"), as_json(metadata))


_seconds = "try_cast(duration AS DOUBLE)"
_audio = {
    "audio_personal": ("privacy", "medium", [(
        "artist <> '' OR encoder IS NOT NULL", "'Personal information found in audio tags'",
        "'personal_info=' || " + shown(("artist", "nullif(artist, '')"), ("encoder", "encoder")))]),
    "audio_geo": ("privacy", "high", [(
        any_of("geo", "location"), "'Geolocation information found in audio tags'",
        "'geo_info=' || " + shown(("Geo", "geo"), ("LOCATION", "location")))]),
    "audio_device": ("information", "low", [(
        any_of("encoder", "source_media"), "'Recording device/software information found'",
        "'device_info=' || " + shown(("encoder", "encoder"), ("sourcemedia", "source_media")))]),
    "audio_channels": ("information", "low", [(
        "channels > 2", "'Unusual audio channel configuration: ' || channels || ' channels'", "'channels=' || channels")]),
    "audio_sample_rate": ("information", "low", [(
        "sample_rate > 48000", "'High sample rate audio: ' || sample_rate || ' Hz'", "'sample_rate=' || sample_rate")]),
    "audio_bitrate": ("information", "low", [(
        "bitrate > 320000", "'High bitrate audio: ' || (bitrate // 1000) || ' kbps'", "'bitrate=' || bitrate")]),
    "audio_pictures": ("information", "low", [(
        "n_pictures > 0", "'Audio file contains embedded pictures/album art'", "'picture_count=' || n_pictures")]),
    "audio_copyright": ("information", "low", [(
        "rights IS NOT NULL", "'Copyright information found'", "'copyright_info=rights: ' || rights")]),
    "audio_commercial_ids": ("information", "low", [(
        "isrc IS NOT NULL", "'Commercial identifiers found'", "'commercial_info=isrc: ' || isrc")]),
    "audio_lyrics": ("information", "low", [(
        any_of("lyrics", "context"), "'Audio file contains embedded lyrics'", "'lyrics_present=True'")]),
    "audio_long": ("information", "low", [(
        f"{_seconds} > 7200",
        f"'Unusually long audio duration: ' || CAST(floor({_seconds} / 60) AS INT) || '.0 minutes'",
        f"'duration_seconds=' || CAST({_seconds} AS VARCHAR)")]),
}
_register(audio_rules.PACK, "customer", AUDIO, audio_records, _audio, readable="duration <> 'long'")

# --- video: from lineitem ----------------------------------------------------
k = "l_orderkey * 8 + l_linenumber"
VIDEO = {
    "id": k,
    "file_path": "'video/' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '.mp4'",
    "width": choose("l_partkey", ["640", "1920", "3840", "3839", "100", "0", "1919", "4000", "7680"]),
    "height": choose("l_suppkey", ["480", "1080", "2160", "1079", "400", "0", "2159", "1000"]),
    "bit_rate": choose("l_partkey", ["15000000", "15000001", "800000", "99500000", None]),
    "creation_time": some("l_suppkey", 3, "CAST(l_shipdate AS STRING)"),
    "title_date": some("l_partkey", 4, "'1999'"),
    "gps": some("l_partkey", 6, "'+52.5' || l_returnflag"),
    "com_location": some("l_suppkey", 7, "'<null>'"),
    "make": some("l_partkey", 8, "'Maker ' || l_linestatus"),
    "camera_model": some("l_suppkey", 9, "'C' || CAST(l_suppkey AS STRING)"),
    "encoder": some("l_partkey", 10, "'Lavf' || CAST(l_linenumber AS STRING)"),
    "n_audio": "CAST(l_quantity AS INT) % 4",
    "n_subtitles": "CAST(l_quantity AS INT) % 3",
    "n_chapters": "CAST(l_quantity AS INT) % 5",
    "codec": choose("l_suppkey", ["h264", "HEVC", "theora", "prores", "vp9", None, "MJPEG"]),
    "duration": choose("l_partkey", ["7200", "7200.5", "10000.25", "60", None, "7320", "0"]),
    "copyright": some("l_suppkey", 11, "'(c) ' || CAST(l_suppkey AS STRING)"),
    "license": some("l_partkey", 12, "'<null>'"),
}
VIDEO_PROPERTIES = {n: n for n in (
    "width", "height", "bit_rate", "creation_time", "title_date", "gps", "com_location", "make", "camera_model",
    "encoder", "codec", "duration", "copyright", "license")}


def video_records(df):
    def upto(column, item):
        return F.when(F.col(column) > 0, F.transform(F.sequence(F.lit(1), F.col(column)), item))

    tongue = lambda i: F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), F.pmod(F.col("id") * i, F.lit(3)).cast("int") + 1)
    audio = upto("n_audio", lambda i: F.struct(
        F.when(i % 2 == 1, F.create_map(F.lit("language"), tongue(i))).alias("tags"),
        F.when(i % 2 == 0, tongue(i)).alias("language")))
    subtitles = upto("n_subtitles", lambda i: F.struct(
        F.when(i == 1, "en").alias("language"), F.when(F.col("id") % 2 == 0, "srt").alias("codec")))
    metadata = F.struct(
        section(VIDEO_PROPERTIES).alias("video_properties"), audio.alias("audio_streams"),
        subtitles.alias("subtitle_streams"), upto("n_chapters", lambda i: i.cast("string")).alias("chapters"))
    return df.select("id", "file_path", F.lit("video").alias("file_type"), as_json(metadata))


_w, _h, _s = "CAST(width AS DOUBLE)", "CAST(height AS DOUBLE)", "CAST(duration AS DOUBLE)"
_big, _hd = f"({_w} >= 3840 AND {_h} >= 2160)", f"({_w} >= 1920 AND {_h} >= 1080)"
_spoken = ("list_sort(list_distinct([['en', 'fr', 'de'][CAST((id * i) % 3 AS INT) + 1] for i in range(1, n_audio + 1)]))")
_null = lambda c: f"replace({c}, '<null>', 'None')"
_register(video_rules.PACK, "lineitem", VIDEO, video_records, {
    "video_resolution": ("information", "low", [(
        f"{_big} OR {_hd}", f"CASE WHEN {_big} THEN '4K or higher resolution video' ELSE 'Full HD resolution video' END",
        "'resolution=' || width || 'x' || height")]),
    "video_aspect": ("information", "low", [(
        f"{_w} > 0 AND {_h} > 0 AND ({_w} / {_h} < 0.5 OR {_w} / {_h} > 3.0)",
        f"'Unusual aspect ratio: ' || printf('%.2f', {_w} / {_h})", f"'aspect_ratio=' || CAST({_w} / {_h} AS VARCHAR)")]),
    "video_bitrate": ("information", "low", [(
        "CAST(bit_rate AS BIGINT) > 15000000", "'High bitrate video'",
        "'bitrate=' || (CAST(bit_rate AS BIGINT) // 1000000) || ' Mbps'")]),
    "video_timestamps": ("information", "low", [
        (f"{c} IS NOT NULL", "'Video creation timestamp found'", f"'timestamp={c}: ' || {c}")
        for c in ("creation_time", "title_date")]),
    "video_geo": ("privacy", "high", [(
        any_of("gps", "com_location"), "'Geolocation information found in video metadata'",
        "'geo_info=' || " + shown(("gps", "gps"), ("com_location", "com_location")))]),
    "video_device": ("privacy", "medium", [(
        any_of("make", "camera_model"), "'Recording device information found'",
        "'device_info=' || " + shown(("make", "make"), ("camera_model", "camera_model")))]),
    "video_software": ("information", "low", [(
        "encoder IS NOT NULL", "'Video editing/encoding software information found'", "'software_info=encoder: ' || encoder")]),
    "video_multi_audio": ("information", "medium", [(
        "n_audio > 1", "'Multiple audio streams: ' || n_audio", "'audio_streams_count=' || n_audio")]),
    "video_languages": ("information", "low", [(
        f"n_audio > 1 AND len({_spoken}) > 1",
        f"'Multiple languages in audio streams: ' || array_to_string({_spoken}, ', ')",
        f"'languages=' || array_to_string({_spoken}, ', ')")]),
    "video_subtitles": ("information", "low", [(
        "n_subtitles > 0", "'Subtitle streams found: ' || n_subtitles",
        "'subtitles=' || array_to_string([CASE WHEN i = 1 THEN 'en: ' ELSE 'unknown: ' END || "
        "CASE WHEN id % 2 = 0 THEN 'srt' ELSE 'unknown' END for i in range(1, n_subtitles + 1)], ', ')")]),
    "video_codec": ("information", "low", [(
        "codec IN ('theora', 'prores', 'MJPEG')", "'Unusual video codec: ' || codec", "'codec=' || codec")]),
    "video_long": ("information", "low", [(
        f"{_s} > 7200", f"'Long video duration: ' || printf('%.1f', {_s} / 60) || ' minutes'",
        f"'duration_seconds=' || CAST({_s} AS VARCHAR)")]),
    "video_chapters": ("information", "low", [(
        "n_chapters > 0", "'Video contains ' || n_chapters || ' chapters/markers'", "'chapters_count=' || n_chapters")]),
    "video_copyright": ("information", "low", [
        (f"{c} IS NOT NULL", "'Copyright/license information found'", f"'{c}=' || {_null(c)}")
        for c in ("copyright", "license")]),
})

# --- executables: from orders ------------------------------------------------
k = "o_orderkey"
EXECUTABLE = {
    "id": k,
    "file_path": f"'bin/' || CAST({k} AS STRING) || '.exe'",
    "kind": choose(k, ["Windows PE", "Linux ELF", "macOS Mach-O", None, "Windows PE"]),
    "head_built": some(k, 4, "CAST(o_orderdate AS STRING)"),
    "pe_built": some(k, 3, f"CASE WHEN {k} % 2 = 0 THEN '' ELSE '2001-02-03' END"),
    "dotnet": f"{k} % 5 = 0",
    "own_sections": f"{k} % 3 <> 0",
    "name1": choose(k, [".text", "UPX0", ".data", "", ".rsrc"]),
    "name2": choose("o_custkey", [".rdata", "packed", ".x"]),
    "entropy1": f"CAST({k} % 81 AS DOUBLE) / 10",
    "entropy2": "CAST(o_custkey % 80 AS DOUBLE) / 10",
    "library": choose(k, ["libc", "libCrypto", None, "ScreenGrab"]),
    "dll": choose("o_custkey", ["kernel32", "HookLib", None, "user32", "spyware"]),
    "func1": choose(k, ["Open", "CryptEncrypt", "Read"]),
    "func2": choose("o_custkey", ["Close", "CapturePassword"]),
    "signed": f"CASE {k} % 4 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END",
    "verified": f"CASE {k} % 8 WHEN 2 THEN TRUE WHEN 3 THEN FALSE END",
    "has_signature": f"{k} % 7 <> 0",
    "resource1": choose(k, ["ICON", "BINARY", "HTML"]),
    "resource2": choose("o_custkey", ["RCDATA", "MENU", "BINARY", "UNKNOWN"]),
    "n_shared": f"{k} % 13",
    "rpath": some(k, 6, "'/opt/' || o_orderstatus"),
    "runpath": some("o_custkey", 5, "'/usr/' || o_orderstatus"),
    "n_arch": f"{k} % 3",
}


def executable_records(df):
    def pair(n):
        return F.struct(F.col(f"name{n}").alias("name"), F.col(f"entropy{n}").alias("entropy"))

    sections = F.array(pair(1), pair(2))

    def dynamic(kind, name=None, value=None):
        text = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("type"), (text if name is None else name).alias("name"),
                        (text if value is None else value).alias("value"))

    shared = F.when(F.col("n_shared") > 0, F.transform(
        F.sequence(F.lit(1), F.col("n_shared").cast("int")),
        lambda i: dynamic("shared_library", name=F.concat(F.lit("lib"), i.cast("string")))))
    none = F.array().cast("array<struct<type:string,name:string,value:string>>")
    paths = F.array_compact(F.array(
        F.when(F.col("rpath").isNotNull(), dynamic("DT_RPATH", value=F.col("rpath"))),
        F.when(F.col("runpath").isNotNull(), dynamic("DT_RUNPATH", value=F.col("runpath")))))
    headers = F.when(F.col("n_arch") > 0, F.transform(
        F.sequence(F.lit(1), F.col("n_arch").cast("int")),
        lambda i: F.struct(F.when(i == 1, "arm64").alias("cpu_type"))))
    metadata = F.struct(
        F.struct(F.col("kind").alias("type"), F.col("head_built").alias("compile_time"), sections.alias("sections"))
        .alias("file_headers"),
        F.when(F.col("own_sections"), F.slice(sections, 1, 1)).alias("sections"),
        F.array(F.struct(F.col("library").alias("name"))).alias("libraries"),
        F.array(F.struct(F.col("dll").alias("name"), F.array("func1", "func2").alias("imports"))).alias("imports"),
        F.when(F.col("has_signature"), F.struct("signed", "verified")).alias("signatures"),
        F.struct(F.col("pe_built").alias("compile_time"), F.col("dotnet").alias("is_dotnet")).alias("pe_info"),
        F.array("resource1", "resource2").alias("resources"),
        F.concat(F.coalesce(shared, none), paths).alias("dynamic"),
        F.struct(headers.alias("headers")).alias("macho_info"))
    return df.select("id", "file_path", F.lit("executable").alias("file_type"), as_json(metadata))


def _listed(*cases) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in cases)
    return f"[x for x in [{items}] if x IS NOT NULL]"


def _bad(c):
    return f"regexp_matches(lower({c}), {quoted('|'.join(K.SUSPICIOUS_IMPORT_TERMS))})"


_entropy = _listed(("entropy1 > 7.0", "name1"), ("entropy2 > 7.0 AND NOT own_sections", "name2"))
_odd = _listed(("name1 NOT LIKE '.%'", "name1"), ("name2 NOT LIKE '.%' AND NOT own_sections", "name2"))
_suspicious = _listed(
    (_bad("library"), "library"), (_bad("dll"), "dll"),
    (f"dll IS NOT NULL AND {_bad('func1')}", "dll || ':' || func1"), (f"dll IS NOT NULL AND {_bad('func2')}", "dll || ':' || func2"))
_resources = _listed(*[(f"{c} IN {in_list(K.SUSPICIOUS_RESOURCES)}", c) for c in ("resource1", "resource2")])
_paths = _listed(("rpath IS NOT NULL", "rpath"), ("runpath IS NOT NULL", "runpath"))
_built = "nullif(coalesce(head_built, pe_built), '')"
_ok, _signed = "coalesce(signed, FALSE) AND coalesce(verified, FALSE)", "coalesce(signed, FALSE)"
_join = lambda items: f"array_to_string({items}, ', ')"
_register(executable_rules.PACK, "orders", EXECUTABLE, executable_records, {
    "exe_type": ("information", "low", [("kind IS NOT NULL", "'Executable type: ' || kind", "'executable_type=' || kind")]),
    "exe_high_entropy": ("security", "high", [(
        f"len({_entropy}) > 0", "'High entropy sections detected (possible packing/encryption)'",
        f"'sections=' || {_join(_entropy)}")]),
    "exe_suspicious_imports": ("security", "high", [(
        f"len({_suspicious}) > 0", "'Potentially suspicious libraries or imports detected'",
        f"'suspicious_items=' || {_join(_suspicious)}")]),
    "exe_signature": ("security", f"CASE WHEN {_ok} THEN 'low' ELSE 'medium' END", [(
        "has_signature",
        f"CASE WHEN {_ok} THEN 'Executable is digitally signed and verified' WHEN {_signed} "
        "THEN 'Executable is signed but not verified' ELSE 'Executable is not digitally signed' END",
        f"'signature=' || CASE WHEN {_ok} THEN 'verified' WHEN {_signed} THEN 'unverified' ELSE 'unsigned' END")]),
    "exe_compile_time": ("information", "low", [(
        f"{_built} IS NOT NULL", f"'Compilation timestamp: ' || {_built}", f"'compile_time=' || {_built}")]),
    "exe_section_names": ("security", "medium", [(
        f"len({_odd}) > 0", "'Non-standard section names detected'", f"'sections=' || {_join(_odd)}")]),
    "exe_dotnet": ("information", "low", [("dotnet", "'.NET assembly detected'", "'dotnet=True'")]),
    "exe_resources": ("security", "medium", [(
        f"len({_resources}) > 0", "'Potentially suspicious resources embedded in executable'",
        f"'resources=' || {_join(_resources)}")]),
    "exe_shared_libs": ("information", "low", [(
        "n_shared > 0", "'Executable dynamically links to ' || n_shared || ' libraries'",
        f"'libraries=' || {_join('[' + repr('lib') + ' || i for i in range(1, n_shared + 1)]')}")]),
    "exe_rpath": ("security", "medium", [(
        f"len({_paths}) > 0", "'Executable uses custom library search paths (RPATH/RUNPATH)'",
        f"'paths=' || {_join(_paths)}")]),
    "exe_universal": ("information", "low", [(
        "n_arch > 1", "'Universal binary with ' || n_arch || ' architectures'", "'architectures=arm64, unknown'")]),
})
