"""Normalizers over producer output that is derived from part and orders."""

from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.operators import normalize as N
from metaudit.plans.base import choose, derive, derive_sql, register, section, table

k = "p_partkey"
PART = {
    "id": k, "name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size",
    "maybe": f"CASE WHEN {k} % 3 = 0 THEN p_brand END",
    "rate": choose(k, ["24000/1001", "30/1", "0/0", "25/0", "29.5", "abc", "1/2/3"]),
    "seconds": f"CAST({k} % 500 AS DOUBLE) / 4",
    "machine": f"CASE {k} % 5 WHEN 0 THEN 332 WHEN 1 THEN 512 WHEN 2 THEN 34404 ELSE {k} % 70000 END",
    "subsystem": f"{k} % 12", "stamp": f"{k} * 40000", "address": f"{k} * 4096",
    "filetype": f"{k} % 14", "version": f"({k} % 20) * 65536 + ({k} % 300) * 256 + p_size",
    "n_streams": f"{k} % 4",
}
SOURCE = derive_sql("part", PART)


def parts(spark, sf_dir):
    return derive(table(spark, sf_dir, "part"), PART)


def shown(column):
    """Entries of a map as sorted text."""
    return F.array_join(F.sort_array(F.transform(
        F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))), "|")


def shown_sql(**pairs) -> str:
    items = ", ".join(f"'{key}=' || {value}" for key, value in pairs.items())
    return f"array_to_string(list_sort([x for x in [{items}] if x IS NOT NULL]), '|')"


@register("exif_normalize", f"SELECT id, {shown_sql(Make='coalesce(maybe, brand)', Model='name', Image_Make='kind')} AS exif FROM ({SOURCE})")
def exif_normalize(spark, sf_dir):
    rows = parts(spark, sf_dir)
    merged = N.exif_normalize(section({"Make": "brand", "Model": "name"}), section({"Make": "maybe", "Image Make": "kind"}))
    return rows.select("id", shown(merged).alias("exif"))


@register("pdf_info_normalize", f"SELECT id, {shown_sql(Author='maybe', Title='name')} AS info, size AS n_pages FROM ({SOURCE})")
def pdf_info_normalize(spark, sf_dir):
    pages = F.sequence(F.lit(1), F.col("size"))
    return parts(spark, sf_dir).select(
        "id", shown(N.pdf_info_normalize(section({"/Author": "maybe", "//Title": "name"}))).alias("info"),
        F.size(pages).alias("n_pages"))


@register("audio_tag_normalize",
          f"SELECT id, {shown_sql(TIT2='name', title='name', TPE1='maybe', artist='coalesce(maybe, brand)', other='kind', tmpo='size', bpm='size')} "
          f"AS tags FROM ({SOURCE})")
def audio_tag_normalize(spark, sf_dir):
    tags = section({"TIT2": "name", "TPE1": "maybe", "artist": "brand", "other": "kind", "tmpo": "size"})
    return parts(spark, sf_dir).select("id", shown(N.audio_tag_normalize(tags)).alias("tags"))


@register("frame_rate",
          "SELECT id, CASE rate WHEN '24000/1001' THEN 24000.0::DOUBLE / 1001 WHEN '30/1' THEN 30.0 WHEN '29.5' THEN 29.5 ELSE 0.0 END "
          f"::DOUBLE AS fps FROM ({SOURCE})")
def frame_rate(spark, sf_dir):
    return parts(spark, sf_dir).select("id", N.frame_rate(F.col("rate")).alias("fps"))


_PROBE_PROPERTIES = shown_sql(
    format="kind", duration="CAST(seconds AS VARCHAR)", size="CAST(size AS VARCHAR)", bit_rate="'0'", title="maybe",
    codec="CASE WHEN n_streams > 0 THEN 'h264' END", width="CASE WHEN n_streams > 0 THEN '640' END",
    height="CASE WHEN n_streams > 0 THEN '0' END", fps="CASE WHEN n_streams > 0 THEN '25.0' END",
    pix_fmt="CASE WHEN n_streams > 0 THEN 'unknown' END", video_handler="CASE WHEN n_streams > 0 THEN brand END")


@register("probe_json_normalize",
          f"SELECT id, {_PROBE_PROPERTIES} AS properties, "
          "CASE WHEN n_streams > 1 THEN 'aac/48000/2/unknown/' || name ELSE '' END AS audio, "
          "CASE WHEN n_streams > 2 THEN 'srt/unknown,ass/' || brand ELSE '' END AS subtitles "
          f"FROM ({SOURCE})")
def probe_json_normalize(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("probe", F.to_json(F.struct(
        F.struct(F.col("kind").alias("format_name"), F.col("seconds").cast("string").alias("duration"),
                 F.col("size").cast("string").alias("size"), F.struct(F.col("maybe").alias("TITLE")).alias("tags")).alias("format"),
        F.expr("""slice(array(
            named_struct('codec_type', 'video', 'codec_name', 'h264', 'width', 640, 'r_frame_rate', '25/1', 'sample_rate', null,
                         'channels', null, 'tags', map('HANDLER', brand)),
            named_struct('codec_type', 'audio', 'codec_name', 'aac', 'width', null, 'r_frame_rate', null, 'sample_rate', '48000',
                         'channels', 2, 'tags', map('Language', name)),
            named_struct('codec_type', 'subtitle', 'codec_name', 'srt', 'width', null, 'r_frame_rate', null, 'sample_rate', null,
                         'channels', null, 'tags', null),
            named_struct('codec_type', 'subtitle', 'codec_name', 'ass', 'width', null, 'r_frame_rate', null, 'sample_rate', null,
                         'channels', null, 'tags', map('language', brand))), 1, CASE WHEN n_streams = 3 THEN 4 ELSE CAST(n_streams AS INT) END)""")
        .alias("streams"))))
    done = rows.select("id", N.probe_json_normalize(F.col("probe")).alias("v"))
    audio = F.transform("v.audio_streams", lambda s: F.concat_ws(
        "/", s["codec"], s["sample_rate"], s["channels"].cast("string"), s["bit_rate"], s["tags"]["language"]))
    subtitles = F.transform("v.subtitle_streams", lambda s: F.concat_ws("/", s["codec"], s["language"]))
    return done.select("id", shown(F.col("v.video_properties")).alias("properties"),
                       F.array_join(audio, ",").alias("audio"), F.array_join(subtitles, ",").alias("subtitles"))


_MEDIA_PROPERTIES = shown_sql(
    format="kind", duration="CAST(seconds AS VARCHAR)", size="CAST(size AS VARCHAR)", bit_rate="'0'", title="maybe",
    codec="'AVC'", width="'1920'", height="'0'", fps="'23.976'", bit_depth="'unknown'", scan_type="brand")


@register("mediainfo_json_normalize",
          f"SELECT id, {_MEDIA_PROPERTIES} AS properties, "
          f"{shown_sql(codec=chr(39) + 'AAC' + chr(39), sample_rate=chr(39) + '44100' + chr(39), channels='CAST(size AS VARCHAR)', bit_rate=chr(39) + '0' + chr(39), language='name')} AS audio, "
          f"'unknown/' || brand || '/unknown' AS subtitles FROM ({SOURCE})")
def mediainfo_json_normalize(spark, sf_dir):
    def track(**columns):
        return F.map_from_entries(F.array_compact(F.array(*[
            F.when(c.isNotNull(), F.struct(F.lit(n.replace("at_", "@")).alias("key"), c.cast("string").alias("value")))
            for n, c in columns.items()])))

    tracks = F.array(
        track(at_type=F.lit("General"), Format=F.col("kind"), Duration=F.col("seconds"), FileSize=F.col("size"), Title=F.col("maybe")),
        track(at_type=F.lit("Video"), Format=F.lit("AVC"), Width=F.lit(1920), FrameRate=F.lit("23.976"), ScanType=F.col("brand")),
        track(at_type=F.lit("Audio"), Format=F.lit("AAC"), SamplingRate=F.lit(44100), Channels=F.col("size"), Language=F.col("name")),
        track(at_type=F.lit("Text"), Language=F.col("brand")), track(at_type=F.lit("Menu"), Format=F.lit("x")))
    rows = parts(spark, sf_dir).withColumn("probe", F.to_json(F.struct(F.struct(tracks.alias("track")).alias("media"))))
    done = rows.select("id", N.mediainfo_json_normalize(F.col("probe")).alias("v"))
    subtitles = F.transform("v.subtitle_streams", lambda s: F.concat_ws("/", s["codec"], s["language"], s["title"]))
    return done.select("id", shown(F.col("v.video_properties")).alias("properties"),
                       shown(F.get("v.audio_streams", F.lit(0))).alias("audio"), F.array_join(subtitles, ",").alias("subtitles"))


def _names_sql(column: str, names: dict, fallback: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in names.items()) + f" ELSE {fallback} END"


@register("pe_header_decode",
          f"SELECT id, {_names_sql('machine', K.PE_MACHINES, chr(39) + 'Unknown (' + chr(39) + ' || printf(' + chr(39) + '%04X' + chr(39) + ', machine) || ' + chr(39) + ')' + chr(39))} AS machine, "
          f"{_names_sql('subsystem', K.PE_SUBSYSTEMS, chr(39) + 'Unknown (' + chr(39) + ' || subsystem || ' + chr(39) + ')' + chr(39))} AS subsystem, "
          "strftime(make_timestamp(stamp * 1000000), '%Y-%m-%dT%H:%M:%S') AS compile_time, "
          "printf('0x%08X', address) AS image_base, printf('0x%08X', id) AS entry_point, "
          f"size AS n_imports, size AS n_exports FROM ({SOURCE})")
def pe_header_decode(spark, sf_dir):
    functions = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: i.cast("string"))
    header = N.pe_header_decode(F.col("machine"), F.col("subsystem"), F.col("stamp"), F.col("address"), F.col("id"))
    libraries = F.array(F.struct(F.col("name"), functions.alias("imports")))
    return parts(spark, sf_dir).select(
        "id", header.alias("h"), F.size(F.get(N.pe_imports(libraries), F.lit(0))["imports"]).alias("n_imports"),
        F.size(functions).alias("n_exports")).select("id", "h.*", "n_imports", "n_exports")


@register("macho_header_decode",
          f"SELECT id, {_names_sql('filetype', K.MACHO_FILE_TYPES, chr(39) + 'UNKNOWN' + chr(39))} AS file_type_name, "
          "(version >> 16) || '.' || ((version >> 8) & 255) || '.' || (version & 255) AS min_os_version "
          f"FROM ({SOURCE})")
def macho_header_decode(spark, sf_dir):
    return parts(spark, sf_dir).select(
        "id", N.macho_header_decode(F.col("filetype"), F.col("version")).alias("h")).select("id", "h.*")


@register("elf_dynamic_rollup",
          "SELECT id, 'shared_library:lib' || name || coalesce(',DT_RUNPATH:/opt/' || maybe, '') AS dynamic, "
          f"size - size // 4 AS n_symbols FROM ({SOURCE})")
def elf_dynamic_rollup(spark, sf_dir):
    tags = F.array_compact(F.array(
        F.struct(F.lit("DT_NEEDED").alias("tag"), F.concat(F.lit("lib"), "name").alias("value")),
        F.struct(F.lit("DT_SONAME").alias("tag"), F.col("brand").alias("value")),
        F.when(F.col("maybe").isNotNull(), F.struct(
            F.lit("DT_RUNPATH").alias("tag"), F.concat(F.lit("/opt/"), "maybe").alias("value")))))
    symbols = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.when(i % 4 == 0, "").otherwise(i.cast("string")))
    text = F.transform(N.elf_dynamic_rollup(tags), lambda d: F.concat(d["type"], F.lit(":"), F.coalesce(d["name"], d["value"])))
    return parts(spark, sf_dir).select(
        "id", F.array_join(text, ",").alias("dynamic"), F.size(N.elf_symbols(symbols)).alias("n_symbols"))


@register("ooxml_core_props", f"SELECT id, {shown_sql(creator='maybe', title='name', modified=chr(39) + '2001-01-0' + chr(39) + ' || CAST(size % 9 + 1 AS VARCHAR)')} AS properties FROM ({SOURCE})")
def ooxml_core_props(spark, sf_dir):
    xml = F.concat(
        F.lit('<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" '
              'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">'),
        F.lit("<dc:creator>"), F.coalesce("maybe", F.lit("")), F.lit("</dc:creator><dc:title>"), "name",
        F.lit("</dc:title><dcterms:modified>2001-01-0"), (F.col("size") % 9 + 1).cast("string"),
        F.lit("</dcterms:modified></cp:coreProperties>"))
    return parts(spark, sf_dir).select("id", shown(N.ooxml_core_props(xml)).alias("properties"))
