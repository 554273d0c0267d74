"""Bring producer output (tag maps, probe JSON, header codes) into metadata sections."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.findings import let, override
from metaudit.functions.numbers import number, whole
from metaudit.operators.classify import lookup

TEXT_MAP = "map<string,string>"


def _empty_map() -> Column:
    return F.create_map().cast(TEXT_MAP)


def _rebuild(pairs: Column) -> Column:
    """Map from (key, value) structs; the last of equal keys wins."""
    def last_of(both):
        return F.map_from_entries(F.filter(both["pairs"], lambda p, i: ~F.array_contains(
            F.slice(both["keys"], i + 2, F.size(both["keys"])), p["key"])))

    with_keys = let(pairs, lambda ps: F.struct(
        ps.alias("pairs"), F.transform(ps, lambda p: p["key"]).alias("keys")))
    return let(with_keys, last_of)


def _rename(section: Column, name) -> Column:
    return _rebuild(F.transform(
        F.map_entries(section), lambda e: F.struct(name(e["key"]).alias("key"), e["value"].alias("value"))))


def exif_normalize(exif: Column, second: Column) -> Column:
    """Second tag map over the first; spaces in its tag names become underscores."""
    return override(exif, _rename(second, lambda k: F.replace(k, F.lit(" "), F.lit("_"))))


def pdf_info_normalize(info: Column) -> Column:
    """Document info without the leading slashes of its keys."""
    return _rename(info, lambda k: F.regexp_replace(k, r"\A/+", ""))


def audio_tag_normalize(tags: Column) -> Column:
    """Add friendly names for known ID3 frames and MP4 atoms; the raw tags stay."""
    names = {**K.ID3_FRAMES, **K.MP4_ATOMS}
    known = F.map_filter(tags, lambda k, v: k.isin(list(names)))
    return override(tags, _rename(known, lambda k: lookup(names, k)))


def audio_cover_format(cover: Column) -> Column:
    """Format and size of an MP4 cover atom, from its bytes."""
    return F.struct(
        F.lit("cover").alias("type"), F.length(cover).alias("size"),
        F.when(F.hex(F.substring(cover, 1, 3)) == "FFD8FF", "jpeg").otherwise("png").alias("format"))


def frame_rate(value: Column) -> Column:
    """``a/b`` or a plain number as frames per second; 0 when unreadable."""
    parts = F.split(value, "/")
    top, bottom = F.get(parts, F.lit(0)).try_cast("bigint"), F.get(parts, F.lit(1)).try_cast("bigint")
    ratio = F.when(F.size(parts) == 2, F.try_divide(top.cast("double"), bottom.cast("double")))
    return F.coalesce(ratio, F.when(F.size(parts) == 1, number(value)), F.lit(0.0))


PROBE_DDL = """
    format STRUCT<format_name: STRING, duration: STRING, size: STRING, bit_rate: STRING, tags: MAP<STRING,STRING>>,
    streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: BIGINT, height: BIGINT, r_frame_rate: STRING,
        pix_fmt: STRING, sample_rate: STRING, channels: BIGINT, bit_rate: STRING, tags: MAP<STRING,STRING>>>
"""


def _or_unknown(value: Column) -> Column:
    return F.coalesce(value, F.lit("unknown"))


def _lower_keys(tags: Column, prefix: str = "") -> Column:
    return F.coalesce(_rename(tags, lambda k: F.concat(F.lit(prefix), F.lower(k))), _empty_map())


def _text_map(**values) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _number_text(value: Column) -> Column:
    return F.coalesce(whole(number(value)), F.lit("0"))


def probe_json_normalize(json: Column) -> Column:
    """ffprobe JSON -> video_properties, audio_streams, subtitle_streams."""
    return let(F.from_json(json, PROBE_DDL), _probe_sections)


def _probe_sections(probe: Column) -> Column:
    container, streams = probe["format"], F.coalesce(probe["streams"], F.array().cast(
        "array<struct<codec_type:string,codec_name:string,width:bigint,height:bigint,r_frame_rate:string,"
        "pix_fmt:string,sample_rate:string,channels:bigint,bit_rate:string,tags:map<string,string>>>"))
    general = F.when(container.isNotNull(), override(
        _text_map(format=_or_unknown(container["format_name"]), duration=F.coalesce(number(container["duration"]), F.lit(0.0)),
                  size=_number_text(container["size"]), bit_rate=_number_text(container["bit_rate"])),
        _lower_keys(container["tags"]))).otherwise(_empty_map())

    def of_type(kind):
        return F.filter(streams, lambda s: _or_unknown(s["codec_type"]) == kind)

    def video_map(s):
        return override(
            _text_map(codec=_or_unknown(s["codec_name"]), width=F.coalesce(s["width"], F.lit(0)),
                      height=F.coalesce(s["height"], F.lit(0)),
                      fps=frame_rate(F.coalesce(s["r_frame_rate"], F.lit("0/1"))), pix_fmt=_or_unknown(s["pix_fmt"])),
            _lower_keys(s["tags"], "video_"))

    properties = F.aggregate(of_type("video"), general, lambda acc, s: override(acc, video_map(s)))
    audio = F.transform(of_type("audio"), lambda s: F.struct(
        _or_unknown(s["codec_name"]).alias("codec"), _or_unknown(s["sample_rate"]).alias("sample_rate"),
        F.coalesce(s["channels"], F.lit(0)).alias("channels"), _or_unknown(s["bit_rate"]).alias("bit_rate"),
        F.when(s["tags"].isNotNull(), _lower_keys(s["tags"])).alias("tags")))
    subtitles = F.transform(of_type("subtitle"), lambda s: F.struct(
        _or_unknown(s["codec_name"]).alias("codec"),
        F.coalesce(s["tags"]["language"], F.lit("unknown")).alias("language")))
    return F.struct(properties.alias("video_properties"), audio.alias("audio_streams"),
                    subtitles.alias("subtitle_streams"))


# Track keys that are copied when present (fixed values).
GENERAL_KEYS = ["Title", "Movie", "Encoded_Date", "Tagged_Date", "Encoded_Application"]
AUDIO_KEYS = ["Language", "Title", "Default", "Forced"]


def mediainfo_json_normalize(json: Column) -> Column:
    """mediainfo JSON -> the same three sections."""
    return let(F.from_json(json, "media STRUCT<track: ARRAY<MAP<STRING,STRING>>>"), _mediainfo_sections)


def _mediainfo_sections(parsed: Column) -> Column:
    tracks = F.coalesce(parsed["media"]["track"], F.array().cast("array<map<string,string>>"))

    def of_type(kind):
        return F.filter(tracks, lambda t: F.lower(F.coalesce(t["@type"], F.lit(""))) == kind)

    def copied(track, keys):
        return _rename(F.map_filter(track, lambda k, v: k.isin(keys)), F.lower)

    def general_map(t):
        return override(
            _text_map(format=_or_unknown(t["Format"]), duration=F.coalesce(number(t["Duration"]), F.lit(0.0)),
                      size=_number_text(t["FileSize"]), bit_rate=_number_text(t["OverallBitRate"])),
            copied(t, GENERAL_KEYS))

    def video_map(t):
        return _text_map(
            codec=_or_unknown(t["Format"]), width=_number_text(t["Width"]), height=_number_text(t["Height"]),
            fps=F.coalesce(number(t["FrameRate"]), F.lit(0.0)), bit_depth=_or_unknown(t["BitDepth"]),
            scan_type=_or_unknown(t["ScanType"]))

    def property_map(t):
        return F.when(F.lower(t["@type"]) == "general", general_map(t)).otherwise(video_map(t))

    describing = F.filter(tracks, lambda t: F.lower(F.coalesce(t["@type"], F.lit(""))).isin("general", "video"))
    properties = F.aggregate(describing, _empty_map(), lambda acc, t: override(acc, property_map(t)))
    audio = F.transform(of_type("audio"), lambda t: override(
        _text_map(codec=_or_unknown(t["Format"]), sample_rate=_number_text(t["SamplingRate"]),
                  channels=_number_text(t["Channels"]), bit_rate=_number_text(t["BitRate"])),
        copied(t, AUDIO_KEYS)))
    subtitles = F.transform(of_type("text"), lambda t: F.struct(
        _or_unknown(t["Format"]).alias("codec"), _or_unknown(t["Language"]).alias("language"),
        _or_unknown(t["Title"]).alias("title")))
    return F.struct(properties.alias("video_properties"), audio.alias("audio_streams"),
                    subtitles.alias("subtitle_streams"))


def pe_header_decode(machine: Column, subsystem: Column, timestamp: Column, image_base: Column,
                     entry_point: Column) -> Column:
    """Readable PE header: names for codes, ISO build time (UTC session), hex addresses."""
    def address(value):
        return F.format_string("0x%08X", value.cast("bigint"))

    return F.struct(
        F.coalesce(lookup(K.PE_MACHINES, machine.cast("int")),
                   F.format_string("Unknown (%04X)", machine.cast("int"))).alias("machine"),
        F.coalesce(lookup(K.PE_SUBSYSTEMS, subsystem.cast("int")),
                   F.format_string("Unknown (%d)", subsystem.cast("int"))).alias("subsystem"),
        F.from_unixtime(timestamp.cast("bigint"), "yyyy-MM-dd'T'HH:mm:ss").alias("compile_time"),
        address(image_base).alias("image_base"),
        address(entry_point).alias("entry_point"))


def pe_imports(imports: Column) -> Column:
    """All functions per imported library; one without a name is Unknown."""
    return F.transform(imports, lambda d: F.struct(
        F.coalesce(d["name"], F.lit("Unknown")).alias("name"), d["imports"].alias("imports")))


def macho_header_decode(file_type: Column, version: Column) -> Column:
    packed = version.cast("int")
    return F.struct(
        F.coalesce(lookup(K.MACHO_FILE_TYPES, file_type.cast("int")), F.lit("UNKNOWN")).alias("file_type_name"),
        F.concat_ws(".", F.shiftright(packed, 16).cast("string"),
                    F.shiftright(packed, 8).bitwiseAND(F.lit(255)).cast("string"),
                    packed.bitwiseAND(F.lit(255)).cast("string")).alias("min_os_version"))


def elf_dynamic_rollup(tags: Column) -> Column:
    """Dynamic entries (tag, value) -> shared libraries and library search paths."""
    kept = F.filter(tags, lambda t: t["tag"].isin("DT_NEEDED", "DT_RPATH", "DT_RUNPATH"))

    def entry(t):
        needed = t["tag"] == "DT_NEEDED"
        return F.struct(
            F.when(needed, "shared_library").otherwise(t["tag"]).alias("type"),
            F.when(needed, t["value"]).alias("name"), F.when(~needed, t["value"]).alias("value"))

    return F.transform(kept, entry)


def elf_symbols(symbols: Column) -> Column:
    """Named symbols."""
    return F.filter(symbols, lambda s: F.coalesce(s, F.lit("")) != "")


NO_XML = "\uffff"  # no XML text can hold it


def ooxml_core_props(core_xml: Column) -> Column:
    """creator, title, created and modified of a core-properties part; absent or empty ones are left out."""
    names = ["creator", "title", "created", "modified"]
    # the text is parsed once, for all properties
    each = f", '{NO_XML}', ".join(f'//*[local-name()="{n}"]' for n in names)
    found = F.split(F.xpath_string(core_xml, F.lit(f"concat({each})")), NO_XML, -1)

    def present(values):
        pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.get(values, F.lit(i)).alias("value")) for i, n in enumerate(names)])
        return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))

    return let(found, present)
