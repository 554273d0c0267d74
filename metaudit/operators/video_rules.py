"""Rules over video properties and streams."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.findings import Items, contains_any, finding, fires, fires_on, listing
from metaudit.functions.numbers import fixed, number, whole
from metaudit.operators.rulebook import Pack

PACK = Pack("video", "video")
NUMERIC = ("width", "height", "bit_rate", "duration")


@PACK.fails_when
def video_unreadable(rec) -> Column:
    """Name and value of the first property that should be a number and is not."""
    props = rec.section("video_properties")
    return F.coalesce(*[
        F.when(props[n].isNotNull() & number(props[n]).isNull(), F.concat(F.lit(n + ": "), props[n])) for n in NUMERIC
    ])


def _size(rec):
    props = rec.section("video_properties")
    return number(props["width"]), number(props["height"])


@PACK.rule
def video_resolution(rec) -> Column:
    width, height = _size(rec)
    name = F.when((width >= 3840) & (height >= 2160), "4K or higher resolution video") \
        .when((width >= 1920) & (height >= 1080), "Full HD resolution video")
    return fires(name.isNotNull(), finding(
        "video_resolution", "information", "low", name,
        resolution=F.concat(whole(width), F.lit("x"), whole(height))))


@PACK.rule
def video_aspect(rec) -> Column:
    width, height = _size(rec)
    ratio = F.when((width > 0) & (height > 0), F.try_divide(width, height))
    return fires_on(ratio, lambda r: (r < 0.5) | (r > 3.0), lambda r: finding(
        "video_aspect", "information", "low",
        F.concat(F.lit("Unusual aspect ratio: "), fixed(r, 2)), aspect_ratio=r))


@PACK.rule
def video_bitrate(rec) -> Column:
    rate = number(rec.section("video_properties")["bit_rate"])
    return fires(rate > 15000000, finding(
        "video_bitrate", "information", "low", "High bitrate video",
        bitrate=F.concat(F.floor(rate / 1000000).cast("string"), F.lit(" Mbps"))))


def _per_key(entries: Column, build) -> Column:
    """One finding per map entry, in key order."""
    return F.transform(F.sort_array(F.map_entries(entries)), build)


@PACK.rule
def video_timestamps(rec) -> Column:
    return _per_key(rec.keys_like("video_properties", K.VIDEO_DATE_TERMS), lambda e: finding(
        "video_timestamps", "information", "low", "Video creation timestamp found",
        timestamp=F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))))


def _properties(rule, type_, severity, description, key, terms):
    def build(rec) -> Column:
        return listing(rule, type_, severity, description, key, rec.keys_like("video_properties", terms))

    build.__name__ = rule
    return PACK.rule(build)


video_geo = _properties(
    "video_geo", "privacy", "high", "Geolocation information found in video metadata", "geo_info", K.VIDEO_GEO_TERMS)
video_device = _properties(
    "video_device", "privacy", "medium", "Recording device information found", "device_info", K.VIDEO_DEVICE_TERMS)
video_software = _properties(
    "video_software", "information", "low", "Video editing/encoding software information found",
    "software_info", K.VIDEO_SOFTWARE_TERMS)


@PACK.rule
def video_multi_audio(rec) -> Column:
    streams = F.size(rec.section("audio_streams"))
    return fires(streams > 1, finding(
        "video_multi_audio", "information", "medium",
        F.concat(F.lit("Multiple audio streams: "), streams), audio_streams_count=streams))


@PACK.rule
def video_languages(rec) -> Column:
    streams = rec.section("audio_streams")
    spoken = F.transform(streams, lambda s: F.when(
        F.map_contains_key(s["tags"], "language"), s["tags"]["language"]).otherwise(s["language"]))
    languages = F.when(F.size(streams) > 1, F.sort_array(F.array_distinct(F.array_compact(spoken))))
    return fires_on(languages, lambda found: F.size(found) > 1, lambda found: finding(
        "video_languages", "information", "low",
        F.concat(F.lit("Multiple languages in audio streams: "), F.array_join(found, ", ")), languages=Items(found)))


@PACK.rule
def video_subtitles(rec) -> Column:
    streams = rec.section("subtitle_streams")
    listed = F.transform(streams, lambda s: F.concat(
        F.coalesce(s["language"], F.lit("unknown")), F.lit(": "), F.coalesce(s["codec"], F.lit("unknown"))))
    return fires(F.size(streams) > 0, finding(
        "video_subtitles", "information", "low",
        F.concat(F.lit("Subtitle streams found: "), F.size(streams)), subtitles=Items(listed)))


@PACK.rule
def video_codec(rec) -> Column:
    codec = rec.section("video_properties")["codec"]
    return fires(~contains_any(codec, K.COMMON_CODECS), finding(
        "video_codec", "information", "low", F.concat(F.lit("Unusual video codec: "), codec), codec=codec))


@PACK.rule
def video_long(rec) -> Column:
    seconds = number(rec.section("video_properties")["duration"])
    return fires(seconds > 7200, finding(
        "video_long", "information", "low",
        F.concat(F.lit("Long video duration: "), fixed(seconds / 60, 1), F.lit(" minutes")),
        duration_seconds=seconds))


@PACK.rule
def video_chapters(rec) -> Column:
    chapters = F.size(rec.section("chapters"))
    return fires(chapters > 0, finding(
        "video_chapters", "information", "low",
        F.concat(F.lit("Video contains "), chapters, F.lit(" chapters/markers")), chapters_count=chapters))


@PACK.rule
def video_copyright(rec) -> Column:
    return _per_key(rec.keys_like("video_properties", K.VIDEO_COPYRIGHT_TERMS), lambda e: F.struct(
        F.lit("video_copyright").alias("rule"), F.lit("information").alias("type"), F.lit("low").alias("severity"),
        F.lit("Copyright/license information found").alias("description"),
        F.create_map(e["key"], F.array(e["value"])).alias("evidence")))
