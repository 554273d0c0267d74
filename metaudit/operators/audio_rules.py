"""Rules over audio tags and properties."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.findings import finding, fires, listing
from metaudit.functions.numbers import fixed, number, whole
from metaudit.operators.rulebook import Pack

PACK = Pack("audio", "audio")
NUMERIC = ("channels", "sample_rate", "bitrate", "duration")


@PACK.fails_when
def audio_unreadable(rec) -> Column:
    """Name and value of the first property that should be a number and is not."""
    props = rec.section("audio_properties")
    return F.coalesce(*[
        F.when(props[n].isNotNull() & number(props[n]).isNull(), F.concat(F.lit(n + ": "), props[n])) for n in NUMERIC
    ])


@PACK.rule
def audio_personal(rec) -> Column:
    found = F.map_filter(rec.keys_like("tags", K.AUDIO_PERSONAL_TERMS), lambda k, v: F.coalesce(v, F.lit("")) != "")
    return listing("audio_personal", "privacy", "medium", "Personal information found in audio tags",
                   "personal_info", found)


@PACK.rule
def audio_geo(rec) -> Column:
    return listing("audio_geo", "privacy", "high", "Geolocation information found in audio tags",
                   "geo_info", rec.keys_like("tags", K.AUDIO_GEO_TERMS))


@PACK.rule
def audio_device(rec) -> Column:
    return listing("audio_device", "information", "low", "Recording device/software information found",
                   "device_info", rec.keys_like("tags", K.AUDIO_DEVICE_TERMS))


@PACK.rule
def audio_channels(rec) -> Column:
    channels = number(rec.section("audio_properties")["channels"])
    return fires(channels > 2, finding(
        "audio_channels", "information", "low",
        F.concat(F.lit("Unusual audio channel configuration: "), whole(channels), F.lit(" channels")),
        channels=whole(channels)))


@PACK.rule
def audio_sample_rate(rec) -> Column:
    rate = number(rec.section("audio_properties")["sample_rate"])
    return fires(rate > 48000, finding(
        "audio_sample_rate", "information", "low",
        F.concat(F.lit("High sample rate audio: "), whole(rate), F.lit(" Hz")), sample_rate=whole(rate)))


@PACK.rule
def audio_bitrate(rec) -> Column:
    rate = number(rec.section("audio_properties")["bitrate"])
    return fires(rate > 320000, finding(
        "audio_bitrate", "information", "low",
        F.concat(F.lit("High bitrate audio: "), F.floor(rate / 1000).cast("string"), F.lit(" kbps")),
        bitrate=whole(rate)))


@PACK.rule
def audio_pictures(rec) -> Column:
    pictures = rec.section("pictures")
    return fires(F.size(pictures) > 0, finding(
        "audio_pictures", "information", "low", "Audio file contains embedded pictures/album art",
        picture_count=F.size(pictures)))


@PACK.rule
def audio_copyright(rec) -> Column:
    return listing("audio_copyright", "information", "low", "Copyright information found",
                   "copyright_info", rec.keys_like("tags", K.AUDIO_COPYRIGHT_TERMS))


@PACK.rule
def audio_commercial_ids(rec) -> Column:
    return listing("audio_commercial_ids", "information", "low", "Commercial identifiers found",
                   "commercial_info", rec.keys_like("tags", K.AUDIO_ID_TERMS))


@PACK.rule
def audio_lyrics(rec) -> Column:
    return fires(rec.keys_like("tags", K.AUDIO_LYRIC_TERMS).isNotNull(), finding(
        "audio_lyrics", "information", "low", "Audio file contains embedded lyrics", lyrics_present=True))


@PACK.rule
def audio_long(rec) -> Column:
    seconds = number(rec.section("audio_properties")["duration"])
    return fires(seconds > 7200, finding(
        "audio_long", "information", "low",
        F.concat(F.lit("Unusually long audio duration: "), fixed(F.floor(seconds / 60).cast("double"), 1),
                 F.lit(" minutes")),
        duration_seconds=seconds))
