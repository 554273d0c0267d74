"""Rules over image metadata (exif, iptc, xmp, basic sections)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.findings import contains_any, finding, fires, fires_on, keep_keys, listing, override
from metaudit.operators.rulebook import Pack

PACK = Pack("image", "image")


@PACK.rule
def image_gps(rec) -> Column:
    exif = rec.section("exif")
    present = F.filter(F.array(*map(F.lit, K.GPS_KEYS)), lambda k: F.map_contains_key(exif, k))
    return F.transform(present, lambda k: finding(
        "image_gps", "privacy", "high", "GPS location data found in EXIF metadata", source="EXIF", field=k))


@PACK.rule
def image_device(rec) -> Column:
    found = override(*[keep_keys(rec.section(s), K.IMAGE_DEVICE_KEYS) for s in ("exif", "basic")])
    return listing("image_device", "privacy", "medium", "Device/software information found", "device_info", found)


@PACK.rule
def image_dates(rec) -> Column:
    found = override(*[keep_keys(rec.section(s), K.IMAGE_DATE_KEYS) for s in ("exif", "iptc")])
    return listing("image_dates", "information", "low",
                   "Image creation/modification timestamps found", "dates", found)


@PACK.rule
def image_contact(rec) -> Column:
    found = keep_keys(rec.section("iptc"), K.IPTC_CONTACT_KEYS)
    return listing("image_contact", "privacy", "medium",
                   "Creator/contact information found in IPTC data", "contact_info", found)


@PACK.rule
def image_edited(rec) -> Column:
    def first_editor(section):
        # presence decides, so a present-but-null value still stops the search
        return F.filter(F.array(*map(F.lit, K.EDITOR_KEYS)), lambda k: F.map_contains_key(section, k))

    def software(section):
        return F.try_element_at(section, F.get(first_editor(section), F.lit(0)))

    exif, xmp = rec.section("exif"), rec.section("xmp")
    used = F.when(F.size(first_editor(xmp)) > 0, software(xmp)).otherwise(software(exif))
    return fires_on(used, lambda s: contains_any(s, K.EDITOR_NAMES), lambda s: finding(
        "image_edited", "authenticity", "medium", F.concat(F.lit("Image edited with "), s), software=s))


@PACK.rule
def image_xmp_history(rec) -> Column:
    return fires(rec.section("xmp")["raw"].contains("xmpMM:History"), finding(
        "image_xmp_history", "authenticity", "medium", "XMP edit history found",
        edit_history="XMP history entries present"))


@PACK.rule
def image_color_profile(rec) -> Column:
    basic = rec.section("basic")
    present = F.map_contains_key(basic, "color_profile") & ~basic["color_profile"].eqNullSafe("None")
    return fires(present, finding(
        "image_color_profile", "information", "low", "Embedded color profile found", color_profile="Present"))
