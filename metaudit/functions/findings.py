"""Building blocks of rules.

A rule is a Column of type ``array<finding>``; null or empty means it did not fire.
Rules are row-local, so any number of them costs one scan and no shuffle.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaudit.schema import FINDING


def no_findings() -> Column:
    return F.lit(None).cast(T.ArrayType(FINDING))


def text(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def finding(rule, type_, severity, description, **evidence) -> Column:
    """One finding. Evidence values are array columns (lists) or scalars (one-item lists)."""
    pairs = []
    for name, value in evidence.items():
        if isinstance(value, Items):
            value = value.column
        else:
            value = F.array(text(value))
        pairs += [F.lit(name), value]
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(type_).alias("type"),
        text(severity).alias("severity"),
        text(description).alias("description"),
        F.create_map(*pairs).alias("evidence"),
    )


class Items:
    """Marks an evidence value that already is an ``array<string>``."""

    def __init__(self, column: Column):
        self.column = column


def fires(condition: Column, found: Column) -> Column:
    """The finding as a one-element array when the condition holds, else null."""
    return F.when(condition, F.array(found))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fires_on(value: Column, test, build) -> Column:
    """The finding built from a value when the value passes the test."""
    return let(value, lambda v: fires(test(v), build(v)))


def listing(rule, type_, severity, description, key, entries: Column) -> Column:
    """A finding that lists the entries of a map, when there are any."""
    return fires_on(entries, lambda m: F.size(m) > 0, lambda m: finding(
        rule, type_, severity, description, **{key: Items(entries_text(m))}))


def combine(rules) -> Column:
    """Concatenate rules in order into one array of findings."""
    rules = list(rules)
    if not rules:
        return F.array().cast(T.ArrayType(FINDING))
    return F.flatten(F.array_compact(F.array(*rules)))


def entries_text(entries: Column) -> Column:
    """``key: value`` strings of a map, in key order."""
    return F.sort_array(
        F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    )


def contains_any(value: Column, terms) -> Column:
    """Lower-cased value contains one of the terms."""
    return F.lower(value).rlike("|".join(t.lower().replace(".", r"\.") for t in terms))


def keep_keys(section: Column, keys) -> Column:
    """The entries of a map whose key is listed; null values count as present."""
    return F.map_filter(section, lambda k, v: k.isin(list(keys)))


def keys_like(section: Column, terms) -> Column:
    """The entries of a map whose key contains a term; null when none does.

    All keys are tested at once as one text; only where a term is found are they walked one by one.
    """
    found = contains_any(F.array_join(F.map_keys(section), "\n"), terms)
    return F.when(found, F.map_filter(section, lambda k, v: contains_any(k, terms)))


def override(first: Column, second: Column) -> Column:
    """Union of two maps; entries of the second replace equal keys of the first."""
    def merged(pair):
        kept = F.map_filter(pair["a"], lambda k, v: ~F.map_contains_key(pair["b"], k))
        return F.map_concat(kept, pair["b"])

    empty = F.expr("CAST(map() AS MAP<STRING,STRING>)")
    return let(F.struct(F.coalesce(first, empty).alias("a"), F.coalesce(second, empty).alias("b")), merged)


def nonempty(value: Column) -> Column:
    """Null for the empty string."""
    return F.when(value != "", value)


def truthy(value: Column) -> Column:
    """A text rendering of a flag is set: neither missing, empty, zero nor false."""
    return F.coalesce(~F.lower(value).isin("", "false", "0", "none", "null"), F.lit(False))
