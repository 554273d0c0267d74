"""Flatten nested metadata into dotted keys, row by row (no shuffle, any depth)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaudit.functions.findings import let

# Each round opens one nesting level of every entry. Rounds come in stages, each entered only by
# rows in which something is left to open; rows deeper than both together fail.
STAGES = (6, 4000)


_ENTRIES = "array<struct<field: string, value: variant, kind: string>>"


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"\A\w+", 0)


def _scalar_text(v: Column, kind: Column) -> Column:
    """Text of a scalar: True/False, decimals as floating point, null as given."""
    plain = F.try_variant_get(v, "$", "string")
    return (
        F.when(kind == "BOOLEAN", F.initcap(plain))
        .when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double").cast("string"))
        .otherwise(plain)
    )


def _entry(field: Column, value: Column, kind: Column | None = None) -> Column:
    return F.struct(field.alias("field"), value.alias("value"), (_kind(value) if kind is None else kind).alias("kind"))


def _members(e: Column) -> Column:
    prefix = F.when(e["field"] == "", "").otherwise(F.concat(e["field"], F.lit(".")))
    return F.transform(
        F.map_entries(e["value"].cast("map<string,variant>")),
        lambda m: _entry(F.concat(prefix, m["key"]), m["value"]))


def _items(e: Column) -> Column:
    """A list of scalars stays one entry; other lists give one entry per item.

    Inside a list only objects are opened further; anything else is already text.
    """
    def one(x, i):
        settled = F.when(x["kind"] == "VOID", F.lit("None")).when(x["kind"] == "ARRAY", F.to_json(x["value"])) \
            .otherwise(_scalar_text(x["value"], x["kind"]))
        nested = x["kind"] == "OBJECT"
        return _entry(
            F.concat(e["field"], F.lit("."), i.cast("string")),
            F.when(nested, x["value"]).otherwise(settled.cast("variant")),
            F.when(nested, "OBJECT").otherwise("STRING"))

    def joined(items):
        text = F.array_join(F.transform(items, lambda x: _scalar_text(x["value"], x["kind"])), ", ")
        return F.array(_entry(e["field"], text.cast("variant"), F.lit("STRING")))

    items = F.transform(e["value"].cast("array<variant>"), lambda x: _entry(F.lit(""), x))
    return let(items, lambda xs: F.when(
        F.exists(xs, lambda x: x["kind"].isin("OBJECT", "ARRAY", "VOID")), F.transform(xs, one)).otherwise(joined(xs)))


def _open_level(entries: Column) -> Column:
    """Replace every object by its members, and every list by its text or its items."""
    return F.flatten(F.transform(
        entries,
        lambda e: F.when(e["kind"] == "OBJECT", _members(e)).when(e["kind"] == "ARRAY", _items(e)).otherwise(F.array(e))))


def _open_objects(entries: Column) -> Column:
    return F.flatten(F.transform(
        entries, lambda e: F.when(e["kind"] == "OBJECT", _members(e)).otherwise(F.array(e))))


def _walk(variant: Column, open_level, kinds) -> Column:
    """Open levels until no entry of these kinds is left."""
    def unfinished(entries):
        return F.exists(entries, lambda e: e["kind"].isin(*kinds))

    def opened(entries, rounds):
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), entries, lambda acc, _: let(
            acc, lambda es: F.when(unfinished(es), open_level(es)).otherwise(es)))

    walked = F.array(_entry(F.lit(""), variant))
    for rounds in STAGES:
        walked = let(walked, lambda es: F.when(unfinished(es), opened(es, rounds)).otherwise(es))
    return let(walked, lambda es: F.when(unfinished(es), F.raise_error(F.lit("metadata is nested too deep")).cast(_ENTRIES)).otherwise(es))


def _last_wins(entries: Column) -> Column:
    """Keep the last entry of each field; the search only runs for rows that repeat one."""
    def checked(pair):
        found, fields = pair["found"], pair["fields"]
        kept = F.filter(found, lambda e, i: ~F.array_contains(
            F.slice(fields, i + 2, F.greatest(F.size(fields) - i - 1, F.lit(0))), e["field"]))
        return F.when(F.size(F.array_distinct(fields)) == F.size(fields), found).otherwise(kept)

    with_fields = let(entries, lambda es: F.struct(
        es.alias("found"), F.transform(es, lambda e: e["field"]).alias("fields")))
    return let(with_fields, checked)


def flatten_entries(variant: Column) -> Column:
    """``array<struct<field, value>>``: dotted key and text of every leaf.

    Lists of scalars join with ``', '``; other lists get indexed keys; null is ``''``;
    an empty object yields nothing.
    """
    def leaf(e):
        return F.struct(
            e["field"].alias("field"), F.coalesce(_scalar_text(e["value"], e["kind"]), F.lit("")).alias("value"))

    return _last_wins(F.transform(_walk(variant, _open_level, ('OBJECT', 'ARRAY')), leaf))


def compare_entries(variant: Column) -> Column:
    """As :func:`flatten_entries`, but lists stay whole (as JSON text) and null stays null."""
    def leaf(e):
        return F.struct(
            e["field"].alias("field"),
            F.when(e["kind"] == "ARRAY", F.to_json(e["value"])).otherwise(_scalar_text(e["value"], e["kind"])).alias("value"))

    return _last_wins(F.transform(_walk(variant, _open_objects, ('OBJECT',)), leaf))


def _as_variant(df: DataFrame, column: str) -> Column:
    if df.schema[column].dataType.typeName() == "variant":
        return F.col(column)
    return F.try_parse_json(F.col(column))


def flatten_metadata(df: DataFrame, key: str, column: str = "metadata") -> DataFrame:
    """Long table ``(key, field, value)`` of the flattened metadata (JSON text or VARIANT)."""
    return df.select(key, _as_variant(df, column).alias("_v")).select(key, F.inline(flatten_entries(F.col("_v"))))


def flatten_for_compare(df: DataFrame, key, column: str = "metadata") -> DataFrame:
    """Long table ``(key, field, value)`` for comparison: lists whole, nulls kept."""
    keys = [key] if isinstance(key, str) else list(key)
    opened = df.select(*keys, _as_variant(df, column).alias("_v"))
    return opened.select(*keys, F.inline(compare_entries(F.col("_v"))))
