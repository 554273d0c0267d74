"""Bring a table into record shape and address its columns."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaudit.functions.findings import let
from metaudit.functions.paths import extension
from metaudit.schema import ERROR, METADATA_SECTIONS, RECORD_COLUMNS

TIMES = ("creation_time", "modification_time", "access_time")


class Record:
    """Column access for rules: record columns, metadata sections and the audit clock.

    ``read`` notes the sections that rules ask for, so that only those are parsed; ``terms`` notes
    which of their keys' terms, so that keys are looked at once for all rules (``with_terms``).
    """

    def __init__(self):
        self.read = set()
        self.terms = set()
        self.path = F.col("file_path")
        self.type = F.col("file_type")
        self.size = F.col("file_size")
        self.mime = F.col("mime_type")
        self.hashes = F.col("hashes")
        self.times = {name: F.col(name) for name in TIMES}
        self.extension = extension(self.path)
        self.now = F.col("_now")

    def section(self, name: str) -> Column:
        self.read.add(name)
        return F.col("metadata")[name]


    def keys_like(self, section: str, terms) -> Column:
        """The entries of a map section whose key contains a term; null when none does."""
        groups = TERM_GROUPS.setdefault(section, [])
        if tuple(terms) not in groups:
            groups.append(tuple(terms))
        group = groups.index(tuple(terms))
        self.terms.add((section, group))
        marked = F.col(_terms_column(section))

        def has(key):
            return F.try_element_at(marked, key).bitwiseAND(F.lit(1 << group)) != 0

        some = F.exists(F.map_values(marked), lambda mask: mask.bitwiseAND(F.lit(1 << group)) != 0)
        return F.when(some, F.map_filter(self.section(section), lambda k, v: F.coalesce(has(k), F.lit(False))))


# Groups of terms that rules look for in the keys of a section; a group's place is its bit.
TERM_GROUPS: dict[str, list[tuple]] = {}


def _terms_column(section: str) -> str:
    return f"_terms_{section}"


def with_terms(df: DataFrame, terms) -> DataFrame:
    """Add for each section a map from the keys that contain terms to bits of their groups.

    ``terms`` is what records have noted. Each key is lower-cased once, and looked at alone only where
    some key of the section has some term. The map is a column of its own, which several rules read.
    """
    wanted: dict[str, list[int]] = {}
    for section, group in sorted(terms):
        wanted.setdefault(section, []).append(group)
    return df.withColumns({_terms_column(s): _marked(F.col("metadata")[s], TERM_GROUPS[s], groups) for s, groups in wanted.items()})


def _marked(section: Column, known: list[tuple], groups: list[int]) -> Column:
    def has(key, terms):
        # a term is plain text, which is found faster without a pattern
        return reduce(or_, [key.contains(t.lower()) for t in terms])

    def marks(key):
        small = F.lower(key)
        return let(small, lambda k: sum((F.when(has(k, known[g]), 1 << g).otherwise(0) for g in groups), F.lit(0)))

    def looked_at(keys):
        marked = F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), marks(k).alias("value"))), lambda m: m["value"] != 0)
        any_term = let(F.lower(F.array_join(keys, "\n")), lambda text: has(text, [t for g in groups for t in known[g]]))
        return F.when(any_term, F.map_from_entries(marked))

    return let(F.map_keys(section), looked_at)


def without_terms(df: DataFrame, terms) -> DataFrame:
    return df.drop(*{_terms_column(s) for s, _ in terms})


def iso_text(value: Column, kind: T.DataType) -> Column:
    """ISO-8601 text of a timestamp; text passes through."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    return value.cast("string")


def conform(df: DataFrame, typed: bool = True, sections=METADATA_SECTIONS) -> DataFrame:
    """Add missing record columns and type the metadata column.

    ``metadata`` may be JSON text, VARIANT, or a struct holding some of the sections; without
    ``typed`` a given one is left as it is. ``sections`` names those that are typed. All other
    columns pass through. Only projections: nothing is shuffled.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = {}
    for name, kind in RECORD_COLUMNS.items():
        if name not in kinds:
            columns[name] = F.lit(None).cast(kind)
        elif name in TIMES:
            columns[name] = iso_text(F.col(name), kinds[name])
    metadata = kinds.get("metadata")
    wanted = [n for n in METADATA_SECTIONS if n in sections]
    ddl = ", ".join(f"{n} {METADATA_SECTIONS[n]}" for n in wanted)
    if metadata is None:
        columns["metadata"] = F.lit(None).cast(_struct_ddl())
    elif not typed or not wanted:
        pass
    elif isinstance(metadata, T.StringType):
        columns["metadata"] = F.from_json("metadata", ddl)
    elif isinstance(metadata, T.VariantType):
        columns["metadata"] = F.from_json(F.to_json("metadata"), ddl)
    else:
        columns["metadata"] = F.struct(*[_section(metadata, name).alias(name) for name in wanted])
    if "errors" not in kinds:
        columns["errors"] = F.array().cast(T.ArrayType(ERROR))
    return df.withColumns(columns)


def _section(metadata: T.StructType, name: str) -> Column:
    """A section of a metadata struct in its declared type; other shapes go through JSON."""
    kind = METADATA_SECTIONS[name]
    if name not in metadata.fieldNames():
        return F.lit(None).cast(kind)
    given = metadata[name].dataType
    section = F.col("metadata")[name]
    if given.simpleString() == kind.replace(" ", "").lower():
        return section
    if isinstance(given, (T.StructType, T.MapType, T.ArrayType)):
        return F.from_json(F.to_json(section), kind)
    return section.cast(kind)


def _struct_ddl() -> str:
    return "struct<" + ", ".join(f"{n}: {k}" for n, k in METADATA_SECTIONS.items()) + ">"
