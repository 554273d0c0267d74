"""The audit: route each record to its rule packs and collect the findings, in one projection."""

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaudit.functions.findings import combine, no_findings
from metaudit.operators import (
    audio_rules, document_rules, executable_rules, generic_rules, image_rules, pattern_rules, video_rules,
)
from metaudit.operators.classify import error_struct
from metaudit.operators.flatten import flatten_entries
from metaudit.operators.records import Record, conform, with_terms, without_terms
from metaudit.operators.rule_index import rule_findings
from metaudit.operators.rulebook import Pack
from metaudit.schema import ERROR, FINDING

PACKS = [
    image_rules.PACK, document_rules.PACK, audio_rules.PACK, video_rules.PACK, executable_rules.PACK,
    generic_rules.PACK,
]
CUSTOM: dict[str, Pack] = {}


def register_rule_pack(name: str, file_type: str | None, rules: dict) -> None:
    """Add rules (``name -> Record -> array-of-findings Column``) for a type, or all types with None.

    A name that is already taken, by a built-in pack too, is left as it is.
    """
    if name in CUSTOM or name in {p.name for p in PACKS} | {"pattern"}:
        return
    pack = Pack(name, file_type)
    pack.rules.update(rules)
    CUSTOM[name] = pack


# Pack expressions name columns and do not depend on the table, so they are built once per
# Spark context, and go with it; building all of them takes seconds of driver time.
_BUILT: WeakKeyDictionary = WeakKeyDictionary()


def _built(df: DataFrame, key, build) -> tuple[Column, frozenset, frozenset]:
    """The expression that ``build(record)`` gives, and the metadata sections and terms that it reads."""
    known = _BUILT.setdefault(df.sparkSession.sparkContext, {})
    if key not in known:
        record = Record()
        known[key] = build(record), frozenset(record.read), frozenset(record.terms)
    return known[key]


def _pack_findings(df: DataFrame, pack: Pack) -> tuple[Column, frozenset, frozenset]:
    def build(record):
        found = combine(rule(record) for rule in pack.rules.values())
        if pack.broken is not None:
            found = F.when(pack.broken(record).isNull(), found)
        return found if pack.file_type is None else F.when(pack.applies(record), found)

    return _built(df, ("findings", pack.name, pack.file_type, *pack.rules.values()), build)


def _pack_error(df: DataFrame, pack: Pack) -> tuple[Column, frozenset, frozenset]:
    def build(record):
        problem = pack.broken(record)
        return F.when(pack.applies(record) & problem.isNotNull(), error_struct(
            "AnalysisError",
            F.concat(F.lit("Failed to analyze metadata for "), record.path, F.lit(f" using {pack.name}")), problem))

    return _built(df, ("error", pack.name), build)


def _pattern_findings(df: DataFrame) -> Column:
    return _built(df, ("pattern",), lambda _: combine(
        pattern_rules.report(n, F.col(f"_m_{n}")) for n in pattern_rules.DETECTORS))[0]


def _clock(df: DataFrame, now: Column | None) -> DataFrame:
    return df.withColumn("_now", F.localtimestamp() if now is None else now)


def run_pack(df: DataFrame, pack: Pack, now: Column | None = None, into: str = "findings") -> DataFrame:
    """Findings of one pack over record columns; only the sections it reads are parsed."""
    return _judged(df, *_pack_findings(df, pack), now, into)


def run_rule(df: DataFrame, rule, now: Column | None = None, into: str = "findings") -> DataFrame:
    """Findings of one rule over record columns; it reaches metadata through ``Record.section``."""
    record = Record()
    return _judged(df, combine([rule(record)]), record.read, record.terms, now, into)


def _judged(df: DataFrame, found: Column, sections, terms, now: Column | None, into: str) -> DataFrame:
    opened = with_terms(_clock(conform(_kept(df), sections=sections), now), terms)
    return _restored(without_terms(opened.withColumn(into, found).drop("_now"), terms), df)


def _kept(df: DataFrame) -> DataFrame:
    """The rules read a typed view of ``metadata``; what came in waits beside it."""
    return df.withColumn("_input", F.col("metadata")) if "metadata" in df.columns else df


def _restored(out: DataFrame, df: DataFrame) -> DataFrame:
    return out.withColumn("metadata", F.col("_input")).drop("_input") if "metadata" in df.columns else out


def _with_entries(df: DataFrame, text_fields) -> DataFrame:
    """Add ``entries``: flattened metadata, followed by the named text columns.

    The parse is a projection of its own, as flattening reads its result several times.
    """
    parts = [pattern_rules.text_entries(df, text_fields)] if text_fields else []
    opened = df
    if "metadata" in df.columns:
        kind = df.schema["metadata"].dataType
        if isinstance(kind, T.VariantType):
            variant = F.col("metadata")
        else:
            variant = F.try_parse_json("metadata" if isinstance(kind, T.StringType) else F.to_json("metadata"))
        opened = df.withColumn("_opened", variant)
        parts.insert(0, F.coalesce(flatten_entries(F.col("_opened")), F.array()))
    entries = F.concat(*parts, F.array()).cast("array<struct<field:string,value:string>>")
    return opened.withColumn("entries", entries).drop("_opened")


def audit(df: DataFrame, now: Column | None = None, text_fields=(), skip_analysis: bool = False) -> DataFrame:
    """Add ``findings`` (and pack errors) to records.

    The detectors read the flattened metadata (JSON text or VARIANT) and, if named, text
    columns. A type pack runs only on rows of its type, and not at all when the table has
    no metadata. ``now`` is the clock for future timestamps. No shuffle; works on a stream.
    """
    if skip_analysis:
        whole = conform(df, typed=False)
        return whole if "findings" in df.columns else whole.withColumn("findings", no_findings())
    packs = list(PACKS) + list(CUSTOM.values())
    if "metadata" not in df.columns:
        packs = [p for p in packs if p.file_type is None or p.name in CUSTOM]
    built = {p.name: _pack_findings(df, p) for p in packs}
    terms = frozenset().union(*[b[2] for b in built.values()])
    records = with_terms(_clock(conform(_kept(_with_entries(df, text_fields))), now), terms)
    records = pattern_rules.with_matches(records, F.col("entries"))
    record = Record()
    parts = [built[p.name][0] for p in packs if p.name not in CUSTOM]
    parts.append(_pattern_findings(df))
    parts += [built[p.name][0] for p in packs if p.name in CUSTOM]
    failed = F.coalesce(record.section("extraction_failed"), F.lit(False))
    if "extraction_failed" in df.columns:
        failed = failed | F.coalesce(F.col("extraction_failed"), F.lit(False))
    none, no_errors = F.array().cast(T.ArrayType(FINDING)), F.array().cast(T.ArrayType(ERROR))
    found = F.flatten(F.array_compact(F.array(*parts)))
    broken = F.array_compact(F.array(*[_pack_error(df, p)[0] for p in packs if p.broken is not None]))
    out = records.withColumns({
        "findings": F.when(failed, none).otherwise(found),
        "errors": F.concat(F.coalesce("errors", no_errors), F.when(failed, no_errors).otherwise(broken.cast(T.ArrayType(ERROR)))),
    })
    return without_terms(_restored(out, df), terms).drop("entries", "_now", *[f"_m_{n}" for n in pattern_rules.DETECTORS])


def match_rules(df: DataFrame, entries: Column, rules: list, into: str = "findings") -> DataFrame:
    """User rules over the entries of each record, as findings.

    ``rules`` is the content of a rules file: dicts with rule, regex, field_like (LIKE on the
    field name, None for all), type and severity. They become one constant, indexed by text
    that matches must contain (see ``rule_index``); there is neither a join nor a shuffle.
    """
    return df.withColumn(into, rule_findings(entries, rules))
