"""Number parsing and formatting."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """Text as a double, null when it is not a number."""
    return value.try_cast("double")


def fixed(value: Column, places: int) -> Column:
    """Fixed-point text, ties to even on the exact value, no grouping."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def whole(value: Column) -> Column:
    """Text of a number, without a trailing .0 for whole numbers."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
