"""Joins in which one key may hold a large part of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000


def meet(rows: DataFrame, facts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with the one fact of their key; ``size`` counts the rows of each key.

    A key is hot from a share of 1 / HOT_KEYS of the rows on, so at most HOT_KEYS facts are broadcast;
    the other rows are shuffled by key. ``facts`` is read several times: give a written table.
    """
    limit = max(facts.agg(F.sum(size)).first()[0] or 0, 1) / HOT_KEYS
    hot = F.broadcast(facts.where(F.col(size) > limit))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(facts.where(F.col(size) <= limit), keys))
