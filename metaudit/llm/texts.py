"""Run numpy work over the texts of a table, slice by slice."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metaudit.llm.words import Texts, sliced


def columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table has."""
    return docs.select(*[docs[n] for n in names])


def per_text(docs: DataFrame, work: Callable[[Texts], list], schema: str, *, id_col: str = "doc_id",
             text_col: str = "text", lower: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, then what ``work`` gives for each text of a slice.

    ``schema`` names the columns after the id. Null texts come as empty ones. Rows are kept
    one to one, so repeated rows and null ids stay as they are.
    """
    source = columns_of(docs, id_col, text_col)
    fields = StructType([source.schema[id_col], *StructType.fromDDL(schema).fields])
    names = fields.names

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, texts in sliced(batch.column(1), lower):
                values = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in work(texts)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *values], names)

    return source.mapInArrow(run, fields)


def rows_out(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                                      StructType.fromDDL(schema).names)


def held_out(id_col: str, modulus: int, remainder: int):
    return F.crc32(F.col(id_col).cast("string")) % modulus == remainder


def rows_where(docs: DataFrame, keep: Callable[[Texts], np.ndarray], *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, for which ``keep`` is true of the text."""
    schema = docs.schema
    place = [f.name for f in schema].index(text_col)

    def run(batches):
        for batch in batches:
            for i, j, texts in sliced(batch.column(place)):
                yield batch.slice(i, j - i).filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, schema)
