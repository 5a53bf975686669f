"""Rows of Arrow batches, a bounded number at a time, for work beside one text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Texts read and rows written at a time.
TEXTS_HELD, ROWS_HELD = 64, 20_000


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    rows = iter(rows)
    while part := list(islice(rows, ROWS_HELD)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of some batches, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_HELD):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, TEXTS_HELD).columns])


def mapped(held: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], out: str) -> DataFrame:
    """What a function gives of a table's batches, as a table of the columns ``out`` names."""
    kinds = StructType.fromDDL(out)
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])
    return held.mapInArrow(lambda batches: batches_of(rows(batches), schema), kinds)
