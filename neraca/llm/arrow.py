"""Columns appended to a DataFrame by a function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def append(
    df: DataFrame, fields: Sequence[T.StructField], compute: Callable[[pa.RecordBatch], Sequence[pa.Array]], drop: Sequence[str] = ()
) -> DataFrame:
    """``df`` with ``fields``, one array of ``compute`` each; a column of the same name is replaced.

    Every other column passes through, except those in ``drop``.
    """
    gone = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in gone]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches):
        for batch in batches:
            arrays = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, *compute(batch)], names)

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
