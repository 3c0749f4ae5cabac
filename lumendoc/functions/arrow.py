"""Arrow functions that need no session until they are used."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(returns: str) -> Callable:
    """A pandas UDF (its kind by the type hints), made when it is called."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap


def in_pieces(values: pa.Array, of: Callable[[pa.Array], pa.Array], type_: pa.DataType, rows: int) -> pa.Array:
    """``of`` over slices of so many rows, so that a batch never stands in memory as Python objects as a whole."""
    return pa.chunked_array([of(values.slice(k, rows)) for k in range(0, len(values), rows)], type_).combine_chunks()
