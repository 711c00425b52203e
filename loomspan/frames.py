"""Helpers on DataFrames of callers, whose columns may have any names."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, number: Column, most: int = 1) -> DataFrame:
    """Rows whose number (of a window) is ``most`` at the most; the columns stay as they are."""
    name = unused(df, "number")
    return df.withColumn(name, number).where(F.col(name) <= most).drop(name)


def unused(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case of letters."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def in_pieces(values: Iterator, kind: pa.DataType, rows: int = 200) -> pa.Array:
    """An Arrow array of values of which only a few are Python objects at a time."""
    pieces = []
    while piece := list(islice(values, rows)):
        pieces.append(pa.array(piece, kind))
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)
