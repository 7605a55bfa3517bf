"""Vectors as whole numbers, and sums over all of them, for the embedding operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that isn't null and whose entries are neither null nor NaN nor infinite; an empty one is."""
    whole = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def scaled(vector: Column, scale: float, shift: int = 0) -> Column:
    """floor(scale * c) + shift of each entry c, as longs; entries must stay within a long."""
    return F.transform(vector, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift))


def matrix(column: pa.Array, dim: int, fill: int = 0) -> np.ndarray:
    """A batch's vectors as rows of longs; shorter ones are filled up with ``fill``."""
    values, lengths = np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))
    if len(lengths) and (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.full((len(lengths), dim), fill, np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = values
    return out


def totals(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], kind: type = float) -> np.ndarray:
    """The sum over all batches of ``rows`` of ``of(batch)``, an array of ``shape``.

    A task returns one row per cell, cells are summed by Spark, and the driver gets the
    cells only. ``kind`` is float or int; whole numbers are summed exactly and must fit 64 bits.
    """
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.ravel(total))], names=["at", "value"])

    out = np.zeros(size, np.int64 if kind is int else float)
    for at, value in rows.mapInArrow(run, f"at int, value {'long' if kind is int else 'double'}").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out.reshape(shape)
