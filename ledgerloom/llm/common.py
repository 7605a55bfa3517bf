"""What the training-data operators share: word patterns, input shaping, staging."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.staging import shared_dir, staged

__all__ = ["SPACE", "WORD", "documents", "free_name", "lower_ascii", "measured", "neighbour", "release", "released", "shared_dir", "small_batches", "staged", "text_or_empty"]

#: ASCII white space, as the operators' contracts have it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of 4 MB, whatever their lengths, unless the session has a size of its own.

    This sets the session's configuration and stays so; operators that call it say so in the README.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m"):  # Spark's default
        spark.conf.set(key, "4m")


def release() -> None:
    """Give memory that this Python worker no longer uses back to the system, where the C library can; idle workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a task's work on its batches, followed by :func:`release`."""

    @wraps(run)
    def of(batches):
        yield from run(batches)
        release()

    return of


def free_name(docs: DataFrame, stem: str) -> str:
    """The first of ``stem_0``, ``stem_1``... that isn't a column of ``docs``."""
    taken = set(docs.columns)
    return next(name for k in range(len(taken) + 1) if (name := f"{stem}_{k}") not in taken)


def measured(table: DataFrame, most: int = 500_000) -> DataFrame:
    """A written ``table`` of small rows, to be broadcast where it has at most ``most`` of them; else Spark joins as it sees fit."""
    return F.broadcast(table) if table.count() <= most else table


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def neighbour(points: DataFrame, keys: list[str], order: str, ahead: bool, width: int, name: str) -> DataFrame:
    """``points`` with ``name``: the next (``ahead``) or previous value of ``order`` in the same key, or null.

    ``points`` must be distinct in (keys, order), ``order`` whole numbers. A key is cut into stretches of
    ``width``, so no task sorts more than one stretch or one row per stretch.
    """
    side = F.lead if ahead else F.lag
    cut = F.floor(F.col(order) / F.lit(width))
    df = points.withColumn("stretch", cut)
    df = df.withColumn("near", side(order).over(Window.partitionBy(*keys, "stretch").orderBy(order)))
    edges = df.groupBy(*keys, "stretch").agg((F.min if ahead else F.max)(order).alias("edge"))
    edges = edges.withColumn("beyond", side("edge").over(Window.partitionBy(*keys).orderBy("stretch"))).drop("edge")
    return df.join(edges, [*keys, "stretch"]).withColumn(name, F.coalesce("near", "beyond")).drop("stretch", "near", "beyond")
