"""Centroid clustering of whole-number vectors by partial-distance search.

Dimensions are taken in the order of their variance, a few at a time. A centroid whose
squared differences so far exceed a vector's best distance is abandoned for this vector;
what survives is summed over all dimensions, so distances are exact and ties are seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged
from ledgerloom.llm.vectors import finite, matrix, scaled, totals

RESULT = "vec_id {id}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: Entries below this size give squared distances that fit a long, up to 1,024 dimensions.
REACH = 2**25


@dataclass(frozen=True)
class Clustering:
    clusters: int = 8
    rounds: int = 10
    dim: int = 64
    step: int = 8  # dimensions added between two looks at the best distance
    rows: int = 4096  # vectors compared at once


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of ``x``; equal distances go to the smaller number.

    The centroid nearest in the first ``step`` dimensions is summed up first, so the
    others meet a low bound early.
    """
    x, centroids = x[:, order], centroids[:, order]
    head = np.stack([np.square(x[:, :step] - c[:step]).sum(axis=1) for c in centroids], axis=1)
    first = head.argmin(axis=1)
    best = head[np.arange(len(x)), first] + np.square(x[:, step:] - centroids[first, step:]).sum(axis=1)
    cluster = first.copy()
    for c, centroid in enumerate(centroids):
        alive = np.flatnonzero((first != c) & (head[:, c] <= best))
        part = head[alive, c]
        for at in range(step, x.shape[1], step):
            part = part + np.square(x[alive, at : at + step] - centroid[at : at + step]).sum(axis=1)
            near = part <= best[alive]
            alive, part = alive[near], part[near]
        won = (part < best[alive]) | ((part == best[alive]) & (c < cluster[alive]))
        cluster[alive[won]], best[alive[won]] = c, part[won]
    return cluster, best


def cluster(vectors: DataFrame, seed_order: Column, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", settings: Clustering = Clustering()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector.

    Vectors with exactly ``dim`` entries, none null or non-finite, are kept; entries
    become floor(scale * c). ``seed_order`` is an expression on ``vec_id``: the kept
    vectors with its smallest values, equal ones in the order of their entries, null ones
    last, are the first centroids. Repeated rows are kept each for itself, as vectors and
    as centroids; of two equal centroids the smaller number gets the vectors and the other
    stays empty and where it is. Fewer vectors than clusters give as many clusters; an
    empty table gives no rows. A null id stays null. Other columns are not read. Entries
    of 2^25 or more raise ArithmeticError. A round is one pass over the written vectors;
    the driver holds the centroids and one sum per cluster and dimension. Rounds that
    change no centroid would all be alike, so the first such round is the last to run.
    """
    kind, dim = vectors.schema[id_col].dataType.simpleString(), settings.dim
    spark = vectors.sparkSession
    vector = F.col(vec_col).cast("array<double>")
    kept = vectors.where(finite(vector) & (F.size(vec_col) == dim))
    rows = staged(kept.select(F.col(id_col).alias("vec_id"), scaled(vector, scale).alias("x")), "clustering-vectors")
    reach = rows.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double")))))).first()[0]
    if reach is None:
        return spark.createDataFrame([], RESULT.format(id=kind))
    if reach >= REACH:
        raise ArithmeticError("an entry is 2^25 or more")
    seeds = rows.orderBy(seed_order.asc_nulls_last(), "x").limit(settings.clusters).select("x").collect()
    centroids = np.array([r[0] for r in seeds], np.int64)
    k, step = len(centroids), settings.step
    xs = rows.select("x")
    powers = totals(xs, lambda b: np.stack([(m := matrix(b.column(0), dim).astype(float)).sum(axis=0), np.square(m).sum(axis=0)]), (2, dim))
    n = rows.count()
    order = np.argsort(-(powers[1] / n - np.square(powers[0] / n)), kind="stable")

    def assigned(column: pa.Array, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        x = matrix(column, dim)
        for at in range(0, len(x), settings.rows):
            part = x[at : at + settings.rows]
            yield part, *nearest(part, centroids, order, step)

    def moved(centroids: np.ndarray) -> np.ndarray:
        def share(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((k, dim + 1), np.int64)
            for x, which, _ in assigned(batch.column(0), centroids):
                for c in np.unique(which):
                    mine = x[which == c]
                    out[c, :dim] += mine.sum(axis=0)
                    out[c, dim] += len(mine)
            return out

        sums = totals(xs, share, (k, dim + 1), int)
        size = np.maximum(sums[:, dim:], 1)
        return np.where(sums[:, dim:] > 0, sums[:, :dim] // size, centroids)  # // rounds down, below zero too

    for _ in range(settings.rounds):
        before, centroids = centroids, moved(centroids)
        if (before == centroids).all():
            break

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(which, distance) for _, which, distance in assigned(batch.column(1), centroids)]
            if found:
                which, distance = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    out = staged(rows.mapInArrow(place, f"vec_id {kind}, cluster int, distance long"), "clustering-assigned")
    inertia = dict(out.groupBy("cluster").agg(F.sum("distance")).collect())
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    by_cluster = lambda values, of: F.get(F.array(*[F.lit(v).cast(of) for v in values]), F.col("cluster"))
    return out.select(
        "vec_id", "cluster", "distance", by_cluster([inertia.get(c, 0) for c in range(k)], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(digest, "string").alias("centroid_sha256"),
    )
