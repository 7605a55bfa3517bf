"""Exact top-k inner products over norm-sorted vectors.

Candidates are range-sorted by descending length and cut into blocks. The longest
``head`` vectors give every query a first k-th best score; queries are sorted by the
length a candidate needs to reach it (Cauchy-Schwarz) and cut into waves, so a wave
meets only the leading blocks. Inside a pair of wave and block, vectors rotated by
the eigenvectors of their scatter matrix (the right singular vectors of the data)
give a partial product over the leading axes; the lengths of the rests bound what is
missing, and only pairs whose bound reaches the current k-th best are multiplied out.

What the driver holds: ``head`` vectors, a scatter matrix, and one length per block
or wave. Pairs of blocks are the unit of work, each of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged


@dataclass(frozen=True)
class SearchPlan:
    k: int = 5
    head: int = 2048  # longest vectors that seed the thresholds
    block: int = 8192  # candidates
    wave: int = 4096  # queries
    step: int = 1024  # candidates compared at once
    axes: int = 16  # of the rotated space in the partial sums


def integer_vectors(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): v is floor(scale * x) of each component.

    Null ids, null or empty vectors and vectors with a null or non-finite
    component take no part. A row repeated with the same id and vector counts once.
    """
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")).dropDuplicates()


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, lengths = np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))
    if len(lengths) and (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = values
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The eigenvectors of the scatter matrix of all vectors, strongest first."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["at", "value"])

    sums = rows.select("v").mapInArrow(scatter, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    matrix = np.zeros(dim * dim)
    for at, value in sums.collect():
        matrix[at] = value
    return np.linalg.eigh(matrix.reshape(dim, dim))[1][:, ::-1].copy()


class Products:
    """Exact inner products of integer vectors, and the bounds that spare most of them."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, turn: np.ndarray, axes: int):
        self.ids, self.v = ids, v
        turned = v @ turn
        self.near, self.rest = turned[:, :axes], np.linalg.norm(turned[:, axes:], axis=1)
        self.most = int(np.abs(v).max(initial=0))

    def exact(self, rows: np.ndarray, other: Products, columns: np.ndarray) -> np.ndarray:
        a, b = self.v[rows], other.v[columns]
        if a.shape[1] * self.most * other.most < 2**53:  # whole numbers that doubles hold
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        return a @ b.T

    def bound(self, other: Products, columns: slice) -> np.ndarray:
        near, rest = other.near[columns], other.rest[columns]
        reach = self.near @ near.T + np.outer(self.rest, rest)
        return reach + 1e-9 * np.outer(np.linalg.norm(self.near, axis=1) + self.rest, np.linalg.norm(near, axis=1) + rest) + 1e-3


def best_of(queries: Products, candidates: Products, least: np.ndarray, plan: SearchPlan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's k best among the candidates that score ``least`` or more."""
    rows, ids, scores = (np.empty(0, np.int64) for _ in range(3))
    least = least.astype(float).copy()
    for at in range(0, len(candidates.ids), plan.step):
        columns = slice(at, at + plan.step)
        may = (queries.bound(candidates, columns) >= least[:, None]) & (queries.ids[:, None] != candidates.ids[None, columns])
        r, c = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(r):
            continue
        product = queries.exact(r, candidates, c + at)
        i, j = np.nonzero(may[np.ix_(r, c)] & (product >= least[r][:, None]))
        rows, ids, scores = np.append(rows, r[i]), np.append(ids, candidates.ids[c[j] + at]), np.append(scores, product[i, j])
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        full = rank == plan.k - 1
        least[rows[full]] = np.maximum(least[rows[full]], scores[full])
        keep = rank < plan.k
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
    return rows, ids, scores


PACKED = "part int, at int, low double, high double, ids binary, v binary, least binary"


def packed(rows: DataFrame, size: int, dim: int, key: str) -> DataFrame:
    """Rows in the order of their partitions, ``size`` to a block; low and high are of ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, waiting = TaskContext.get().partitionId(), 0, []

        def block(table: pa.Table) -> pa.RecordBatch:
            keys = np.asarray(table[key])
            least = np.asarray(table["least"]).astype("<f8").tobytes()
            data = [[part], [at], [keys.min()], [keys.max()], [np.asarray(table["vec_id"]).astype("<i8").tobytes()], [_matrix(table["v"], dim).astype("<i8").tobytes()], [least]]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kinds, strict=True)], names=["part", "at", "low", "high", "ids", "v", "least"])

        held = 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            while held >= size:
                table = pa.Table.from_batches(waiting)
                yield block(table.slice(0, size))
                at, held = at + 1, held - size
                waiting = table.slice(size).to_batches()
        if held:
            yield block(pa.Table.from_batches(waiting))

    return rows.select("vec_id", "v", "least", key).mapInArrow(run, PACKED)


def _numbered(blocks: DataFrame) -> tuple[DataFrame, list]:
    """``blocks`` with a running number ``n``, and (low, high) of each: one small row per block reaches the driver."""
    places = sorted(blocks.select("part", "at", "low", "high").collect())
    starts: dict[int, int] = {}
    for n, (part, *_) in enumerate(places):
        starts.setdefault(part, n)
    table = blocks.sparkSession.createDataFrame(list(starts.items()) or [(-1, 0)], "part int, first int")
    return blocks.join(F.broadcast(table), "part").withColumn("n", F.col("first") + F.col("at")).drop("first", "part", "at"), [(low, high) for _, _, low, high in places]


def search(vectors: DataFrame, is_query: Column, plan: SearchPlan = SearchPlan()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query.

    ``vectors`` are those of :func:`integer_vectors`; ``is_query`` is a condition on
    ``vec_id``. A query is never its own candidate, nor is a row of the same id. Ties
    go to the smaller vec_id. Fewer candidates give fewer rows; an empty table gives
    none. Vectors of unequal lengths are compared as if filled with zeros. Scores must
    fit 64 bits.
    """
    rows = staged(vectors.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))), "topk-vectors")
    spark = rows.sparkSession
    out = "query_id long, vec_id long, score long"
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn, axes = rotation(rows, dim), min(plan.axes, dim)
    top = rows.orderBy(F.desc("norm"), "vec_id").limit(plan.head).select("vec_id", "v").collect()
    head_ids = np.array([r[0] for r in top], np.int64)
    head = np.zeros((len(top), dim), np.int64)
    for i, r in enumerate(top):
        head[i, : len(r[1])] = r[1]

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = Products(head_ids, head, turn, axes)
        for batch in batches:
            mine = Products(np.asarray(batch.column(0)), _matrix(batch.column(1), dim), turn, axes)
            r, _, s = best_of(mine, longest, np.full(batch.num_rows, -np.inf), plan)
            least = np.full(batch.num_rows, -np.inf)
            count = np.bincount(r, minlength=batch.num_rows)
            lowest = np.full(batch.num_rows, np.inf)
            np.minimum.at(lowest, r, s)
            least[count >= plan.k] = lowest[count >= plan.k]
            norm = np.asarray(batch.column(2))
            need = np.where(least <= 0, 0.0, least / np.maximum(norm, 1e-300) * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least), pa.array(need)], names=["vec_id", "v", "least", "need"])

    queries = rows.where(is_query).select("vec_id", "v", "norm").repartition(8 * spark.sparkContext.defaultParallelism)
    seeded = staged(queries.mapInArrow(seed, "vec_id long, v array<bigint>, least double, need double"), "topk-queries")
    waves = staged(packed(seeded.repartitionByRange(F.col("need"), F.col("vec_id")).sortWithinPartitions("need", "vec_id"), plan.wave, dim, "need"), "topk-waves")
    sorted_ = rows.withColumn("least", F.lit(0.0)).repartitionByRange(F.desc("norm"), F.col("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = staged(packed(sorted_, plan.block, dim, "norm"), "topk-blocks")
    waves, needs = _numbered(waves)
    blocks, norms = _numbered(blocks)
    if not needs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    highest = np.array([high for _, high in norms])
    lowest_need = np.array([low for low, _ in needs])
    # Waves come by rising need, blocks by falling length: wave w meets the first of[w] blocks, block j the first to[j] waves.
    to = np.searchsorted(lowest_need, highest, side="right")
    of = np.searchsorted(-highest, -lowest_need, side="right")
    small = spark.createDataFrame([(j, int(n)) for j, n in enumerate(to)], "n int, to int")
    far = spark.createDataFrame([(w, int(n)) for w, n in enumerate(of)], "n int, upto int")
    left = blocks.join(F.broadcast(small), "n").where("to > 0").select(F.col("n").alias("j"), F.explode(F.sequence(F.lit(0), F.col("to") - 1)).alias("w"), "ids", "v")
    right = waves.join(F.broadcast(far), "n").where("upto > 0").select(F.explode(F.sequence(F.lit(0), F.col("upto") - 1)).alias("j"), F.col("n").alias("w"), "ids", "v", "least")

    def meet(block: pa.Table, wave: pa.Table) -> pa.Table:
        found = ([], [], [])
        if block.num_rows and wave.num_rows:
            side = [Products(np.frombuffer(t["ids"][0].as_py(), "<i8"), np.frombuffer(t["v"][0].as_py(), "<i8").reshape(-1, dim), turn, axes) for t in (wave, block)]
            r, ids, s = best_of(*side, np.frombuffer(wave["least"][0].as_py(), "<f8"), plan)
            found = (side[0].ids[r], ids, s)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    found = left.groupBy("j", "w").cogroup(right.groupBy("j", "w")).applyInArrow(meet, out).dropDuplicates()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= plan.k).select("query_id", "rank", "vec_id", "score")
