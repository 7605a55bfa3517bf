import math
import random

from pyspark.sql import functions as F

from ledgerloom.llm import topk
from ledgerloom.llm.queries import op2_topk


def brute(rows, k=5):
    v = {i: [math.floor(256 * float(x)) for x in e] for i, e in rows}
    out = {}
    for q in (i for i in v if i % 50 == 0):
        score = lambda c: sum(a * b for a, b in zip(v[q], v[c]))  # noqa: B023, E731
        out[q] = sorted(((-score(c), c) for c in v if c != q))[:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_against_brute_force_with_ties_and_small_blocks(spark):
    random.seed(6)
    common = [random.gauss(0, 1) for _ in range(12)]
    rows = [(i, common if i % 3 == 0 else [random.gauss(0, random.choice([0.1, 1, 5])) for _ in range(12)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plan = topk.SearchPlan(head=40, block=64, wave=4, step=16, axes=4)
    assert got(topk.search(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, plan)) == brute(rows)
    assert got(topk.search(topk.integer_vectors(df), F.col("vec_id") % 50 == 0)) == brute(rows)


def test_bounds_never_lose_a_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(-500, 500, (20, 16)), rng.integers(-500, 500, (30, 16))
    turn = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    left, right = topk.Products(np.arange(20), a, turn, 5), topk.Products(np.arange(30), b, turn, 5)
    assert (left.bound(right, slice(0, 30)) >= a @ b.T).all()


def test_nulls_odd_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (None, [9.0, 9.0]), (6, [-0.001, 0.5]), (6, [-0.001, 0.5]), (50, [2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string")
    found = got(topk.search(topk.integer_vectors(df), F.col("vec_id") % 50 == 0))
    assert found == {0: [(-256 * 512, 50), (256 - 512 * 128, 6)], 50: [(-512 * 256, 0), (512, 6)]}
    assert topk.search(topk.integer_vectors(df.where("vec_id < 0")), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(topk.integer_vectors(df), F.lit(False)).count() == 0


def test_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(op2_topk(spark, "/root/testdata/sf0.001")) == brute(rows)
