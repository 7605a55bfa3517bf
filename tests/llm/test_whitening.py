import math
from decimal import Decimal

import numpy as np
import pytest

from ledgerloom.llm import whitening
from ledgerloom.llm.queries import op12_whitening


def by_hand(vectors, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors])
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum(int(d) ** 2 for d in n * row.astype(object) - sums) for row in x]
    c = (n * x - sums) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return n, deviation, c @ turn / np.sqrt(values), values / (np.square(c).sum() / n)


def compare(rows, ids, vectors, k=8):
    n, deviation, white, shares = by_hand(vectors, k)
    at = {i: j for j, i in enumerate(ids)}
    got = np.full((n, k), np.nan)
    for r in rows:
        j, c = at[r["vec_id"]], r["component"] - 1
        got[j, c] = r["whitened"]
        assert r["n"] == n and int(r["deviation"]) == deviation[j] and abs(r["explained"] / shares[c] - 1) < 1e-6 and r["identity_error"] < 1e-4
    sign = np.sign((got * white).sum(axis=0))
    assert not np.isnan(got).any() and np.abs(got - white * sign).max() < 1e-6
    assert np.abs(np.cov(got.T, bias=True) - np.eye(k)).max() < 1e-9


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = op12_whitening(spark, sf)
    assert dict(rows.dtypes)["deviation"] == "bigint"
    compare(rows.collect(), [r[0] for r in table], [r[1] for r in table])


def test_lanczos_stops_early_where_the_spectrum_falls_and_finds_equal_eigenvalues():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    for values, most in ((0.5 ** np.arange(200.0), 6), (np.r_[np.full(20, 7.0), np.ones(180)], 3), (np.full(200, 3.0), 1)):
        a = (turn * values) @ turn.T
        found, vectors, passes = whitening.lanczos(lambda q, a=a: a @ q, 200)
        assert np.allclose(found, np.sort(values)[::-1][:8]) and passes <= most
        assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12 and np.abs(a @ vectors - vectors * found).max() < 1e-10


def test_lanczos_restarts_on_breakdown_and_spans_small_spaces():
    for values in (np.r_[5.0, 4.0, np.zeros(28)], np.zeros(30), np.arange(30.0)):
        a = np.diag(values)
        found, vectors, _ = whitening.lanczos(lambda q, a=a: a @ q, 30, whitening.Whitening(components=3, block=3))
        assert np.allclose(found, np.sort(values)[::-1][:3]) and np.abs(vectors.T @ vectors - np.eye(3)).max() < 1e-12
    assert len(whitening.lanczos(lambda q: 2.0 * q, 1)[0]) == 1


SCHEMA = "vec_id long, embedding array<double>, component string, n string, x string"


def test_odd_vectors_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    good = [(None if i == 3 else i, rng.normal(size=5).tolist()) for i in range(40)]
    good += [good[7], (99, good[7][1])]
    bad = [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [math.nan] * 5), (53, [math.inf] * 5)]
    short = [(60, [0.5, 0.25]), (61, [])]
    df = spark.createDataFrame([(*r, "c", "n", "x") for r in good + bad + short], SCHEMA)
    rows = whitening.whiten(df).collect()
    filled = [*good, (60, [0.5, 0.25, 0, 0, 0]), (61, [0.0] * 5)]
    assert len(rows) == 5 * len(filled)
    once = [r for r in rows if r["vec_id"] != 7] + [r for r in rows if r["vec_id"] == 7][:5] * 2
    assert len(once) == len(rows)
    n, deviation, _, _ = by_hand([v for _, v in filled], 5)
    assert sorted(int(r["deviation"]) for r in rows if r["component"] == 1) == sorted(deviation) and rows[0]["n"] == n


def test_nothing_to_scale(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], "", "", "") for i in range(9)], SCHEMA)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}
    with pytest.raises(ArithmeticError):
        whitening.whiten(spark.createDataFrame([(i, [1e12 * i], "", "", "") for i in range(9)], SCHEMA))


def test_deviations_are_exact_beyond_doubles(spark):
    rows = [(i, [1e4 * i * i, 3e4 * i], "", "", "") for i in range(50)]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: Decimal(d) for i, d in enumerate(by_hand([r[1] for r in rows], 2)[1])}
