import hashlib
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import clustering
from ledgerloom.llm.queries import ORACLE_SQL, op13_clustering

def seed():
    return F.expr("sha2(concat('3:', cast(vec_id as string)), 256)")

SCHEMA = "vec_id long, embedding array<double>, cluster string, x string"


def by_hand(rows, k=8, rounds=10):
    rows = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(rows, key=key)[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(place(v)[1], []).append(v)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *place(v)) for i, v in rows]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found)


def got(df):
    return Counter(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_partial_distances_lose_nothing_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(2)
    for step in (1, 3, 8, 100):
        x, c = rng.integers(-3, 4, (500, 10)), rng.integers(-3, 4, (7, 10))
        c[5] = c[2]
        d = np.square(x[:, None] - c[None]).sum(axis=2)
        which, best = clustering.nearest(x, c, rng.permutation(10), step)
        assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_against_plain_python_with_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.normal(size=64), 1).tolist()) for i in range(60)]
    rows += [rows[4]] * 10 + [(100 + i, rows[4][1]) for i in range(20)] + [(None, rows[9][1])]
    bad = [(200, None), (201, [1.0] * 63), (202, [1.0] * 65), (203, [math.nan] * 64), (204, [None] * 64), (205, [math.inf] * 64), (206, [])]
    df = spark.createDataFrame([(*r, "c", "x") for r in rows + bad], SCHEMA).repartition(5)
    assert got(clustering.cluster(df, seed())) == by_hand(rows)
    small = clustering.Clustering(clusters=3, rounds=2, rows=7, step=5)
    assert got(clustering.cluster(df, seed(), settings=small)) == by_hand(rows, 3, 2)


def test_few_equal_or_no_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(20)]
    for rows in (same, same[:3], same[:1], []):
        df = spark.createDataFrame([(*r, "c", "x") for r in rows], SCHEMA)
        assert got(clustering.cluster(df, seed())) == (by_hand(rows) if rows else Counter())
    with pytest.raises(ArithmeticError):
        clustering.cluster(spark.createDataFrame([(1, [1e9] * 64, "c", "x")], SCHEMA), seed())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    table = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    mine = got(op13_clustering(spark, sf))
    assert mine == by_hand(table)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(sf, 'embeddings.parquet')}'")
    rows = con.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({ORACLE_SQL['op13_clustering']})").fetchall()
    assert Counter(rows) == mine
