import random

import numpy as np
import pytest
from helpers import awkward, documents, empty

from ledgerloom.llm import simhash


def signed(x):
    return int(np.uint64(x).astype(np.int64))


def truth(fps, distance=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprint_follows_the_definition():
    from xxhash import xxh64

    text = "The quick brown\tfox JUMPS over\nthe lazy dog the quick brown fox"
    words = text.lower().split()
    hashes = [xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Two Words") == xxh64(b"two words", seed=42).intdigest()
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("r", [6, 7, 8, 9])
def test_close_fingerprints_share_a_key(spark, r):
    random.seed(r)
    rows = []
    for i in range(300):
        a = random.getrandbits(64)
        b = a
        for bit in random.sample(range(64), 4):
            b ^= 1 << bit
        rows += [(i, signed(a)), (i, signed(b))]
    from pyspark.sql import functions as F

    keys = spark.createDataFrame(rows, "i long, fp long").select("i", "fp", F.explode(simhash.block_keys(F.col("fp"), r, 4)).alias("key"))
    assert keys.groupBy("i", "key").agg(F.count_distinct("fp").alias("n")).where("n = 2").select("i").distinct().count() == 300


@pytest.mark.parametrize(("hot", "chunk"), [(64, 2048), (8, 50)])
def test_components_of_a_dense_group(spark, hot, chunk):
    random.seed(1)
    fps = {random.getrandbits(64)}
    centre = next(iter(fps))
    while len(fps) < 400:
        x = random.choice([centre, *list(fps)[:20]])
        for b in random.sample(range(64), random.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    fps |= {random.getrandbits(64) for _ in range(200)}
    want = truth(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = dict(simhash.components(simhash.links(df, hot=hot, chunk=chunk)).collect())
    got = {f: roots.get(signed(f), signed(f)) for f in fps}
    assert len(set(want.values())) == len(set(got.values())) == len({(want[f], got[f]) for f in fps})


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    roots = dict(simhash.components(edges).collect())
    assert {roots[i] for i in range(61)} == {0} and roots[101] == 100
    assert simhash.components(edges.where("a < 0")).count() == 0


def test_near_duplicates(spark):
    random.seed(2)
    base = " ".join(random.choice("abcdefghij") + str(random.randint(0, 500)) for _ in range(400))
    texts = [base, base, base.replace("a1 ", "a2 ", 1), base.upper(), "quite another text of some words", "", None]
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    want = truth({simhash.fingerprint(t) for t in texts})
    for i, t in enumerate(texts):
        assert rows[i]["fp"] == signed(simhash.fingerprint(t))
        assert rows[i]["component_id"] == min(j for j, u in enumerate(texts) if want[simhash.fingerprint(u)] == want[simhash.fingerprint(t)])
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, texts)).collect()}
    assert kept == {r["component_id"] for r in rows.values()}


def test_awkward_and_empty(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 8
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    nulls = documents(spark, ["one lone text", "another text altogether, long"]).selectExpr("cast(null as long) doc_id", "text", "source")
    assert simhash.keep_one(nulls).count() == 2 and simhash.keep_one(nulls.union(nulls)).count() == 2
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0
