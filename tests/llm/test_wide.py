import random

import numpy as np
import pytest
from helpers import DOCS, awkward, documents, empty, grams, truth

import corpus_pipeline
from ledgerloom.llm import simhash, wide


def variants(n, seed=3, words=120):
    """Texts around common bases, from near copies to mere relatives."""
    random.seed(seed)
    bases = [[f"w{random.randint(0, 5000)}" for _ in range(words)] for _ in range(6)]
    texts = []
    for _ in range(n):
        text = list(random.choice(bases))
        for _ in range(random.randint(0, 5)):
            text[random.randrange(words)] = f"x{random.randint(0, 10**6)}"
        texts.append(" ".join(text))
    return texts


def test_the_stage_drops_a_copy_of_similarity_083_that_is_many_bits_away(spark):
    for seed in range(100):
        random.seed(seed)
        words = [f"w{random.randint(0, 5000)}" for _ in range(115)]
        other = [*words[:30], "new", *words[31:80], "newer", *words[81:]]
        a, b = " ".join(words), " ".join(other)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 4:
            break
    assert 0.8 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) < 0.85
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, [a, b, "something else altogether"]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


@pytest.mark.parametrize("plan", [{}, {"crowd": 1, "chunk": 700}, {"crowd": 4, "hot": 5, "side": 900}])
def test_components_are_those_of_brute_force(spark, plan):
    texts = variants(90)
    want = truth(texts)
    assert 10 < len(want) < 80
    assert {r["doc_id"] for r in wide.keep_one(documents(spark, texts), **plan).select("doc_id").collect()} == want


def test_blocks_follow_from_the_chance_of_a_miss():
    for n in (2, 10**5, 10**9):
        width, number = wide.blocks_for(n)
        assert (1 - wide.agreement() ** width) ** number <= wide.MISS < (1 - wide.agreement() ** width) ** (number - 1)
    assert wide.blocks_for(10**9)[0] == 22


def test_bits_agree_as_often_as_the_angle_says():
    rng = np.random.default_rng(1)
    for shared in (80, 160):
        differ = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, shared * 5 // 4, np.uint64)
            extra = len(pool) - shared
            a, b = pool[: shared + extra // 2], np.concatenate([pool[:shared], pool[shared + extra // 2 :]])
            differ.append((wide.bits_of(a, 8) ^ wide.bits_of(b, 8)).mean())
        assert abs(np.mean(differ) - (1 - wide.agreement())) < 0.012


def test_choice_among_rows_of_one_id(spark):
    rows = [(1, "b  a", "en", "x", 1), (1, "b a", "en", "z", 1), (1, "b a", "en", "y", 1), (2, "B A", "en", "x", 1), (None, "c", "en", "x", 1), (None, "c", "en", "x", 1)]
    for _ in range(2):
        kept = wide.keep_one(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "c"), (1, "b  a")]


def test_similarity_of_just_080_is_enough(spark):
    a = "a b c d e f g h"  # four shingles, all among the five of the longer text
    kept = wide.keep_one(documents(spark, [a, a + " i", "A  b c\td e f g h", "a b c d e f g x y"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


def test_awkward_and_empty(spark):
    kept = wide.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert wide.keep_one(empty(spark)).count() == 0
