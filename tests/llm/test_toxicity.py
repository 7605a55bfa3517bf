import zlib

import pytest
from helpers import awkward, documents, empty

from ledgerloom.llm import toxicity
from ledgerloom.llm.queries import op7_toxicity

LEXICON = toxicity.Lexicon({"idiot": 3.0, "trash": 3.0}, {"moro": 2.0}, frozenset({"morose"}))


@pytest.mark.parametrize(
    ("clause", "want"),
    [
        ("you are an idiot", {"targeted": 3.0}),
        ("an idiot wrote code", {"plain": 3.0}),
        ("he is not an idiot", {"negated": 3.0}),
        ("not at all what an idiot does", {"plain": 3.0}),
        ("she said idiot", {"reported": 3.0}),
        ('the word "idiot" is old', {"reported": 3.0}),
        ("morons all round", {"plain": 2.0}),
        ("a morose mood", {}),
        ("i will kill you", {"targeted": 3.0}),
        ("kill the process", {}),
        ("idiots", {}),
    ],
)
def test_clauses(clause, want):
    found = toxicity.clause_features(clause, LEXICON)
    assert {c: w for c, w in found.items() if w} == want


def test_composition_is_the_chain_of_its_parts():
    one = toxicity.compose(toxicity.Transducer(0, 4, toxicity.negation))
    for (state, symbol), (after, out) in one.items():
        assert (after, out) == toxicity.negation(state, symbol)
    assert len(toxicity.GRAMMAR) == 4 * 3 * 2 * len(toxicity.ALPHABET)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)
    test = [(r["toxic"], r["predicted"], r["score"]) for r in rows if r["held_out"]]
    assert sum(p for y, p, _ in test if y) >= 0.85 * sum(y for y, _, _ in test)
    assert sum(p for y, p, _ in test if not y) <= 0.01 * sum(not y for y, _, _ in test)
    assert all(0 <= s <= 1 for _, _, s in test)


def test_only_the_text_counts(spark):
    model = toxicity.ToxicityModel(LEXICON, [0.4, 1, 1.3, 0.5, 0.5], -2.0)
    a = documents(spark, ["you idiot", "fine", None, ""])
    b = a.selectExpr("doc_id + 1000 as doc_id", "text", "'de' as lang", "'z' as source", "n_chars")
    scores = lambda df: [r["score"] for r in toxicity.score(df, model).orderBy("doc_id").collect()]
    assert scores(a) == scores(b) and scores(a)[0] > 0.5 > scores(a)[1] == scores(a)[2] == scores(a)[3]
    assert [r["doc_id"] for r in toxicity.drop_toxic(a, model).orderBy("doc_id").collect()] == [1, 2, 3]


def test_awkward_and_empty(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(awkward(spark), labels)
    assert toxicity.score(awkward(spark), model).count() == 8
    assert toxicity.drop_toxic(awkward(spark), model, 1.1).columns == awkward(spark).columns
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels.where("doc_id < 0"))).count() == 0
