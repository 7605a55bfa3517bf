import re

import pytest
from helpers import awkward, documents, empty

from ledgerloom.llm import licences
from ledgerloom.llm.queries import op9_licences


@pytest.mark.parametrize(
    ("text", "labels", "freedom"),
    [
        ("MIT", ["mit"], 1.0),
        ("MIT OR GPL-2.0-only", ["mit", "gpl"], 1.0),
        ("MIT AND GPL-2.0-only", ["mit", "gpl"], 0.4),
        ("(MIT OR GPL-3.0-or-later) AND CC-BY-NC-4.0", ["mit", "gpl", "cc-by-nc"], 0.1),
        ("GPL-2.0-only WITH Classpath-exception-2.0", ["gpl"], 0.6),
        ("MIT OR GPL-2.0-only AND CC-BY-NC-4.0", ["mit", "gpl", "cc-by-nc"], 1.0),
        ("Apache-2.0 and some prose follows", ["apache", "some"], 0.5),
        ("MIT */", ["mit"], 1.0),
    ],
)
def test_expressions(text, labels, freedom):
    found = licences.parse_expression(text)
    assert found.labels == labels and found.freedom == freedom and found.valid


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "MIT AND OR GPL-2.0", ")", "()", "(" * 5000])
def test_bad_expressions(text):
    assert not licences.parse_expression(text).valid


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licences.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_base_places_against_brute_force(spark):
    for r in op9_licences(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        n, places = base(r["text"])
        assert r["n_words"] == n and r["n_base"] == len(places)
        assert r["first_word"] == (places[0][0] if places else None) and r["last_word"] == (places[-1][0] if places else None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_findings(spark):
    texts = ["MIT\nLicense; the mit-license", "submit license", "Licensed under CC BY-NC 4.0.", "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nGNU General Public License", "mit license " * 3000, None]
    rows = {r["doc_id"]: r for r in licences.scan(documents(spark, texts)).collect()}
    assert [(f["label"], f["word"]) for f in rows[0]["findings"]] == [("mit", 0), ("mit", 3)]
    assert rows[1]["findings"] == []
    assert [f["label"] for f in rows[2]["findings"]] == ["cc-by-nc"] and rows[2]["score"] == 0.1
    assert rows[3]["tag_labels"] == ["apache", "mit"] and rows[3]["score"] == 0.4
    assert len(rows[4]["findings"]) == 3000 and rows[4]["findings"][-1]["word"] == 5998
    assert rows[5]["n_words"] == 0 and rows[5]["score"] == 0.5


def test_awkward_and_empty(spark):
    assert licences.scan(awkward(spark)).count() == 8
    assert licences.scan(empty(spark)).count() == 0
