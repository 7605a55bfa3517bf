import zlib
from collections import Counter

import pytest
from helpers import awkward, documents, empty

from ledgerloom.llm import packing
from ledgerloom.llm.queries import op3_packing, tokenizer_path

TEXTS = ["Hello, world. It's a test!!", "", None, "réeux ÄÖ ß é́ İ Σς 中文 ½ <|endoftext|> x<|endoftext|>.", "a b c " * 5000, "\x1c\x85 nbsp\xa0x   y", "don't they're we'll I'd 123 4.5 $$$ a### ''s"]


def ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [2]


def test_cuts_are_binary():
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        cut = packing.cuts(n)
        assert sum(cut) == n and all(c & (c - 1) == 0 and c <= 4096 for c in cut)


def test_pieces_give_the_tokenizers_ids_back(spark):
    rows = packing.pack(documents(spark, TEXTS), tokenizer_path()).collect()
    for i, text in enumerate(TEXTS):
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        found = b"".join(r["ids"] for r in mine)
        assert [int.from_bytes(found[k : k + 4], "little") for k in range(0, len(found), 4)] == ids(text)
        assert [r["start"] for r in mine] == [sum(r["length"] for r in mine[:k]) for k in range(len(mine))]
        assert {r["doc_tokens"] for r in mine} == {len(ids(text))}
    assert max(Counter(r["sequence_id"] for r in rows).values()) == 1 and {r["offset"] for r in rows} == {0}


def test_word_cache_may_overflow():
    small, large = (packing.WordIds(tokenizer_path(), most) for most in (3, 10_000))
    words = packing.split_words("one two, three. four five six one two, seven eight nine ten one")
    assert [small[w] for w in words] == [large[w] for w in words]


def test_portions_hold_every_row_once():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 5, None, "", "b" * 30, "c" * 4, "d" * 4, "e"])], names=["i", "t"])
    for most in (1, 8, 9, 1000):
        got = [p.column(0).to_pylist() for p in packing.portions(batch, 1, most)]
        assert sum(got, []) == list(range(7)) and all(len(g) == 1 or sum(len(batch.column(1)[i].as_py() or "") for i in g) <= most for g in got)


def test_awkward_and_empty(spark):
    rows = packing.pack(awkward(spark), tokenizer_path()).collect()
    assert sum(r["start"] == 0 for r in rows) == 8
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty(spark), tokenizer_path(), window=1000)


def test_query(spark):
    for r in op3_packing(spark, "/root/testdata/sf0.001").where("doc_id < 20").collect():
        assert r["ids_crc32"] < 2**32 and r["offset"] == 0
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 3").first()["text"]
    mine = ids(text)
    for r in op3_packing(spark, "/root/testdata/sf0.001").where("doc_id = 3").collect():
        part = b"".join(x.to_bytes(4, "little") for x in mine[r["start"] : r["start"] + r["length"]])
        assert zlib.crc32(part) == r["ids_crc32"]
