import random
import zlib

import numpy as np
import pytest
from helpers import awkward, documents, empty
from pyspark.sql import functions as F

from ledgerloom.llm import packing, tokenfile
from ledgerloom.llm.common import shared_dir
from ledgerloom.llm.queries import op11_tokenfile, tokenizer_path

TEXTS = ["Hello, world. It's a test!!", "", None, "réeux ÄÖ ß é́ İ Σς 中文 ½ <|endoftext|> x<|endoftext|>.", "a b c " * 5000, "\x1c\x85 nbsp\xa0x   y", " \t\r\n\v\f lead  and trail \n"]


def ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


def bits_by_hand(values, bits):
    whole = sum(int(v) << k * bits for k, v in enumerate(values))
    return whole.to_bytes(-(-len(values) * bits // 8), "little")


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 31, 32])
def test_bits_are_one_little_endian_stream_and_come_back_from_anywhere(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        data = tokenfile.pack_bits(values, bits)
        assert data == bits_by_hand(values, bits)
        for low, high in ((0, n), (n // 3, n // 2), (n, n), (max(n - 1, 0), n)):
            assert tokenfile.unpack_bits(data, bits, high - low, low).tolist() == values[low:high].tolist()


def written(spark, docs, name, **more):
    import uuid

    return tokenfile.write(docs, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", tokenizer_path(), **more)


def by_hand(rows):
    """(doc_id, start, n_tokens, ids_crc32, ids) in ascending order of doc_id."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        mine = np.array(ids(text), "<u4").tobytes()
        out.append((doc_id, start, len(mine) // 4, zlib.crc32(mine), mine))
        start += len(mine) // 4
    return out


@pytest.mark.parametrize(("block_ids", "files"), [(1, 3), (64, 2), (65_536, None)])
def test_round_trip(spark, block_ids, files):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(60)]
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = written(spark, docs, "round", block_ids=block_ids, files=files)
    got = tokenfile.read(spark, path).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got] == by_hand(rows)


def test_any_range_of_ids(spark):
    rows = list(enumerate(TEXTS * 4))
    path = written(spark, spark.createDataFrame(rows, "doc_id long, text string"), "range", block_ids=500, files=3)
    everything = np.frombuffer(b"".join(r[4] for r in by_hand(rows)), "<u4").tolist()
    for start, count in ((0, 10), (7, 20_000), (len(everything) - 5, 50), (len(everything), 5), (3, 0)):
        found = sorted(tokenfile.read_range(spark, path, start, count).collect())
        assert [i for r in found for i in r["ids"]] == everything[start : start + count]
        assert not found or found[0]["start"] == start


def test_the_fewest_bits_of_the_vocabulary(spark):
    path = written(spark, documents(spark, ["one", "two"]), "bits")
    assert {(r["bits"], len(r["data"])) for r in spark.read.parquet(f"{path}/blocks").collect()} == {(16, 2 * r) for r in [4]}
    assert packing.TextIds(tokenizer_path(), 70_000).bits == 17


def test_awkward_and_empty(spark):
    df = awkward(spark)
    path = written(spark, df, "awkward")
    got = tokenfile.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4, 4, 5] and sum(r["n_tokens"] == 1 for r in got) == 4
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in got:
        assert bytes(r["ids"]) == np.array(ids(texts[r["doc_id"]]), "<u4").tobytes()
    path = written(spark, empty(spark), "empty")
    assert tokenfile.read(spark, path).count() == 0 and tokenfile.read_range(spark, path, 0, 10).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_tokenfile(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [r[:4] for r in by_hand(rows)]
    assert op11_tokenfile(spark, sf).where(F.col("ids_crc32") < 0).count() == 0
