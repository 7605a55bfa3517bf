import random
import re
from collections import Counter

from helpers import awkward, documents, empty

from ledgerloom.llm import quality
from ledgerloom.llm.queries import op10_quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def check(rows):
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(r["text"])


def test_base_rules_against_brute_force(spark):
    random.seed(4)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(200)]
    texts += ["x " * 5000, "same line\nsame line\n\n \nsame line", "a b\x1c c", "😀 # * | é" * 30, None, ""]
    check(quality.base_rules(documents(spark, texts), quality.QualityRules()).collect())


def test_query_on_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = op10_quality(spark, sf).join(texts, "doc_id").collect()
    check(rows)
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(k for q, k in judged if q) >= 0.99 * sum(q for q, _ in judged)
    assert sum(not k for q, k in judged if not q) >= 0.9 * sum(not q for q, _ in judged)


def test_awkward_and_empty(spark):
    rules = quality.QualityRules(buckets=64)
    flat = [0.0] * 64
    rows = quality.judge(awkward(spark), flat, rules).collect()
    assert len(rows) == 8 and sum(r["kept"] for r in rows) == 0
    assert quality.judge(empty(spark), flat, rules).count() == 0
    none = spark.createDataFrame([], "doc_id long")
    assert quality.fit(empty(spark), none, rules) == flat and quality.fit(awkward(spark), none, rules) == flat
