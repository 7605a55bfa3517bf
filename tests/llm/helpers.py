"""Small tables, and documents with everything that has gone wrong somewhere."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "a", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    long = "word " * 30_000 + "x" * 50_000
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (None, "plain text here", "en", "b", 3), (4, "plain text here", None, "b", 3), (4, "plain text here", None, "b", 3), (5, " \t\n", "en", None, 3)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("size", "score", "fp", "fp_0", "spans", "spans_0", "h", "h_0", "copies_0", "skey_0", "ids", "start", "findings", "grams", "w"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def truth(texts, least=0.8):
    """The smallest index of each component of texts by brute force."""
    root = list(range(len(texts)))
    sets = [grams(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return set(root)
