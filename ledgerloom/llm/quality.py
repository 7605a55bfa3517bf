"""Quality rules: repetition rules, then a hashed n-gram log-likelihood ratio. SQL functions only.

Two multinomials over hashed word and mark n-grams (orders 1 and 2) are counted:
one over all documents, one over trusted documents. A document's score is the
mean over its n-grams of log p(trusted) - log p(corpus); it is kept when the base
rules pass and the score reaches a fixed threshold, the same for every document.
The model is one array of ``buckets`` numbers, whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE, text_or_empty

#: A token of the n-grams: a run of letters and digits, or a run of marks.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 1 << 16
    smoothing: float = 1.0
    threshold: float = -0.25  # mean log-likelihood ratio
    least_words: int = 20
    most_repeated: int = 30  # percent of words in repeated windows
    trusted: int = 200_000  # at most about so many trusted documents make the target model


def grams(text_col: str, rules: QualityRules) -> Column:
    """The buckets of a text's token n-grams of orders 1 and 2."""
    tokens = F.regexp_extract_all(text_or_empty(text_col), F.lit(TOKEN), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    return hashes


def _bucket(h: Column, rules: QualityRules) -> Column:
    return h.bitwiseAND(F.lit(rules.buckets - 1)).cast("int")


def _pairs(col: str) -> Column:
    """Hashes of neighbouring tokens."""
    ahead = F.slice(F.col(col), 2, F.greatest(F.size(col) - 1, F.lit(0)))
    both = F.zip_with(F.slice(F.col(col), 1, F.size(ahead)), ahead, lambda a, b: F.xxhash64(a, b))
    return both


def trusted_ids(labels: DataFrame, rules: QualityRules, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The ids labelled 1, thinned by hash to about ``rules.trusted`` where there are more."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    one_in = -(-good.count() // rules.trusted)
    return good.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(one_in, 1))) == 0)


def fit(docs: DataFrame, trusted: DataFrame, rules: QualityRules, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The weight of each bucket. Corpus counts run over all documents.

    ``trusted`` is bounded by ``rules.trusted`` ids and is broadcast; the counts
    come back as one row per bucket.
    """
    marked = docs.select(F.col(id_col).alias("doc_id"), grams(text_col, rules).alias("h")).join(F.broadcast(trusted.withColumn("good", F.lit(1))), "doc_id", "left")
    marked = marked.select("good", F.explode(F.concat("h", _pairs("h"))).alias("g"))
    counts = marked.groupBy(_bucket(F.col("g"), rules).alias("bucket")).agg(F.count("*").alias("raw"), F.count("good").alias("good"))
    raw, good = [0] * rules.buckets, [0] * rules.buckets
    for row in counts.collect():
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["good"]
    a, all_raw, all_good = rules.smoothing, sum(raw), sum(good)
    base_raw, base_good = log(all_raw + a * rules.buckets), log(all_good + a * rules.buckets)
    if not all_good:
        return [0.0] * rules.buckets
    return [round((log(g + a) - base_good) - (log(r + a) - base_raw), 5) for g, r in zip(good, raw, strict=True)]


def score(col: str, weights: list[float], rules: QualityRules) -> Column:
    """Mean weight of the n-grams of the token hashes in ``col``; 0 without tokens."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    add = lambda acc, g: acc + F.get(table, _bucket(g, rules))
    total = F.aggregate(_pairs(col), F.aggregate(F.col(col), F.lit(0.0), add), add)
    return F.when(F.size(col) > 0, total / (2 * F.size(col) - 1)).otherwise(F.lit(0.0))


def repeated_words(col: str) -> Column:
    """How many words lie in windows of ``WINDOW`` words that occur twice or more.

    ``col``: the windows' hashes with their places, sorted, or null where none repeats.
    """
    ahead = F.concat(F.slice(F.col(col), 2, F.greatest(F.size(col) - 1, F.lit(0))), F.array(F.lit(None)))
    both = F.zip_with(F.col(col), ahead, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(both, lambda p: p.isNotNull()))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end"))
    return F.coalesce(F.aggregate(places, start, step, lambda acc: acc["n"]), F.lit(0)).cast("long")


def base_rules(docs: DataFrame, rules: QualityRules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text_or_empty(text_col)
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), words.alias("w"), lines.alias("lines"))
    df = df.select(
        "doc_id", "text",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text_or_empty("text"), F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("wh"),
    )
    whole = F.slice(F.col("wh"), 1, F.greatest(F.size("wh") - (WINDOW - 1), F.lit(0)))
    windows = whole
    for k in range(1, WINDOW):
        ahead = F.slice(F.col("wh"), k + 1, F.greatest(F.size("wh") - (WINDOW - 1), F.lit(0)))
        windows = F.zip_with(windows, ahead, lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("win", windows).drop("wh")
    placed = F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("twice", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(placed))).drop("win")
    df = df.withColumn("n_repeat_words", repeated_words("twice")).drop("twice")
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def judge(docs: DataFrame, weights: list[float], rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept for every row of ``docs``.

    Null text has no words and fails the base rules; a text without tokens has an
    ``llr`` of 0. Texts of any length are read whole. Rows that share an id are judged
    each for itself; an empty table gives an empty result; other columns are not read.
    """
    df = base_rules(docs, rules, id_col, text_col)
    df = df.withColumn("grams", grams("text", rules)).drop("text")
    df = df.withColumn("llr", score("grams", weights, rules)).drop("grams")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= rules.threshold))
