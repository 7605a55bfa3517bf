"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. A source that should contribute
``target`` words takes every document ``floor(target / size)`` times, and once
more those whose hash lies below a threshold. The thresholds come from
histograms: words are summed by (source, leading hash bits), a running sum finds
the bucket in which the budget runs out, and only that bucket is counted again
by its next bits, until it holds one hash. Thresholds for growing budgets are
nested, so a larger mix contains the smaller one, and no document is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, staged, text_or_empty

HASH_DIGITS = 15  # hexadecimal digits of the md5 that make the 60-bit hash


@dataclass(frozen=True)
class MixPlan:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # by rank of the source's name, repeating
    budget: float = 1.5  # words of the mix, as a share of all words
    cap: float = 2.0  # a source gives at most so many times its own words
    digits: int = 3  # hexadecimal digits of the hash that one histogram level resolves
    salt: str = "mix:"
    broadcast_sources: int = 50_000  # thresholds of more sources are joined by a shuffle


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def _hash(id_col: str, salt: str) -> Column:
    key = F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.substring(F.md5(key.cast("binary")), 1, HASH_DIGITS)


def source_targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """(skey, source_size, target): the budget shared by weight, capped, the excess reshared.

    The rank that deals the weights runs over one row per source. Resharing
    needs two sums over that table per round; a round caps at least one source.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in plan.weights])
    rank = (F.row_number().over(by) - 1) % len(plan.weights)
    sources = sizes.withColumn("w", F.get(cycle, rank)).withColumn("most", plan.cap * F.col("source_size"))
    sources = staged(sources.select("skey", "source_size", "w", "most"), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level = plan.budget * total, 0.0
    while True:
        above = F.col("w") * F.lit(level) > F.col("most")
        w, used = sources.agg(F.sum(F.when(~above, F.col("w"))), F.sum(F.when(above, F.col("most")))).first()
        new = (budget - (used or 0.0)) / w if w else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("w") * F.lit(level), F.col("most"))
    return sources.select("skey", "source_size", target.alias("target"))


def _near(docs: DataFrame, small: DataFrame, n: int, plan: MixPlan, how: str = "inner") -> DataFrame:
    return docs.join(F.broadcast(small) if n <= plan.broadcast_sources else small, "skey", how)


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, skey) for every row of ``docs``.

    Null text has size 0; a null source is a source of its own, ranked last.
    Rows that share an id share its hash: they are taken together. A document
    without words is never taken; texts of any length are counted whole. An empty
    table gives an empty result. Columns other than the three named are not read,
    whatever their names.
    """
    sized, targets, cuts, n = _planned(docs, plan, id_col, text_col, source_col)
    out = _near(sized, targets.join(cuts, "skey", "left"), n, plan)
    copies = copies_of("size", "h", "whole", "cut", "edge_in")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "skey")


def copies_of(size: str, h: str, whole: str, cut: str, edge_in: str) -> Column:
    """How often a document is taken: its source's whole rounds, and once more below the threshold."""
    once_more = F.coalesce((F.col(h) < F.col(cut)) | (F.col(edge_in) & F.col(h).startswith(F.col(cut))), F.lit(False))
    return F.when(F.col(size) > 0, F.col(whole) + once_more.cast("long")).otherwise(F.lit(0).cast("long"))


def plan_sources(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """(targets, thresholds, number of sources): what a mix of ``docs`` takes from each source."""
    return _planned(docs, plan, id_col, text_col, source_col)[1:]


def _planned(docs: DataFrame, plan: MixPlan, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    skey = F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col)))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        skey.alias("skey"),
        word_count(text_col).alias("size"),
        _hash(id_col, plan.salt).alias("h"),
    )
    sized = staged(sized, "mix-sizes")
    sizes = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, plan)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = staged(targets, "mix-targets")
    n = targets.count()
    return sized, targets, thresholds(sized, targets, n, plan), n


def thresholds(sized: DataFrame, targets: DataFrame, n: int, plan: MixPlan) -> DataFrame:
    """(skey, cut, edge_in): hashes below ``cut`` are taken, those that begin with it if ``edge_in``."""
    open_ = targets.where("need > 0").select("skey", F.lit("").alias("cut"), F.lit(0.0).alias("before"), "need")
    found = None
    for level in range(plan.digits, HASH_DIGITS + 1, plan.digits):
        inside = _near(sized.where("size > 0").select("skey", "h", "size"), open_, n, plan).where(F.col("h").startswith(F.col("cut")))
        prefix = F.substring("h", 1, level)
        hist = inside.groupBy("skey", prefix.alias("p"), "before", "need").agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        running = F.col("before") + F.sum("words").over(Window.partitionBy("skey").orderBy("p"))
        hist = hist.withColumn("upto", running)
        edge = hist.where("upto >= need and upto - words < need")
        edge = edge.withColumn("start", F.col("upto") - F.col("words")).withColumn("single", F.col("low") == F.col("high"))
        edge = staged(edge.select("skey", "p", "start", "upto", "need", "single"), f"mix-level{level}")
        closer = F.col("upto") - F.col("need") <= F.col("need") - F.col("start")
        last = level + plan.digits > HASH_DIGITS
        done = edge.where("true" if last else "single").select("skey", F.col("p").alias("cut"), closer.alias("edge_in"))
        found = done if found is None else found.unionByName(done)
        open_ = edge.where("not single").select("skey", F.col("p").alias("cut"), F.col("start").alias("before"), "need")
        if last or open_.isEmpty():
            break
    return found


def repeated(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns kept; rows not taken go.

    A row's copies follow from its hash, its size and its source's threshold, so
    the texts are never shuffled: the thresholds, one row per source, are joined.
    """
    taken = set(docs.columns)
    names = {n: next(x for k in range(len(taken) + 1) if (x := f"{n}_{k}") not in taken) for n in ("skey", "h", "size", "cut", "edge", "whole", "copies", "copy")}
    skey = F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col)))
    targets, cuts, n = plan_sources(docs, plan, id_col, text_col, source_col)
    small = targets.join(cuts, "skey", "left").select(*[F.col(a).alias(names[b]) for a, b in (("skey", "skey"), ("whole", "whole"), ("cut", "cut"), ("edge_in", "edge"))])
    df = docs.withColumns({names["skey"]: skey, names["h"]: _hash(id_col, plan.salt), names["size"]: word_count(text_col)})
    df = df.join(F.broadcast(small) if n <= plan.broadcast_sources else small, names["skey"])
    df = df.withColumn(names["copies"], copies_of(*[names[x] for x in ("size", "h", "whole", "cut", "edge")])).where(F.col(names["copies"]) > 0)
    return df.withColumn(names["copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copies"])))).select(*docs.columns)
