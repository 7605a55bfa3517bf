"""Matching line items to ledger rows inside a document. Amounts are whole cents.

Every join carries the document and a stretch of amounts as equality keys, so a
large document is spread and an item meets only the rows near its amount. The greedy
one-to-one assignment settles what can reach nothing else at once, and the rest in rounds.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money, text
from ledgerloom.operators.reservations import reserve
from ledgerloom.staging import staged

ITEM = {"item_id": "item_id", "cents": "item_cents", "description": "item_desc"}
ROW = {"row_id": "row_id", "cents": "row_cents", "description": "row_desc"}


def _sides(items: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = items.select("docno", *[F.col(a).alias(b) for a, b in ITEM.items()])
    return left, ledger.select("docno", *[F.col(a).alias(b) for a, b in ROW.items()])


def near(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tol: int, placed: bool = False) -> DataFrame:
    """Pairs of equal ``keys`` whose amounts ``a`` and ``b`` are at most ``tol`` apart; a row of ``left`` meets two stretches of amounts. ``placed``: with the ``stretch`` where they met."""
    width = F.lit(2 * tol + 1)
    ends = F.array_distinct(F.array(F.floor((F.col(a) - tol) / width), F.floor((F.col(a) + tol) / width)))
    pairs = left.withColumn("stretch", F.explode(ends)).join(right.withColumn("stretch", F.floor(F.col(b) / width)), [*keys, "stretch"])
    pairs = pairs.where(F.abs(F.col(a) - F.col(b)) <= tol)
    return pairs if placed else pairs.drop("stretch")


def near_by_share(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tol: int, pct: int, placed: bool = False) -> DataFrame:
    """Pairs of equal ``keys`` whose amounts are at most ``tol`` cents or ``pct`` percent of ``a`` apart.

    A row of ``left`` looks at stretches as wide as its own reach, rounded up to a power
    of two; rows of ``right`` are put into stretches of the widths that occur, some forty at most. ``placed``: with the ``level`` and ``stretch`` where they met.
    """
    if not pct:
        return near(left, right, keys, a, b, tol, placed)
    reach = F.greatest(F.lit(tol).cast("long"), F.floor(F.abs(F.col(a)) * pct / 100).cast("long"))
    left = left.where(F.col(a).isNotNull()).withColumn("reach", reach).withColumn("level", F.length(F.bin(2 * F.col("reach"))))
    width = F.pow(F.lit(2), F.col("level")).cast("long")
    ends = F.array_distinct(F.array(F.floor((F.col(a) - F.col("reach")) / width), F.floor((F.col(a) + F.col("reach")) / width)))
    levels = [r[0] for r in left.select("level").distinct().collect()]
    right = right.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("stretch", F.floor(F.col(b) / width))
    pairs = left.withColumn("stretch", F.explode(ends)).join(right, [*keys, "level", "stretch"])
    pairs = pairs.where(F.abs(F.col(a) - F.col(b)) <= F.col("reach")).drop("reach")
    return pairs if placed else pairs.drop("level", "stretch")


def candidates(items: DataFrame, ledger: DataFrame, tol: int, pct: int = 0) -> DataFrame:
    """Pairs of item and ledger row of one document whose amounts agree (docno, item_*, row_*)."""
    return near_by_share(*_sides(items, ledger), ["docno"], "item_cents", "row_cents", tol, pct)


def nearest_amount(items: DataFrame, ledger: DataFrame, tol: int | None = None) -> DataFrame:
    """The row with the nearest amount for each item; equals go to the smaller row_id. Items and rows without an amount take no part.

    Without ``tol`` items and rows are sorted together by amount, and the row before
    and the row behind an item are compared; no pairs are made.
    """
    left, right = _sides(items, ledger)
    if tol is not None:
        pairs = near(left, right, ["docno"], "item_cents", "row_cents", tol).withColumn("apart", F.abs(F.col("row_cents") - F.col("item_cents")))
        best = pairs.groupBy("docno", "item_id").agg(F.min(F.struct("apart", "row_id", "row_cents")).alias("b"))
        return best.select("docno", "item_id", "b.row_id", "b.row_cents", "b.apart")
    rows = right.where("row_cents is not null").groupBy("docno", "row_cents").agg(F.min("row_id").alias("row_id"))
    points = rows.select("docno", F.col("row_cents").alias("cents"), F.struct("row_id", "row_cents").alias("row"), F.lit(None).alias("item_id"))
    points = points.unionByName(left.where("item_cents is not null").select("docno", F.col("item_cents").alias("cents"), F.lit(None).alias("row"), "item_id"))
    upto = lambda order: F.last("row", ignorenulls=True).over(Window.partitionBy("docno").orderBy(order, F.col("item_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = points.withColumn("below", upto(F.asc("cents"))).withColumn("above", upto(F.desc("cents"))).where("item_id is not null")
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.row_cents") - F.col("cents")).alias("apart"), F.col(f"{c}.row_id").alias("row_id"), F.col(f"{c}.row_cents").alias("row_cents")))
    return placed.withColumn("b", F.least(option("below"), option("above"))).where("b is not null").select("docno", "item_id", "b.row_id", "b.row_cents", "b.apart")


def best_coverage(items: DataFrame, ledger: DataFrame, tol: int) -> DataFrame:
    """Of the rows whose amount agrees the one whose description is covered best; equals go to the smaller row_id."""
    pairs = candidates(items, ledger, tol).withColumn("score", F.round(text.coverage(F.col("item_desc"), F.col("row_desc")) * 100, 1))
    best = pairs.groupBy("docno", "item_id").agg(F.max(F.struct("score", -F.col("row_id"))).alias("b"))
    return best.select("docno", "item_id", (-F.col("b.col2")).alias("row_id"), "b.score")


def gross_up_match(items: DataFrame, ledger: DataFrame, tol: int, pct: int = 109) -> DataFrame:
    """Nearest row to an item's amount with tax on top, within ``tol``."""
    return nearest_amount(items.withColumn("cents", money.gross_up(F.col("cents"), pct)), ledger, tol)


def amount_islands(items: DataFrame, ledger: DataFrame, tol: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``island``: rows of different islands are more than ``tol`` apart.

    Occupied stretches of ``tol + 1`` cents that touch form an island. Stretches
    are counted first, so a document brings one row per stretch to the window.
    """
    stretch = F.floor(F.col("cents") / F.lit(tol + 1))
    both = items.select("docno", stretch.alias("s")).unionByName(ledger.select("docno", stretch.alias("s"))).distinct()
    order = Window.partitionBy("docno").orderBy("s")
    starts = both.withColumn("new", (F.col("s") - F.lag("s").over(order) > 1).cast("int"))
    island = starts.select("docno", "s", F.coalesce(F.sum("new").over(order), F.lit(0)).alias("island"))
    put = lambda df: df.withColumn("s", stretch).join(island, ["docno", "s"]).drop("s")
    return put(items), put(ledger)


def nearest_free(free: list[tuple[int, int]], cents: int) -> tuple[int, int] | None:
    """Of the sorted (cents, id) the nearest to ``cents``; equals go to the smaller id."""
    at = bisect_left(free, (cents, -(2**63)))
    options = free[at : at + 1]
    if at:
        options.append(free[bisect_left(free, (free[at - 1][0], -(2**63)))])
    return min(options, key=lambda x: (abs(x[0] - cents), x[1]), default=None)


def greedy_assign(items: DataFrame, ledger: DataFrame, tol: int) -> DataFrame:
    """One-to-one: items in order take the nearest free row within ``tol`` (docno, item_id, row_id).

    Items of one amount are a class; classes meet the rows near them once, and these pairs are
    written once. An item and a row that can reach nothing else are settled by that, all
    others by rounds of reservations. Documents, classes and rows are spread.
    """
    left = items.select("docno", "item_id", F.col("cents").alias("item_cents"))
    right = ledger.select("docno", "row_id", F.col("cents").alias("row_cents"))
    amounts = left.groupBy("docno", "item_cents").agg(F.min("item_id").alias("klass"), F.count("*").alias("n_items"))
    pairs = near(amounts, right, ["docno"], "item_cents", "row_cents", tol).withColumn("apart", F.abs(F.col("item_cents") - F.col("row_cents")))
    within = lambda c: F.count("*").over(Window.partitionBy("docno", c))
    pairs = staged(pairs.drop("row_cents").withColumn("n_rows", within("klass")).withColumn("n_classes", within("row_id")), "greedy-pairs")
    alone = (F.col("n_items") == 1) & (F.col("n_rows") == 1) & (F.col("n_classes") == 1)
    easy, crowded = pairs.where(alone).select("docno", F.col("klass").alias("item_id"), "row_id"), pairs.where(~alone)
    classes = crowded.select("docno", "item_cents", "klass", "n_items").distinct()
    members = classes.where("n_items = 1").select("docno", F.col("klass").alias("item_id"), "klass")
    members = members.unionByName(left.join(classes.where("n_items > 1"), ["docno", "item_cents"]).select("docno", "item_id", "klass"))
    rank = F.row_number().over(Window.partitionBy("docno", "klass").orderBy("apart", "row_id"))
    rest = reserve(members, crowded.select("docno", "klass", F.col("row_id").alias("row"), rank.alias("rank")))
    return easy.unionByName(rest.select("docno", "item_id", F.col("row").alias("row_id")))


def exact_assign(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """One-to-one for equal amounts: the n-th item of an amount takes the n-th row of it. No Python."""
    nth = lambda df, i: df.withColumn("nth", F.row_number().over(Window.partitionBy("docno", "cents").orderBy(i)))
    pairs = nth(items.select("docno", "cents", "item_id"), "item_id").join(nth(ledger.select("docno", "cents", "row_id"), "row_id"), ["docno", "cents", "nth"])
    return pairs.select("docno", "item_id", "row_id", "cents")


#: Documents of more rows are busy: their items meet rows by stretches of amounts, those of the others meet all rows of the document.
BUSY = 64
BEST = ["exact", "near", "score", "after"]


def _option(item_cents: Column, item_desc: Column, row: Column) -> Column:
    """How well a row, a struct of ``ROW``, suits an item: struct in which the larger is the better, then the row itself."""
    # Most texts are alike as they are, which needs no pattern.
    same = F.equal_null(item_desc, row["row_desc"]) | (text.normal_text(item_desc) == text.normal_text(row["row_desc"]))
    cover = F.round(text.coverage(item_desc, row["row_desc"]) * 100, 1)

    def option(s: Column) -> Column:
        near = F.when(s, -F.abs(row["row_cents"] - item_cents)).otherwise(F.lit(0).cast("long"))
        order = [s.cast("int"), near, F.when(s, 100.0).otherwise(cover), -row["row_id"]]
        return F.struct(*[c.alias(n) for c, n in zip(order, BEST, strict=True)], row["row_id"].alias("row_id"), row["row_desc"].alias("row_desc"))

    return text.once(same, option)


def _quiet(left: DataFrame, right: DataFrame, tol: int, pct: int) -> DataFrame:
    """Items of documents with few rows, each with the list of these rows: no pairs are made, and each side is dealt by document only."""
    row = F.struct(*ROW.values())
    lists = right.groupBy("docno").agg(F.collect_list(row).alias("rows"), F.sum(F.coalesce("row_cents", F.lit(0))).alias("doc_cents"), F.count("*").alias("doc_rows"))
    apart = lambda r, c: F.abs(r["row_cents"] - c)
    item, up = F.col("item_cents"), F.col("up")
    best = F.array_max(F.transform(F.filter("rows", lambda r: apart(r, item) <= tol), lambda r: _option(item, F.col("item_desc"), r)))
    gross = F.array_min(F.transform(F.filter("rows", lambda r: apart(r, up) <= tol), lambda r: F.struct(apart(r, up).alias("apart"), r["row_id"].alias("row_id"))))["row_id"]
    # Items without a document are told apart first, so that both sides read the same rows and may share a shuffle.
    out = left.where("docno is not null").join(lists, "docno", "left").withColumn("up", money.gross_up(item, pct)).withColumn("b", best)
    return out.withColumn("gross_row", F.when(F.col("b").isNull(), gross))


def _crowded(left: DataFrame, right: DataFrame, tol: int, pct: int) -> DataFrame:
    """Items of busy documents: they meet the rows of their stretch of amounts, so a document is spread."""
    option = _option(F.col("item_cents"), F.col("item_desc"), F.struct(*ROW.values()))
    best = near(left, right, ["docno"], "item_cents", "row_cents", tol).groupBy("docno", "item_id").agg(F.max(option).alias("b"))
    sums = right.groupBy("docno").agg(F.sum(F.coalesce("row_cents", F.lit(0))).alias("doc_cents"), F.count("*").alias("doc_rows"))
    back = lambda df, names: df.select("docno", *[F.col(b).alias(a) for a, b in names.items()])
    gross = gross_up_match(back(left, ITEM), back(right, ROW), tol, pct).select("docno", "item_id", F.col("row_id").alias("gross_row"))
    return left.join(best, ["docno", "item_id"], "left").join(gross, ["docno", "item_id"], "left").join(sums, "docno", "left")


def match_items(items: DataFrame, ledger: DataFrame, tol: int, threshold: int = 80, pct: int = 109) -> DataFrame:
    """One verdict per item: the first rule that fires, without consumption of rows.

    ``price_then_exact`` (equal descriptions), ``price_then_coverage``, with
    ``|weak_desc`` where the score is low and words are missing,
    ``price_doc_total_sum``, ``price_grossup``, else a NO_MATCH and its kind.

    Rows are counted first: items of documents with at most ``BUSY`` rows look
    through the list of these rows, only the others meet theirs by stretches of amounts.
    """
    left, right = _sides(items, ledger)
    busy = staged(right.groupBy("docno").count().where(f"docno is not null and count > {BUSY}").select("docno"), "busy-documents")
    part = lambda how: (left.join(busy, "docno", how), right.join(busy, "docno", how))
    verdicts = lambda df: _verdicts(df, tol, threshold)
    if busy.isEmpty():
        out = verdicts(_quiet(left, right, tol, pct))
    else:
        out = verdicts(_quiet(*part("left_anti"), tol, pct)).unionByName(verdicts(_crowded(*part("left_semi"), tol, pct)))
    lost = left.where("docno is null").select("docno", "item_id", F.lit(None).cast("long").alias("row_id"), F.lit("").alias("rule"), F.lit("NO_MATCH").alias("status"), F.lit(0.0).alias("score"), F.lit("MISSING_SUPPORTING_DOCS").alias("no_match_type"))
    return out.unionByName(lost)


def _verdicts(found: DataFrame, tol: int, threshold: int) -> DataFrame:
    """The verdict of each item from its best row ``b``, its row with tax on top and its document's rows."""
    b = F.col("b")
    weak = (b["score"] < threshold) & ~text.same_words(F.col("item_desc"), b["row_desc"])
    direct = F.when(b["exact"] == 1, "price_then_exact").when(weak, "price_then_coverage|weak_desc").otherwise("price_then_coverage")
    total = (F.col("doc_rows") >= 2) & (F.abs(F.col("doc_cents") - F.col("item_cents")) <= tol)
    rule = F.when(b.isNotNull(), direct).when(total, "price_doc_total_sum").when(F.col("gross_row").isNotNull(), "price_grossup")
    row = F.when(b.isNotNull(), b["row_id"]).when(total, F.lit(None).cast("long")).otherwise(F.col("gross_row"))
    told = found.select("docno", "item_id", row.alias("row_id"), rule.alias("rule"), b["score"].alias("score"), "doc_rows")
    fired = F.col("rule").isNotNull()
    kind = F.when(~fired, F.when(F.col("doc_rows").isNull(), "MISSING_SUPPORTING_DOCS").otherwise("AMOUNT_DOES_NOT_TALLY"))
    return told.select("docno", "item_id", "row_id", F.coalesce("rule", F.lit("")).alias("rule"), F.when(fired, "OK").otherwise("NO_MATCH").alias("status"), F.coalesce("score", F.when(fired, 100.0), F.lit(0.0)).alias("score"), kind.alias("no_match_type"))


def priority(status: Column) -> Column:
    return F.when(status == "OK", 4).when(status.isin("DESC_MISMATCH", "AMOUNT_MISMATCH"), 3).when(status == "FLAG", 1).otherwise(0)


def best_matches(matches: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by priority of status, then ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(priority(F.col("status"))), *order))
    return matches.withColumn("rank", rank).where("rank = 1").drop("rank")


def preferred_file(matches: DataFrame) -> DataFrame:
    """Per docno the file with the most OK matches, then the most matches, the best mean score, the first name."""
    by_file = matches.groupBy("docno", "file").agg(F.count_if(F.col("status") == "OK").alias("n_ok"), F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))
    rank = F.row_number().over(Window.partitionBy("docno").orderBy(F.desc("n_ok"), F.desc("n"), F.desc("mean_score"), "file"))
    return by_file.withColumn("rank", rank).where("rank = 1").drop("rank")
