"""Pages of text to the line-item relation: all extractors, each line claimed once, tagged, without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import ReconcileConfig
from ledgerloom.functions import dates, money, predicates, text
from ledgerloom.operators import extract, netting
from ledgerloom.staging import staged

#: Who may claim a line first. Receipts have forms of their own and come before the readers of looser text.
RANKS = ["receipt", "stack", "dual", "trailing", "table", "layout", "ragged", "named", "free", "bare"]
FOUND = ["file", "page", "claim", "line_no", "last_no", "date", "description", "currency", "amount", "source", "parent_line"]


def _tagged(df: DataFrame, rank: str, source: Column | None = None) -> DataFrame:
    """``df`` in the shape of ``FOUND``: what an extractor doesn't tell is null, a line ends where it begins, and ``rank`` may claim it."""
    more = {"last_no": F.col("line_no"), "date": F.lit(None).cast("date"), "currency": F.lit(None).cast("string"), "parent_line": F.lit(None).cast("int")}
    df = df.withColumns({c: v for c, v in (more | {"claim": F.lit(RANKS.index(rank))}).items() if c not in df.columns})
    return (df if source is None else df.withColumn("source", source)).select(*FOUND)


def mended_pages(pages: DataFrame, default_currency: str = "SGD") -> DataFrame:
    """(file, page, text, page_currency, lines) written once: pages with their currency and their lines, hard wraps mended."""
    pages = pages.select("file", "page", "text").withColumn("page_currency", money.page_currency(F.col("text"), default_currency))
    return staged(extract.mended(pages), "items-pages")


def found_items(pages: DataFrame, default_currency: str = "SGD", words: DataFrame | None = None) -> DataFrame:
    """What every extractor finds on ``pages`` (of ``mended_pages``), lines claimed (``extract.claimed``).

    Receipts and tables are read from the lines as they are, everything else from lines
    whose hard wraps are mended. Amounts without a currency have the page's. ``words``
    are the positioned words of pages, for tables that only their layout shows. An extractor
    reads the pages that hold a word, or a line, without which it finds nothing.
    """
    own, word = F.col("page_currency"), lambda s: F.lit(s)
    total = lambda name: F.concat(F.lit(name), F.when(predicates.says_total(F.col("description")), "_total").otherwise(""))
    saying = lambda words: pages.where(predicates.holds(F.col("text"), words))
    receipts = extract.receipt_rows(extract.lines_of(pages, "page_currency")).withColumn("currency", F.coalesce("currency", own))
    rank = F.when(F.col("form") == "bare", RANKS.index("bare")).otherwise(RANKS.index("receipt"))
    stacked = pages.where(F.col("text").rlike(rf"(?i)(?:^|\R) *{extract.CODE} *(?:\R|$)"))
    due = saying(["due"]).where(predicates.holds(F.col("text"), ["amount"]))
    free = extract.free_text_items(pages.where(extract.mended_text().rlike(extract.FREE_FIGURE)))
    every = [
        _tagged(receipts.withColumn("claim", rank), "receipt", word("receipt_row")),
        _tagged(extract.stacked_receipts(extract.lines_of(stacked)), "stack", word("receipt_stack")),
        _tagged(extract.dual_currency_due(due).withColumns({"description": F.lit("Amount due"), "currency": F.lit("SGD")}), "dual", word("kv_total")),
        _tagged(extract.trailing_totals(saying(predicates.TRAILING_WORDS), own), "trailing", word("trail_total")),
        _tagged(extract.header_table(extract.lines_of(saying(predicates.HEADER_WORDS).repartition("file", "page"), "page_currency"), page=own), "table", total("table")),
        _tagged(extract.ragged_rows(extract.mended_lines(pages.repartition("file", "page"), "page_currency"), own), "ragged"),
        _tagged(extract.labelled_amounts(saying(predicates.TOTAL_WORDS), own), "named", F.concat(F.lit("kv_"), F.col("kind"))),
        _tagged(free, "free"),
    ]
    if words is not None:
        placed = extract.layout_rows(words)
        # Rows of a layout are numbered by position, not by lines: they claim among themselves.
        every.append(_tagged(placed.withColumn("line_no", -1 - F.col("line_no")), "layout", total("layout")))
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return extract.claimed(out.where(money.nonzero(F.col("amount")) & ((F.col("description") != "") | F.col("parent_line").isNotNull())).withColumn("item", F.monotonically_increasing_id()))


def _with_echoes(found: DataFrame) -> DataFrame:
    """Rows and how often each comes (``copies``): a row that parts of an allocation repeat, once for each of them; the parts themselves go."""
    ragged = F.col("claim") == RANKS.index("ragged")
    rows = Window.partitionBy("file", "page", F.coalesce("parent_line", "line_no"))
    echoes = F.count_if(F.contains("source", F.lit("|echo"))).over(rows)
    tied = found.where(ragged).withColumn("copies", F.greatest(echoes, F.lit(1)))
    return tied.unionByName(found.where(~ragged).withColumn("copies", F.lit(1).cast("long"))).where(~F.contains("source", F.lit("|")))


def line_items(pages: DataFrame, config: ReconcileConfig = ReconcileConfig(), default_currency: str = "SGD", words: DataFrame | None = None) -> DataFrame:
    """(docno, file, page, line_no, date, description, currency, cents, source, in_period, net_zero_pair) of all pages, sorted by file, page, date and line.

    Of items alike in amount and description a file keeps the first by page, line and
    source. Parts of an allocation go; where they only repeat their row (an echo), the row
    comes as often as it has echoes, and its copies are tagged ``|echo_synth``. An item
    without a date has the file's last one.
    """
    pages = mended_pages(pages, default_currency)
    found = found_items(pages, default_currency, words)
    stem = F.regexp_replace("file", r"\.[A-Za-z0-9]{1,5}$", "")
    docno = text.doc_id(stem, config.docno_mode, config.docno_segment, config.docno_pattern, config.docno_group)
    more = {"docno": F.coalesce(text.null_if_empty(docno), text.doc_number(stem)), "cents": money.cents(F.col("amount")), "currency": F.coalesce("currency", F.lit(default_currency)), "nkey": text.alike(F.col("description"))}
    items = staged(_with_echoes(found).withColumns(more).drop("amount", "parent_line", "last_no", "item", "claim"), "items-found")
    undated = items.where("date is null")
    if not undated.isEmpty():
        day = F.try_element_at(F.filter(dates.date_tokens(F.coalesce("text", F.lit(""))), lambda d: dates.parse_date(d).isNotNull()), F.lit(-1))
        last = pages.select("file", "page", day.alias("day")).where("day is not null").groupBy("file").agg(dates.parse_date(F.max_by("day", "page")).alias("last_day"))
        items = items.where("date is not null").unionByName(undated.join(last, "file", "left").withColumn("date", F.col("last_day")).drop("last_day"))
    # Dealt once by document and text, which is what repeats and cancelling amounts have in common.
    items = extract.first_seen(items.withColumn("emit_seq", F.struct("page", "line_no", "source")).repartition("docno", "nkey"), ["docno", "file"])
    items = items.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    items = items.withColumn("source", F.concat("source", F.when(F.col("copy") > 1, "|echo_synth").otherwise("")))
    items = items.withColumn("in_period", dates.in_period(F.col("date"), config.period_start, config.period_end))
    out = netting.item_net_zero(items).select("docno", "file", "page", "line_no", "date", "description", "currency", "cents", "source", "in_period", "net_zero_pair")
    return out.orderBy("file", "page", "date", "line_no", "source")
