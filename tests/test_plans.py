"""What a query's plan works out a row: Spark repeats the expression of a column wherever it is named, and that grows without a change in results."""

import re

import pytest

from ledgerloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
#: The most patterns a plan may hold, and the most times it may deal rows out.
MOST = {
    "layout_wrapped": (40, 3),
    "layout_rows": (40, 3),
    "wrapped_pages": (70, 3),
    "receipt_rows": (70, 3),
    "unwrapped_receipts": (90, 3),
    "kv_totals": (60, 3),
    "trailing_totals": (60, 3),
    "header_table": (40, 3),
}


@pytest.mark.parametrize("name", sorted(MOST))
def test_plans_work_things_out_once(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    patterns, deals = MOST[name]
    assert len(re.findall("RLIKE|regexp_", plan)) <= patterns
    assert len(re.findall("Exchange hashpartitioning", plan)) <= deals


def test_no_tier_of_a_pool_goes_through_the_driver(spark):
    from ledgerloom.operators import docpool

    docs, book = plans.docs_and_ids(spark, SF)
    left, ids = docpool.documents(docs), docpool.ledger_ids(book, "doc")
    for tier in (docpool.by_equality, docpool.by_suffix, docpool.by_containment, docpool.by_tag, docpool.by_overlap):
        assert "Broadcast" not in tier(left, ids)._jdf.queryExecution().executedPlan().toString(), tier.__name__


def test_ragged_rows_work_things_out_once(spark):
    from ledgerloom.operators import extract

    lines = spark.createDataFrame([("f", 1, 0, "Hotel room"), ("f", 1, 1, "deluxe SGD 12.00")], "file string, page int, line_no int, line string")
    found = extract.ragged_rows(lines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("RLIKE|regexp_", plan)) <= 120
    assert [(r["description"], r["amount"]) for r in found.collect()] == [("Hotel room deluxe", 12.0)]


def test_line_items_deal_pages_and_items_out_a_few_times(spark, monkeypatch):
    from ledgerloom.operators import extract
    from ledgerloom.plans import line_items

    written, staged = [], extract.staged
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (extract, line_items):
        monkeypatch.setattr(module, "staged", lambda df, name: written.append((name, plan(df))) or staged(df, name))
    last = plan(plans.line_items_all_forms(spark, SF))
    assert [name for name, _ in written] in (["items-pages", "claims", "items-found"], ["items-pages", "claims", "claims", "items-found"])
    deals = [p.count("Exchange hashpartitioning") for p in [*dict(written).values(), last]]
    assert deals[0] <= 3 and sum(deals) <= 16, deals
    # Ragged rows: amounts, labels and the text of a row are looked for only where they can be.
    lines = spark.createDataFrame([("f", 1, 0, "x")], "file string, page int, line_no int, line string")
    assert len(re.findall("RLIKE|regexp_", plan(extract.ragged_rows(lines)))) <= 60


def test_what_was_shuffled_for_a_written_table_goes_from_the_disk(spark):
    import time
    from pathlib import Path

    from pyspark.sql import functions as F

    from ledgerloom.staging import CLEAN_UP, staged

    local, before = Path(spark.sparkContext.getConf().get("spark.local.dir")), spark.conf.get(CLEAN_UP)
    files = lambda: {f for f in local.rglob("shuffle_*.data")}
    kept = spark.range(100_000).groupBy((F.col("id") % 977).alias("k")).count()
    assert kept.count() == 977
    old = files()
    df = staged(spark.range(1_000_000).groupBy((F.col("id") % 300_007).alias("k")).count(), "shuffled")
    until = time.time() + 20
    while files() - old and time.time() < until:
        time.sleep(0.2)
    assert not files() - old and df.count() == 300_007
    assert spark.conf.get(CLEAN_UP) == before and kept.count() == 977


def test_options_of_a_class_as_one_by_one(spark):
    """The rows a class may take: as many as its document has items, over both stretches of amounts that it meets."""
    from ledgerloom.plans import reconcile

    said = ["red lamp", "red lamp big", "blue pen", "lamp"]
    rows = [("P", (f"d{i}", i), 1000 + i % 13, said[i % 4]) for i in range(60)]
    seen, book = {}, []
    for pool, row, cents, text in sorted(rows, key=lambda r: r[1]):
        seen[cents, text] = seen.get((cents, text), 0) + 1
        book.append((pool, (row[1], row[0]), cents, text, seen[cents, text]))
    book = spark.createDataFrame(book, "pool string, row struct<row_id: long, docno: string>, row_cents long, row_ndesc string, nth int")
    asks = [("a", 1, 1003, "red lamp", 3), ("a", 2, 1009, "lamp", 3), ("b", 1, 1003, "red lamp", 9), ("c", 1, 5, "lamp", 2)]
    wanted = spark.createDataFrame([(*a, "P") for a in asks], "docno string, klass long, cents long, ndesc string, need long, pool string")
    got = {}
    for r in reconcile.ranked_options(wanted, book, 5, 0).collect():
        got.setdefault((r["docno"], r["klass"]), []).append((r["rank"], r["row"]["row_id"]))
    share = lambda asked, have: 1.0 if asked in have else sum(w in have.split() for w in asked.split()) / len(asked.split())
    for doc, klass, cents, text, need in asks:
        near = [(t != text, abs(c - cents) if t == text else 0, -(1.0 if t == text else share(t, text)), row[1]) for _, row, c, t in rows if abs(c - cents) <= 5]
        assert [i for _, i in sorted(got.get((doc, klass), []))] == [n[3] for n in sorted(near)[:need]], (doc, klass)


def test_words_of_a_layout_are_put_together_once(spark):
    from ledgerloom.operators import extract

    words = [("f", 1, 24.0, 10.0, "blue1"), ("f", 1, 24.0, 60.0, "lamp1"), ("f", 1, 24.0, 480.0, "USD"), ("f", 1, 24.0, 500.0, "12.00"), ("f", 1, 12.0, 10.0, "SGD"), ("f", 1, 36.0, 10.0, "v1.5"), ("f", 1, 36.0, 60.0, None), ("f", 2, 24.0, 500.0, "7.00")]
    words += [("f", 3, 24.0, 10.0, "red3"), ("f", 3, 24.0, 60.0, "pen3"), ("f", 3, 24.0, 470.0, "EUR"), ("f", 3, 26.0, 500.0, "9.00"), ("f", 3, 26.0, 10.0, "two3"), ("f", 3, 26.0, 60.0, "sets3")]
    rows = extract.layout_rows(spark.createDataFrame(words, "file string, page int, y double, x double, word string"))
    got = sorted((r["page"], r["line_no"], r["description"], r["currency"], r["amount"]) for r in rows.collect())
    assert got == [(1, 12, "blue1 lamp1 v1.5", "USD", 12.0), (3, 13, "red3 pen3 two3 sets3", "EUR", 9.0)]
    assert len(re.findall("Aggregate", rows._jdf.queryExecution().optimizedPlan().toString())) == 2
