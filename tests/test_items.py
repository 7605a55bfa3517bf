import time

from pyspark.sql import functions as F

from ledgerloom.config import ReconcileConfig
from ledgerloom.operators import extract
from ledgerloom.plans.line_items import line_items


def pages(spark, *texts):
    return spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)], "file string, page int, text string")


def test_each_form_of_wrapping(spark):
    cases = {
        "SGD 14/03/2025 Grab home\n55.28": "SGD 14/03/2025 Grab home 55.28",
        "SGD 1/2/2025 a\n867\n60\n12.00\nq": "SGD 1/2/2025 a 867.60 12.00\nq",
        "55\n28\nx": "55.28\nx",
        "Total 1,867\n60": "Total 1,867.60",
        "fare 867 60": "fare 867.60",
        "lunch SGD\n1/2/2025 team": "lunch SGD 1/2/2025 team",
        "SGD\n1/2/2025 team 1,234\n50": "SGD 1/2/2025 team 1,234.50",
        "hotel SGD\n120.00": "hotel SGD 120.00",
        "SGD\n99.00": "SGD 99.00",
        "paid 1/2/2025\nsgd\n5.00\nend": "paid 1/2/2025 sgd 5.00\nend",
        "paid 1/2/2025\nSGD\nend": "paid 1/2/2025 SGD\nend",
        "1/2/2025\ntwo words\nmore\nSGD\n5.00": "1/2/2025 two words more SGD 5.00",
        "1/2/2025\none\ntwo\nthree\nfour\nSGD\n5.00": "1/2/2025\none\ntwo\nthree\nfour SGD 5.00",
        "1/2/2025\nGrand total\nSGD\n5.00": "1/2/2025\nGrand total\nSGD 5.00",
        "1/2/2025\n60\nz": "1/2/2025\n60\nz",
        "12.50\n60": "12.50\n60",
        "a\r\n\r\nb  c": "a\n\nb  c",
        "": "",
        None: "",
    }
    got = {r["page"]: r["text"] for r in extract.unwrap(pages(spark, *cases)).collect()}
    assert [got[i + 1] for i in range(len(cases))] == list(cases.values())


def test_lines_know_where_they_stood(spark):
    rows = extract.wrapped_lines(pages(spark, "a\nSGD\n1/2/2025 x 12\n50\n\nb")).orderBy("line_no").collect()
    assert [(r["line_no"], r["last_no"], r["line"]) for r in rows] == [(0, 0, "a"), (1, 3, "SGD 1/2/2025 x 12.50"), (4, 4, ""), (5, 5, "b")]


def test_long_pages_take_seconds(spark):
    n = 20_000
    text = "\n".join(f"{1 + i % 28}/3/2025 SGD {i}.00 for things of many kinds" for i in range(n)) + "\nSGD 1/2/2025 a\n" + "5.00\n" * n
    began = time.time()
    assert extract.wrapped_lines(pages(spark, text)).count() == n + 2
    found = extract.dated_amounts(pages(spark, text)).agg(F.count("*"), F.sum((F.col("date") == F.expr("make_date(2025, 3, 1 + int(n) % 28)")).cast("int"))).first()
    assert found[0] == n and found[1] == n and time.time() - began < 90


def test_the_nearest_date_before_or_behind(spark):
    text = "1/1/2025 a SGD 1.00 b 2/1/2025\n" + "x" * 900 + " SGD 2.00 " + "y" * 900 + "\n3/1/2025 SGD 3.00" + " " * 8 + "4/1/2025"
    got = [(r["amount"], str(r["date"]), r["line_no"]) for r in extract.dated_amounts(pages(spark, text)).orderBy("n").collect()]
    assert got == [(1.0, "2025-01-01", 0), (2.0, "2025-01-04", 1), (3.0, "2025-01-03", 2)]


def test_running_text_takes_in_its_neighbours(spark):
    text = "two telling words\nSGD 5.00\n\nDelivery charge\nSGD 7.00\nblue pen sets\nGrand total\nSGD 9.00"
    got = {(r["amount"], r["description"], r["source"]) for r in extract.free_text_items(pages(spark, text)).collect()}
    assert (5.0, "two telling words", "summary") in got and (7.0, "blue pen sets", "summary") in got


def test_a_line_serves_the_first_who_claims_it(spark):
    rows = [(0, 2, 5, 5), (1, 3, 5, 6), (2, 4, 6, 6), (3, 2, 5, 5), (4, 4, 5, 7), (5, 0, 9, 9), (6, 9, 9, 9)]
    df = spark.createDataFrame([("f", 1, *r) for r in rows], "file string, page int, item long, claim int, line_no int, last_no int")
    assert {r["item"] for r in extract.claimed(df).collect()} == {0, 2, 3, 5}
    assert extract.claimed(df.where("item > 99")).count() == 0


def test_items_of_all_forms_once_sorted_and_dated(spark):
    texts = [
        "SGD 3/1/2025 blue pen 5.00\n2/1/2025\nteam dinner out\nSGD\n88.50",
        "blue widget deluxe\nItem total: SGD 12.00\n\nhotel two nights SGD 200.00\nAllocation\nSGD 200.00\nSGD 200.00\nSGD 50.00\n",
        "Description    Amount\nred lamp big    7.00\nTotal    7.00",
    ]
    rows = line_items(pages(spark, *texts).withColumn("file", F.lit("INV 0012345.pdf")), ReconcileConfig()).collect()
    got = [(r["page"], str(r["date"]), r["description"], r["cents"], r["source"]) for r in rows]
    assert got[:2] == [(1, "2025-01-02", "team dinner out", 8850, "receipt_stack"), (1, "2025-01-03", "blue pen", 500, "receipt_row")]
    assert got[2][2:] == ("blue widget deluxe", 1200, "trail_total") and [g[4] for g in got[3:5]] == ["text_row", "text_row|echo_synth"]
    assert (3, "2025-01-02", "red lamp big", 700, "table") in got and not any(g[3] == 5000 for g in got)
    assert {r["docno"] for r in rows} == {"12345"}
    assert line_items(pages(spark, "nothing to see", None, "")).count() == 0


def test_currencies_beside_figures(spark):
    texts = ["SGD: 5.00 (USD)", "EUR 1.00 2.00 GBP", "17 pcs 3.00", "GST payable 9.00 total incl. GST 8.00", "x" * 60 + " 4.00", "", None, "on 1/2/2025"]
    lines = spark.createDataFrame([("f", 1, i, t) for i, t in enumerate(texts)], "file string, page int, line_no int, line string")
    rows = extract.amounts_in_context(lines).orderBy("line_no", "n").collect()
    assert [(r["line_no"], r["amount"], r["currency"], r["picked"]) for r in rows] == [(0, 5.0, "USD", True), (1, 1.0, "EUR", False), (1, 2.0, "GBP", True), (2, 3.0, "SGD", True), (3, 9.0, "SGD", False), (3, 8.0, "SGD", True), (4, 4.0, "SGD", True)]


def test_pages_that_bring_their_lines_are_read_alike(spark):
    texts = [
        "hotel room deluxe\n\n   \nItem total:\nSGD\n12.00\nAmount\n5.00\ngst 1.00",
        "Amount due 1,000.00 USD or\n1,350.00 SGD\nTotal 1,867\n60\n\ntwo words\ndelivery\nInvoice total SGD 9.50",
        "two telling words\nSGD 5.00\n\nDelivery charge\nSGD\n7.00\nblue pen sets\nGrand total\n1/2/2025 SGD 9.00",
        "",
        None,
    ]
    whole = extract.mended(pages(spark, *texts).withColumn("page_currency", F.lit("SGD")))
    lines = extract.wrapped_lines(pages(spark, *texts))
    rows = lambda df: sorted(str(r) for r in df.select(sorted(df.columns)).collect())
    for read in (extract.dual_currency_due, extract.trailing_totals, extract.labelled_amounts):
        assert rows(read(whole)) == rows(read(lines)) != [], read.__name__
    at = lambda df, *more: {(r["page"], r["amount"], r["description"], r["source"], *[r[c] for c in more]) for r in df.collect()}
    free = at(extract.free_text_items(whole), "line_no", "last_no")
    assert {f[:4] for f in free} == at(extract.free_text_items(extract.unwrap(pages(spark, *texts)))) and (1, 12.0, "Amount", "summary", 4, 5) in free


def test_claims_deal_items_out_once(spark, monkeypatch):
    rows = [(i, i % 9, i % 40, i % 40 + i % 3) for i in range(200)]
    df = spark.createDataFrame([("f", 1, *r) for r in rows], "file string, page int, item long, claim int, line_no int, last_no int")
    written, staged = [], extract.staged
    monkeypatch.setattr(extract, "staged", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name))
    got = {r["item"] for r in extract.claimed(df).collect()}
    taken, wanted = {}, set()
    for claim in range(9):
        won = [r for r in rows if r[1] == claim and all(taken.get(n, claim) == claim for n in range(r[2], r[3] + 1))]
        wanted |= {r[0] for r in won}
        taken |= {n: claim for r in won for n in range(r[2], r[3] + 1)}
    assert got == wanted and written and all(p.count("Exchange hashpartitioning") <= 1 for p in written)
