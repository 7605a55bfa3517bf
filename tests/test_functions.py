from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, predicates, text


def values(spark, f, *rows):
    """What ``f`` makes of each row of strings."""
    n = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [r[0] for r in df.orderBy("i").select(f(*[F.col(f"c{k}") for k in range(n)])).collect()]


def test_normal_text(spark):
    assert values(spark, text.normal_text, ("Taxi-Ride / Nº 5  (SGD)",), (None,), (" --- ",)) == ["taxi ride n 5 sgd", "", ""]


def test_coverage(spark):
    rows = [("Grab ride to office 12", "office 12"), ("blue pen", "blue pen 7"), ("anything", ""), ("anything", "the of"), ("red", "blue"), ("a red red hat", "red hat red coat")]
    assert values(spark, text.coverage, *rows) == [1.0, 0.5, 1.0, 1.0, 0.0, 0.75]


def test_same_words(spark):
    rows = [("two boxes of pen", "pens"), ("lunch box", "boxes"), ("red", "claim fee"), ("red", "blue")]
    assert values(spark, text.same_words, *rows) == [True, True, True, False]


def test_identifiers(spark):
    assert values(spark, text.identifier, ("1.5e6",), ("12.0",), ("ab-12/x",), (None,)) == ["1500000", "12", "AB12X", ""]
    assert values(spark, text.clean_stem, ("report_v3",), ("copy of a (2)",), ("Scanned bill",)) == ["report", "of a", "bill"]


@pytest.mark.parametrize(
    ("stem", "want"),
    [("PO 00123456", "123456"), ("Order 7654321 (1)", "7654321"), ("SO 0099887766", "99887766"), ("INVOICE 12345_v2", "12345"), ("SV01954455", "SV1954455"), ("12345678 and 87654321", "87654321"), ("x1234567890 12345678", "1234567890"), ("ab1234567", "AB1234567"), ("plain name", "PLAINNAME")],
)
def test_document_ids(spark, stem, want):
    assert values(spark, text.doc_id, (stem,)) == [want]


def test_document_id_modes(spark):
    mode = lambda **k: values(spark, lambda c: text.doc_id(c, **k), ("AB_12345678_99887766",))[0]
    assert mode(mode="segment", segment=1) == "12345678" and mode(mode="first_long_digits") == "12345678" and mode(mode="last_long_digits") == "99887766"
    assert mode(mode="regex", pattern=r"AB_(?:[0-9]+)_([0-9]+)") == "99887766" and mode(mode="po") == ""


def test_keys_are_never_empty(spark):
    (eq, contained), *_ = [(r[0], r[1]) for r in spark.sql("select 'SV00012345678' n").select(text.equal_keys(F.col("n")), text.contained_keys(F.col("n"))).collect()]
    assert "SV00012345678" in eq and "00012345678" in eq and "12345678" in eq and "" not in eq
    assert "12345678" in contained and "012345678" in contained
    assert values(spark, text.equal_keys, ("00000",)) == [["00000"]]


def test_routes(spark):
    rows = [("Grab: from A St to B Rd",), ("taxi to Home from Work",), ("Office to Airport",), ("Mall – Zoo",), ("lunch",), (None,)]
    assert [tuple(r) for r in values(spark, text.route, *rows)] == [("A St", "B Rd"), ("Work", "Home"), ("Office", "Airport"), ("Mall", "Zoo"), ("", ""), ("", "")]


def test_places_lose_what_receipts_add(spark):
    rows = [("• 08:43 at 12 Main St; SGX1234A",), ("8:43AM Harbour – Front (distance: 3.5 km)",), ("picked up on 3 May from Old Rd arrived on 3 May 9:00",), ("[Plaza]>>Sing 10:30",), ("",), (None,)]
    assert values(spark, text.clean_place, *rows) == ["12 Main St", "Harbour Front", "Old Rd", "Plaza Sing 10 30", "", None]
    assert values(spark, text.route_label, ("Grab from A St to B Rd",), ("lunch",), (None,)) == [" A St -> B Rd", "", ""]


def test_small_text_helpers(spark):
    assert values(spark, text.last_words, ("a b c d e f",), ("a b",)) == ["d e f", "a b"]
    assert values(spark, text.from_number, ("SGX1 bike 26B Jalan",), ("none",)) == ["26B Jalan", "none"]
    assert values(spark, text.spaced, ("camelCase  a- b\fz",)) == ["camel Case a-b z"]
    assert len(values(spark, text.safe_name, ("x" * 100,))[0]) == 60
    assert values(spark, text.compact_description, ("31/7/2025 the big lunch 12.50",), ("7 May 2025 x",)) == ["big lunch", ""]


@pytest.mark.parametrize(
    ("written", "want"),
    [("1,234.50", 1234.5), ("(12.50)", -12.5), ("l2O.S0", 120.5), ("12.50-", 12.5), ("12,50", 1250.0), ("$5", None), ("", None), ("-3", -3.0), (None, None), ("1.2.3", None)],
)
def test_amounts(spark, written, want):
    assert values(spark, money.parse_amount, (written,)) == [want]


def test_cents_are_joined_once_and_only_across_blanks(spark):
    assert values(spark, money.join_cents, ("86760",), ("123 O 45",), ("12345.67",), ("12 o50 x",)) == ["86760", "123.45", "12345.67", "12.50 x"]


def test_amounts_in_lines(spark):
    found = lambda line: [(a["amount"], a["currency"]) for a in values(spark, lambda c: money.amounts(c, F.lit("SGD")), (line,))[0]]
    assert found("Paid 12.50 on 31/07/2025 for 3 pens") == [(12.5, "SGD")]
    assert found("USD 1,200 or S$ 1,600.50") == [(1200.0, "USD"), (1600.5, "SGD")]
    assert found("(12.50) 1234.56") == [(-12.5, "SGD"), (1234.56, "SGD")]
    assert found("room 12 of 1999") == []


def test_tolerances(spark):
    df = spark.createDataFrame([(100, 105), (100, 106), (None, 100), (1000, 1050), (0, 0)], "b long, i long")
    assert [r[0] for r in df.select(money.within(F.col("b"), F.col("i"), 5)).collect()] == [True, False, False, False, True]
    assert [r[0] for r in df.select(money.within(F.col("b"), F.col("i"), 5, 5)).collect()] == [True, False, False, True, True]
    assert df.select(money.sum_tolerance(F.lit(100_000), 5, 1, 7)).first()[0] == 700 and df.select(money.sum_tolerance(F.lit(100_000), 5, 1)).first()[0] == 100_000
    assert df.select(money.gross_up(F.lit(50)), money.gross_up(F.lit(-50))).first()[:] == (55, -55)


def test_currencies(spark):
    assert values(spark, money.page_currency, ("eur and Sgd",), ("only £5",), ("HK$ 4",), ("none",)) == ["SGD", "GBP", "HKD", "SGD"]


@pytest.mark.parametrize(
    ("written", "want"),
    [("31/7/2025", date(2025, 7, 31)), ("31-07-2025", date(2025, 7, 31)), ("2025-07-31", date(2025, 7, 31)), ("7 May 2025", date(2025, 5, 7)), ("7 August 2025", date(2025, 8, 7)), ("1/2/25", date(2025, 2, 1)), ("31/31/2025", None), ("30/2/2025", None), ("soon", None), (None, None), ("45869", date(2025, 7, 31)), ("45869.75", date(2025, 7, 31))],
)
def test_dates(spark, written, want):
    assert values(spark, dates.sheet_date, (written,)) == [want]


def test_periods_treat_nulls_apart(spark):
    df = spark.createDataFrame([(date(2025, 1, 1),), (date(2025, 2, 1),), (None,)], "d date")
    bounds = date(2025, 1, 15), date(2025, 2, 1)
    assert [r[0] for r in df.select(dates.in_period(F.col("d"), *bounds)).collect()] == [False, True, True]
    assert [r[0] for r in df.select(dates.in_pay_period(F.col("d"), *bounds)).collect()] == [False, True, False]
    assert [r[0] for r in df.select(dates.in_pay_period(F.col("d"), None, None)).collect()] == [True, True, True]


def test_months_in_names(spark):
    assert values(spark, dates.month_in_name, ("report jul 25.xlsx",), ("July2025",), ("none",)) == [date(2025, 7, 1), date(2025, 7, 1), None]


def test_predicates(spark):
    assert values(spark, predicates.says_total, ("Grand  total 5",), ("balance due",), ("totally",), (None,)) == [True, True, False, False]
    assert values(spark, predicates.is_garbage, ("a normal line of text with words",), ("",), (None,), ("\x00\x01\x02" * 30,), ("12 34 56 78 " * 20,)) == [False, True, True, True, True]
    assert values(spark, predicates.is_table_header, ("Description   Amount",), ("Date",)) == [True, False]
    assert values(spark, text.is_transport, ("GrabCar",), ("cable",), ("lunch",), (None,)) == [True, True, False, False]
