import random

from pyspark.sql import functions as F

from ledgerloom.config import ReconcileConfig
from ledgerloom.operators import docpool, extract, matching, netting, totals, verdicts
from ledgerloom.plans import reconcile

ITEM = "docno long, item_id long, description string, cents long"
ROW = "docno long, row_id long, description string, cents long"


def tables(spark, items, rows):
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(rows, ROW)


def greedy(items, rows, tol):
    """The sequential rule, written down plainly."""
    used, out = set(), set()
    for doc, item, _, cents in sorted(items):
        free = [(abs(c - cents), r) for d, r, _, c in rows if d == doc and (d, r) not in used and abs(c - cents) <= tol]
        if free:
            row = min(free)[1]
            used.add((doc, row))
            out.add((doc, item, row))
    return out


def test_greedy_is_the_sequential_rule(spark):
    random.seed(9)
    items = [(d, i, "x", random.randint(0, 60)) for d in range(12) for i in range(random.randint(1, 9))]
    rows = [(d, i, "x", random.randint(0, 60)) for d in range(12) for i in range(random.randint(1, 9))]
    for tol in (0, 3, 10):
        left, right = tables(spark, items, rows)
        found = {tuple(r) for r in matching.greedy_assign(left, right, tol).collect()}
        assert found == greedy(items, rows, tol)
        again = {tuple(r) for r in matching.greedy_assign(left.repartition(7), right.repartition(3), tol).collect()}
        assert again == found


def test_scaling_amounts_keeps_matches(spark):
    random.seed(10)
    items = [(1, i, "x", random.randint(0, 500)) for i in range(20)]
    rows = [(1, i, "x", random.randint(0, 500)) for i in range(20)]
    big = lambda t: [(d, i, x, c * 10) for d, i, x, c in t]
    pairs = lambda i, r, tol: {(x["item_id"], x["row_id"]) for x in matching.candidates(*tables(spark, i, r), tol).collect()}
    assert pairs(items, rows, 5) == pairs(big(items), big(rows), 50)


def test_rules_fire_in_order(spark):
    items = [(1, 1, "blue pen", 500), (2, 1, "red pen 77", 500), (2, 2, "ink", 505), (3, 1, "sum", 300), (4, 1, "net", 100), (5, 1, "lost", 9), (6, 1, "alone", 1), (7, 1, "zebra", 500)]
    rows = [(1, 1, "pen", 500), (1, 2, "Blue-Pen", 503), (2, 1, "red pen", 500), (2, 2, "pen 77 red", 500), (3, 1, "a", 100), (3, 2, "b", 200), (4, 1, "gross", 109), (5, 1, "c", 5000), (7, 1, "car wash", 500)]
    found = {(r["docno"], r["item_id"]): r for r in matching.match_items(*tables(spark, items, rows), 5).collect()}
    rule = {k: (r["rule"], r["row_id"], r["no_match_type"]) for k, r in found.items()}
    assert rule[1, 1] == ("price_then_exact", 2, None)
    assert rule[2, 1] == ("price_then_coverage", 1, None)  # the first of equal scores
    assert rule[3, 1] == ("price_doc_total_sum", None, None)
    assert rule[4, 1] == ("price_grossup", 1, None)
    assert rule[5, 1] == ("", None, "AMOUNT_DOES_NOT_TALLY") and rule[6, 1] == ("", None, "MISSING_SUPPORTING_DOCS")
    assert rule[7, 1] == ("price_then_coverage|weak_desc", 1, None)
    assert matching.match_items(spark.createDataFrame([], ITEM), tables(spark, items, rows)[1], 5).count() == 0


def test_busy_documents_give_what_quiet_ones_give(spark, monkeypatch):
    random.seed(12)
    words = ["blue pen", "Blue-Pen", "red pen 77", "ink for boxes", "boxes of ink", "car wash fees", "", None]
    side = lambda d, n: [(d, i, random.choice(words), random.choice([None, random.randint(-300, 300)])) for i in range(n)]
    sizes = {1: (90, 200), 2: (5, 70), 3: (80, 6), 4: (4, 64), 5: (3, 65), 6: (2, 0), 7: (0, 3), None: (3, 80)}
    items, rows = [r for d, (n, _) in sizes.items() for r in side(d, n)], [r for d, (_, n) in sizes.items() for r in side(d, n)]
    # A document that tallies as a whole, and one item with tax on top, in a document of either kind.
    items += [(8, 1, "sum", 3000), (9, 1, "net", 10_000), (1, 900, "net", 20_000), (10, 1, "sum", 7000)]
    rows += [(8, 1, "a", 1000), (8, 2, "b", 2000), (9, 1, "c", 10_900), (1, 900, "d", 21_800), *[(10, i, "e", 100) for i in range(70)]]
    both, found = tables(spark, items, rows), {}
    for most in (matching.BUSY, 0, 1000):
        monkeypatch.setattr(matching, "BUSY", most)
        found[most] = sorted(matching.match_items(*both, 5).collect(), key=repr)
    assert found[0] == found[1000] == found[64] and len(found[0]) == len(items)
    rule = {(r["docno"], r["item_id"]): (r["rule"], r["row_id"]) for r in found[64]}
    assert rule[8, 1] == rule[10, 1] == ("price_doc_total_sum", None) and rule[9, 1] == ("price_grossup", 1) and rule[1, 900] == ("price_grossup", 900)
    assert len({r["rule"] for r in found[64]}) == 6


def test_each_tier(spark):
    docs = spark.createDataFrame([("INV12345",), ("9912345678",), ("a 87654321",), ("AB123x",), ("55443322118",), ("nothing at all",)], "docno string")
    book = spark.createDataFrame([("INV-12345",), ("0012345678",), ("ID876543219",), ("AB123",), ("5544332211A",), ("",), (None,)], "doc string")
    tiers = {r["docno"]: (r["ledger_id"], r["tier"]) for r in docpool.pool(docs, book, "doc").collect()}
    assert tiers["INV12345"] == ("INV12345", "doc_eq") and tiers["9912345678"] == ("0012345678", "doc_suffix_8")
    assert tiers["a 87654321"] == ("ID876543219", "doc_contains") and tiers["AB123x"] == ("AB123", "doc_eq")
    assert tiers["55443322118"] == ("5544332211A", "doc_frac_0.91") and tiers["nothing at all"] == (None, "none")
    assert docpool.pool(docs, book, "doc", require_match=True).where("tier = 'none'").count() == 0


def test_overlap_against_brute_force(spark):
    random.seed(11)
    ids = ["".join(random.choice("A12") for _ in range(random.randint(4, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(x, x) for x in ids[:30]], "docno string, number string").distinct()
    book = spark.createDataFrame([(x,) for x in ids[30:]], "ledger_id string").distinct()
    found = {(r["docno"], r["ledger_id"]) for r in docpool.by_overlap(docs, book).collect()}

    def share(a, b):
        n = max((k for k in range(1, min(len(a), len(b)) + 1) if any(a[i : i + k] in b for i in range(len(a) - k + 1))), default=0)
        first = next((a[i : i + n] for i in range(len(a) - n + 1) if n and a[i : i + n] in b), "")
        return n / min(len(a), len(b)) if any(c.isdigit() for c in first) else 0

    assert found == {(a, b) for a in ids[:30] for b in ids[30:] if share(a, b) >= 0.8}


def test_netting(spark):
    rows = [(1, 1, "Fee", 100), (1, 2, "fee", -100), (1, 3, "other", 50), (2, 1, "a", 70), (2, 2, "a", -70), (2, 3, "a", 70), (None, 1, "x", 1), (None, 2, "x", -1)]
    df = spark.createDataFrame([(*r, "SGD") for r in rows], ROW + ", currency string")
    assert [tuple(r) for r in netting.ledger_net_zero(df, 5).collect()] == [(1, "fee", 2, 0)]
    assert {(r["docno"], r["plus_row"], r["minus_row"]) for r in netting.offset_pairs(df).collect()} == {(1, 1, 2), (2, 1, 2)}
    assert {(r["docno"], r["row_id"]) for r in netting.item_net_zero(df).where("net_zero_pair").collect()} == {(1, 1), (1, 2)}


def test_pair_sums_are_the_first_pair(spark):
    random.seed(12)
    entries = [(k, i, random.randint(0, 80)) for k in range(4) for i in range(5)]
    pay = [(k, i, random.randint(-10, 60)) for k in range(4) for i in range(12)]
    c = spark.createDataFrame(entries, "key long, entry_id long, entry_cents long")
    p = spark.createDataFrame(pay, "key long, pay_id long, pay_cents long")
    want = {}
    for k, i, t in entries:
        mine = [(b, v) for a, b, v in pay if a == k]
        pairs = [(a, b) for a, x in mine for b, y in mine if a < b and abs(x + y - t) <= 2]
        if pairs:
            want[k, i] = min(pairs)
    assert {(r["key"], r["entry_id"]): (r["first_pay_id"], r["second_pay_id"]) for r in totals.pair_sums(c, p, 2).collect()} == want


def test_backstop_without_entries_says_nothing(spark):
    c = spark.createDataFrame([], "key long, entry_id long, entry_cents long")
    p = spark.createDataFrame([(1, 1, 5)], "key long, pay_id long, pay_cents long")
    none = spark.createDataFrame([], "key long, entry_id long, pay_id long")
    assert totals.backstop(c, p, none, 1).first()["totals_match"] is None


def test_later_phases_win_and_guards_hold(spark):
    P = verdicts.PHASES
    rows = [(1, P["default"], "NO_MATCH", "", 0.0, "d"), (1, P["no_support"], "NO_MATCH", "", 0.0, "missing"), (2, P["net_zero"], "OK", "z", 100.0, "zero"), (2, P["item_match"], "OK", "i", 90.0, "item"), (3, P["doc_total"], "OK", "t", 100.0, "total"), (3, P["no_support"], "NO_MATCH", "", 0.0, "missing"), (4, P["item_match"], "OK", "i", 90.0, "item"), (4, P["period"], "OUT_OF_PERIOD", "p", 0.0, "late"), (5, P["item_match"], "OK", "i", 90.0, "item"), (5, P["blank_doc"], "NO_MATCH", "", 0.0, "")]
    df = spark.createDataFrame(rows, "row_id long, phase int, status string, rule string, score double, comment string")
    found = {r["row_id"]: (r["status"], r["comment"]) for r in verdicts.reduce_events(df).collect()}
    assert found == {1: ("NO_MATCH", "missing"), 2: ("OK", "zero"), 3: ("OK", "total"), 4: ("OUT_OF_PERIOD", "late"), 5: ("OK", "")}


def test_whole_reconciliation(spark):
    from datetime import date

    items = [(1, 1, "blue pen", 500), (2, 1, "both", 300)]
    rows = [(1, 1, "Blue Pen", 500), (1, 2, "other", 900), (2, 1, "a", 100), (2, 2, "b", 200), (3, 1, "fee", 50), (3, 2, "fee", -50), (4, 1, "lost", 7), (None, 1, "meta", 0)]
    left = spark.createDataFrame(items, ITEM)
    right = spark.createDataFrame([(*r, date(2025, 1, 1)) for r in rows] + [(5, 1, "late", 5, date(2026, 1, 1))], ROW + ", doc_date date")
    config = ReconcileConfig(period_start=date(2025, 1, 1), period_end=date(2025, 12, 31))
    found = {(r["docno"], r["row_id"]): (r["status"], r["rule"], r["comment"]) for r in reconcile.reconcile(left, right, config).collect()}
    assert len(found) == 9
    assert found[1, 1][:2] == ("OK", "price_then_exact") and found[1, 2][:2] == ("NO_MATCH", "")
    assert found[2, 1][:2] == found[2, 2][:2] == ("OK", "doc_total_sum") and found[3, 1][:2] == ("OK", "net_zero_book")
    assert found[4, 1][2] == "NO_MATCH, MISSING SUPPORTING DOCS" and found[5, 1][0] == "OUT_OF_PERIOD" and found[None, 1][2] == ""
    assert reconcile.reconcile(left.where("docno > 99"), right, config).count() == 9


def pages(spark, *texts):
    return spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)], "file string, page int, text string")


def test_receipts(spark):
    text = "Shop A  Meals  SGD 14/03/2025  Team lunch  1,181.59\nSGD 15/3/2025 taxi home 12.50\n  45.00 \nnothing here\n"
    rows = extract.receipt_rows(extract.lines_of(pages(spark, text))).orderBy("line_no").collect()
    assert [(r["form"], r["description"], r["amount"]) for r in rows] == [("wide", "Team lunch", 1181.59), ("row", "taxi home", 12.5), ("bare", "(no desc)", 45.0)]
    stack = "1/2/2025\nTeam dinner\nat the pier\nSGD\n88.50\n2/2/2025\nGrand total\nSGD\n1.00\n"
    rows = extract.stacked_receipts(extract.lines_of(pages(spark, stack))).collect()
    assert [(str(r["date"]), r["description"], r["amount"]) for r in rows] == [("2025-02-01", "Team dinner at the pier", 88.5)]


def test_stacked_receipts_have_any_number_of_lines(spark):
    long = "\n".join(["1/2/2025", *[f"part {k}" for k in range(9)], "SGD", "88.50"])
    text = f"{long}\n2/2/2025\nDescription Amount\n3/2/2025\nlunch\n\n4/2/2025\nusd\n7.00\n5/2/2025\nSGD\n9.00\n6/2/2025\ntaxi\n"
    rows = extract.stacked_receipts(extract.lines_of(pages(spark, text, "SGD\n1.00"))).orderBy("line_no").collect()
    words = " ".join(f"part {k}" for k in range(9))
    assert [(str(r["date"]), r["currency"], r["description"], r["amount"]) for r in rows] == [("2025-02-01", "SGD", words, 88.5), ("2025-02-03", "USD", "lunch 4/2/2025", 7.0)]


def test_wrapped_lines_are_joined(spark):
    rows = extract.unwrap(pages(spark, "taxi 12\n50\nlunch\nSGD\n30.00\nSGD\n1/2/2025 x")).first()["text"].split("\n")
    assert rows == ["taxi 12.50", "lunch SGD 30.00", "SGD 1/2/2025 x"]


def test_totals_take_their_text_from_above(spark):
    text = "Blue widget deluxe\nGST 0.50\nItem total: SGD 12.00\n\nAmount due 5.00 USD or\n 6.75 SGD\n"
    lines = extract.lines_of(pages(spark, text))
    assert [(r["description"], r["amount"]) for r in extract.trailing_totals(lines).collect()] == [("Blue widget deluxe", 12.0)]
    assert [r["amount"] for r in extract.dual_currency_due(lines).collect()] == [6.75]


def test_pages_lend_their_routes(spark):
    rows = extract.page_routes(pages(spark, "x", "Grab from A to B", "y", "z")).orderBy("page").collect()
    assert [r["origin"] for r in rows] == ["A", "A", "A", None]


def test_echoes_and_first_seen(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 1, 5), (3, 1, 5), (4, None, 9)], "item_id long, parent_id long, cents long")
    assert sorted(r["item_id"] for r in extract.replicate_for_echoes(df).collect()) == [1, 1, 4]
    seen = spark.createDataFrame([("f", 5, "A  b", 1), ("f", 5, "a B", 2), ("g", 5, "a b", 3)], "file string, cents long, description string, emit_seq int")
    assert sorted(r["emit_seq"] for r in extract.first_seen(seen).collect()) == [1, 3]


def test_entries_take_payroll_rows_in_order(spark):
    random.seed(13)
    entries = [(k, i, random.randint(0, 40), random.randint(0, 2)) for k in range(8) for i in range(random.randint(1, 6))]
    pay = [(k, i, random.randint(0, 40), random.randint(0, 2)) for k in range(8) for i in range(random.randint(0, 6))]
    c = spark.createDataFrame(entries, "key long, entry_id long, entry_cents long, d int").selectExpr("key", "entry_id", "entry_cents", "date_from_unix_date(d) as entry_day")
    p = spark.createDataFrame(pay, "key long, pay_id long, pay_cents long, d int").selectExpr("key", "pay_id", "pay_cents", "date_from_unix_date(d) as pay_day")
    want, used = set(), set()
    for k, i, cents, day in sorted(entries):
        free = [x for x in pay if x[0] == k and (k, x[1]) not in used]
        free = [x for x in free if x[3] == day] or free
        best = min(((abs(x[2] - cents), x[1]) for x in free), default=None)
        if best and best[0] <= 4:
            used.add((k, best[1]))
            want.add((k, i, best[1]))
    assert {tuple(r) for r in totals.line_assign(c, p, 4).collect()} == want
    found = {(r["key"], r["entry_id"]): (r["rule"], r["pay_ids"]) for r in totals.end_of_month(c, p, 4).collect()}
    assert len(found) == len(entries)
    assert {k for k, v in found.items() if v[0] == "eom_line_match"} == {(k, i) for k, i, _ in want}
    taken = [(k, i) for (k, _), (rule, ids) in found.items() if rule == "eom_line_match" for i in ids.split(",")]
    assert len(taken) == len(set(taken))


def test_ragged_rows(spark):
    text = "Blue widget\nlarge box SGD 12.50\nAllocations\nWBS A1 SGD 12.50\nWBS A2 SGD 4.00\n\nTeam dinner at pier USD 30.00\nGrand total\nSGD 42.50\nroom 12 of 1999\n7.00 plain figure\n"
    rows = extract.ragged_rows(extract.lines_of(pages(spark, text))).orderBy("line_no").collect()
    assert [(r["line_no"], r["source"], r["amount"], r["parent_line"]) for r in rows] == [(1, "text_row", 12.5, None), (3, "text_row|echo", 12.5, 1), (4, "text_row|alloc_part", 4.0, 1), (6, "text_row", 30.0, None), (7, "text_row_total", 42.5, None)]
    assert rows[0]["description"] == "large box" and rows[3]["currency"] == "USD"


def test_end_of_month_rows(spark):
    df = spark.createDataFrame([("Payroll June", "5.00", "30/6/2025"), ("lunch", "1.00", None), ("CPF", "x", None), ("net pay", "7", "45838")], "`Budget Category` string, Amount string, `Document Date` string")
    rows = totals.end_of_month_rows(df, "Amount", "Document Date").collect()
    assert [(r["eom_cents"], str(r["eom_date"])) for r in rows] == [(500, "2025-06-30"), (700, "2025-06-30")]
    assert totals.end_of_month_rows(df.drop("Budget Category"), "Amount", "x").count() == 0 and totals.end_of_month_rows(df, "none", "x").count() == 0


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def payroll(spark):
    entries = spark.createDataFrame([(1, 1, 100, "a"), (1, 2, 200, None), (70, 3, 100, "b")], "key long, entry_id long, entry_cents long, entry_day string")
    return entries, spark.createDataFrame([(1, 1, 40, "a"), (1, 2, 60, "c"), (70, 3, 100, "c"), (70, 4, 900, "c")], "key long, pay_id long, pay_cents long, pay_day string")


def test_same_day_rows_need_no_window_over_pairs(spark):
    df = totals.same_day_candidates(*payroll(spark))
    assert {tuple(r) for r in df.collect()} == {(1, 1, 100, 1, 40, True), (1, 2, 200, 1, 40, False), (1, 2, 200, 2, 60, False), (70, 3, 100, 3, 100, False), (70, 3, 100, 4, 900, False)}
    assert "Window" not in optimized(df)


def test_pair_sums_do_not_multiply_what_is_missing(spark):
    df = totals.pair_sums(*payroll(spark), 0)
    assert [tuple(r) for r in df.collect()] == [(1, 1, 1, 2)]
    assert "explode(sequence" not in optimized(df) and "min(pay_cents" in optimized(df)


def test_stacked_receipts_sort_a_page_once(spark):
    lines = spark.createDataFrame([("f", 1, n, s) for n, s in enumerate(["1/2/2024", "Red pen", "SGD", "12.50", "", "3/2/2024", "4/2/2024", "Box", "USD", "1.00"])], "file string, page int, line_no int, line string")
    df = extract.stacked_receipts(lines)
    assert sorted((r.line_no, r.description, r.currency, r.amount, r.last_no) for r in df.collect()) == [(0, "Red pen", "SGD", 12.5, 3), (5, "4/2/2024 Box", "USD", 1.0, 9)]
    assert "line_no ASC" not in optimized(df).replace("#", " ").replace("  ", " ") and optimized(df).count("Window [") <= 2


def test_neighbouring_keys_share_a_call_and_keep_their_rows(spark):
    entries = spark.createDataFrame([(k, k, 100, "a") for k in range(1, 40)], "key long, entry_id long, entry_cents long, entry_day string")
    pay = spark.createDataFrame([(k, 1000 + k, 100 + k % 3, "a") for k in range(1, 40)], "key long, pay_id long, pay_cents long, pay_day string")
    days = lambda df, c: df.withColumn(c, F.lit("2024-01-01").cast("date"))
    df = totals.line_assign(days(entries, "entry_day"), days(pay, "pay_day"), 1)
    assert {tuple(r) for r in df.collect()} == {(k, k, 1000 + k) for k in range(1, 40) if k % 3 < 2}
    head = optimized(df).split("FlatMapGroupsInPandas")[1].split("]")[0]
    assert "('docno, 64)" in head and "('island, 64)" in head  # no call for each key
