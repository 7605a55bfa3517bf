"""Domain relations over the driver's tables, with the same expressions in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The order of a document's lines.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "cents", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their part's ``description``, and ``docno``, ``cents`` and ``doc_date``."""
    lines = table(spark, sf_dir, "lineitem").withColumn("cents", money.cents(F.col("l_extendedprice")))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("description"))
    df = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return df.select(F.col("l_orderkey").alias("docno"), "description", *LINE_ORDER, F.to_date("l_shipdate").alias("doc_date"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(docno, row_id, description, cents, doc_date, l_partkey): order lines as ledger rows; row_id counts within a document.

    Rows are numbered behind the join with their parts, as the SQL has it, and stay dealt by document.
    """
    order = Window.partitionBy("docno").orderBy(*LINE_ORDER)
    df = _lines(spark, sf_dir).withColumn("row_id", F.row_number().over(order).cast("long"))
    return df.select("docno", "row_id", "description", "cents", "doc_date", "l_partkey")


LEDGER = """ledger AS (
  SELECT l_orderkey AS docno, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), l_quantity, l_discount, l_tax, l_shipdate) AS row_id,
         p_name || ' ' || p_type AS description, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_shipdate AS DATE) AS doc_date, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(docno, item_id, description, cents, file, currency): ledger rows as extracted items, some off by a little, net of tax, wrong or missing."""
    k = F.col("l_partkey") % 10
    cents = F.when(k == 6, F.col("cents") + 3).when(k == 7, F.floor(F.col("cents") * 100 / 109)).when(k == 8, F.col("cents") + 1000).otherwise(F.col("cents"))
    cents = F.when(k == 7, F.expr("cents * 100 div 109")).otherwise(cents).cast("long")
    df = ledger(spark, sf_dir).where("l_partkey % 10 <> 9")
    file = F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string"))
    return df.select("docno", F.col("row_id").alias("item_id"), "description", cents.alias("cents"), file.alias("file"), F.lit("SGD").alias("currency"))


ITEMS = (
    LEDGER
    + """, items AS (
  SELECT docno, row_id AS item_id, description,
         CASE l_partkey % 10 WHEN 6 THEN cents + 3 WHEN 7 THEN cents * 100 // 109 WHEN 8 THEN cents + 1000 ELSE cents END AS cents,
         'f' || CAST(l_partkey % 3 AS VARCHAR) AS file, 'SGD' AS currency
  FROM ledger WHERE l_partkey % 10 <> 9)"""
)


def signed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows by part instead of order; every second row of an odd part is reversed, so amounts may cancel."""
    df = ledger(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("l_partkey").orderBy("docno", "row_id"))
    df = df.withColumn("n", rank.cast("long"))
    base = F.when(F.col("l_partkey") % 2 == 1, F.col("l_partkey") * 100).otherwise(F.col("cents"))
    return df.select(F.col("l_partkey").alias("docno"), F.col("n").alias("row_id"), "description", F.when(F.col("n") % 2 == 0, -base).otherwise(base).alias("cents"), F.lit("SGD").alias("currency"))


SIGNED = (
    LEDGER
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY docno, row_id) AS n FROM ledger),
signed AS (
  SELECT l_partkey AS docno, n AS row_id, description, (CASE WHEN n % 2 = 0 THEN -1 ELSE 1 END) * (CASE WHEN l_partkey % 2 = 1 THEN l_partkey * 100 ELSE cents END) AS cents, 'SGD' AS currency FROM numbered)"""
)


def entries_and_pay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as entries (even ids) and payroll rows (odd ids), by user; amounts in whole units, as cents."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.floor(F.col("value")).cast("long").alias("cents"), F.to_date("ts").alias("day"))
    entries = e.where("event_id % 2 = 0").select("key", F.col("event_id").alias("entry_id"), F.col("cents").alias("entry_cents"), F.col("day").alias("entry_day"))
    pay = e.where("event_id % 2 = 1").select("key", F.col("event_id").alias("pay_id"), F.col("cents").alias("pay_cents"), F.col("day").alias("pay_day"))
    return entries, pay


PAY = """e AS (SELECT user_id AS key, event_id, CAST(floor(value) AS BIGINT) AS cents, CAST(ts AS DATE) AS day FROM events),
entries AS (SELECT key, event_id AS entry_id, cents AS entry_cents, day AS entry_day FROM e WHERE event_id % 2 = 0),
pay AS (SELECT key, event_id AS pay_id, cents AS pay_cents, day AS pay_day FROM e WHERE event_id % 2 = 1)"""


def receipts(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """(file, page, text): one page per order with a receipt for each of its lines; an order's lines are few.

    Lines are put in order where a page is put together, and pages stay dealt by file.
    """
    df = _lines(spark, sf_dir)
    amount = F.concat((F.expr("cents div 100")).cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    day = F.date_format("doc_date", "d/M/yyyy")
    line = {
        "row": F.concat_ws(" ", F.lit("SGD"), day, "description", amount),
        "stack": F.concat_ws("\n", day, "description", F.lit("SGD"), amount),
        "total": F.concat_ws("\n", F.col("description"), F.concat(F.lit("Item total: SGD "), amount), F.lit("")),
        "table": F.concat_ws("    ", "description", amount),
        "free": F.concat_ws(" ", F.lit("Paid on"), day, F.lit("for"), "description", F.lit("the sum of SGD"), F.concat(amount, F.lit(";"))),
        "dual": F.concat_ws(" ", F.lit("Amount due 1.00 USD or"), amount, F.lit("SGD")),
    }[form]
    ordered = F.sort_array(F.collect_list(F.struct(*LINE_ORDER, line.alias("line"))))
    return df.groupBy(F.concat(F.lit("o"), F.col("docno").cast("string")).alias("file"), F.lit(1).alias("page")).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def _pages(rows: DataFrame, page: Column, block: Column, head: Column | None = None) -> DataFrame:
    """(file, page, text): the blocks of an order's rows, by page; an order's rows are few."""
    ordered = F.sort_array(F.collect_list(F.struct("row_id", block.alias("block"))))
    body = F.array_join(F.transform(ordered, lambda x: x["block"]), "\n")
    text = body if head is None else F.concat(head, body)
    # By document, as the rows are dealt already.
    return rows.groupBy("docno", page.alias("page")).agg(text.alias("text")).select(F.concat(F.lit("o"), F.col("docno").cast("string")).alias("file"), "page", "text")


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Ledger rows above zero, with how their amounts and days are written."""
    amount = F.concat((F.expr("cents div 100")).cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    return ledger(spark, sf_dir).where("cents > 0"), amount, F.date_format("doc_date", "d/M/yyyy")


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of order lines in nine forms, by part."""
    df, amount, day = _written(spark, sf_dir)
    form = (F.col("l_partkey") % 9).cast("int")
    priced = F.concat(F.lit("SGD "), amount)
    echoes = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("\nAllocation by percentage\n"), priced, F.lit("\n"), priced, F.lit("\n"))).otherwise("")
    blocks = [
        F.concat_ws(" ", F.lit("SGD"), day, "description", amount),
        F.concat_ws("\n", day, "description", F.lit("SGD"), amount),
        F.concat_ws(" ", F.lit("Amount due 1.00 USD or"), amount, F.lit("SGD")),
        F.concat(F.col("description"), F.lit("\nItem total: "), priced, F.lit("\n")),
        F.concat_ws("    ", "description", amount),
        F.concat(F.col("description"), F.lit(" "), priced, echoes),
        F.concat(F.lit("Amount: "), amount),
        F.concat(F.col("description"), F.lit(" SGD\n"), amount),
        F.concat(F.lit("Service fees\n"), priced, F.lit("\n"), "description"),
    ]
    df = df.withColumn("block", F.get(F.array(*blocks), form))
    return _pages(df, (form + 1), F.col("block"), F.when(F.first(form) == 4, "Description    Amount\n").otherwise(""))


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of order lines broken over lines in nine ways, by row."""
    df, amount, day = _written(spark, sf_dir)
    way = (F.col("row_id") % 9).cast("int")
    whole, cents = F.expr("cents div 100").cast("string"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    row = F.concat_ws(" ", F.lit("SGD"), day, "description")
    two, one = "\n", " "
    blocks = [
        F.concat_ws(two, row, amount),  # the amount below its row
        F.concat_ws(two, F.concat_ws(one, F.lit("SGD"), day, "description", whole), cents),  # the cents below
        F.concat_ws(two, row, whole, cents),  # both, each on its own
        F.concat_ws(two, F.lit("SGD"), F.concat_ws(one, day, "description", amount)),  # the currency above
        F.concat_ws(two, F.lit("SGD"), F.concat_ws(one, day, "description", whole), cents),  # and the cents below
        F.concat_ws(two, F.concat_ws(one, day, "description"), F.lit("SGD"), amount),  # text, currency, amount
        F.concat_ws(two, day, "description", F.lit("SGD"), amount),  # a stack
        F.concat_ws(two, F.concat_ws(one, day, "description", F.lit("SGD")), amount),  # ends in its currency
        F.concat_ws(one, F.lit("SGD"), day, "description", whole, cents),  # cents a blank apart
    ]
    return _pages(df.withColumn("block", F.get(F.array(*blocks), way)), way, F.concat("block", F.lit("\n")))


# A ledger and its documents, for the whole reconciliation


def claim_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a ledger: ids written in five ways or missing, reversals, rides, payroll runs, and orders with few different amounts."""
    k, r, p = F.col("docno"), F.col("row_id"), F.col("l_partkey")
    df = ledger(spark, sf_dir)
    number = (k + 10_000_000).cast("string")
    ways = [F.concat(F.lit("INV-"), number), F.concat(F.lit("9"), number), number, F.concat(F.lit("X"), number, F.lit("Y")), F.concat(F.lit("Z"), F.left(number, F.lit(7)))]
    ref = F.when(k % 17 != 5, F.get(F.array(*ways), (k % 5).cast("int")))
    reversal = (k % 9 == 4) & (r <= 2)
    paid = (p % 400 == 11) & F.year("doc_date").between(1996, 1999)
    said = F.when(reversal, F.lit("Reversal of fee")).when(paid, F.concat(F.lit("Payroll run "), "description")).when(p % 8 == 0, F.concat(F.lit("Grab ride "), "description")).otherwise(F.col("description"))
    cents = F.when(reversal, F.when(r == 1, 5000).otherwise(-5000)).when((k % 6 == 2) & (k % 11 != 3), 1000 * (1 + r % 2)).otherwise(F.col("cents")).cast("long")
    return df.select(k.alias("k"), r.alias("r"), p.alias("p"), ref.alias("docno"), (k * 100 + r).alias("row_id"), said.alias("description"), cents.alias("cents"), "doc_date", F.concat(F.lit("W"), (p % 7).cast("string")).alias("wbs"))


def claim_items(book: DataFrame) -> DataFrame:
    """Items of documents named otherwise than the ledger writes them: some off by a little, net of tax, wrong, twice or missing, with grand totals and vouchers that cancel."""
    k, r, p = F.col("k"), F.col("r"), F.col("p")
    number = (k + 10_000_000).cast("string")
    ways = [F.concat(F.lit("INV"), number, F.lit(" (2)")), F.concat(F.lit("scan_00"), number), F.concat(number, F.lit("_v3")), number, F.concat(F.lit("Q"), number)]
    stem = F.when(k % 11 == 3, F.translate(number, "0123456789", "ABCDEFGHIJ")).otherwise(F.get(F.array(*ways), (k % 5).cast("int")))
    book = book.withColumn("stem", stem)
    cents = F.when(p % 10 == 6, F.col("cents") + 3).when(p % 10 == 7, F.expr("cents * 100 div 109")).when(p % 10 == 8, F.col("cents") + 1000).otherwise(F.col("cents"))
    said = F.when(k % 6 == 2, F.concat(F.lit("part "), F.left("description", F.lit(20)))).otherwise(F.col("description"))
    copies = F.explode(F.sequence(F.lit(0), F.when(p % 10 == 5, 1).otherwise(0)))
    lines = book.where((p % 10 != 9) & ~F.startswith("description", F.lit("Payroll run"))).withColumn("copy", copies)
    lines = lines.select("stem", (r * 10 + F.col("copy")).alias("item_id"), said.alias("description"), cents.cast("long").alias("cents"), F.concat(F.lit("f"), (p % 3).cast("string")).alias("file"), F.lit("text_row").alias("source"))
    sums = book.where(k % 7 == 0).groupBy("stem").agg(F.sum("cents").alias("cents"))
    sums = sums.select("stem", F.lit(1000).cast("long").alias("item_id"), F.lit("Grand total").alias("description"), "cents", F.lit("f0").alias("file"), F.lit("trail_total").alias("source"))
    both = F.explode(F.array(F.struct(F.lit(1001).alias("item_id"), F.lit(500).alias("cents")), F.struct(F.lit(1002).alias("item_id"), F.lit(-500).alias("cents")))).alias("v")
    vouchers = book.where(k % 13 == 0).select("stem").distinct().select("stem", both).select("stem", F.col("v.item_id").cast("long").alias("item_id"), F.lit("Voucher").alias("description"), F.col("v.cents").cast("long").alias("cents"), F.lit("f0").alias("file"), F.lit("kv_item").alias("source"))
    return lines.unionByName(sums).unionByName(vouchers).withColumnRenamed("stem", "docno").withColumn("currency", F.lit("SGD"))


def claim_payroll(book: DataFrame) -> DataFrame:
    """Payroll rows behind the ledger's payroll runs: equal, off by a little, in two parts, or wrong by turns so that only the totals agree."""
    runs = book.where(F.startswith("description", F.lit("Payroll run")))
    third = F.col("row_id") % 3
    turn = F.row_number().over(Window.partitionBy(third).orderBy("row_id"))
    runs = runs.withColumn("turn", turn).withColumn("of", F.count("*").over(Window.partitionBy(third)))
    shift = F.when(third == 1, 1).when((third == 2) & ((F.col("turn") < F.col("of")) | (F.col("of") % 2 == 0)), F.when(F.col("turn") % 2 == 1, 700).otherwise(-700)).otherwise(0)
    parts = F.when((F.col("row_id") % 6 == 0) & (F.col("cents") > 100_000), F.array(F.col("cents") - 1500 - 20 * F.col("turn"), (1500 + 20 * F.col("turn")).cast("long"))).otherwise(F.array((F.col("cents") + shift).cast("long")))
    runs = runs.select("row_id", "doc_date", F.posexplode(parts).alias("part", "pay_cents"))
    return runs.select((F.col("row_id") * 2 + F.col("part")).alias("pay_id"), "pay_cents", F.date_add("doc_date", F.when(F.col("row_id") % 2 == 1, 3).otherwise(0)).alias("pay_day"))


CLAIM = (
    LEDGER
    + """, n0 AS (SELECT *, CAST(docno + 10000000 AS VARCHAR) AS num, docno % 9 = 4 AND row_id <= 2 AS reversal, l_partkey % 400 = 11 AND year(doc_date) BETWEEN 1996 AND 1999 AS paid FROM ledger),
book AS MATERIALIZED (
  SELECT docno AS k, row_id AS r, l_partkey AS p, num,
         CASE WHEN docno % 17 <> 5 THEN CASE docno % 5 WHEN 0 THEN 'INV-' || num WHEN 1 THEN '9' || num WHEN 2 THEN num WHEN 3 THEN 'X' || num || 'Y' ELSE 'Z' || left(num, 7) END END AS docno,
         docno * 100 + row_id AS row_id, CASE WHEN reversal THEN 'Reversal of fee' WHEN paid THEN 'Payroll run ' || description WHEN l_partkey % 8 = 0 THEN 'Grab ride ' || description ELSE description END AS description,
         CASE WHEN reversal THEN CASE row_id WHEN 1 THEN 5000 ELSE -5000 END WHEN docno % 6 = 2 AND docno % 11 <> 3 THEN 1000 * (1 + row_id % 2) ELSE cents END AS cents, doc_date, 'W' || CAST(l_partkey % 7 AS VARCHAR) AS wbs,
         CASE WHEN docno % 11 = 3 THEN translate(num, '0123456789', 'ABCDEFGHIJ') ELSE CASE docno % 5 WHEN 0 THEN 'INV' || num || ' (2)' WHEN 1 THEN 'scan_00' || num WHEN 2 THEN num || '_v3' WHEN 3 THEN num ELSE 'Q' || num END END AS stem
  FROM n0),
i0 AS (
  SELECT stem AS docno, r * 10 + unnest(CASE WHEN p % 10 = 5 THEN [0, 1] ELSE [0] END) AS item_id, CASE WHEN k % 6 = 2 THEN 'part ' || left(description, 20) ELSE description END AS description,
         CASE p % 10 WHEN 6 THEN cents + 3 WHEN 7 THEN CASE WHEN cents < 0 THEN -(-cents * 100 // 109) ELSE cents * 100 // 109 END WHEN 8 THEN cents + 1000 ELSE cents END AS cents, 'f' || CAST(p % 3 AS VARCHAR) AS file, 'text_row' AS source
  FROM book WHERE p % 10 <> 9 AND NOT starts_with(description, 'Payroll run')
  UNION ALL SELECT stem, 1000, 'Grand total', CAST(sum(cents) AS BIGINT), 'f0', 'trail_total' FROM book WHERE k % 7 = 0 GROUP BY stem
  UNION ALL SELECT stem, unnest([1001, 1002]), 'Voucher', unnest([500, -500]), 'f0', 'kv_item' FROM (SELECT DISTINCT stem FROM book WHERE k % 13 = 0)),
it AS MATERIALIZED (SELECT *, count(*) OVER w >= 2 AND sum(cents) OVER w = 0 AS net_zero FROM i0 WINDOW w AS (PARTITION BY docno, trim(regexp_replace(lower(description), '\\s+', ' ', 'g')))),
entries AS MATERIALIZED (SELECT 0 AS key, row_id, row_number() OVER (ORDER BY row_id) AS entry_id, cents AS entry_cents, doc_date AS entry_day FROM book WHERE regexp_matches(lower(description), 'eom|end of month|month end|payroll|salary|salaries|cpf|net pay')),
pay0 AS (SELECT *, row_number() OVER (PARTITION BY row_id % 3 ORDER BY row_id) AS turn, count(*) OVER (PARTITION BY row_id % 3) AS n FROM book WHERE starts_with(description, 'Payroll run')),
pay AS MATERIALIZED (
  SELECT 0 AS key, row_id * 2 + unnest(CASE WHEN row_id % 6 = 0 AND cents > 100000 THEN [0, 1] ELSE [0] END) AS pay_id, unnest(CASE WHEN row_id % 6 = 0 AND cents > 100000 THEN [cents - 1500 - 20 * turn, 1500 + 20 * turn] ELSE [cents + CASE WHEN row_id % 3 = 1 THEN 1 WHEN row_id % 3 = 2 AND (turn < n OR n % 2 = 0) THEN CASE WHEN turn % 2 = 1 THEN 700 ELSE -700 END ELSE 0 END] END) AS pay_cents,
         doc_date + CAST(CASE WHEN row_id % 2 = 1 THEN 3 ELSE 0 END AS INTEGER) AS pay_day FROM pay0)"""
)
