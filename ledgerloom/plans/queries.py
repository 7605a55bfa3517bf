"""The engine's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import ReconcileConfig
from ledgerloom.functions import dates, money, predicates, text
from ledgerloom.operators import docpool, extract, matching, netting, totals, verdicts
from ledgerloom.plans import line_items as items_plan
from ledgerloom.plans import reconcile as whole
from ledgerloom.plans import views
from ledgerloom.plans.views import ITEMS, LEDGER, PAY, SIGNED
from ledgerloom.sources import discover
from ledgerloom.sources import ledger as ledger_source
from ledgerloom.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TOL = 5


def query(sql: str | None = None, day: str = "") -> Callable[[Query], Query]:
    """Register a query and its SQL; the column ``day`` of both is shown as text."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = (lambda spark, sf: f(spark, sf).withColumn(day, F.col(day).cast("string"))) if day else f
        if sql:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE (CAST({day} AS VARCHAR) AS {day}) FROM ({sql})" if day else sql
        return f

    return put


def doc_amounts(spark, sf):
    """Order totals as the ledger, order lines as items."""
    items = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("docno"), money.cents(F.col("l_extendedprice")).alias("cents"))
    book = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("docno"), money.cents(F.col("o_totalprice")).alias("cents"))
    return items, book


# Totals of documents


@query("""
WITH i AS (SELECT l_orderkey AS docno, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS item_cents FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS docno, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS ledger_cents FROM orders GROUP BY 1)
SELECT docno, item_cents, ledger_cents,
       CASE WHEN item_cents IS NULL THEN 'NO_MATCH' WHEN abs(item_cents - ledger_cents) * 100 <= greatest(500, abs(item_cents) * 5) THEN 'OK' ELSE 'AMOUNT_MISMATCH' END AS verdict
FROM b LEFT JOIN i USING (docno)""")
def doc_total_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    items, book = doc_amounts(spark, sf)
    return totals.doc_totals(items, book, TOL, 5)


@query("SELECT o_orderkey AS docno, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def doc_total_missing(spark: SparkSession, sf: str) -> DataFrame:
    items, book = doc_amounts(spark, sf)
    return totals.without_support(book, items)


# Matching items to rows

NEAR = ITEMS + """, near AS (
  SELECT i.docno, item_id, row_id, i.cents AS item_cents, l.cents AS row_cents, i.description AS item_desc, l.description AS row_desc
  FROM items i JOIN ledger l USING (docno) WHERE abs(i.cents - l.cents) <= 5)"""


@query(f"WITH {NEAR} SELECT docno, item_id, row_id, item_cents, row_cents FROM near")
def price_tol_match(spark: SparkSession, sf: str) -> DataFrame:
    return matching.candidates(views.items(spark, sf), views.ledger(spark, sf), TOL).select("docno", "item_id", "row_id", "item_cents", "row_cents")


@query(f"""WITH {ITEMS}, r AS (
  SELECT i.docno, item_id, row_id, l.cents AS row_cents, abs(i.cents - l.cents) AS apart, row_number() OVER (PARTITION BY i.docno, item_id ORDER BY abs(i.cents - l.cents), row_id) AS n
  FROM items i JOIN ledger l USING (docno))
SELECT docno, item_id, row_id, row_cents, apart FROM r WHERE n = 1""")
def nearest_amount_match(spark: SparkSession, sf: str) -> DataFrame:
    return matching.nearest_amount(views.items(spark, sf), views.ledger(spark, sf))


STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def sql_tokens(c: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '' AND t NOT IN ({STOP}))"


def sql_coverage(found: str, wanted: str) -> str:
    w = "CASE WHEN regexp_matches(t, '[0-9]') THEN 2 ELSE 1 END"
    total = f"coalesce(list_sum(list_transform({sql_tokens(wanted)}, lambda t: {w})), 0)"
    hit = f"coalesce(list_sum(list_transform({sql_tokens(wanted)}, lambda t: CASE WHEN list_contains({sql_tokens(found).replace('lambda t: t', 'lambda u: u').replace('AND t NOT', 'AND u NOT')}, t) THEN {w} ELSE 0 END)), 0)"
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    return f"CASE WHEN {norm(wanted)} = '' OR contains({norm(found)}, {norm(wanted)}) OR {total} = 0 THEN 1.0::DOUBLE ELSE CAST({hit} AS DOUBLE) / {total} END"


@query(f"""WITH {NEAR}, s AS (SELECT docno, item_id, row_id, round({sql_coverage('item_desc', 'row_desc')} * 100, 1) AS score FROM near)
SELECT docno, item_id, arg_min(row_id, (-score, row_id)) AS row_id, max(score) AS score FROM s GROUP BY docno, item_id""")
def coverage_best_match(spark: SparkSession, sf: str) -> DataFrame:
    return matching.best_coverage(views.items(spark, sf), views.ledger(spark, sf), TOL)


@query(f"""WITH a AS (SELECT p_partkey, p_name || ' ' || p_type AS found, p_type || CASE WHEN p_partkey % 3 = 0 THEN ' fees' ELSE ' ' || p_brand END AS wanted FROM part)
SELECT p_partkey, {sql_coverage('found', 'wanted')} AS covered FROM a""")
def desc_coverage(spark: SparkSession, sf: str) -> DataFrame:
    p = views.table(spark, sf, "part")
    wanted = F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, " fees").otherwise(F.concat(F.lit(" "), F.col("p_brand"))))
    return p.select("p_partkey", text.coverage(F.concat_ws(" ", "p_name", "p_type"), wanted).alias("covered"))


LOW = ", ".join(f"'{w}'" for w in text.LOW_INFO)


@query(f"""WITH a AS (SELECT p_partkey, {sql_tokens("p_name || ' ' || p_type")} AS have, list_filter({sql_tokens("p_type || CASE WHEN p_partkey % 3 = 0 THEN ' fees' WHEN p_partkey % 3 = 1 THEN 's' ELSE ' extra' END")}, lambda t: t NOT IN ({LOW})) AS wanted FROM part)
SELECT p_partkey, len(list_filter(wanted, lambda w: NOT (list_contains(have, w) OR (ends_with(w, 'es') AND list_contains(have, w[:-3])) OR (ends_with(w, 's') AND list_contains(have, w[:-2]))))) = 0 AS same FROM a""")
def contains_same_words(spark: SparkSession, sf: str) -> DataFrame:
    p = views.table(spark, sf, "part")
    k = F.col("p_partkey") % 3
    wanted = F.concat(F.col("p_type"), F.when(k == 0, " fees").when(k == 1, "s").otherwise(" extra"))
    return p.select("p_partkey", text.same_words(F.concat_ws(" ", "p_name", "p_type"), wanted).alias("same"))


@query(f"""WITH {ITEMS}, g AS (SELECT docno, item_id, (cents * 109 + 50) // 100 AS cents FROM items),
r AS (SELECT g.docno, item_id, row_id, l.cents AS row_cents, abs(g.cents - l.cents) AS apart, row_number() OVER (PARTITION BY g.docno, item_id ORDER BY abs(g.cents - l.cents), row_id) AS n FROM g JOIN ledger l USING (docno) WHERE abs(g.cents - l.cents) <= 5)
SELECT docno, item_id, row_id, row_cents, apart FROM r WHERE n = 1""")
def grossup_match(spark: SparkSession, sf: str) -> DataFrame:
    return matching.gross_up_match(views.items(spark, sf), views.ledger(spark, sf), TOL)


@query(f"""WITH {ITEMS}, i AS (SELECT *, row_number() OVER (PARTITION BY docno, cents ORDER BY item_id) AS n FROM items),
l AS (SELECT *, row_number() OVER (PARTITION BY docno, cents ORDER BY row_id) AS n FROM ledger)
SELECT i.docno, item_id, row_id, i.cents FROM i JOIN l ON i.docno = l.docno AND i.cents = l.cents AND i.n = l.n""")
def greedy_exact_assign(spark: SparkSession, sf: str) -> DataFrame:
    return matching.exact_assign(views.items(spark, sf), views.ledger(spark, sf))


@query(f"""WITH RECURSIVE {NEAR},
o AS (SELECT docno, item_id, row_number() OVER (PARTITION BY docno ORDER BY item_id) AS k FROM items),
c AS (SELECT docno, k, near.item_id, list((abs(item_cents - row_cents), row_id) ORDER BY abs(item_cents - row_cents), row_id) AS options FROM near JOIN o USING (docno, item_id) GROUP BY ALL),
step AS (
  SELECT DISTINCT docno, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS item_id, NULL::BIGINT AS row_id FROM o
  UNION ALL
  SELECT s.docno, o.k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, o.item_id, pick
  FROM (SELECT s.docno, s.k + 1 AS k, used, o.item_id, list_filter(coalesce(options, []), lambda x: NOT list_contains(used, x[2]))[1][2] AS pick
        FROM step s JOIN o ON o.docno = s.docno AND o.k = s.k + 1 LEFT JOIN c ON c.docno = s.docno AND c.k = s.k + 1) s JOIN o ON o.docno = s.docno AND o.k = s.k)
SELECT docno, item_id, row_id FROM step WHERE row_id IS NOT NULL""")
def greedy_tol_assign(spark: SparkSession, sf: str) -> DataFrame:
    return matching.greedy_assign(views.items(spark, sf), views.ledger(spark, sf), TOL)


@query(f"""WITH {NEAR}, s AS (SELECT *, trim(regexp_replace(lower(item_desc), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(row_desc), '[^a-z0-9]+', ' ', 'g')) AS same, round({sql_coverage('item_desc', 'row_desc')} * 100, 1) AS cov FROM near),
b AS (SELECT *, row_number() OVER (PARTITION BY docno, item_id ORDER BY same DESC, CASE WHEN same THEN abs(item_cents - row_cents) ELSE 0 END, CASE WHEN same THEN 100.0 ELSE cov END DESC, row_id) AS n FROM s),
m AS (SELECT *, len(list_filter(list_filter({sql_tokens('row_desc')}, lambda t: t NOT IN ({LOW})), lambda w: NOT (list_contains({sql_tokens('item_desc').replace('lambda t: t', 'lambda u: u').replace('AND t NOT', 'AND u NOT')}, w) OR (ends_with(w, 'es') AND list_contains({sql_tokens('item_desc').replace('lambda t: t', 'lambda u: u').replace('AND t NOT', 'AND u NOT')}, w[:-3])) OR (ends_with(w, 's') AND list_contains({sql_tokens('item_desc').replace('lambda t: t', 'lambda u: u').replace('AND t NOT', 'AND u NOT')}, w[:-2]))))) = 0 AS words FROM b WHERE n = 1),
d AS (SELECT docno, CAST(sum(cents) AS BIGINT) AS doc_cents, count(*) AS doc_rows FROM ledger GROUP BY 1),
g0 AS (SELECT i.docno, item_id, row_id, row_number() OVER (PARTITION BY i.docno, item_id ORDER BY abs((i.cents * 109 + 50) // 100 - l.cents), row_id) AS n FROM items i JOIN ledger l USING (docno) WHERE abs((i.cents * 109 + 50) // 100 - l.cents) <= 5),
j AS (SELECT i.docno, i.item_id, m.row_id AS m_row, m.same, m.cov, m.words, g0.row_id AS g_row, d.doc_rows >= 2 AND abs(doc_cents - i.cents) <= 5 AS total
      FROM items i LEFT JOIN m USING (docno, item_id) LEFT JOIN g0 ON g0.docno = i.docno AND g0.item_id = i.item_id AND g0.n = 1 LEFT JOIN d ON d.docno = i.docno)
SELECT docno, item_id, CASE WHEN m_row IS NOT NULL THEN m_row WHEN total THEN NULL ELSE g_row END AS row_id,
  CASE WHEN m_row IS NOT NULL THEN CASE WHEN same THEN 'price_then_exact' WHEN cov < 80 AND NOT words THEN 'price_then_coverage|weak_desc' ELSE 'price_then_coverage' END WHEN total THEN 'price_doc_total_sum' WHEN g_row IS NOT NULL THEN 'price_grossup' ELSE '' END AS rule,
  CASE WHEN m_row IS NOT NULL OR total OR g_row IS NOT NULL THEN 'OK' ELSE 'NO_MATCH' END AS status,
  CASE WHEN m_row IS NOT NULL THEN CASE WHEN same THEN 100.0 ELSE cov END WHEN total OR g_row IS NOT NULL THEN 100.0 ELSE 0.0 END::DOUBLE AS score,
  CASE WHEN m_row IS NULL AND NOT total AND g_row IS NULL THEN 'AMOUNT_DOES_NOT_TALLY' END AS no_match_type
FROM j""")
def match_items(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_items(views.items(spark, sf), views.ledger(spark, sf), TOL)


def scored_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Near pairs with a status and a score that follow from their ids."""
    pairs = matching.candidates(views.items(spark, sf), views.ledger(spark, sf), 100_000)
    status = F.when((F.col("item_id") + F.col("row_id")) % 3 == 0, "OK").when((F.col("item_id") + F.col("row_id")) % 3 == 1, "FLAG").otherwise("NO_MATCH")
    return pairs.select("docno", "item_id", "row_id", "item_cents", "row_cents", status.alias("status"), ((F.col("item_cents") * 7 + F.col("row_cents")) % 101).alias("score"), F.length("item_desc").alias("n_desc"))


SCORED = ITEMS + """, scored AS (
  SELECT docno, item_id, row_id, i.cents AS item_cents, l.cents AS row_cents, CASE (item_id + row_id) % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'FLAG' ELSE 'NO_MATCH' END AS status, (i.cents * 7 + l.cents) % 101 AS score, CAST(length(i.description) AS INTEGER) AS n_desc
  FROM items i JOIN ledger l USING (docno) WHERE abs(i.cents - l.cents) <= 100000)"""
PRIO = "CASE status WHEN 'OK' THEN 4 WHEN 'FLAG' THEN 1 ELSE 0 END"


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY docno, item_cents, row_id ORDER BY {PRIO} DESC, score DESC, n_desc DESC, item_id) AS n FROM scored) SELECT docno, item_id, row_id, item_cents, status, score FROM r WHERE n = 1")
def match_dedup_best(spark: SparkSession, sf: str) -> DataFrame:
    best = matching.best_matches(scored_matches(spark, sf), ["docno", "item_cents", "row_id"], [F.desc("score"), F.desc("n_desc"), F.col("item_id")])
    return best.select("docno", "item_id", "row_id", "item_cents", "status", "score")


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY docno, row_id ORDER BY {PRIO} DESC, score DESC, item_id) AS n FROM scored) SELECT docno, row_id, item_id, status, score FROM r WHERE n = 1")
def row_best(spark: SparkSession, sf: str) -> DataFrame:
    return matching.best_matches(scored_matches(spark, sf), ["docno", "row_id"], [F.desc("score"), F.col("item_id")]).select("docno", "row_id", "item_id", "status", "score")


@query(f"""WITH {ITEMS}, m AS (SELECT docno, file, CASE WHEN item_id % 3 = 0 THEN 'FLAG' ELSE 'OK' END AS status, cents % 101 AS score FROM items),
f AS (SELECT docno, file, count(*) FILTER (status = 'OK') AS n_ok, count(*) AS n, round(avg(score), 4) AS mean_score FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY docno ORDER BY n_ok DESC, n DESC, mean_score DESC, file) AS k FROM f)
SELECT docno, file, n_ok, n, mean_score FROM r WHERE k = 1""")
def preferred_file(spark: SparkSession, sf: str) -> DataFrame:
    m = views.items(spark, sf).select("docno", "file", F.when(F.col("item_id") % 3 == 0, "FLAG").otherwise("OK").alias("status"), (F.col("cents") % 101).alias("score"))
    return matching.preferred_file(m)


# Documents to ledger ids


def docs_and_ids(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """File stems of orders, and a ledger whose ids are written in five ways."""
    k = F.col("o_orderkey")
    stem = F.concat(F.when(k % 5 == 0, "INV").when(k % 5 == 1, "scan_00").when(k % 5 == 2, "AB").when(k % 5 == 3, "7700").otherwise("Q"), (k + 10_000_000).cast("string"), F.when(k % 4 == 0, " (2)").when(k % 4 == 1, "_v3").otherwise(""))
    number = (k + 10_000_000).cast("string")
    written = F.when(k % 5 == 0, F.concat(F.lit("INV-"), number)).when(k % 5 == 1, F.concat(F.lit("9"), number)).when(k % 5 == 2, F.concat(F.lit("X"), number, F.lit("Y"))).when(k % 5 == 3, number).otherwise(F.concat(F.lit("Z"), F.left(number, F.lit(7))))
    o = views.table(spark, sf, "orders")
    return o.select(stem.alias("docno")), o.where(k % 3 != 0).select(written.alias("doc"))


STEMS = """o AS (SELECT o_orderkey AS k, CAST(o_orderkey + 10000000 AS VARCHAR) AS num FROM orders),
docs AS (SELECT DISTINCT docno, regexp_replace(upper(regexp_replace(regexp_replace(regexp_replace(docno, '\\([ ]*[0-9]+[ ]*\\)$', ''), '(?i)[ _-]v[0-9]+$', ''), '(?i)\\b(original|compressed|copy|scanned)\\b', '')), '[^A-Z0-9]', '', 'g') AS number
  FROM (SELECT CASE k % 5 WHEN 0 THEN 'INV' WHEN 1 THEN 'scan_00' WHEN 2 THEN 'AB' WHEN 3 THEN '7700' ELSE 'Q' END || num || CASE k % 4 WHEN 0 THEN ' (2)' WHEN 1 THEN '_v3' ELSE '' END AS docno FROM o)),
ids AS (SELECT DISTINCT regexp_replace(upper(doc), '[^A-Z0-9]', '', 'g') AS ledger_id, regexp_replace(doc, '[^0-9]', '', 'g') AS digits
  FROM (SELECT CASE k % 5 WHEN 0 THEN 'INV-' || num WHEN 1 THEN '9' || num WHEN 2 THEN 'X' || num || 'Y' WHEN 3 THEN num ELSE 'Z' || num[:7] END AS doc FROM o WHERE k % 3 <> 0)),
keys AS (SELECT DISTINCT docno, key FROM (
  SELECT docno, unnest(list_concat([number, ltrim(number, '0')], list_concat(regexp_extract_all(number, '[A-Z]{1,4}[0-9]{3,}'), list_concat(regexp_extract_all(number, '[0-9]{5,}'), list_transform(regexp_extract_all(number, '[0-9]{5,}'), lambda x: ltrim(x, '0')))))) AS key FROM docs) WHERE key <> ''),
eq AS (SELECT DISTINCT docno, ledger_id, 'doc_eq' AS tier FROM keys JOIN ids ON key = ledger_id)"""
SUFFIX = STEMS + """, sp AS (
  SELECT docno, ledger_id, list_max(list_filter(range(8, least(length(mine), length(digits)) + 1), lambda n: right(mine, n) = right(digits, n))) AS same
  FROM (SELECT docno, regexp_replace(number, '[^0-9]', '', 'g') AS mine FROM docs) JOIN (SELECT * FROM ids WHERE length(digits) >= 8) ON right(mine, 8) = right(digits, 8) WHERE length(mine) >= 8),
suffix AS (SELECT docno, ledger_id, 'doc_suffix_' || CAST(same AS VARCHAR) AS tier FROM (SELECT *, rank() OVER (PARTITION BY docno ORDER BY same DESC) AS r FROM sp) WHERE r = 1)"""
CONTAIN = SUFFIX + """, runs AS (
  SELECT DISTINCT docno, run FROM (SELECT docno, unnest(list_concat([r, ltrim(r, '0')], CASE WHEN length(r) >= 8 THEN [right(r, 8), right(r, 9)] ELSE [] END)) AS run
    FROM (SELECT docno, unnest(regexp_extract_all(number, '[0-9]{5,}')) AS r FROM docs)) WHERE length(run) >= 5),
grams AS (SELECT DISTINCT ledger_id, substr(ledger_id, CAST(i AS INTEGER), 5) AS gram FROM (SELECT ledger_id, unnest(range(1, greatest(length(ledger_id) - 3, 2))) AS i FROM ids WHERE length(digits) >= 7)),
contain AS (SELECT DISTINCT docno, ledger_id, 'doc_contains' AS tier FROM runs JOIN grams ON left(run, 5) = gram WHERE contains(ledger_id, run))"""


@query(f"WITH {STEMS} SELECT * FROM eq")
def docpool_eq(spark: SparkSession, sf: str) -> DataFrame:
    docs, book = docs_and_ids(spark, sf)
    return docpool.by_equality(docpool.documents(docs), docpool.ledger_ids(book, "doc")).select("docno", "ledger_id", "tier")


@query(f"WITH {SUFFIX} SELECT * FROM suffix")
def docpool_suffix(spark: SparkSession, sf: str) -> DataFrame:
    docs, book = docs_and_ids(spark, sf)
    return docpool.by_suffix(docpool.documents(docs), docpool.ledger_ids(book, "doc"))


@query(f"WITH {CONTAIN} SELECT * FROM contain")
def docpool_contains(spark: SparkSession, sf: str) -> DataFrame:
    docs, book = docs_and_ids(spark, sf)
    return docpool.by_containment(docpool.documents(docs), docpool.ledger_ids(book, "doc"))


ALPHA = CONTAIN + """, alpha AS (SELECT DISTINCT docno, ledger_id, 'doc_alpha' AS tier FROM (SELECT docno, unnest(regexp_extract_all(number, '[A-Z]{2,}[0-9]{3,}')) AS tag FROM docs) JOIN ids ON tag = ledger_id)"""


@query(f"WITH {ALPHA} SELECT * FROM alpha")
def docpool_alpha(spark: SparkSession, sf: str) -> DataFrame:
    docs, book = docs_and_ids(spark, sf)
    return docpool.by_tag(docpool.documents(docs), docpool.ledger_ids(book, "doc"))


CASCADE = ALPHA + """,
t1 AS (SELECT * FROM eq), t2 AS (SELECT * FROM suffix WHERE docno NOT IN (SELECT docno FROM t1)),
t3 AS (SELECT * FROM contain WHERE docno NOT IN (SELECT docno FROM t1 UNION SELECT docno FROM t2)),
t4 AS (SELECT * FROM alpha WHERE docno NOT IN (SELECT docno FROM t1 UNION SELECT docno FROM t2 UNION SELECT docno FROM t3)),
hits AS MATERIALIZED (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4)"""


@query(f"""WITH {CASCADE} SELECT * FROM hits UNION ALL SELECT docno, NULL, 'none' FROM docs WHERE docno NOT IN (SELECT docno FROM hits)""")
def docpool_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs, book = docs_and_ids(spark, sf)
    return docpool.pool(docs, book, "doc", with_overlap=False)


OVERLAP = CASCADE + """,
rest AS MATERIALIZED (SELECT docno, number, length(number) AS n FROM docs WHERE length(number) >= 4 AND docno NOT IN (SELECT docno FROM hits)),
mine AS MATERIALIZED (SELECT DISTINCT docno, number, n, substr(number, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS piece FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM (SELECT *, unnest(range(4, n + 1)) AS k FROM rest))),
theirs AS MATERIALIZED (SELECT DISTINCT ledger_id, m, substr(ledger_id, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS piece FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT ledger_id, length(ledger_id) AS m, unnest(range(4, length(ledger_id) + 1)) AS k FROM ids WHERE length(ledger_id) >= 4))),
share AS (SELECT docno, ledger_id, max(length(piece)) / least(any_value(n), any_value(m)) AS share FROM mine JOIN theirs USING (piece)
  WHERE regexp_matches(piece, '[0-9]') AND length(piece) >= 0.8 * least(n, m) GROUP BY docno, ledger_id),
frac AS (SELECT docno, ledger_id, 'doc_frac_' || printf('%.2f', max(share) OVER (PARTITION BY docno)) AS tier FROM share),
pool AS (SELECT * FROM hits UNION ALL SELECT * FROM frac UNION ALL SELECT docno, NULL, 'none' FROM docs WHERE docno NOT IN (SELECT docno FROM hits UNION SELECT docno FROM frac))"""


#: The tiers alone: they need ``docs`` (docno, number) and ``ids`` (ledger_id, digits).
TIERS = "keys AS" + OVERLAP.partition("keys AS")[2]


@query(f"WITH {OVERLAP} SELECT * FROM pool")
def docpool_overlap(spark: SparkSession, sf: str) -> DataFrame:
    docs, book = docs_and_ids(spark, sf)
    return docpool.pool(docs, book, "doc")


# Amounts that cancel

NDESC = "trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {SIGNED} SELECT docno, row_id, cents, n >= 2 AND total = 0 AS net_zero_pair FROM (
  SELECT *, count(*) OVER w AS n, sum(cents) OVER w AS total FROM signed WINDOW w AS (PARTITION BY docno, currency, trim(regexp_replace(lower(description), '\\s+', ' ', 'g'))))""")
def item_net_zero(spark: SparkSession, sf: str) -> DataFrame:
    return netting.item_net_zero(views.signed_ledger(spark, sf)).select("docno", "row_id", "cents", "net_zero_pair")


@query(f"""WITH {SIGNED} SELECT docno, {NDESC} AS ndesc, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM signed GROUP BY 1, 2
HAVING count(*) >= 2 AND bool_or(cents > 0) AND bool_or(cents < 0) AND abs(sum(cents)) <= 5""")
def book_net_zero(spark: SparkSession, sf: str) -> DataFrame:
    return netting.ledger_net_zero(views.signed_ledger(spark, sf), TOL)


@query(f"""WITH {SIGNED}, d AS MATERIALIZED (SELECT docno, {NDESC} AS ndesc, row_id, cents FROM signed WHERE cents <> 0),
plus AS MATERIALIZED (SELECT docno, ndesc, row_id AS plus_row, cents, row_number() OVER (PARTITION BY docno, ndesc, cents ORDER BY row_id) AS nth FROM d WHERE cents > 0),
minus AS MATERIALIZED (SELECT docno, ndesc, row_id AS minus_row, -cents AS cents, row_number() OVER (PARTITION BY docno, ndesc, cents ORDER BY row_id) AS nth FROM d WHERE cents < 0)
SELECT docno, ndesc, plus_row, minus_row, cents FROM plus JOIN minus USING (docno, ndesc, cents, nth)""")
def offset_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return netting.offset_pairs(views.signed_ledger(spark, sf))


# Months


def months_and_support(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = views.ledger(spark, sf).withColumn("description", F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("Grab ride "), "description")).otherwise(F.col("description")))
    df = df.withColumn("wbs", F.concat(F.lit("W"), (F.col("l_partkey") % 7).cast("string")))
    months = totals.month_totals(df)
    shifted = months.select("month", F.explode(F.array(F.lit(0), F.lit(3), F.lit(900))).alias("off"), "cents", "wbs_set")
    support = shifted.select((F.months_between("month", F.lit("1990-01-01").cast("date")).cast("long") * 1000 + F.col("off")).alias("support_id"), "month", (F.col("cents") + F.col("off")).alias("cents"), F.when(F.col("off") == 0, F.slice("wbs_set", 1, 3)).otherwise(F.col("wbs_set")).alias("wbs_set"))
    return months, support


MONTHS = LEDGER + """, months AS (
  SELECT CAST(date_trunc('month', doc_date) AS DATE) AS month, CAST(sum(cents) AS BIGINT) AS cents, list_sort(list(DISTINCT 'W' || CAST(l_partkey % 7 AS VARCHAR))) AS wbs
  FROM ledger WHERE l_partkey % 4 = 0 OR regexp_matches(lower(description), 'grab|gojek|tada|uber|taxi|cab|corporate rides|rides|transport|comfort') GROUP BY 1)"""


@query(f"WITH {MONTHS} SELECT month, cents, array_to_string(wbs, ',') AS wbs FROM months", day="month")
def transport_totals(spark: SparkSession, sf: str) -> DataFrame:
    months, _ = months_and_support(spark, sf)
    return months.select("month", "cents", F.array_join("wbs_set", ",").alias("wbs"))


@query(f"""WITH {MONTHS}, support AS (
  SELECT (date_diff('month', DATE '1990-01-01', month)) * 1000 + o AS support_id, month, cents + o AS support_cents, CASE WHEN o = 0 THEN wbs[:3] ELSE wbs END AS swbs FROM months, (SELECT unnest([0, 3, 900]) AS o)),
r AS (SELECT m.month, m.cents, support_id, support_cents, CAST(len(list_intersect(wbs, swbs)) AS INTEGER) AS overlap, row_number() OVER (PARTITION BY m.month ORDER BY len(list_intersect(wbs, swbs)) DESC, support_id) AS n FROM months m JOIN support s ON m.month = s.month AND abs(m.cents - support_cents) <= 5)
SELECT m.month, m.cents, support_id, support_cents, overlap FROM months m LEFT JOIN r ON r.month = m.month AND n = 1""", day="month")
def transport_month(spark: SparkSession, sf: str) -> DataFrame:
    return totals.match_months(*months_and_support(spark, sf), TOL)


# End of month


@query("SELECT conv_id, turn, regexp_matches(lower(text || CASE WHEN turn % 3 = 0 THEN ' Payroll run' ELSE '' END), 'eom|end of month|month end|payroll|salary|salaries|cpf|net pay') AS eom FROM conversations")
def eom_keyword(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations")
    said = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 0, " Payroll run").otherwise(""))
    return c.select("conv_id", "turn", predicates.is_end_of_month(said).alias("eom"))


SAME = PAY + """, pairs AS (SELECT key, entry_id, entry_cents, pay_id, pay_cents, entry_day = pay_day AS same_day, bool_or(entry_day = pay_day) OVER (PARTITION BY key, entry_id) AS any_same FROM entries JOIN pay USING (key)),
cand AS (SELECT key, entry_id, entry_cents, pay_id, pay_cents, same_day FROM pairs WHERE same_day OR NOT any_same)"""


@query(f"WITH {SAME} SELECT * FROM cand")
def eom_same_day(spark: SparkSession, sf: str) -> DataFrame:
    return totals.same_day_candidates(*views.entries_and_pay(spark, sf))


LINE = SAME + """, r AS (SELECT key, entry_id, pay_id, abs(pay_cents - entry_cents) AS apart, row_number() OVER (PARTITION BY key, entry_id ORDER BY abs(pay_cents - entry_cents), pay_id) AS n FROM cand),
lines AS (SELECT key, entry_id, pay_id, apart FROM r WHERE n = 1 AND apart <= 5)"""


@query(f"WITH {LINE} SELECT * FROM lines")
def eom_line_match(spark: SparkSession, sf: str) -> DataFrame:
    return totals.line_match(*views.entries_and_pay(spark, sf), TOL)


@query(f"""WITH {PAY}, r AS (SELECT c.key, entry_id, a.pay_id AS first_pay_id, b.pay_id AS second_pay_id, row_number() OVER (PARTITION BY c.key, entry_id ORDER BY a.pay_id, b.pay_id) AS n
  FROM entries c JOIN pay a ON a.key = c.key JOIN pay b ON b.key = c.key AND a.pay_id < b.pay_id AND abs(a.pay_cents + b.pay_cents - entry_cents) <= 5)
SELECT key, entry_id, first_pay_id, second_pay_id FROM r WHERE n = 1""")
def eom_pair_sum(spark: SparkSession, sf: str) -> DataFrame:
    return totals.pair_sums(*views.entries_and_pay(spark, sf), TOL)


@query(f"""WITH {LINE}, c AS (SELECT coalesce(CAST(sum(entry_cents) AS BIGINT), 0) AS entries_left FROM entries WHERE (key, entry_id) NOT IN (SELECT (key, entry_id) FROM lines)),
p AS (SELECT coalesce(CAST(sum(pay_cents) AS BIGINT), 0) AS payroll_left FROM pay WHERE (key, pay_id) NOT IN (SELECT (key, pay_id) FROM lines))
SELECT abs(entries_left - payroll_left) <= 5 AS totals_match, entries_left, payroll_left FROM c, p""")
def eom_totals_backstop(spark: SparkSession, sf: str) -> DataFrame:
    entries, pay = views.entries_and_pay(spark, sf)
    return totals.backstop(entries, pay, totals.line_match(entries, pay, TOL), TOL)


EOM_STEPS = """o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY entry_id) AS k FROM entries),
c AS (SELECT key, k, list({'same': coalesce(pay_day = entry_day, false), 'apart': abs(pay_cents - entry_cents), 'id': pay_id} ORDER BY abs(pay_cents - entry_cents), pay_id) AS options FROM o JOIN pay USING (key) GROUP BY ALL),
step AS (
  SELECT DISTINCT key, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS entry_id, NULL::BIGINT AS pay_id FROM o
  UNION ALL
  SELECT key, k, CASE WHEN pick.apart <= 5 THEN list_append(used, pick.id) ELSE used END, entry_id, CASE WHEN pick.apart <= 5 THEN pick.id END
  FROM (SELECT key, k, used, entry_id, coalesce(list_filter(free, lambda x: x.same)[1], free[1]) AS pick
        FROM (SELECT s.key, o.k, used, o.entry_id, list_filter(options, lambda x: NOT list_contains(used, x.id)) AS free
              FROM step s JOIN o ON o.key = s.key AND o.k = s.k + 1 LEFT JOIN c ON c.key = s.key AND c.k = o.k))),
lines AS MATERIALIZED (SELECT key, entry_id, pay_id FROM step WHERE pay_id IS NOT NULL),
rest AS MATERIALIZED (SELECT * FROM entries ANTI JOIN lines USING (key, entry_id)), free_pay AS MATERIALIZED (SELECT * FROM pay ANTI JOIN lines USING (key, pay_id)),
pairs AS (SELECT c.key, entry_id, min((a.pay_id, b.pay_id)) AS p
  FROM rest c JOIN free_pay a ON a.key = c.key JOIN free_pay b ON b.key = c.key AND a.pay_id < b.pay_id AND abs(a.pay_cents + b.pay_cents - entry_cents) <= 5 GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {PAY}, {EOM_STEPS}
SELECT e.key, e.entry_id, CASE WHEN pay_id IS NOT NULL THEN 'eom_line_match' WHEN p IS NOT NULL THEN 'eom_pair_match' ELSE '' END AS rule,
  CASE WHEN pay_id IS NOT NULL THEN CAST(pay_id AS VARCHAR) WHEN p IS NOT NULL THEN CAST(p[1] AS VARCHAR) || ',' || CAST(p[2] AS VARCHAR) ELSE '' END AS pay_ids
FROM entries e LEFT JOIN lines USING (key, entry_id) LEFT JOIN pairs USING (key, entry_id)""")
def eom_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Lines one to one, then pairs of what is left."""
    return totals.end_of_month(*views.entries_and_pay(spark, sf), TOL)


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events WHERE event_id % 7 = 0 OR CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'", day="day")
def period_filter_null_true(spark: SparkSession, sf: str) -> DataFrame:
    return _in_period(spark, sf, dates.in_period)


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE event_id % 7 <> 0 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'", day="day")
def period_filter_null_false(spark: SparkSession, sf: str) -> DataFrame:
    return _in_period(spark, sf, dates.in_pay_period)


def _in_period(spark: SparkSession, sf: str, inside: Callable) -> DataFrame:
    from datetime import date

    day = F.when(F.col("event_id") % 7 != 0, F.to_date("ts"))
    e = views.table(spark, sf, "events").select("event_id", day.alias("day"))
    return e.where(inside(F.col("day"), date(2024, 1, 10), date(2024, 1, 20)))


# Scalars


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 2 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""", day="day")
def excel_serial_date(spark: SparkSession, sf: str) -> DataFrame:
    o, day = views.table(spark, sf, "orders"), F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    cell = F.when(k % 11 == 0, "not a date").when(k % 3 == 0, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")).when(k % 3 == 1, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "d MMMM yyyy"))
    return o.select("o_orderkey", dates.sheet_date(cell).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders", day="day")
def date_normalize(spark: SparkSession, sf: str) -> DataFrame:
    o, day, k = views.table(spark, sf, "orders"), F.to_date("o_orderdate"), F.col("o_orderkey")
    written = F.when(k % 13 == 0, "31/31/2025").when(k % 4 == 0, F.date_format(day, "dd-MM-yyyy")).when(k % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 2, F.date_format(day, "d MMM yyyy")).otherwise(F.date_format(day, "d/M/yy"))
    return o.select("o_orderkey", dates.parse_date(written).alias("day"))


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders", day="month")
def month_in_name(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders")
    name = F.concat(F.lit("support "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(".xlsx"))
    return o.select("o_orderkey", dates.month_in_name(name).alias("month"))


@query("""WITH a AS (SELECT o_orderkey AS k, CAST(o_orderkey + 12345678 AS VARCHAR) AS n FROM orders)
SELECT k AS o_orderkey, CASE k % 7 WHEN 4 THEN 'SV' || n WHEN 6 THEN 'RECEIPTONLY' ELSE n END AS doc_id FROM a""")
def doc_id_auto(spark: SparkSession, sf: str) -> DataFrame:
    o, k = views.table(spark, sf, "orders"), F.col("o_orderkey")
    n = (k + 12345678).cast("string")
    forms = [F.concat(F.lit("PO 00"), n, F.lit(" scan")), F.concat(F.lit("Order"), n, F.lit(" (1)")), F.concat(F.lit("SO "), n, F.lit(" v2")), F.concat(F.lit("Invoice "), n), F.concat(F.lit("SV0"), n, F.lit(" copy")), F.concat(F.lit("1234567 x"), n), F.lit("receipt only_v2")]
    stem = forms[-1]
    for i, f in enumerate(forms[:-1]):
        stem = F.when(k % 7 == i, f).otherwise(stem)
    return o.select("o_orderkey", text.doc_id(stem).alias("doc_id"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey * 1000 AS VARCHAR) WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') ELSE '' END AS id FROM customer""")
def id_normalize(spark: SparkSession, sf: str) -> DataFrame:
    c, k = views.table(spark, sf, "customer"), F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("e3"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".00"))).when(k % 4 == 2, F.col("c_name"))
    return c.select("c_custkey", text.identifier(raw).alias("id"))


@query("SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS ndesc FROM documents")
def norm_desc(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").select("doc_id", text.normal_text(F.col("text")).alias("ndesc"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS amount FROM customer")
def parse_amount(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "customer")
    shown = F.format_number(F.abs(F.round("c_acctbal", 2)), 2)
    written = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("$"), shown)).when(F.col("c_acctbal") < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(F.translate(shown, "0", "O"))
    return c.select("c_custkey", money.parse_amount(written).alias("amount"))


@query("""SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'SGD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'HKD' ELSE 'SGD' END AS currency FROM customer""")
def page_currency(spark: SparkSession, sf: str) -> DataFrame:
    c, k = views.table(spark, sf, "customer"), F.col("c_nationkey") % 5
    page = F.concat(F.col("c_name"), F.when(k == 0, " eur then sgd 5").when(k == 1, " $5").when(k == 2, " paid 12 Eur").when(k == 3, " HK$ 5").otherwise(" nothing"))
    return c.select("c_custkey", money.page_currency(page).alias("currency"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE 'Home' END AS origin, CASE p_partkey % 3 WHEN 0 THEN p_type ELSE p_brand END AS destination FROM part""")
def route_extract(spark: SparkSession, sf: str) -> DataFrame:
    p, k = views.table(spark, sf, "part"), F.col("p_partkey") % 3
    trip = F.when(k == 0, F.concat(F.lit("Grab: from "), F.translate("p_brand", "#", "#"), F.lit(" to "), F.col("p_type"))).when(k == 1, F.concat(F.lit("taxi to "), F.col("p_brand"), F.lit(" from Home"))).otherwise(F.concat(F.lit("Home to "), F.col("p_brand")))
    return p.select("p_partkey", text.route(trip)["origin"].alias("origin"), text.route(trip)["destination"].alias("destination"))


@query("SELECT p_partkey, contains(p_type, 'POLISHED') AS ride FROM part")
def transport_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = views.table(spark, sf, "part")
    about = F.when(F.contains("p_type", F.lit("POLISHED")), "Corporate Rides").otherwise(F.lit("Lunch"))
    return p.select("p_partkey", text.is_transport(about).alias("ride"))


@query("""SELECT doc_id, regexp_replace(source || '_' || CAST(doc_id AS VARCHAR), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM documents WHERE text IS NOT NULL""")
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", text.safe_name(F.concat_ws("_", "source", F.col("doc_id").cast("string"))).alias("name"))


# Text of documents to items


@query(f"WITH {LEDGER} SELECT 'o' || CAST(docno AS VARCHAR) AS file, doc_date AS date, 'SGD' AS currency, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description, cents FROM ledger", day="date")
def receipt_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.receipt_rows(extract.lines_of(views.receipts(spark, sf, "row")))
    return rows.select("file", "date", "currency", "description", money.cents(F.col("amount")).alias("cents"))


@query(f"WITH {LEDGER} SELECT 'o' || CAST(docno AS VARCHAR) AS file, doc_date AS date, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description, cents FROM ledger", day="date")
def stacked_receipts(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.stacked_receipts(extract.lines_of(views.receipts(spark, sf, "stack")))
    return rows.select("file", "date", "description", money.cents(F.col("amount")).alias("cents"))


@query(f"WITH {LEDGER} SELECT 'o' || CAST(docno AS VARCHAR) AS file, cents FROM ledger")
def dual_currency_due(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.dual_currency_due(extract.lines_of(views.receipts(spark, sf, "dual")))
    return rows.select("file", money.cents(F.col("amount")).alias("cents"))


@query(f"WITH {LEDGER} SELECT 'o' || CAST(docno AS VARCHAR) AS file, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description, 'SGD' AS currency, cents FROM ledger WHERE cents > 0")
def trailing_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.trailing_totals(extract.lines_of(views.receipts(spark, sf, "total")))
    return rows.select("file", "description", "currency", money.cents(F.col("amount")).alias("cents"))


@query(f"WITH {LEDGER} SELECT 'o' || CAST(docno AS VARCHAR) AS file, 'total' AS kind, 'SGD' AS currency, cents FROM ledger WHERE cents > 0")
def kv_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.labelled_amounts(extract.lines_of(views.receipts(spark, sf, "total")))
    return rows.select("file", "kind", "currency", money.cents(F.col("amount")).alias("cents"))


@query(f"WITH {LEDGER} SELECT 'o' || CAST(docno AS VARCHAR) AS file, CAST(row_id - 1 AS INTEGER) AS n, cents FROM ledger")
def free_text_amounts(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.dated_amounts(views.receipts(spark, sf, "free"))
    return rows.select("file", "n", money.cents(F.col("amount")).alias("cents"))


@query(f"""WITH {LEDGER}, pos AS (
  SELECT docno, row_id, doc_date, day, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY docno ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM (SELECT *, CAST(day(doc_date) AS VARCHAR) || '/' || CAST(month(doc_date) AS VARCHAR) || '/' || CAST(year(doc_date) AS VARCHAR) AS day,
    'Paid on ' || CAST(day(doc_date) AS VARCHAR) || '/' || CAST(month(doc_date) AS VARCHAR) || '/' || CAST(year(doc_date) AS VARCHAR) || ' for ' || description || ' the sum of SGD ' || CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ';' AS line FROM ledger)),
spots AS (SELECT docno, row_id, doc_date, base + 8 AS d_at, base + strpos(line, ' SGD ') AS f_at FROM pos),
r AS (SELECT f.docno, f.row_id, d.doc_date, row_number() OVER (PARTITION BY f.docno, f.row_id ORDER BY abs(d.d_at - f.f_at), d.d_at) AS n FROM spots f JOIN spots d ON f.docno = d.docno AND abs(d.d_at - f.f_at) <= 800)
SELECT 'o' || CAST(docno AS VARCHAR) AS file, CAST(row_id - 1 AS INTEGER) AS n, doc_date AS date FROM r WHERE n = 1""", day="date")
def nearest_date(spark: SparkSession, sf: str) -> DataFrame:
    return extract.dated_amounts(views.receipts(spark, sf, "free")).select("file", "n", "date")


@query("""SELECT doc_id, length(text) = 0 OR length(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', '', 'g')) / greatest(length(text), 1) < 0.55 OR len(regexp_extract_all(text, '[A-Za-z]{3,}')) / greatest(length(text) / 30.0, 1.0) < 0.15
  OR length(regexp_replace(left(text, 1500), '[\\x00-\\x7E]', '', 'g')) / greatest(length(left(text, 1500)), 1) > 0.25 AS garbage FROM documents""")
def garbage_pages(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").select("doc_id", predicates.is_garbage(F.col("text")).alias("garbage"))


@query("SELECT conv_id, turn, regexp_matches(text || CASE WHEN turn % 2 = 0 THEN ' Grand  Total 5.00' ELSE ' sum' END, '(?i)\\b(grand\\s*total|sub\\s*total|total|amount\\s+due|balance\\s+due)\\b') AS total FROM conversations")
def total_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", predicates.says_total(F.concat(F.col("text"), F.when(F.col("turn") % 2 == 0, " Grand  Total 5.00").otherwise(" sum"))).alias("total"))


@query(f"WITH {LEDGER} SELECT 'o' || CAST(docno AS VARCHAR) AS file, doc_date AS date, 'SGD' AS currency, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description, cents FROM ledger", day="date")
def unwrapped_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts whose currency and cents were wrapped onto lines of their own."""
    pages = views.receipts(spark, sf, "row")
    wrapped = pages.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"SGD ", "SGD\n"), r"\.([0-9]{2})(?=\n|$)", "\n$1"))
    rows = extract.receipt_rows(extract.lines_of(extract.unwrap(wrapped)))
    return rows.select("file", "date", "currency", "description", money.cents(F.col("amount")).alias("cents"))


@query(f"WITH {LEDGER} SELECT 'o' || CAST(docno AS VARCHAR) AS file, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description, 'SGD' AS currency, cents FROM ledger WHERE cents > 0")
def header_table(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.receipts(spark, sf, "table")
    text_ = F.concat(F.lit("Invoice 12.00\nDescription    Amount\n"), F.col("text"), F.lit("\nGrand Total    99.00\nnot a row    5.00"))
    rows = extract.header_table(extract.lines_of(pages.withColumn("text", text_)))
    return rows.select("file", "description", "currency", money.cents(F.col("amount")).alias("cents"))


@query(f"""WITH {LEDGER}, n AS (SELECT docno, count(*) AS n FROM ledger GROUP BY 1)
SELECT 'o' || CAST(docno AS VARCHAR) AS file, CAST(p AS INTEGER) AS page, CASE WHEN p IN (2, 3, 1, 4) AND n >= 1 THEN 'Home' END AS origin, CASE WHEN p IN (2, 3, 1, 4) AND n >= 1 THEN 'Office ' || CAST(docno AS VARCHAR) END AS destination
FROM n, (SELECT unnest([1, 2, 3, 4, 5]) AS p)""")
def page_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Five pages per order; the third tells the route, which serves pages one to four."""
    docs = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    pages = docs.select(F.concat(F.lit("o"), F.col("k").cast("string")).alias("file"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page"), "k")
    said = F.when(F.col("page") == 3, F.concat(F.lit("Receipt\nGrab from Home to Office "), F.col("k").cast("string"))).otherwise("nothing here")
    return extract.page_routes(pages.withColumn("text", said))


@query("""SELECT p_partkey, list_aggregate(list_filter(string_split(trim(regexp_replace(p_name || ' ' || p_type, '\\s+', ' ', 'g')), ' '), lambda w: NOT regexp_full_match(w, '[0-9.,]+')), 'string_agg', ' ') AS description FROM part""")
def compact_description(spark: SparkSession, sf: str) -> DataFrame:
    p = views.table(spark, sf, "part")
    line = F.concat(F.lit("31/7/2025 the "), F.col("p_name"), F.lit(" 12.50 of "), F.col("p_type"))
    return p.select("p_partkey", text.compact_description(line).alias("description"))


@query("""SELECT c_custkey, (CASE c_custkey % 4 WHEN 0 THEN 50.0 WHEN 1 THEN 10.0 WHEN 2 THEN -30.0 ELSE -15.0 END)::DOUBLE + (CASE WHEN c_nationkey % 2 = 0 THEN 2.0 ELSE 0.0 END)::DOUBLE + c_nationkey * 0.001::DOUBLE AS score FROM customer""")
def context_score(spark: SparkSession, sf: str) -> DataFrame:
    c, k = views.table(spark, sf, "customer"), F.col("c_custkey") % 4
    left = F.when(k == 0, "Total incl. GST").when(k == 1, "Total without GST").when(k == 2, "GST payable").otherwise("service charge")
    currency = F.when(F.col("c_nationkey") % 2 == 0, "SGD").otherwise("USD")
    return c.select("c_custkey", money.context_score(left, currency, F.lit("SGD"), F.col("c_nationkey")).alias("score"))


@query("""WITH p AS (SELECT p_partkey AS k, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part),
f AS (SELECT k, unnest(CASE k % 4
    WHEN 0 THEN [{'n': 0, 'cents': c, 'currency': 'EUR', 'picked': true}, {'n': 1, 'cents': 300, 'currency': 'SGD', 'picked': false}]
    WHEN 1 THEN [{'n': 0, 'cents': c, 'currency': 'USD', 'picked': true}]
    WHEN 2 THEN [{'n': 0, 'cents': c, 'currency': 'USD', 'picked': false}, {'n': 1, 'cents': 725, 'currency': 'GBP', 'picked': true}]
    ELSE [{'n': 0, 'cents': -c, 'currency': 'SGD', 'picked': true}, {'n': 1, 'cents': 50, 'currency': 'JPY', 'picked': false}] END) AS x FROM p)
SELECT CAST(k AS VARCHAR) AS file, x.n AS n, CAST(x.cents AS BIGINT) AS cents, x.currency AS currency, x.picked AS picked FROM f""")
def amount_currencies(spark: SparkSession, sf: str) -> DataFrame:
    """Figures whose currency stands behind, before or at them, and the one that the words on its left speak for."""
    p = views.table(spark, sf, "part").withColumn("cents", money.cents(F.col("p_retailprice")))
    amount = F.concat(F.expr("cents div 100").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    ways = [
        F.concat(F.lit("Total including GST "), amount, F.lit(" (EUR) and 17 pieces, GST payable SGD: 3.00")),
        F.concat(F.lit("paid on 31/7/2025 usd - "), amount, F.lit(" net")),
        F.concat(F.lit("US$"), amount, F.lit(" or GBP 7.25")),
        F.concat(F.lit("refund ("), amount, F.lit(") less delivery 0.50 JPY")),
    ]
    lines = p.select(F.col("p_partkey").cast("string").alias("file"), F.lit(1).alias("page"), F.lit(0).alias("line_no"), F.get(F.array(*ways), (F.col("p_partkey") % 4).cast("int")).alias("line"))
    return extract.amounts_in_context(lines).select("file", "n", money.cents(F.col("amount")).alias("cents"), "currency", "picked")


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS file, 's' AS sheet, CASE WHEN c_nationkey % 2 = 0 THEN 'Total pay' ELSE 'Paid' END AS "column", CAST(sum(CASE WHEN c_nationkey % 2 = 0 THEN 100 ELSE 100 * c_custkey END) AS BIGINT) AS cents FROM customer GROUP BY ALL""")
def support_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets whose total column is named, and sheets where the largest column is taken."""
    c, even = views.table(spark, sf, "customer"), F.col("c_nationkey") % 2 == 0
    cell = lambda no, header, value: F.struct(F.lit(no).alias("col_no"), header.alias("header"), value.alias("value"))
    cells = F.array(cell(0, F.lit("Name"), F.col("c_name")), cell(1, F.when(even, "Amount").otherwise("Paid"), F.col("c_custkey").cast("string")), cell(2, F.when(even, "Total pay").otherwise("Count"), F.lit("1.00")))
    rows = c.select(F.col("c_nationkey").cast("string").alias("file"), F.lit("s").alias("sheet"), F.explode(cells).alias("c"))
    return totals.support_summary(rows.select("file", "sheet", "c.*"))


@query(f"""WITH {LEDGER} SELECT 'o' || CAST(docno AS VARCHAR) AS file, CAST(row_id * 6 AS INTEGER) AS line_no,
  array_to_string(list_transform(string_split(trim(regexp_replace(description, '\\s+', ' ', 'g')), ' '), lambda w: w || CAST(row_id AS VARCHAR)), ' ') AS description, cents FROM ledger""")
def layout_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as words on a page: text from the left, the amount at 500, a repeated mark between."""
    df = views.ledger(spark, sf).withColumn("words", F.split(F.trim("description"), r"\s+"))
    amount = F.concat(F.expr("cents div 100").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    at = F.transform("words", lambda w, i: F.struct((i * 60.0).alias("x"), F.concat(w, F.col("row_id").cast("string")).alias("word")))
    every = F.concat(at, F.array(F.struct(F.lit(400.0).alias("x"), F.lit("qtymark").alias("word")), F.struct(F.lit(500.0).alias("x"), amount.alias("word"))))
    words = df.select(F.concat(F.lit("o"), F.col("docno").cast("string")).alias("file"), F.lit(1).alias("page"), (F.col("row_id") * 12.0).alias("y"), F.explode(every).alias("w")).select("file", "page", "y", "w.*")
    rows = extract.layout_rows(words)
    return rows.select("file", "line_no", "description", money.cents(F.col("amount")).alias("cents"))


@query(f"""WITH {LEDGER}, r AS (SELECT *, string_split(trim(regexp_replace(description, '\\s+', ' ', 'g')), ' ') AS w FROM ledger)
SELECT 'o' || CAST(docno AS VARCHAR) AS file, CAST(row_id * 50 + 6 AS INTEGER) AS line_no,
  array_to_string(list_transform(list_concat(CASE WHEN row_id % 3 = 1 THEN ['above', 'it'] ELSE [] END, list_concat(w, CASE WHEN row_id % 3 = 0 THEN [] ELSE ['one', 'two', 'three'] END)), lambda x: x || CAST(row_id AS VARCHAR)), ' ') AS description,
  CASE WHEN row_id % 2 = 0 THEN 'USD' ELSE 'SGD' END AS currency, cents FROM r""")
def layout_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as words on a page, their text over up to five lines: one above, three below, a fourth too many."""
    df = views.ledger(spark, sf).withColumn("words", F.split(F.trim("description"), r"\s+"))
    amount = F.concat(F.expr("cents div 100").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    n, k = F.col("row_id").cast("string"), F.col("row_id") % 3
    word = lambda y, x, w: F.struct(F.lit(y).cast("double").alias("dy"), x.cast("double").alias("x"), w.alias("word"))
    own = F.transform("words", lambda w, i: word(12, i * 50, F.concat(w, n)))
    figure = F.array(word(12, F.lit(460), F.when(F.col("row_id") % 2 == 0, "USD").otherwise("SGD")), word(12, F.lit(500), amount))
    above = F.when(k == 1, F.array(word(0, F.lit(0), F.concat(F.lit("above"), n)), word(0, F.lit(50), F.concat(F.lit("it"), n)))).otherwise(F.array().cast("array<struct<dy:double,x:double,word:string>>"))
    below = F.when(k != 0, F.array(*[word(24 + 12 * i, F.lit(0), F.concat(F.lit(w), n)) for i, w in enumerate(["one", "two", "three", "four"])])).otherwise(F.array(word(24, F.lit(0), F.lit("Grand")), word(24, F.lit(50), F.lit("total")), word(36, F.lit(0), F.concat(F.lit("lost"), n))))
    words = df.select(F.concat(F.lit("o"), F.col("docno").cast("string")).alias("file"), F.lit(1).alias("page"), "row_id", F.explode(F.concat(above, own, figure, below)).alias("w"))
    rows = extract.layout_rows(words.select("file", "page", (F.col("row_id") * 100.0 + F.col("w.dy")).alias("y"), "w.x", "w.word"))
    return rows.select("file", "line_no", "description", "currency", money.cents(F.col("amount")).alias("cents"))


# Positioned words: the words of conversations, placed by their numbers


def placed_words(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("page"), F.posexplode(F.split("text", " ")).alias("word_no", "word"))
    return c.select("file", "page", "word_no", "word", (F.col("word_no") % 7 * 83 + F.length("word") % 3).cast("double").alias("x"), (F.floor(F.col("word_no") / 7)).cast("int").alias("line_no"))


WORDS = """w0 AS (SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn AS INTEGER) AS page, string_split(text, ' ') AS ws FROM conversations),
words AS (SELECT file, page, CAST(i - 1 AS INTEGER) AS word_no, ws[i] AS word, CAST((i - 1) % 7 * 83 + length(ws[i]) % 3 AS DOUBLE) AS x, CAST((i - 1) // 7 AS INTEGER) AS line_no
  FROM (SELECT file, page, ws, unnest(range(1, len(ws) + 1)) AS i FROM w0))"""


@query(f"WITH {WORDS} SELECT file, page, line_no, string_agg(word, ' ' ORDER BY word_no) AS text FROM words WHERE trim(word) <> '' GROUP BY ALL")
def ocr_line_assembly(spark: SparkSession, sf: str) -> DataFrame:
    w = placed_words(spark, sf).withColumnRenamed("line_no", "line").withColumn("block", F.lit(1)).withColumn("par", F.lit(1))
    return extract.assemble_lines(w).select("file", "page", F.col("line").alias("line_no"), "text")


@query(f"""WITH {WORDS}, b AS (SELECT file, page, round_even(x / 10, 0) * 10 AS x, count(*) AS n FROM words GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file, page ORDER BY n DESC, x) AS k FROM b) SELECT file, page, x, n FROM r WHERE k = 1""")
def dominant_column(spark: SparkSession, sf: str) -> DataFrame:
    return extract.dominant_column(placed_words(spark, sf))


@query(f"WITH {WORDS} SELECT file, page, greatest(12.0, least(28.0, quantile_cont(x / 10, 0.25))) AS margin FROM words GROUP BY ALL")
def gap_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return extract.right_margin(placed_words(spark, sf).withColumn("gap", F.col("x") / 10))


@query(f"""WITH {WORDS}, n AS (SELECT file, page, count(DISTINCT line_no) AS n_lines FROM words GROUP BY ALL),
s AS (SELECT file, page, lower(word) AS word, count(DISTINCT line_no) AS n FROM words WHERE regexp_full_match(lower(word), '[a-z]{{3,}}') GROUP BY ALL)
SELECT file, page, word, n FROM s JOIN n USING (file, page) WHERE n >= 0.6 * n_lines""")
def noise_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return extract.noise_words(placed_words(spark, sf))


@query(f"""WITH {WORDS}, l AS (SELECT file, page, line_no, CAST(line_no * 12 + (line_no % 5 = 4)::INT * 20 AS DOUBLE) AS y FROM words GROUP BY ALL),
g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY file, page ORDER BY y, line_no) > 20 THEN 1 ELSE 0 END AS new FROM l)
SELECT file, page, line_no, y, CAST(sum(new) OVER (PARTITION BY file, page ORDER BY y, line_no) AS BIGINT) AS grp FROM g""")
def gap_line_groups(spark: SparkSession, sf: str) -> DataFrame:
    lines = placed_words(spark, sf).select("file", "page", "line_no").distinct()
    y = (F.col("line_no") * 12 + F.when(F.col("line_no") % 5 == 4, 20).otherwise(0)).cast("double")
    return extract.vertical_groups(lines.withColumn("y", y))


# Items


@query(f"""WITH {ITEMS}, r AS (SELECT docno, item_id, description, cents, row_number() OVER (PARTITION BY l_k, cents, trim(regexp_replace(lower(description), '\\s+', ' ', 'g')) ORDER BY docno, item_id) AS n FROM (SELECT *, file AS l_k FROM items))
SELECT docno, item_id, description, cents FROM r WHERE n = 1""")
def first_seen_items(spark: SparkSession, sf: str) -> DataFrame:
    items = views.items(spark, sf).withColumn("emit_seq", F.struct("docno", "item_id"))
    return extract.first_seen(items).select("docno", "item_id", "description", "cents")


@query(f"""WITH {ITEMS}, p AS (SELECT docno * 100 + item_id AS item_id, CASE WHEN item_id > 1 AND item_id % 2 = 0 THEN docno * 100 + item_id - 1 END AS parent_id, cents FROM items),
m AS (SELECT parent_id AS item_id, count(*) AS m FROM p WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT item_id, cents, unnest(range(1, greatest(coalesce(m, 1), 1) + 1)) AS copy FROM p LEFT JOIN m USING (item_id) WHERE parent_id IS NULL""")
def echo_synth(spark: SparkSession, sf: str) -> DataFrame:
    items = views.items(spark, sf)
    key = F.col("docno") * 100 + F.col("item_id")
    parent = F.when((F.col("item_id") > 1) & (F.col("item_id") % 2 == 0), key - 1)
    return extract.replicate_for_echoes(items.select(key.alias("item_id"), parent.alias("parent_id"), "cents")).select("item_id", "cents", "copy")


@query(f"""WITH {LEDGER}, r AS (SELECT docno, doc_date, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description, cents, row_id, row_number() OVER (PARTITION BY docno, cents, lower(trim(regexp_replace(description, '\\s+', ' ', 'g'))) ORDER BY row_id) AS n FROM ledger)
SELECT CAST(docno + 10000000 AS VARCHAR) AS docno, doc_date AS date, description, cents, 'receipt_row' AS source FROM r WHERE n = 1""", day="date")
def line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts of every order through all extractors; the file name tells the document."""
    pages = views.receipts(spark, sf, "row")
    number = (F.regexp_replace("file", "o", "").cast("long") + 10_000_000).cast("string")
    items = items_plan.line_items(pages.withColumn("file", F.concat(F.lit("Invoice "), number, F.lit(" (2).pdf"))))
    return items.select("docno", "date", "description", "cents", "source")


FORMS = LEDGER + """, r AS (SELECT *, CAST(l_partkey % 9 AS INTEGER) AS form, trim(regexp_replace(description, '\\\\s+', ' ', 'g')) AS said FROM ledger WHERE cents > 0),
i AS (SELECT docno, row_id, form, cents, CASE WHEN form IN (0, 1) THEN doc_date END AS own, CASE form WHEN 2 THEN 'Amount due' WHEN 6 THEN 'Amount' ELSE said END AS description,
        CASE form WHEN 0 THEN 'receipt_row' WHEN 1 THEN 'receipt_stack' WHEN 2 THEN 'kv_total' WHEN 3 THEN 'trail_total' WHEN 4 THEN 'table' WHEN 6 THEN 'kv_item' WHEN 8 THEN 'summary' ELSE 'text_row' END AS source FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY docno, cents, lower(description) ORDER BY form, row_id) AS n FROM i),
d AS (SELECT docno, arg_max(doc_date, (form, row_id)) AS last_day FROM r WHERE form IN (0, 1) GROUP BY 1)"""


@query(f"""WITH {FORMS}
SELECT 'o' || CAST(docno AS VARCHAR) AS file, form + 1 AS page, coalesce(own, last_day) AS date, description, 'SGD' AS currency, cents, source || CASE WHEN copy > 1 THEN '|echo_synth' ELSE '' END AS source
FROM (SELECT *, unnest(CASE WHEN form = 5 AND row_id % 3 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE n = 1) LEFT JOIN d USING (docno)""", day="date")
def line_items_all_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as items in nine forms, a page each; rows with two allocations that repeat them count twice."""
    items = items_plan.line_items(views.forms(spark, sf))
    return items.select("file", "page", "date", "description", "currency", "cents", "source")


@query(f"WITH {LEDGER} SELECT 'o' || CAST(docno AS VARCHAR) AS file, doc_date AS date, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description, cents, CAST(row_id % 9 AS INTEGER) AS wrap FROM ledger WHERE cents > 0", day="date")
def wrapped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts broken over lines in nine ways, a page for each, mended to one line each."""
    lines = extract.wrapped_lines(views.wrapped(spark, sf)).where("line <> ''")
    whole = r"^(?:SGD )?([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}) (.*?)(?: SGD)? ([0-9]+\.[0-9]{2})$"
    cut = lambda r: F.when(r != F.col("line"), F.split(r, "\u0001", 3)).otherwise(F.array(F.lit(""), F.lit(""), F.lit("")))
    parts = text.once(F.regexp_replace("line", whole, "$1\u0001$3\u0001$2"), cut)
    row = text.once(parts, lambda p: F.struct(dates.parse_date(p[0]).alias("date"), text.spaced(p[2]).alias("description"), money.cents(money.parse_amount(p[1])).alias("cents")))
    return lines.select("file", F.inline(F.array(row)), F.col("page").alias("wrap"))


# Verdicts


@query("""WITH ev AS (
  SELECT o_orderkey AS row_id, 0 AS phase, 'NO_MATCH' AS status, '' AS rule, 0.0::DOUBLE AS score, 'NO_MATCH' AS comment FROM orders
  UNION ALL SELECT o_orderkey, 1, 'OK', 'doc_total', 100.0, 'total' FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 3, 'OK', 'net_zero_book', 100.0, 'zero' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 4, CASE WHEN o_orderkey % 4 = 1 THEN 'FLAG' ELSE 'OK' END, 'item', CAST(o_orderkey % 100 AS DOUBLE), 'item' FROM orders WHERE o_orderkey % 5 < 2
  UNION ALL SELECT o_orderkey, 5, 'NO_MATCH', '', 0.0, 'NO_MATCH, MISSING SUPPORTING DOCS' FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, 9, 'OUT_OF_PERIOD', 'period_check', 0.0, 'outside' FROM orders WHERE o_orderkey % 11 = 0),
f AS (SELECT row_id, bool_or(phase = 3) AS zero, bool_or(phase BETWEEN 1 AND 4 AND status <> 'NO_MATCH') AS settled, any_value(row_id % 13 = 0) AS blank FROM ev GROUP BY 1),
r AS (SELECT ev.*, blank, row_number() OVER (PARTITION BY row_id ORDER BY phase DESC) AS n FROM ev JOIN f USING (row_id) WHERE NOT (phase = 4 AND zero) AND NOT (phase = 5 AND settled))
SELECT row_id, status, rule, score, CASE WHEN blank THEN '' ELSE comment END AS comment FROM r WHERE n = 1""")
def verdict_precedence(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = views.table(spark, sf, "orders").select("o_orderkey")
    event = lambda when, phase, status, rule, score, comment: F.when(when, F.struct(F.lit(phase).alias("phase"), status.alias("status"), F.lit(rule).alias("rule"), score.cast("double").alias("score"), F.lit(comment).alias("comment")))
    ok, no, hundred, zero = F.lit("OK"), F.lit("NO_MATCH"), F.lit(100), F.lit(0)
    every = [
        event(F.lit(True), 0, no, "", zero, "NO_MATCH"),
        event(k % 2 == 0, 1, ok, "doc_total", hundred, "total"),
        event(k % 3 == 0, 3, ok, "net_zero_book", hundred, "zero"),
        event(k % 5 < 2, 4, F.when(k % 4 == 1, "FLAG").otherwise("OK"), "item", k % 100, "item"),
        event(k % 7 == 0, 5, no, "", zero, "NO_MATCH, MISSING SUPPORTING DOCS"),
        event(k % 11 == 0, 9, F.lit("OUT_OF_PERIOD"), "period_check", zero, "outside"),
        event(k % 13 == 0, 10, no, "", zero, ""),
    ]
    events = o.select(k.alias("row_id"), F.explode(F.filter(F.array(*every), lambda e: e.isNotNull())).alias("e")).select("row_id", "e.*")
    return verdicts.reduce_events(events)


@query(f"""WITH {SCORED}, m AS (SELECT docno * 100 + row_id AS row_id, status, CASE WHEN item_id % 5 = 0 THEN 'price_grossup' ELSE 'price_then_exact' END AS rule, CAST(score AS DOUBLE) AS score, 'doc_eq' AS via FROM scored),
g AS (SELECT row_id, count(*) FILTER (status = 'OK') AS k, bool_or(rule = 'price_grossup') AS grossed, arg_max(status, ({PRIO}, score)) AS st, arg_max(score, ({PRIO}, score)) AS sc FROM m GROUP BY 1)
SELECT row_id, CASE WHEN st = 'OK' AND grossed THEN 'OK (GROSSUP MATCH) (row ' || CAST(row_id AS VARCHAR) || ')' WHEN st = 'OK' THEN 'OK – ' || CAST(k AS VARCHAR) || ' match(es) via doc_eq (row ' || CAST(row_id AS VARCHAR) || ')'
  WHEN st = 'FLAG' THEN 'FLAG – low match (score ' || printf('%.1f', sc) || ') (row ' || CAST(row_id AS VARCHAR) || ')' ELSE 'NO_MATCH' END AS comment FROM g""")
def comment_rollup(spark: SparkSession, sf: str) -> DataFrame:
    m = scored_matches(spark, sf)
    rule = F.when(F.col("item_id") % 5 == 0, "price_grossup").otherwise("price_then_exact")
    m = m.select((F.col("docno") * 100 + F.col("row_id")).alias("row_id"), "status", rule.alias("rule"), F.col("score").cast("double").alias("score"), F.lit("doc_eq").alias("via"), "item_cents", "row_cents")
    return verdicts.comments(m)


def sql_same_words(found: str, wanted: str) -> str:
    have = sql_tokens(found).replace("lambda t: t", "lambda u: u").replace("AND t NOT", "AND u NOT")
    known = f"list_contains({have}, w) OR (ends_with(w, 'es') AND list_contains({have}, w[:-3])) OR (ends_with(w, 's') AND list_contains({have}, w[:-2]))"
    return f"len(list_filter(list_filter({sql_tokens(wanted)}, lambda t: t NOT IN ({LOW})), lambda w: NOT ({known}))) = 0"


RIDE = "grab|gojek|tada|uber|taxi|cab|corporate rides|rides|transport|comfort"
UPPER_ID = "regexp_replace(upper(coalesce(docno, '')), '[^A-Z0-9]', '', 'g')"
RECONCILE = f"""WITH RECURSIVE {views.CLAIM},
docs AS MATERIALIZED (SELECT DISTINCT docno, regexp_replace(upper(regexp_replace(regexp_replace(regexp_replace(docno, '\\([ ]*[0-9]+[ ]*\\)$', ''), '(?i)[ _-]v[0-9]+$', ''), '(?i)\\b(original|compressed|copy|scanned)\\b', '')), '[^A-Z0-9]', '', 'g') AS number FROM it),
ids AS MATERIALIZED (SELECT DISTINCT {UPPER_ID} AS ledger_id, regexp_replace({UPPER_ID}, '[^0-9]', '', 'g') AS digits FROM book WHERE docno IS NOT NULL),
{TIERS},
{EOM_STEPS.replace("o AS (", "eo AS (").replace("FROM o ", "FROM eo ").replace("FROM o)", "FROM eo)").replace("FROM o\n", "FROM eo\n").replace("JOIN o ON o.", "JOIN eo o ON o.").replace("step", "estep").replace("c AS (SELECT key, k", "ec AS (SELECT key, k").replace("LEFT JOIN c ON", "LEFT JOIN ec c ON").replace("rest AS", "erest AS").replace("FROM rest c", "FROM erest c")},
places AS MATERIALIZED (SELECT docno, coalesce(ledger_id, '*') AS pool, tier FROM pool),
rs AS MATERIALIZED (SELECT row_id, docno AS ref, description, cents, doc_date, wbs, {UPPER_ID} AS lid, {NDESC} AS nd FROM book),
pooled AS MATERIALIZED (SELECT lid AS pool, row_id, cents, description, nd FROM rs WHERE lid <> '' UNION ALL SELECT '*', row_id, cents, description, nd FROM rs),
live AS MATERIALIZED (SELECT *, {NDESC} AS nd, row_number() OVER (PARTITION BY docno ORDER BY item_id) AS k FROM it WHERE NOT net_zero),
cand AS MATERIALIZED (SELECT l.docno, l.item_id, p.row_id, l.nd = p.nd AS same, abs(p.cents - l.cents) AS apart, l.description AS item_desc, p.description AS row_desc FROM live l JOIN places USING (docno) JOIN pooled p USING (pool) WHERE abs(p.cents - l.cents) <= 5),
scored AS MATERIALIZED (SELECT docno, item_id, row_id, same, apart, CASE WHEN same THEN 1.0::DOUBLE ELSE {sql_coverage('item_desc', 'row_desc')} END AS cov, {sql_same_words('item_desc', 'row_desc')} AS words FROM cand),
opts AS MATERIALIZED (SELECT docno, item_id, list(row_id ORDER BY same DESC, CASE WHEN same THEN apart ELSE 0 END, cov DESC, row_id) AS options FROM scored GROUP BY ALL),
pool_sums AS MATERIALIZED (SELECT pool, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM pooled GROUP BY 1),
sums AS MATERIALIZED (SELECT docno, CAST(sum(cents) AS BIGINT) AS pool_cents, CAST(sum(n) AS BIGINT) AS pool_rows, min(tier) AS tier FROM places JOIN pool_sums USING (pool) GROUP BY 1),
up AS (SELECT *, CASE WHEN cents < 0 THEN -((-cents * 109 + 50) // 100) ELSE (cents * 109 + 50) // 100 END AS gross FROM live),
g0 AS (SELECT u.docno, u.item_id, arg_min({{'row': p.row_id, 'of': p.description, 'mine': u.description}}, (abs(p.cents - gross), p.row_id)) AS g FROM up u JOIN places USING (docno) JOIN pooled p USING (pool) WHERE abs(p.cents - gross) <= 5 GROUP BY ALL),
g1 AS MATERIALIZED (SELECT docno, item_id, g.row AS gross_row, g.of AS gross_desc, g.mine AS gross_mine FROM g0),
todo AS MATERIALIZED (
  SELECT l.docno, l.k, l.item_id, coalesce(options, []) AS options, coalesce(pool_rows >= 2 AND abs(pool_cents - l.cents) <= 5, false) AS by_sum, gross_row, pool_rows, tier, round({sql_coverage('gross_mine', 'gross_desc')} * 100, 1) AS gross_score
  FROM live l LEFT JOIN opts USING (docno, item_id) LEFT JOIN sums USING (docno) LEFT JOIN g1 USING (docno, item_id)),
turn AS (
  SELECT DISTINCT docno, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS item_id, NULL::BIGINT AS pick, NULL::BOOLEAN AS spent FROM todo
  UNION ALL
  SELECT docno, k, CASE WHEN pick IS NOT NULL THEN list_append(used, pick) WHEN NOT by_sum AND gross_row IS NOT NULL THEN list_append(used, gross_row) ELSE used END, item_id, pick, coalesce(len(list_distinct(used)) = pool_rows, false)
  FROM (SELECT t.docno, t.k, used, t.item_id, by_sum, gross_row, pool_rows, list_filter(options, lambda x: NOT list_contains(used, x))[1] AS pick FROM turn s JOIN todo t ON t.docno = s.docno AND t.k = s.k + 1)),
m0 AS MATERIALIZED (
  SELECT l.docno, l.item_id, l.description, l.cents, l.file, l.source, tier, gross_row, gross_score, pick, s.same, round(s.cov * 100, 1) AS cov, s.words, pick IS NOT NULL AS chosen, pick IS NULL AND NOT spent AND by_sum AS summed, spent
  FROM live l JOIN turn u USING (docno, item_id) JOIN todo t USING (docno, item_id) LEFT JOIN scored s ON s.docno = l.docno AND s.item_id = l.item_id AND s.row_id = pick),
m AS MATERIALIZED (
  SELECT docno, item_id, description, cents, file, source, CASE WHEN chosen THEN pick WHEN NOT summed THEN gross_row END AS row_id,
         CASE WHEN chosen THEN CASE WHEN same THEN 'price_then_exact' ELSE 'price_then_coverage' END || CASE WHEN cov < 80 AND NOT words THEN '|weak_desc' ELSE '' END WHEN summed THEN 'price_doc_total_sum' WHEN gross_row IS NOT NULL THEN 'price_grossup' ELSE 'price_required' END AS rule,
         CASE WHEN chosen THEN cov WHEN summed THEN 100.0 WHEN gross_row IS NOT NULL THEN gross_score ELSE 0.0 END AS score, coalesce(tier, 'none') AS via FROM m0),
kept AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY docno, cents, contains(source, 'total'), row_id ORDER BY score DESC, length(description) DESC, item_id) AS n FROM m WHERE row_id IS NOT NULL) WHERE n = 1),
best AS MATERIALIZED (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY row_id ORDER BY score DESC, docno, item_id) AS n FROM kept) WHERE n = 1),
words AS (SELECT row_id, CASE WHEN bool_or(rule = 'price_grossup') THEN 'OK (GROSSUP MATCH)' ELSE 'OK – ' || CAST(count(*) AS VARCHAR) || ' match(es) via ' || arg_max(via, (score, via)) END || ' (row ' || CAST(row_id AS VARCHAR) || ')' AS comment FROM kept GROUP BY row_id),
own_sums AS (SELECT docno, CAST(sum(cents) AS BIGINT) AS item_cents FROM it GROUP BY 1),
equal AS (SELECT docno, item_cents, pool_cents FROM own_sums JOIN sums USING (docno) WHERE tier <> 'none' AND abs(item_cents - pool_cents) <= 5),
months AS (SELECT CAST(date_trunc('month', doc_date) AS DATE) AS month, CAST(sum(cents) AS BIGINT) AS cents FROM book WHERE regexp_matches(lower(description), '{RIDE}') GROUP BY 1),
fit AS (SELECT month, cents FROM months WHERE month(month) % 2 = 0),
zero AS (SELECT ref, nd FROM rs WHERE lid <> '' GROUP BY ALL HAVING count(*) >= 2 AND bool_or(cents > 0) AND bool_or(cents < 0) AND abs(sum(cents)) <= 5),
signs AS (SELECT *, row_number() OVER (PARTITION BY ref, nd, abs(cents), sign(cents) ORDER BY row_id) AS nth FROM rs WHERE lid <> '' AND cents <> 0),
couples AS (SELECT a.row_id AS x, b.row_id AS y FROM signs a JOIN signs b ON a.ref = b.ref AND a.nd = b.nd AND a.nth = b.nth AND a.cents = -b.cents AND a.cents > 0),
netted AS (SELECT row_id FROM rs JOIN zero USING (ref, nd) WHERE lid <> '' UNION SELECT x FROM couples UNION SELECT y FROM couples),
by_total AS (SELECT DISTINCT docno, pool_cents FROM m JOIN sums USING (docno) WHERE rule = 'price_doc_total_sum'),
found AS MATERIALIZED (SELECT e.row_id, lines.pay_id IS NOT NULL OR p IS NOT NULL AS matched, e.entry_id, e.entry_cents FROM entries e LEFT JOIN lines USING (key, entry_id) LEFT JOIN pairs USING (key, entry_id)),
gone AS (SELECT pay_id FROM lines UNION SELECT unnest([p[1], p[2]]) FROM pairs),
agreed AS (SELECT abs((SELECT coalesce(sum(entry_cents), 0) FROM found WHERE NOT matched) - (SELECT coalesce(sum(pay_cents), 0) FROM pay WHERE pay_id NOT IN (SELECT pay_id FROM gone))) <= 5 AS ok,
  (SELECT coalesce(sum(entry_cents), 0) FROM found WHERE NOT matched) / 100.0 AS entries_left, (SELECT coalesce(sum(pay_cents), 0) FROM pay WHERE pay_id NOT IN (SELECT pay_id FROM gone)) / 100.0 AS payroll_left),
ev AS MATERIALIZED (
  SELECT row_id, 0 AS phase, 'NO_MATCH' AS status, '' AS rule, 0.0::DOUBLE AS score, 'NO_MATCH' AS comment FROM rs
  UNION ALL SELECT row_id, 1, 'OK', 'doc_total_match_pdf_weak_desc', 100.0, printf('OK – doc total matches PDF (weak description) (pdf=%.2f, excel=%.2f)', item_cents / 100.0, pool_cents / 100.0) FROM equal JOIN places USING (docno) JOIN rs ON lid = pool
  UNION ALL SELECT row_id, 2, 'OK', 'transport_period_total', 100.0, printf('OK – transport total for %s matches support (claims=%.2f, support=%.2f)', strftime(month, '%Y-%m'), fit.cents / 100.0, fit.cents / 100.0) FROM rs JOIN fit ON CAST(date_trunc('month', doc_date) AS DATE) = month WHERE regexp_matches(lower(description), '{RIDE}')
  UNION ALL SELECT row_id, 3, 'OK', 'net_zero_book', 100.0, 'OK – net zero within claims book (offsetting entries)' FROM netted
  UNION ALL SELECT row_id, 4, 'OK', rule, score, comment FROM best JOIN words USING (row_id)
  UNION ALL SELECT row_id, 5, 'NO_MATCH', '', 0.0, 'NO_MATCH, MISSING SUPPORTING DOCS' FROM rs WHERE row_id NOT IN (SELECT row_id FROM kept)
  UNION ALL SELECT row_id, 6, 'OK', 'doc_total_sum', 100.0, printf('OK – doc total matches (sum=%.2f)', pool_cents / 100.0) FROM by_total JOIN places USING (docno) JOIN rs ON lid = pool OR pool = '*'
  UNION ALL SELECT row_id, 7, 'OK', 'eom_line_match', 100.0, 'OK – EOM matched to payroll (line)' FROM found WHERE matched
  UNION ALL SELECT row_id, 8, 'OK', 'eom_total_match', 100.0, 'OK – EOM totals match payroll' FROM found WHERE NOT matched AND (SELECT ok FROM agreed)
  UNION ALL SELECT row_id, 9, 'OUT_OF_PERIOD', 'period_check', 0.0, 'Outside of claim period' FROM rs WHERE NOT doc_date BETWEEN DATE '1995-01-01' AND DATE '2000-12-31'),
fl AS (SELECT row_id, bool_or(phase = 3) AS zero, bool_or(phase BETWEEN 1 AND 4 AND status <> 'NO_MATCH') AS settled FROM ev GROUP BY 1),
v AS (SELECT row_id, max((phase, score, rule, status, comment)) AS v FROM ev JOIN fl USING (row_id) WHERE NOT (phase = 4 AND zero) AND NOT (phase = 5 AND settled) GROUP BY 1),
w AS (SELECT row_id, v[4] AS status, v[3] AS rule, v[2] AS score, v[5] AS comment, coalesce(entry_id = 1 AND NOT ok AND v[4] <> 'OUT_OF_PERIOD', false) AS noted, entries_left, payroll_left FROM v LEFT JOIN found USING (row_id), agreed),
served AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY n DESC, mean_score DESC, file) AS place FROM (SELECT ref, file, count(*) AS n, round(avg(score), 4) AS mean_score FROM kept JOIN rs USING (row_id) WHERE ref IS NOT NULL GROUP BY ALL)) WHERE place = 1)
SELECT rs.ref AS docno, row_id, w.status, CASE WHEN noted THEN 'eom_total_diff' ELSE w.rule END AS rule, w.score,
       CASE WHEN lid = '' THEN '' WHEN noted THEN printf('EOM total mismatch vs payroll: claims_left=%.2f, payroll_left=%.2f', entries_left, payroll_left) ELSE w.comment END AS comment,
       coalesce(CASE WHEN lid = '' THEN NULL WHEN regexp_matches(lower(rs.description), '{RIDE}') OR regexp_matches(lower(best.description), '{RIDE}') OR regexp_matches(lower(best.file), '{RIDE}') THEN best.file ELSE coalesce(served.file, best.file) END, '') AS file
FROM rs JOIN w USING (row_id) LEFT JOIN best USING (row_id) LEFT JOIN served ON served.ref = rs.ref AND best.row_id IS NOT NULL"""


@query(RECONCILE)
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """All phases over all items and rows: pools, one-to-one matches, transport months, offsets, payroll and the period."""
    from datetime import date

    book = staged(views.claim_ledger(spark, sf), "reconcile-book")
    items = netting.item_net_zero(views.claim_items(book))
    months = totals.month_totals(book)
    support = months.select(F.months_between("month", F.lit("1990-01-01").cast("date")).cast("long").alias("support_id"), "month", (F.col("cents") + F.when(F.month("month") % 2 == 0, 0).otherwise(900)).alias("cents"), "wbs_set")
    config = ReconcileConfig(period_start=date(1995, 1, 1), period_end=date(2000, 12, 31))
    return whole.reconcile(items, book.drop("k", "r", "p"), config, support, views.claim_payroll(book))


# Sources


@query("""SELECT CASE c_custkey % 2 WHEN 0 THEN 'f0' ELSE 'f1' END AS file, min(c_custkey) AS header_row FROM customer WHERE c_custkey % 10 IN (3, 4) GROUP BY 1""")
def header_detect(spark: SparkSession, sf: str) -> DataFrame:
    c, k = views.table(spark, sf, "customer"), F.col("c_custkey")
    cells = F.when(k % 10 == 3, F.array(F.lit("Doc"), F.lit("Short Text"), F.lit("Amt (SGD)"))).when(k % 10 == 4, F.array(F.lit("Description"), F.lit("Amount"))).when(k % 10 == 2, F.array(F.lit("Description"), F.lit("Date"))).otherwise(F.array(F.col("c_name"), F.lit(None)))
    rows = c.select(F.concat(F.lit("f"), (k % 2).cast("string")).alias("file"), F.lit("s").alias("sheet"), k.alias("excel_row"), cells.alias("cells"))
    return ledger_source.header_rows(rows).select("file", "header_row")


@query("""WITH f AS (SELECT '/in/d' || CAST(page_id % 9 AS VARCHAR) || '/' || n AS path, n FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'account report ' WHEN 1 THEN 'notes ' WHEN 2 THEN 'payroll posting ' WHEN 3 THEN '~$account ' WHEN 4 THEN 'salary schedule ' ELSE 'actual ledger ' END || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 4 = 0 THEN '.csv' ELSE '.xlsx' END AS n FROM pages)),
l AS (SELECT path, row_number() OVER (ORDER BY CASE WHEN n LIKE '%.csv' AND n LIKE '%report%' THEN 0 WHEN regexp_matches(n, 'ledger|actual|posting|report') THEN 1 ELSE 2 END, CASE WHEN n LIKE '%.csv' THEN 0 ELSE 1 END, length(n), path) AS r FROM f WHERE n NOT LIKE '~$%'),
p AS (SELECT path, row_number() OVER (ORDER BY CASE WHEN n LIKE '%payroll%' THEN 0 ELSE 1 END, CASE WHEN n LIKE '%posting%' THEN 0 ELSE 1 END, length(n), path) AS r FROM f WHERE n LIKE '%.xlsx' AND regexp_matches(n, 'schedule|payroll|salary|cpf|sdf') AND n NOT LIKE '~$%')
SELECT 'ledger' AS kind, path FROM l WHERE r = 1 UNION ALL SELECT 'payroll', path FROM p WHERE r = 1""")
def file_rank(spark: SparkSession, sf: str) -> DataFrame:
    p, k = views.table(spark, sf, "pages"), F.col("page_id")
    stems = ["account report ", "notes ", "payroll posting ", "~$account ", "salary schedule ", "actual ledger "]
    name = F.concat(F.get(F.array(*map(F.lit, stems)), (k % 6).cast("int")), k.cast("string"), F.when(k % 4 == 0, ".csv").otherwise(".xlsx"))
    files = p.select(F.concat(F.lit("/in/d"), (k % 9).cast("string"), F.lit("/"), name).alias("path")).withColumn("name", discover.file_name(F.col("path")))
    return discover.ledger(files).select(F.lit("ledger").alias("kind"), "path").unionByName(discover.payroll(files).select(F.lit("payroll").alias("kind"), "path"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE 'pw' || CAST(conv_id + 1000 AS VARCHAR) END AS password FROM conversations")
def message_password(spark: SparkSession, sf: str) -> DataFrame:
    c, secret = views.table(spark, sf, "conversations"), F.concat(F.lit("pw"), (F.col("conv_id") + 1000).cast("string"))
    k = F.col("turn") % 4
    said = F.when(k == 0, F.concat(F.lit("Password: "), secret, F.lit("."))).when(k == 1, F.concat(F.lit("the password is \""), secret, F.lit("\""))).when(k == 2, F.concat(F.lit("PWD = "), secret)).otherwise(F.lit("password: abc"))
    return c.select("conv_id", "turn", discover.password(said).alias("password"))
