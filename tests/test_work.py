"""Work that must not come back: patterns a plan holds and times it deals rows out, and rows numbered as the SQL numbers them."""

import re

import pytest

from ledgerloom.plans import queries as plans
from ledgerloom.plans import views

SF = "/root/testdata/sf0.001"
#: The most patterns a plan may hold, and the most times it may deal rows out.
MOST = {
    "wrapped_pages": (70, 1),
    "unwrapped_receipts": (60, 1),
    "receipt_rows": (40, 1),
    "nearest_date": (30, 1),
    "free_text_amounts": (20, 1),
    "trailing_totals": (60, 1),
    "header_table": (24, 1),
    "greedy_tol_assign": (0, 0),
    "match_items": (12, 3),
}


@pytest.mark.parametrize("name", sorted(MOST))
def test_plans_do_no_more_than_they_must(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    patterns, deals = MOST[name]
    assert len(re.findall("RLIKE|regexp_", plan)) <= patterns
    assert len(re.findall("Exchange hashpartitioning", plan)) <= deals


def test_rows_without_a_part_are_not_numbered(spark, tmp_path):
    """The SQL numbers rows behind their join."""
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey <= 40").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SF}/part.parquet").where("p_partkey % 2 = 0").write.parquet(f"{tmp_path}/part.parquet")
    last = views.ledger(spark, str(tmp_path)).groupBy("docno").agg({"row_id": "max", "*": "count"}).collect()
    assert last and all(r["max(row_id)"] == r["count(1)"] for r in last)
