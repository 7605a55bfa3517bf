import os
from collections import Counter

import duckdb
import pytest

from ledgerloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = db.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in want.fetchall())
    assert got == rows and got


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_the_others_have_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry_works_without_the_training_data_operators(spark, monkeypatch):
    import importlib.util as u

    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    find = u.find_spec
    monkeypatch.setattr(u, "find_spec", lambda name, *a: None if name == "ledgerloom.llm" else find(name, *a))
    assert set(entry.queries()) == set(plans.QUERIES) and set(entry.oracle_sql()) == set(plans.ORACLE_SQL)


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "ledgerloom")):
        if not folder.endswith("/llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "ledgerloom.llm" not in open(os.path.join(folder, f)).read(), f
