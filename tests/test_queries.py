"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from atomweave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(map(repr, (tuple(plain(r[i]) for i in order) for r in data)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(list(want.columns), want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_import_of_llm_elsewhere():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "atomweave")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as own:
                        text = own.read()
                    assert "atomweave.llm" not in text and "from .llm" not in text and "from ..llm" not in text
