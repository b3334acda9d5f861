"""Every query with SQL against DuckDB, at the smallest scale."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from corpusq.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(entry.oracle_sql()) <= set(entry.queries())


def test_crawl_report_lists_up_to_100_errors(spark):
    rows = QUERIES["crawl_report"](spark, "/root/testdata/sf0.1").collect()
    assert max(r.urls_failed for r in rows) > 5
    assert all(len(r.errors.split("\n")) == min(100, r.urls_failed) for r in rows)


def test_safe_filename_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "é" * 400 + " name.txt"), (2, "a" + " " * 500 + "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.safe_name for r in QUERIES["safe_filename"](spark, str(tmp_path)).collect()} == {1: "name.txt", 2: "a_b"}
