"""The registered queries against their SQL on DuckDB."""

import math
import os

import duckdb
import pytest

from siftline.plans import catalogue

SF = os.environ.get("SIFTLINE_SF", "/root/testdata/sf0.001")


def rows(frame):
    cell = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    names = sorted(frame.columns)
    return sorted(([cell(r[n]) for n in names] for r in frame.to_dict("records")), key=str), names


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("customer", "orders", "part", "lineitem", "events", "nation", "region", "documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours = catalogue.queries()[name](spark, SF).toPandas().astype(object)
    theirs = duck.sql(catalogue.oracle_sql()[name]).df().astype(object)
    ours, theirs = ours.where(ours.notna(), None), theirs.where(theirs.notna(), None)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()
