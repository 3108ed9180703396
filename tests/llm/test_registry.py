"""The registered queries against their SQL on DuckDB, over whole tables."""

import os
from collections import Counter

import duckdb
import pytest

from siftline.llm import registry

SF = os.environ.get("SIFTLINE_SF", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "conversations")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.sql(registry.oracle_sql()[name])
    ours = registry.queries()[name](spark, SF)
    assert sorted(ours.columns) == sorted(theirs.columns)
    names = sorted(ours.columns)
    assert Counter(map(tuple, ours.select(names).collect())) == Counter(theirs.project(", ".join(names)).fetchall())


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in registry.queries()] == [*(f"op{n}" for n in range(1, 11)), "pipeline"]
