"""Every registered query against its SQL text at the smallest scale."""

import duckdb
import pytest

from tools.check import TABLES, compare
from weftgraph.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, con, name):
    status, mine, theirs, _, note = compare(spark, name, SF, con)
    assert status in ("ok", "rows"), f"{name}: {status} {mine} {theirs} {note}"


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
    assert set(all_queries()) - set(all_oracles()) == {"ann_recall"}
