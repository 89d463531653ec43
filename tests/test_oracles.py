"""Each registered query against its DuckDB oracle on the smallest data folder."""

import duckdb
import pytest

import __spark_entry__ as E
from tools_compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
FAST = ["url_parts", "page_title", "directory_listing", "catch_all_hosts", "redirect_verdict",
        "html_links", "classify_urls", "secret_matches", "redacted_snippet", "normalize_target"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    cols = sorted(sdf.columns)
    assert cols == sorted(odf.columns)
    assert rows_of(sdf, cols) == rows_of(odf, cols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "finding_severity" in df.columns
