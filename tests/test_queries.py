"""Every registered query of the core package against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from scrivener.plans import inspections, oracles, queries, studies

QUERIES, ORACLE_SQL = queries.QUERIES | studies.QUERIES | inspections.QUERIES, oracles.ORACLE_SQL | studies.ORACLE_SQL | inspections.ORACLE_SQL

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"fit_logreg", "ablation", "calibration_methods", "group_refits_features", "metadata_fit", "learned_tag_entropy"}


def same(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_all_but_fits_have_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == ROWS_ONLY and not set(ORACLE_SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(map(same, r)) for r in found.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    if name in ROWS_ONLY:
        assert rows
        return
    sql = tables.sql(ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert rows == sorted((tuple(same(r[i]) for i in at) for r in sql.fetchall()), key=str)
