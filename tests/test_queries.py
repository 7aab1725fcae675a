"""Every query with SQL gives DuckDB's rows."""

import glob
import math
import os

import duckdb
import pytest

from plumeline.plans.oracle import ORACLE, oracle_sql
from plumeline.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
#: Iterative or driver-side algorithms, tested for themselves.
WITHOUT_SQL = {"map_clusterize", "precond_apply", "lanczos_posterior"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame):
    def cell(v):
        if v is None or v is getattr(__import__("pandas"), "NA", None) or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted([cell(v) for v in r] for r in frame[columns].astype(object).values.tolist())


def test_every_query_has_sql():
    assert QUERIES.keys() - ORACLE.keys() == WITHOUT_SQL
    assert not ORACLE.keys() - QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_posterior_sees_all_sites(spark, monkeypatch):
    from plumeline.plans import inversion

    seen, whole = [], inversion.state_sensitivity
    monkeypatch.setattr(inversion, "state_sensitivity", lambda obs, *rest: seen.append(obs) or whole(obs, *rest))
    QUERIES["lanczos_posterior"](spark, DATA)
    assert seen[0].select("site").distinct().count() > 1
