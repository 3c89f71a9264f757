"""Every query that has SQL is held against it on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from helmwatch.plans import catalog, diagnostic_queries, health_queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 4)
    return str(v)


# tests/test_health.py holds the calibrated chain against SQL on a larger table, fitted once.
@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - set(health_queries.QUERIES) - set(diagnostic_queries.QUERIES)))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF_DIR)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    names = want.columns
    expected = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in want.fetchall())
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_exact_limits_leave_their_tails(spark):
    """At the lower limit so many successes or more have probability 0.025, at the upper so many or fewer."""
    found = catalog.QUERIES["ag29_clopper_pearson"](spark, "/root/testdata/sf0.01").select("k", "n", "lower", "upper").distinct().collect()
    tail = lambda n, ks, p: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in ks)
    assert len(found) > 20
    for k, n, lower, upper in found:
        assert lower == 0 if k == 0 else abs(tail(n, range(k, n + 1), lower) - 0.025) < 1e-4
        assert upper == 1 if k == n else abs(tail(n, range(k + 1), upper) - 0.025) < 1e-4


def test_uncertainty_of_held_out_rows(spark):
    """Scores are residuals in units of the total scale, which is at least the aleatoric one."""
    rows = catalog.QUERIES["ml9_ml15_uncertainty"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 500
    for r in rows:
        assert r["total"] >= r["aleatoric"] - 1e-4 and (r["total"] < 1 or abs(r["score"] - abs(r["residual"]) / r["total"]) < 1e-2)


def test_phases_have_their_pathology(spark):
    """The cause stands beside the phase, as it did first."""
    rows = catalog.QUERIES["pr25_pr26_phases"](spark, SF_DIR).collect()
    assert len(rows) == 3 and {r["pathology"] for r in rows} == {"near_zero_target_scale"}
    assert "AS pathology" in catalog.ORACLES["pr25_pr26_phases"]
