"""The calibrated chain: order statistics by value ranges, conformal states, the threshold cube, the ordered walk."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helmwatch.operators import conformal as C
from helmwatch.operators import health as H
from helmwatch.operators import order_statistics as O
from helmwatch.plans import diagnostic_queries as dq
from helmwatch.plans import health_queries as q
from tests.test_oracles import plain

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chain(spark):
    return q.Chain(spark, SF_DIR)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_sql(spark, duck, chain, monkeypatch, name):
    monkeypatch.setattr(q, "Chain", lambda *_: chain)
    got, want = q.QUERIES[name][0](spark, SF_DIR), duck.sql(q.QUERIES[name][1])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    expected = Counter(tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall())
    assert rows == expected and rows


@pytest.fixture(scope="module")
def audit(chain):
    return dq.Audit(chain)


@pytest.mark.parametrize("name", sorted(dq.QUERIES))
def test_audit_equals_sql(spark, duck, audit, monkeypatch, name):
    monkeypatch.setattr(dq, "_audit", lambda *_: audit)
    got, want = dq.QUERIES[name][0](spark, SF_DIR), duck.sql(dq.QUERIES[name][1])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == Counter(tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall()) and rows


def test_audit_reproduces_the_metrics(audit):
    """What the rows give under the selected configuration is what the walk over all configurations gave."""
    metrics = {(r["case_key"], r["configuration_id"]): r for r in audit.chain.metrics.collect()}
    for r in audit.cases.collect():
        m = metrics[r["case_key"], r["configuration_id"]]
        assert (r["prediction_rows"], r["actionable_rows"], r["raw_alarm_rows"]) == (m["rows"], m["actionable_rows"], m["tp"] + m["fp"])
        assert r["mean_width"] == pytest.approx(m["mean_width"]) and r["mean_score"] == pytest.approx(m["mean_interval_score"])
    assert {r["cause"] for r in audit.targets.collect()} > {"not_pathological"}


def test_longest_run_breaks_at_gaps_segments_and_idle_rows(spark):
    from helmwatch.operators import diagnostics as D

    rows = [("a", m, s, act, alarm) for m, s, act, alarm in [(0, 0, True, True), (10, 0, True, True), (30, 0, True, True), (40, 1, True, True), (50, 1, True, True), (60, 1, True, True), (70, 1, False, True), (80, 1, True, True), (90, 1, True, False)]]
    rows += [("b", 0, 0, True, False)]
    df = spark.createDataFrame(rows, "case_key string, m int, segment_id int, actionable boolean, alarm boolean").selectExpr("*", "timestampadd(MINUTE, m, timestamp_ntz'2024-01-01 00:00:00') AS ts")
    assert {r[0]: r[1] for r in D.longest_alarm_run(df, 10).collect()} == {"a": 3, "b": 0}


def test_audit_without_cases(spark, audit):
    from helmwatch.operators import diagnostics as D

    none = audit.cases.where("false")
    assert [r["anomaly_cases"] for r in D.phase_summary(none).collect()] == [0, 0, 0] and D.farm_summary(none).count() == 0
    assert D.width_concentration(none).first()["normal_cases"] == 0 and D.target_decomposition(audit.chain.fit, audit.chain.cases, none, q.GRID).count() == 0
    last = D.decision(none, audit.targets.where("false")).first()
    assert last["care"] is None and not last["new_experiment"] and not last["coverage_publishable"]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    rows = [(k, None if rng.random() < 0.1 else float(np.round(rng.normal(), 1)), int(rng.integers(0, 5))) for k in ["a", "a", "a", "b", None] for _ in range(400)]
    rows += [("lone", 2.5, 3), ("flat", 1.0, 0), ("flat", 1.0, 1), ("none", None, 2)]
    return rows, spark.createDataFrame(rows, "k string, v double, fold int").repartition(5)


def of_key(rows, key, without=None):
    return np.array([v for k, v, f in rows if k == key and v is not None and f != without])


def test_linear_quantiles_are_numpys(values):
    rows, df = values
    got = {r["k"]: (r["n"], r["q"]) for r in O.linear_quantiles(df, "v", (0.0, 0.25, 0.5, 0.9, 1.0), "k").collect()}
    assert set(got) == {"a", "b", None, "lone", "flat"}
    for key, (n, found) in got.items():
        v = of_key(rows, key)
        assert n == len(v) and np.allclose(found, np.quantile(v, [0, 0.25, 0.5, 0.9, 1.0]))


def test_complements_are_numpys(values):
    rows, df = values
    for higher in (False, True):
        got = O.complement_quantiles(df, "v", "fold", 5, (0.1, 0.5, 0.95), "k", higher=higher).collect()
        # A complement without values has no row: the lone value's own fold.
        assert len(got) == 3 * 5 + 4 + 5
        for r in got:
            v = of_key(rows, r["k"], r["fold"])
            assert r["n"] == len(v) and np.allclose(r["q"], np.quantile(v, [0.1, 0.5, 0.95], method="higher" if higher else "linear"))


def test_complement_parameters(values):
    rows, df = values
    for r in O.complement_parameters(df, "v", "fold", 5, "k").collect():
        v = of_key(rows, r["k"], r["fold"])
        iqr = np.subtract(*np.quantile(v, [0.75, 0.25]))
        scale = iqr if iqr > 1e-12 else v.std() if v.std() > 1e-12 else 1.0
        assert np.isclose(r["center"], np.median(v)) and np.isclose(r["scale"], scale)


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(8)
    rows = [("k", float(np.round(rng.normal(), 2)), float(rng.integers(1, 5)) / 8) for _ in range(500)]
    got = O.weighted_quantiles(spark.createDataFrame(rows, "k string, v double, w double"), "v", F.col("w"), (0.1, 0.5, 0.99), "k").first()
    v, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    order = np.argsort(v, kind="stable")
    run = np.cumsum(w[order])
    assert np.allclose(got["q"], [v[order][np.searchsorted(run, p * w.sum() - 1e-9)] for p in (0.1, 0.5, 0.99)]) and np.isclose(got["mass"], w.sum())


def test_complements_copy_no_rows(values):
    """Five complements: the aggregation holds one row a key and distinct value, not five."""
    rows, df = values
    assert O.fold_sums(df, "v", "fold", 5, "k").count() == len({(k, v) for k, v, _ in rows if v is not None})


def test_states_are_stored_and_loaded(spark, chain, tmp_path):
    C.store_state(chain.states, str(tmp_path / "states"))
    C.store_state(chain.models, str(tmp_path / "models"))
    one = C.load_case_conformal(spark, str(tmp_path / "states"), "Wind Farm B/1")
    assert one.select("case_key").distinct().count() == 1 and one.count() == 5
    arrays = C.case_arrays(one, q.N, len(q.GRID.coverages), q.FOLDS)
    models = C.load_case_mean_model(spark, str(tmp_path / "models"), "Wind Farm B/1")
    rows = C.residuals(chain.rows.where("train_test = 'prediction'"), models, False)
    whole = C.score_case_conformal(C.residuals(chain.rows.where("train_test = 'prediction'"), chain.models, False), chain.cases, q.GRID.coverages)
    assert sorted(map(str, C.score_case_conformal(rows, arrays, q.GRID.coverages).collect())) == sorted(map(str, whole.where("case_key = 'Wind Farm B/1'").collect()))
    width = C.predict_case_interval(rows, arrays, 1).select("scale", "half_width").first()
    m = arrays.first()["multipliers"][1]
    assert [w for w in width["half_width"]] == [s * k if s is not None else None for s, k in zip(width["scale"], m, strict=True)]
    means = C.predict_case_mean(rows, models).select("prediction", "y", "residual").collect()
    assert all(abs(p + r - y) < 1e-9 for x in means for p, y, r in zip(x["prediction"], x["y"], x["residual"], strict=True) if y is not None)


def test_multipliers_grow_with_coverage(chain):
    for r in chain.states.select("total.quantiles", "aleatoric.quantiles").collect():
        assert all(a <= b for found in r if found[0] is not None for a, b in zip(found, found[1:], strict=False))


def test_one_configuration_scores_like_the_matrix(spark, chain):
    k = 75
    rows = C.residuals(chain.rows, chain.models, False)
    one = {(r["case_key"], r["ts"]): (r["smoothed"], r["alarm"]) for r in H.score_case_health(rows, chain.cases, chain.thresholds, q.GRID, k).where("train_test = 'prediction'").collect()}
    window = k // len(q.GRID.quantiles) % len(q.GRID.windows)
    family = k // (len(q.GRID.quantiles) * len(q.GRID.windows))
    for r in chain.candidates.select("case_key", "ts", "smoothed", "alarms").collect():
        assert one[r["case_key"], r["ts"]] == (r["smoothed"][window][family], r["alarms"][k])
    assert any(alarm for _, alarm in one.values())


def test_walk_is_the_same_over_any_batches(spark, chain):
    want = sorted(map(str, H.case_metrics(chain.candidates, q.outcomes(chain.rows), q.GRID, q.CRITICALITY).drop("mean_width", "mean_covered", "mean_interval_score", "earliness").collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        shuffled = chain.candidates.orderBy(F.rand(3))
        got = sorted(map(str, H.case_metrics(shuffled, q.outcomes(chain.rows), q.GRID, q.CRITICALITY).drop("mean_width", "mean_covered", "mean_interval_score", "earliness").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want and want


def test_adjusted_p_values_with_ties_over_many_ranges(spark):
    from helmwatch.operators import relations as R

    rng = np.random.default_rng(2)
    p = [float(x) for x in np.round(rng.random(3000) ** 3, 3)]
    df = spark.createDataFrame([(i, "hot", x, 7) for i, x in enumerate(p)] + [(9001, "hot", None, 7), (9002, None, 0.2, 7)], "i int, k string, p double, rows int").repartition(6)
    got = {r["i"]: (r["holm"], r["bh"]) for r in R.benjamini_hochberg(R.holm(df, "p", "k"), "p", "k").collect()}
    order = np.argsort(p, kind="stable")
    s, m = np.array(p)[order], len(p)
    holm = np.minimum(1, np.maximum.accumulate((m - np.arange(m)) * s))
    bh = np.minimum(1, np.minimum.accumulate((s * m / np.arange(1, m + 1))[::-1])[::-1])
    assert all(np.isclose(got[int(i)][0], h) and np.isclose(got[int(i)][1], b) for i, h, b in zip(order, holm, bh, strict=True))
    assert got[9001] == (None, None) and got[9002] == (0.2, 0.2)


def test_transform_keeps_columns_with_the_parameters_names(spark):
    from helmwatch.operators import quality as A

    df = spark.createDataFrame([("a", 1.0, 5, "x"), ("a", 3.0, 6, "y"), ("a", None, 7, "z")], "k string, v double, center int, scale string")
    out = A.robust_transform(df, "v", A.robust_parameters(df, "v", "k"), "k")
    assert out.columns == ["k", "v", "center", "scale", "v_scaled", "v_missing"]
    assert sorted((r["center"], r["scale"], r["v_scaled"], r["v_missing"]) for r in out.collect()) == [(5, "x", -1.0, 0), (6, "y", 1.0, 0), (7, "z", 0.0, 1)]
