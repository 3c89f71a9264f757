"""Operators on small fixtures with values worked out by hand."""

import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import bearing as B
from helmwatch.operators import evaluation as E
from helmwatch.operators import quality as A
from helmwatch.operators import relations as R
from helmwatch.operators import ridge as G
from helmwatch.operators import sequence as Q


def one(df):
    return tuple(df.first())


def series(spark, minutes, **columns):
    rows = [("c", float(m), i, *(v[i] for v in columns.values())) for i, m in enumerate(minutes)]
    kinds = {bool: "boolean", int: "long", float: "double"}
    extra = "".join(f", {k} {kinds[type(next(x for x in v if x is not None))]}" for k, v in columns.items())
    df = spark.createDataFrame(rows, f"case_key string, m double, row_id long{extra}")
    return df.withColumn("ts", F.timestamp_add("SECOND", (F.col("m") * 60).cast("int"), F.to_timestamp_ntz(F.lit("2024-01-01"))).cast("timestamp_ntz"))


def test_segments_break_at_any_other_step(spark):
    df = Q.strict_segments(series(spark, [0, 10, 20, 20, 30, 40.0166667, 50.0166667]), 10)
    assert [r["segment_id"] for r in df.orderBy("row_id").collect()][:2] == [0, 0]
    assert df.agg(F.max("segment_id")).first()[0] == 2
    audit = Q.order_audit(series(spark, [0, 10, 10, 5, 40]), "row_id", 10).first()
    assert (audit["duplicate_timestamps"], audit["nonmonotonic_timestamps"], audit["gap_count"], audit["continuous_segments"], audit["maximum_gap_minutes"]) == (1, 1, 1, 2, 35.0)


def test_criticality_walk_restarts_behind_a_gap(spark):
    df = series(spark, [0, 10, 20, 30, 50], alarm=[True, True, False, True, True], act=[True, True, True, False, True])
    walk = Q.criticality_walk(Q.strict_segments(df, 10), F.col("alarm"), F.col("act"))
    assert [r["criticality"] for r in walk.orderBy("row_id").collect()] == [1, 2, 1, 1, 1]
    first = Q.first_crossing(walk, 2).first()
    assert first["event_alarm"] and first["maximum_criticality"] == 2


def test_walk_equals_the_loop(spark):
    rng = np.random.default_rng(0)
    alarm, act = rng.random(400) < 0.5, rng.random(400) < 0.8
    df = series(spark, [10 * i for i in range(400)], alarm=alarm.tolist(), act=act.tolist())
    got = [r["criticality"] for r in Q.criticality_walk(Q.strict_segments(df, 10), F.col("alarm"), F.col("act")).orderBy("row_id").collect()]
    want, c = [], 0
    for a, on in zip(alarm, act, strict=True):
        c = max(0, c + (1 if a else -1)) if on else c
        want.append(c)
    assert got == want


def test_median_needs_a_full_window_and_runs_break(spark):
    df = Q.strict_segments(series(spark, [0, 10, 20, 30, 60, 70, 80], v=[1.0, 5.0, 3.0, None, 2.0, 4.0, 9.0]), 10)
    assert [r["smoothed"] for r in Q.causal_median(df, "v", 3).orderBy("row_id").collect()] == [None, None, 3.0, None, None, None, 4.0]
    assert Q.longest_run(df, F.col("v") > 2).first()["longest_run"] == 2
    assert Q.longest_run(df, F.col("v") > 99).first()["longest_run"] == 0


@pytest.mark.parametrize(("values", "want"), [((1.0, 1.0, 1.0, 1.0, 0), 0.0), ((1.0, 1.0, 1.0, 0.4, 1), 0.4), ((0.5, 0.5, 0.5, 1.0, 1), 0.7)])
def test_care_score_rules(spark, values, want):
    df = spark.createDataFrame([values], "f double, ws double, ef double, acc double, n int")
    assert df.select(S.care_score(*map(F.col, df.columns))).first()[0] == pytest.approx(want)


def test_published_rows_follow_the_formula(spark):
    rows = [(0.3719, 0.1893, 0.5366, 0.8413, 0.5561), (0.4794, 0.3605, 0.4949, 0.7433, 0.5643), (0.2932, 0.2411, 0.6364, 0.9176, 0.6012), (0.3920, 0.2423, 0.5760, 0.8706, 0.5903)]
    df = spark.createDataFrame(rows, "f double, ws double, ef double, acc double, care double")
    for r in df.select(S.care_score(F.col("f"), F.col("ws"), F.col("ef"), F.col("acc"), F.lit(1)).alias("got"), "care").collect():
        assert r["got"] == pytest.approx(r["care"], abs=1.01e-4)
    assert spark.range(1).select(S.f_beta(F.lit(22), F.lit(18), F.lit(23))).first()[0] == pytest.approx(0.5366, abs=1e-4)
    assert spark.range(1).select(S.f_beta(F.lit(4), F.lit(1), F.lit(2))).first()[0] == pytest.approx(5 / 6.5)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.5,), (0.75,), (1.0,)], "p double").select(S.earliness_weight(F.col("p"))).collect()] == [1, 1, 0.5, 0]


def test_multiplicity(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double").withColumn("g", F.lit(1))
    out = {r["k"]: (r["holm"], r["bh"]) for r in R.benjamini_hochberg(R.holm(p, "p", "g"), "p", "g").collect()}
    assert out[1] == pytest.approx((0.03, 0.03)) and out[2] == pytest.approx((0.06, 0.04)) and out[3] == pytest.approx((0.06, 0.04)) and out[4] == (None, None)
    obs, null = spark.createDataFrame([(1, 3.0)], "g int, v double"), spark.createDataFrame([(1, float(i)) for i in range(1, 5)], "g int, v double")
    assert R.empirical_p(obs, null, "v", "g").first()["p"] == pytest.approx(0.6)


def test_limits_of_shares(spark):
    lo, hi = spark.range(1).select(*S.wilson(F.lit(5), F.lit(10))).first()
    assert (lo, hi) == pytest.approx((0.236593, 0.763407), abs=1e-6)
    df = spark.createDataFrame([(0, 20), (5, 5), (3, 0), (None, 4)], "k int, n int").select("k", B.clopper_pearson(F.col("k"), F.col("n")).alias("c"))
    got = [tuple(r["c"]) for r in df.collect()]
    assert got[0][1] == pytest.approx(0.168433, abs=1e-6) and got[1][0] == pytest.approx(0.478176, abs=1e-6)


def test_robust_statistics(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 10)] + [(2, 7.0), (2, 7.0), (3, None), (3, float("nan"))], "g int, v double")
    out = {r["g"]: r for r in A.robust_parameters(df, "v", "g").collect()}
    assert (out[1]["center"], out[1]["q25"], out[1]["q75"], out[1]["scale"]) == (3, 2, 4, 2)
    assert out[2]["scale"] == 1.0 and out[3]["n"] == 0 and out[3]["center"] is None
    assert A.higher_quantile(df.where("g = 1"), "v", 0.9, "g").first()["quantile"] == 10
    ladder = {r["g"]: r["scale_statistic"] for r in A.fit_ladder(df, "v", "g").collect()}
    assert ladder == {1: "iqr", 2: "unit", 3: "unit"}
    blocks = spark.createDataFrame([(1, 1, float(v)) for v in (1, 2, 3, 4)] + [(1, 2, 5.0), (1, 2, 6.0)], "g int, b int, v double")
    assert [A.equal_block_quantile(blocks, "v", "b", p, "g").first()["quantile"] for p in (0.25, 0.5, 0.75, 0.95)] == [2, 4, 5, 6]
    t = spark.range(100).select(F.col("id").cast("double").alias("v"), F.lit(True).alias("t"))
    assert A.population_stability(t.union(t.withColumn("t", F.lit(False))), "v", F.col("t")).first()["psi"] == pytest.approx(0)
    assert A.population_stability(t.union(t.select(F.col("v") + 10, F.lit(False))), "v", F.col("t")).first()["psi"] == pytest.approx(1.220596, abs=2e-2)


def test_corrected_probability(spark):
    rank = lambda b, c: spark.range(1).select(E.corrected_probability(F.lit(b), c)).first()[0] * b
    assert [round(rank(30, c)) for c in (0.95, 0.98, 0.99)] == [30, 30, 30]
    assert [round(rank(39, c)) for c in (0.95, 0.98, 0.99)] == [38, 39, 39]
    assert spark.range(1).select(E.corrected_probability(F.lit(29), 0.95)).first()[0] is None


def test_ridge_line_and_leverage(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0), (1, 2.0, 5.0), (1, 3.0, 7.5)], "g int, x double, y double")
    r = E.ridge_line(df, "x", "y", 1.0, "g").first()
    assert (r["intercept"], r["slope"]) == pytest.approx((1.4375, 1.791667), abs=1e-6)


def test_crossfit_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = 1 + x @ [2.0, -1.0] + 0.5 * x[:, 0] ** 2 + rng.normal(size=300) * 0.1
    rows = [("c", i % 5, float(a), float(b), None if i == 7 else float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "case_key string, fold_id int, a double, b double, y double")
    terms = G.basis([F.col("a"), F.col("b")])
    models = G.crossfit(df, terms, F.col("y"))
    m = models.first()
    design = np.column_stack([np.ones(300), x, x**2, x[:, 0] * x[:, 1]])
    keep = np.arange(300) != 7
    want = G.solve(design[keep].T @ design[keep], design[keep].T @ y[keep], m["penalty"])
    assert np.allclose(m["coefficients"], want) and m["r2"] > 0.99 and m["rows"] == 299
    train = keep & (np.arange(300) % 5 != 3)
    own = G.solve(design[train].T @ design[train], design[train].T @ y[train], m["penalty"])
    got = {r["a"]: r["prediction"] for r in G.predict(df, models, terms).collect()}
    assert got[float(x[3, 0])] == pytest.approx(float(design[3] @ own))


def test_rows_near_a_held_out_fold_do_not_train_for_it(spark):
    rng = np.random.default_rng(3)
    x, fold, bits = rng.normal(size=200), np.arange(200) // 8 % 5, np.zeros(200, int)
    for k in range(5):
        near = [i for i in range(200) if (fold[max(i - 2, 0) : i + 3] == k).any()]
        bits[near] |= 1 << k
    y = 3 * x + rng.normal(size=200)
    df = spark.createDataFrame([("c", 1, i, int(f), float(a), float(t)) for i, (f, a, t) in enumerate(zip(fold, x, y, strict=True))], "case_key string, segment_id int, ts int, fold_id int, x double, y double")
    df = Q.embargo_bits(df, width=2)
    assert [r["embargo_bits"] for r in df.orderBy("ts").collect()] == bits.tolist()
    m = G.crossfit(df, [F.lit(1.0), F.col("x")], F.col("y"), penalties=(0.5,)).first()
    design, total = np.column_stack([np.ones(200), x]), 0.0
    for k in range(5):
        train, held = (bits >> k & 1) == 0, fold == k
        b = G.solve(design[train].T @ design[train], design[train].T @ y[train], 0.5)
        assert np.allclose(m["fold_coefficients"][k], b)
        total += ((y[held] - design[held] @ b) ** 2).sum()
    assert m["errors"][0] == pytest.approx(total)


def test_orders_of_a_bearing(spark):
    df = spark.createDataFrame([(8.0, 6.77, 28.50, 0.0)], "n double, d double, p double, a double")
    got = df.select(*B.characteristic_orders(*map(F.col, df.columns)).values()).first()
    assert tuple(got) == pytest.approx((0.381228, 3.049825, 4.950175, 1.986103), abs=1e-6)
    assert [r[0] for r in spark.createDataFrame([(25.0,), (54.0,)], "r double").select(B.order_usable(F.lit(3.049825), F.col("r"))[0]).collect()] == pytest.approx([1.2456, 2.6905], abs=1e-3)
    orders = spark.createDataFrame([(1, "bpfo", 3.049825), (1, "bpfi", 4.950175), (1, "ftf", 0.4)], "bearing int, name string, order_value double")
    assert B.resolution_search(orders).first()["revolutions"] == 53  # 2.62 / 0.049825, rounded up


def test_simulated_fault_shows_at_its_order(spark):
    d = spark.createDataFrame([(1, 5, 3.05, 12.0), (2, 6, None, 0.0)], "trial_id long, seed long, order_value double, snr_db double")
    f = B.envelope_peaks(4096.0, [(600.0, 1200.0)], {"bpfo": 3.05, "bpfi": 4.95}, 30.0)
    got = {r["trial_id"]: r for r in B.simulate(d).select("trial_id", f("signal").alias("f")).select("trial_id", "f.*").collect()}
    assert got[1]["bpfo"] > 3 * got[1]["bpfi"] and math.isfinite(got[2]["bpfo"])


def test_predicates(spark):
    df = spark.createDataFrame([(" Train ", "0", "1.0", "x"), ("1.0", "inf", None, "abnormal"), (None, "abc", "0", "Healthy")], "p string, s string, v string, l string")
    got = df.select(S.partition_name(F.col("p")), S.partition_label(F.col("p")), S.is_normal(F.col("s")), S.cell_class(F.col("v")), S.event_is_anomaly(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("train", "train", True, "finite", None), ("prediction", "prediction", False, "source_missing", True), ("unknown", "<MISSING>", False, "zero", False)]
    some, strict, together = S.row_flags(F.col("a"), F.col("b"))
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, None), (None, None), (1.0, 0.0)], "a double, b double")
    assert [tuple(r) for r in rows.select(some, strict, together).collect()] == [(True, True, True), (True, False, True), (False, False, False), (True, False, False)]


def test_weights_and_health(spark):
    c = spark.createDataFrame([(1, "a", 0.5, 0.0), (1, "b", 0.5, 0.0), (2, "a", -1.0, 0.0)], "g int, channel string, r2 double, rmse double")
    assert [r["weight"] for r in E.reliability_weights(c, 0.95, "g").orderBy("g", "channel").collect()] == [0.5, 0.5, 1.0]
    h = spark.createDataFrame([(1, 2.0, 0.6), (1, None, 0.4), (2, 3.0, 0.8), (2, None, 0.2)], "ts int, e double, w double")
    assert [(r["health"]) for r in E.weighted_health(h, "e", "w", "ts").orderBy("ts").collect()] == [None, pytest.approx(3.0)]


def test_ordered_counts_of_few_keys_with_ties_and_missing_keys(spark):
    rows = [(k, float(v)) for k, n in (("a", 500), ("b", 3), (None, 40)) for v in [(i * 7919) % 97 for i in range(n)]] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["v"]): (r["count"], r["upto"], r["n"]) for r in A.ordered_counts(df, "v", "k").collect()}
    for (k, v), found in got.items():
        own = [x for j, x in rows if j == k and x is not None]
        assert found == (own.count(v), sum(x <= v for x in own), len(own))
    assert {k for k, _ in got} == {"a", "b", None}
    high = {r["k"]: (r["quantile"], r["n"]) for r in A.higher_quantile(df, "v", 0.9, "k").collect()}
    own = sorted(x for j, x in rows if j == "a" and x is not None)
    assert high["a"] == (own[450], 500) and set(high) == {"a", "b", None}


def test_keys_that_repeat_are_refused_whatever_is_read(spark):
    from helmwatch.operators import selection as X

    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k int, w int")
    for right in (twice, twice.select("k")):
        for read in (lambda d: d.count(), lambda d: d.select("v").collect(), lambda d: d.collect()):
            with pytest.raises(Exception, match="not unique"):
                read(X.left_one_to_one(left, right, ["k"]))
    once = twice.where("w > 5")
    assert sorted(tuple(r) for r in X.left_one_to_one(left, once, ["k"]).collect()) == [(1, "a", 6), (2, "b", 7)]
    with pytest.raises(Exception, match="no assignment"):
        X.with_assignment(left, spark.createDataFrame([(1, "t")], "k int, part string"), "k", "part").select("v").count()


def test_intervals_of_a_key_without_bound(spark):
    from helmwatch.operators import relations as R

    base = "to_timestamp_ntz('2024-01-01 00:00:00')"
    # A key with 100,000 intervals of a minute, every other one of them; overlapping and touching ones merge.
    many = spark.range(100_000).selectExpr("'hot' AS case_key", f"timestampadd(MINUTE, CAST(id * 2 AS INT), {base}) AS start", f"timestampadd(SECOND, CAST(id * 120 + 59 AS INT), {base}) AS end")
    some = spark.sql(f"SELECT 'x' AS case_key, {base} AS start, timestampadd(DAY, 3, {base}) AS end UNION ALL SELECT 'x', timestampadd(DAY, 1, {base}), timestampadd(DAY, 5, {base}) UNION ALL SELECT 'x', timestampadd(DAY, 9, {base}), timestampadd(DAY, 8, {base})")
    rows = spark.range(20_000).selectExpr("'hot' AS case_key", f"timestampadd(SECOND, CAST(id * 90 AS INT), {base}) AS ts", "id AS _span").unionByName(spark.range(12).selectExpr("'x' AS case_key", f"timestampadd(DAY, CAST(id AS INT), {base}) AS ts", "id AS _span").withColumnRenamed("_span", "_span"))
    out = R.in_intervals(rows.withColumnRenamed("_span", "n"), many.unionByName(some))
    assert out.count() == 20_012 and out.columns == ["case_key", "ts", "n", "in_event"]
    assert all(r["in_event"] == (r["n"] * 90 % 120 < 60) for r in out.where("case_key = 'hot'").collect())
    assert sorted(r["n"] for r in out.where("case_key = 'x' AND in_event").collect()) == [0, 1, 2, 3, 4, 5]
    assert R.merged_spans(some, "case_key").count() == 1


def test_spectral_path_is_that_of_the_singular_values(spark):
    from helmwatch.operators import crossfit as X
    from helmwatch.operators import spectral as P

    rng = np.random.default_rng(9)
    n, p, m, folds = 200, 5, 3, 4
    phi = np.column_stack([np.ones(n), rng.normal(size=(n, p - 1))])
    y = phi @ rng.normal(size=(p, m)) + rng.normal(size=(n, m))
    y[rng.random((n, m)) < 0.1] = np.nan
    fold = np.arange(n) // 10 % folds
    rows = [("c", int(fold[i]), True, 1 << int(fold[i]), phi[i].tolist(), [None if np.isnan(v) else float(v) for v in y[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "case_key string, fold_id int, fit boolean, embargo_bits int, phi array<double>, responses array<double>")
    df = df.withColumn("train_bits", X.training_bits(F.col("fit"), F.col("embargo_bits"), folds)).drop("fit", "embargo_bits")
    solved = P.solve_path(P.fold_grams(df, p, m, folds))
    chosen = P.choose_penalty(df, solved, m).first()
    r2 = []
    for penalty in P.PATH:
        off = np.empty((n, m))
        for k in range(folds):
            u, s, vt = np.linalg.svd(phi[fold != k], full_matrices=False)
            b = vt.T @ np.diag(s / (s**2 + penalty)) @ u.T @ np.nan_to_num(y[fold != k])
            off[fold == k] = y[fold == k] - phi[fold == k] @ b
        r2.append([1 - np.nansum(off[:, j] ** 2) / (np.nanvar(y[:, j]) * np.isfinite(y[:, j]).sum()) for j in range(m)])
    best = int(np.argmax(np.median(r2, axis=1)))
    assert chosen["penalty"] == best and np.allclose(chosen["r2"], r2[best])
    u, s, vt = np.linalg.svd(phi, full_matrices=False)
    h = ((phi @ vt.T) ** 2 @ (s**2 / (s**2 + P.PATH[best]) ** 2)).tolist()
    got = P.path_scores(df.withColumn("i", F.monotonically_increasing_id()), solved, P.choose_penalty(df, solved, m), folds).orderBy("i").collect()
    assert np.allclose([r["leverage"] for r in got], h)


def test_bootstrap_draws_as_many_clusters_as_there_are(spark):
    from helmwatch.operators import evaluation as E

    df = spark.createDataFrame([(i, 1, i) for i in range(11)], "k int, one int, v int")
    got = E.cluster_bootstrap(df, "k", ("one", "v"), 500, 3).collect()
    assert len(got) == 500 and all(r["one"] == 11 for r in got)
    assert abs(np.mean([r["v"] for r in got]) - 55) < 2 and E.cluster_bootstrap(df.limit(0), "k", ("v",), 5, 3).count() == 0


def test_null_orders_are_drawn_within_rows(spark):
    """As by brute force over the whole grid, without a join to broadcast or a shuffle of grid points."""
    found = [(1, "ftf", 0.4), (1, "bpfo", 3.049825), (1, "bpfi", 4.950175), (2, "bpfo", 2.5), (3, "bsf", None), (3, "bpfo", 7.99)]
    orders = spark.createDataFrame(found, "bearing int, name string, order_value double")
    nulls = B.matched_nulls(orders, B.forbidden_centres(orders), "s", 5, 2_001)
    got = sorted((r.bearing, r.name, r.pool, r.grid_id) for r in nulls.collect())
    plan = nulls._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "Window" not in plan
    whole = lambda x: abs(x - max(1.0, round(x)))
    want = []
    for b, name, value in found:
        if name == "ftf" or value is None:
            continue
        centres = [k * v + s for c, n, v in found if c == b and v is not None for k in range(1, 2 if n == "ftf" else 4) for s in ((0.0,) if n == "ftf" else (-1.0, 0.0, 1.0))]
        centres = [c for c in centres if 1.25 <= c <= 8]
        at = [(i, 1.25 + i * (6.75 / 2000)) for i in range(2001)]
        free = [i for i, x in at if abs(whole(x) - whole(value)) <= 0.015 and all(abs(c - x) > 0.04 for c in centres)]
        drawn = sorted((md5(f"s|{b}|{name}|{i}".encode()).hexdigest(), i) for i in free)[:5]
        want += [(b, name, len(free), i) for _, i in drawn if len(free) >= 5]
    assert got == sorted(want) and len({x[:2] for x in got}) >= 2


def test_fit_ladder_shuffles_counts_not_rows(spark):
    """Few keys with many rows: every exchange takes counted values; the rungs are those worked out by numpy."""
    rng = np.random.default_rng(3)
    found = {"a": rng.integers(0, 9, 3000) / 10.0, "b": np.append(np.zeros(2500), rng.integers(1, 9, 500)), None: np.array([1.0, 1.0, 1.0, 5.0])}
    rows = [(k, float(x)) for k, xs in found.items() for x in xs] + [("a", None), ("c", None)]
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = A.fit_ladder(spark.createDataFrame(rows, "k string, v double"), "v", "k")
        got = {r["k"]: r for r in out.collect()}
        nodes, stack = [], [out._jdf.queryExecution().executedPlan()]
        while stack:
            nodes.append(stack.pop())
            stack += [nodes[-1].children().apply(i) for i in range(nodes[-1].children().size())]
        shuffled = [n.metrics().get("shuffleRecordsWritten").get().value() for n in nodes if n.nodeName() == "Exchange"]
    finally:
        for c, x in held.items():
            spark.conf.set(c, x)
    assert shuffled and max(shuffled) < len(rows) / 10
    for k, xs in found.items():
        q = np.quantile(xs, [0.25, 0.5, 0.75])
        mad = np.median(np.abs(xs - q[1]))
        name, scale = ("iqr", q[2] - q[0]) if q[2] > q[0] else ("mad", 1.4826 * mad) if mad > 0 else ("sd", xs.std(ddof=1))
        assert got[k]["scale_statistic"] == name and got[k]["scale"] == pytest.approx(scale) and got[k]["center"] == q[1]
        assert got[k]["missing_indicator"] == (k == "a")
    assert got["c"]["center"] is None and got["c"]["scale_statistic"] == "unit"
