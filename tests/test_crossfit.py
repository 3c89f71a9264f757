"""Cross-fitted ridge models of many targets against the same steps with numpy, case by case."""

from itertools import combinations

import numpy as np
import pytest

from helmwatch.operators import crossfit as X

FOLDS, MIN = 3, 20
DESIGN = X.Design(("wind_speed", "power_avg", "other"), ("power_avg",))
PENALTIES = (1e-4, 1.0, 1e2)


def test_core_drivers_by_phrase_then_name():
    names = ("zeta", "pitch_angle_avg", "power_b", "power_a", "wind_speed_max", "alpha")
    d = X.Design(names)
    assert [names[i] for i in d.core()] == ["wind_speed_max", "power_a", "power_b", "pitch_angle_avg", "alpha"]
    assert sum(n.startswith("cubic") for n in d.names()) == 1 and sum(n.startswith("interaction") for n in d.names()) == 10


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for case in ("a", "b"):
        n = 240
        x = rng.normal(size=(n, 3)) * [2, 5, 1] + [8, 0, 3]
        y = np.column_stack([x[:, 0] ** 2 + rng.normal(size=n) * (j + 1) + x[:, 1] * j for j in range(12)])
        y[rng.integers(0, n, 3), 0] += 1e4  # outliers that the clip holds back
        x[rng.random(n) < 0.1, 1] = np.nan
        for group in range(3):
            y[np.ix_(rng.random(n) < 0.05 * group, range(group, 12, 3))] = np.nan
        for i in range(n):
            fold = i // 16 % FOLDS
            near = {(i + s) // 16 % FOLDS for s in (-2, 0, 2) if 0 <= i + s < n} | {fold}
            rows.append((case, i, fold, i % 7 != 0, sum(1 << k for k in near), [None if np.isnan(v) else float(v) for v in x[i]], [None if np.isnan(v) else float(v) for v in y[i]]))
    df = spark.createDataFrame(rows, "case_key string, row_id long, fold_id int, fit boolean, embargo_bits int, drivers array<double>, targets array<double>").repartition(6)
    from pyspark.sql import functions as F

    return rows, df.withColumn("train_bits", X.training_bits(F.col("fit"), F.col("embargo_bits"), FOLDS)).drop("fit", "embargo_bits")


def scales(v):
    iqr = np.subtract(*np.quantile(v, [0.75, 0.25]))
    return np.median(v), iqr if iqr > 1e-12 else v.std() if v.std() > 1e-7 else None


def terms(z, missing):
    core = DESIGN.core()
    return np.column_stack([z, missing[:, 1], z**2, z[:, 0] ** 3, *(z[:, a] * z[:, b] for a, b in combinations(core, 2))])


def numpy_case(rows):
    x = np.array([[np.nan if v is None else v for v in r[5]] for r in rows])
    y = np.array([[np.nan if v is None else v for v in r[6]] for r in rows])
    fold, fit, bits = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    sse, count = np.zeros(len(PENALTIES)), 0
    masks, held = {}, []
    for k in range(FOLDS):
        train = fit & (bits >> k & 1 == 0)
        missing = np.isnan(x)
        filled = np.where(missing, np.nanmedian(x[train], axis=0), x)
        z = np.column_stack([(filled[:, d] - m) / (s or 1) for d in range(3) for m, s in [scales(filled[train, d])]])
        raw = terms(z, missing)
        design = np.column_stack([np.ones(len(raw))] + [np.zeros(len(raw)) if s is None else (raw[:, t] - m) / s for t in range(raw.shape[1]) for m, s in [scales(raw[train, t])]])
        for t in range(y.shape[1]):
            seen = train & ~np.isnan(y[:, t])
            masks[k, t] = tuple(np.flatnonzero(seen))
            m, s = scales(y[seen, t])
            own = fit & (fold == k) & ~np.isnan(y[:, t])
            fits = []
            for j, penalty in enumerate(PENALTIES):
                gram = design[seen].T @ design[seen] + penalty * np.diag([0.0] + [1.0] * (design.shape[1] - 1))
                b = np.linalg.solve(gram, design[seen].T @ ((y[seen, t] - m) / s))
                off = (y[own, t] - m) / s - design[own] @ b
                fits.append(off * s)
                sse[j] += (np.clip(off, -10, 10) ** 2).sum()
            count += own.sum()
            held.append((t, fits, y[own, t] - y[seen, t].mean()))
    best = int(np.argmin(sse))
    r2 = {t: 1 - sum((f[best] ** 2).sum() for u, f, _ in held if u == t) / sum((b**2).sum() for u, _, b in held if u == t) for t in range(y.shape[1])}
    return sse / count, best, r2, masks


def test_matches_numpy_and_shares_grams(spark, data, tmp_path):
    rows, df = data
    store = iter(range(99))

    def kept(frame, name):
        path = str(tmp_path / f"{name}-{next(store)}")
        frame.write.parquet(path)
        return spark.read.parquet(path)

    designed, states = X.scaled_design(df, DESIGN, FOLDS, kept=kept)
    designed = kept(designed, "designed")
    masks = kept(X.observation_masks(designed, FOLDS), "masks")
    sums = kept(X.grams(designed, masks, len(DESIGN.names())), "grams")
    solved = kept(X.solve_grams(sums, PENALTIES, MIN), "solved")
    errors = kept(X.penalty_errors(designed, solved, PENALTIES), "errors")
    r2 = {(r["case_key"], r["target"]): r["r2"] for r in X.held_out_r2(designed, solved, errors, states, MIN).collect()}
    got = {r["case_key"]: r for r in errors.collect()}
    for case in ("a", "b"):
        want, best, want_r2, want_masks = numpy_case([r for r in rows if r[0] == case])
        assert np.allclose(got[case]["errors"], want, rtol=1e-6) and got[case]["selected"] == best
        assert all(np.isclose(r2[case, t], v, rtol=1e-6) for t, v in want_r2.items())
        # Twelve targets with three masks make three Grams a fold.
        assert sums.where(f"case_key = '{case}' AND k < {FOLDS}").count() == len(set((k, m) for (k, _), m in want_masks.items())) == 3 * FOLDS
