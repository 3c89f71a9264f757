"""Cross-fitted ridge models from sums.

A case's Gram matrix, by fold, is a set of sums that Spark adds up map-side: rows never gather in one task. From them
come, per case, the penalty (by pooled held-out error), the held-out and final coefficients, R2 and precision - small
dense algebra on one row per case. Predictions are column expressions on the rows again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENALTIES = (1e-4, 1e-2, 1.0, 1e2, 1e4)
MODEL_SCHEMA = "case_key string, penalty double, coefficients array<double>, fold_coefficients array<array<double>>, r2 double, rows long, precision array<double>, errors array<double>"


def basis(drivers: list[Column]) -> list[Column]:
    """Linear and square terms and pairwise products of standardised drivers, after a constant."""
    out = [F.lit(1.0), *drivers, *(d * d for d in drivers)]
    return out + [a * b for i, a in enumerate(drivers) for b in drivers[i + 1 :]]


def gram(df: DataFrame, terms: list[Column], target: Column, key: str = "case_key", fold: str = "fold_id") -> DataFrame:
    """(key, fold, embargo_bits, n, y, yy, xy array, xx array): sums over rows whose target is observed; xx is the upper
    triangle. Rows near other folds have their own sums, by the set of folds they are near; without embargo_bits in df
    there is no embargo."""
    p = len(terms)
    bits = F.col("embargo_bits") if "embargo_bits" in df.columns else F.call_function("shiftleft", F.lit(1), F.col(fold).cast("int"))
    rows = df.select(key, fold, bits.cast("int").alias("embargo_bits"), target.alias("_y"), *(t.alias(f"_x{i}") for i, t in enumerate(terms))).where("_y IS NOT NULL")
    x = [F.col(f"_x{i}") for i in range(p)]
    return rows.groupBy(key, fold, "embargo_bits").agg(
        F.count("*").alias("n"), F.sum("_y").alias("y"), F.sum(F.col("_y") * F.col("_y")).alias("yy"),
        F.array(*(F.sum(c * F.col("_y")) for c in x)).alias("xy"), F.array(*(F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p))).alias("xx"),
    )


def solve(xx: np.ndarray, xy: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge coefficients; the constant, first, is not penalised. Least squares where the system is singular."""
    a = xx + penalty * np.diag([0.0] + [1.0] * (len(xy) - 1))
    try:
        return np.linalg.solve(a, xy)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, xy, rcond=None)[0]


def _fit(penalties: tuple[float, ...], folds: int, min_rows: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = len(pdf["xy"].iloc[0])
        upper = np.triu_indices(p)
        # Sums of each fold's own rows, and of the rows that may train for it: neither in it nor near it.
        own, rest = ([[0.0, 0.0, 0.0, np.zeros(p), np.zeros((p, p))] for _ in range(folds)] for _ in range(2))
        for r in pdf.sort_values(["fold_id", "embargo_bits"]).itertuples():
            half = np.zeros((p, p))
            half[upper] = r.xx
            sums = (r.n, r.y, r.yy, np.asarray(r.xy, float), half + half.T - np.diag(np.diag(half)))
            for held in (own[int(r.fold_id)], *(rest[k] for k in range(folds) if not r.embargo_bits >> k & 1)):
                for i, v in enumerate(sums):
                    held[i] = held[i] + v
        n, y, yy, xy, xx = (np.array([f[i] for f in own]) for i in range(5))
        if n.sum() < max(min_rows, p + 10):
            return pd.DataFrame(columns=[f.split()[0] for f in MODEL_SCHEMA.split(", ")])
        errors, betas = [], []
        for penalty in penalties:
            fits = [solve(t[4], t[3], penalty) for t in rest]
            errors.append(sum(yy[k] - 2 * b @ xy[k] + b @ xx[k] @ b for k, b in enumerate(fits)))
            betas.append(fits)
        errors = np.array(errors)
        # Of nearly equal errors the largest penalty.
        best = max(i for i, e in enumerate(errors) if e <= errors.min() * (1 + 1e-12) + 1e-12)
        means = [t[1] / max(t[0], 1) for t in rest]
        base = sum(yy[k] - 2 * m * y[k] + n[k] * m * m for k, m in enumerate(means))
        penalised = xx.sum(0) + penalties[best] * np.diag([0.0] + [1.0] * (p - 1))
        precision = np.linalg.pinv(penalised)
        row = (pdf["case_key"].iloc[0], penalties[best], solve(xx.sum(0), xy.sum(0), penalties[best]).tolist(), [b.tolist() for b in betas[best]], float(1 - errors[best] / base) if base > 1e-12 else None, int(n.sum()), ((precision + precision.T) / 2).ravel().tolist(), errors.tolist())
        return pd.DataFrame([row], columns=[f.split()[0] for f in MODEL_SCHEMA.split(", ")])

    return fit


def crossfit(df: DataFrame, terms: list[Column], target: Column, folds: int = 5, penalties: tuple[float, ...] = PENALTIES, min_rows: int = 200) -> DataFrame:
    """One model per case with enough observed rows; df has case_key and fold_id, and embargo_bits where rows near a
    held-out fold must not train for it. errors are the pooled held-out squared errors of the penalties."""
    sums = gram(df, terms, target)
    return sums.groupBy("case_key").applyInPandas(_fit(penalties, folds, min_rows), MODEL_SCHEMA)


def dot(coefficients: Column, terms: list[Column]) -> Column:
    total = F.get(coefficients, 0) * terms[0]
    for i, t in enumerate(terms[1:], 1):
        total = total + F.get(coefficients, i) * t
    return total


def predict(df: DataFrame, models: DataFrame, terms: list[Column], held_out: bool = True) -> DataFrame:
    """prediction: by the coefficients that did not see the row's fold, or by the final ones. One model per case, so
    the models are small; Spark broadcasts them while they are."""
    joined = df.join(models.select("case_key", "coefficients", "fold_coefficients", "precision", F.col("rows").alias("model_rows")), "case_key")
    use = F.get("fold_coefficients", F.col("fold_id").cast("int")) if held_out else F.col("coefficients")
    p = len(terms)
    leverage = sum((F.get("precision", i * p + j) * terms[i] * terms[j] for i in range(p) for j in range(p)), F.lit(0.0))
    return joined.withColumn("prediction", dot(use, terms)).withColumn("leverage", F.greatest(leverage, F.lit(0.0)) * F.col("model_rows")).drop("coefficients", "fold_coefficients", "precision", "model_rows")


def log_variance_target(residual: Column, scale: Column, eps: float = 1e-6) -> Column:
    return F.log(residual * residual + eps * scale * scale)


def aleatoric_scale(log_variance: Column, limit: float = 60.0) -> Column:
    return F.exp(0.5 * F.least(F.greatest(log_variance, F.lit(-limit)), F.lit(limit)))


def total_scale(aleatoric: Column, support: Column) -> Column:
    return aleatoric * F.sqrt(1 + F.greatest(support, F.lit(0.0)))
