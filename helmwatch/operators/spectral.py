"""Ridge regression of many responses along the whole path of penalties from one spectral decomposition a fold.

The Gram matrix of what trains for a fold is a sum by case and fold. Its eigenvectors give the coefficients of every
penalty, and the leverage of new rows, without another solve. The penalty is the one with the greatest median over
responses of the embargoed held-out R2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATH = tuple(10.0**e for e in range(-2, 6))
CLIP = 8.0
SOLUTION = "case_key string, k int, coefficients array<array<array<double>>>, leverage array<array<double>>"


def standardised(value: Column, center: Column, mean: Column, sd: Column) -> Column:
    """A driver with gaps at the median, in deviations from the mean, clipped at CLIP of them."""
    z = (F.coalesce(value, center) - mean) / F.when(sd > 1e-12, sd).otherwise(1.0)
    return F.least(F.greatest(z, F.lit(-CLIP)), F.lit(CLIP))


def fold_grams(rows: DataFrame, p: int, responses: int, folds: int, key: str = "case_key") -> DataFrame:
    """(key, k, n, xx, xy) from rows with phi[p], responses[m] and train_bits: xx the upper triangle, xy[m][p]. k runs
    over the folds, and `folds` stands for all fit rows. Missing responses count as 0, their mean."""
    one = rows.select(key, "phi", "responses", F.explode(F.array(*(F.when(F.shiftright("train_bits", k).bitwiseAND(1) == 1, F.lit(k)) for k in range(folds + 1)))).alias("k")).where("k IS NOT NULL")
    x = [F.get("phi", i) for i in range(p)]
    y = [F.coalesce(F.get("responses", j), F.lit(0.0)) for j in range(responses)]
    return one.groupBy(key, "k").agg(F.count("*").alias("n"), F.array(*(F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p))).alias("xx"), F.array(*(F.array(*(F.sum(v * w) for v in x)) for w in y)).alias("xy"))


def _decompose(path: tuple[float, ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                xy = np.array(r.xy.tolist(), float).T
                gram = np.zeros((len(xy), len(xy)))
                gram[np.triu_indices(len(xy))] = r.xx
                gram += np.triu(gram, 1).T
                squares, v = np.linalg.eigh(gram)
                squares = np.maximum(squares, 0)
                turned = v.T @ xy
                coefficients = [(v @ (turned / (squares + penalty)[:, None])).T.tolist() for penalty in path]
                leverage = [((v * (squares / (squares + penalty) ** 2)) @ v.T).ravel().tolist() for penalty in path]
                out.append((r.case_key, r.k, coefficients, leverage))
            yield pd.DataFrame(out, columns=["case_key", "k", "coefficients", "leverage"])

    return run


def solve_path(grams: DataFrame, path: tuple[float, ...] = PATH) -> DataFrame:
    """(case_key, k, coefficients[penalty][response][term], leverage[penalty], a matrix by rows)."""
    return grams.mapInPandas(_decompose(path), SOLUTION)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def choose_penalty(rows: DataFrame, solved: DataFrame, responses: int, path: tuple[float, ...] = PATH, key: str = "case_key", fold: str = "fold_id") -> DataFrame:
    """(key, penalty, r2[response], sd[response]): the penalty's place on the path, the first of equal ones, with the
    held-out R2 and the deviation of the held-out residuals of every response, at least 1e-6. Only observed responses
    count; both measures come from sums of one pass over the fit rows."""
    held = rows.where("train_bits > 0").join(solved.withColumnRenamed("k", fold), [key, fold])
    long = held.select(key, "phi", "coefficients", F.posexplode("responses").alias("response", "y")).where("y IS NOT NULL")
    off = F.transform("coefficients", lambda c: F.col("y") - _dot(F.col("phi"), F.get(c, F.col("response"))))
    long = long.select(key, "response", "y", off.alias("off"))
    at = range(len(path))
    sums = long.groupBy(key, "response").agg((F.var_pop("y") * F.count("*")).alias("_t"), F.array(*(F.sum(F.get("off", j) * F.get("off", j)) for j in at)).alias("_e"), F.array(*(F.stddev_pop(F.get("off", j)) for j in at)).alias("_sd"))
    r2 = sums.withColumn("_r2", F.transform("_e", lambda e: F.when(F.col("_t") > 1e-12, 1 - e / F.col("_t"))))
    case = r2.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("response", F.struct("_r2", "_sd")))).alias("_m"), F.array(*(F.median(F.get("_r2", j)) for j in at)).alias("_median"))
    best = (F.array_position("_median", F.array_max("_median")) - 1).cast("int")
    case = case.withColumn("penalty", best)
    grid = F.sequence(F.lit(0), F.lit(responses - 1))
    return case.select(key, "penalty", F.transform(grid, lambda j: F.get(F.try_element_at("_m", j)["_r2"], F.col("penalty"))).alias("r2"), F.transform(grid, lambda j: F.greatest(F.get(F.try_element_at("_m", j)["_sd"], F.col("penalty")), F.lit(1e-6))).alias("sd"))


def path_scores(rows: DataFrame, solved: DataFrame, chosen: DataFrame, folds: int, key: str = "case_key") -> DataFrame:
    """rows with leverage and scores[response]: absolute residuals of the model on all fit rows, over the response's
    deviation times sqrt(1 + leverage). leverage is phi' V diag(s^2 / (s^2 + penalty)^2) V' phi."""
    final = solved.where(F.col("k") == folds).join(chosen, key).select(key, F.get("coefficients", F.col("penalty")).alias("_c"), F.get("leverage", F.col("penalty")).alias("_h"), F.col("sd").alias("_sd"))
    joined = rows.join(final, key)
    p = F.size("phi")
    quadratic = F.aggregate(F.zip_with("phi", F.sequence(F.lit(0), p - 1), lambda v, i: v * _dot(F.col("phi"), F.slice("_h", i * p + 1, p))), F.lit(0.0), lambda s, v: s + v)
    joined = joined.withColumn("leverage", quadratic)
    scores = F.transform("responses", lambda y, j: F.abs(y - _dot(F.col("phi"), F.get("_c", j))) / (F.get("_sd", j) * F.sqrt(1 + F.col("leverage"))))
    return joined.withColumn("scores", scores).select(*rows.columns, "leverage", "scores")
