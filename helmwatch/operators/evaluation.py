"""Scoring of alarms and calibration of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import order_statistics as O


def confusion(df: DataFrame, truth: Column, predicted: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(~truth & ~predicted).alias("tn"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(truth & predicted).alias("tp")
    )


def care(cases: DataFrame, *keys: str) -> DataFrame:
    """The score of cases (is_anomaly, coverage_fbeta, earliness, accuracy, event_alarm), over keys."""
    anomaly, alarm = F.col("is_anomaly"), F.col("event_alarm")
    out = cases.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(anomaly, F.col("coverage_fbeta"))), F.lit(0.0)).alias("f"), F.coalesce(F.avg(F.when(anomaly, F.col("earliness"))), F.lit(0.0)).alias("ws"),
        S.f_beta(F.count_if(anomaly & alarm), F.count_if(~anomaly & alarm), F.count_if(anomaly & ~alarm)).alias("ef"),
        F.coalesce(F.avg(F.when(~anomaly, F.col("accuracy"))), F.lit(0.0)).alias("acc"), F.count_if(alarm).alias("alarms"),
    )
    return out.withColumn("care", S.care_score(F.col("f"), F.col("ws"), F.col("ef"), F.col("acc"), F.col("alarms")))


def corrected_probability(blocks: Column, coverage: float) -> Column:
    rank = F.greatest(F.lit(1), F.least(F.ceil((blocks + 1) * F.lit(float(coverage))), blocks))
    return F.when(blocks >= 30, rank / blocks)


def block_maxima(df: DataFrame, score: str, min_rows: int, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(score).alias("maximum"), F.count(score).alias("observed")).withColumn("usable", F.col("observed") >= min_rows)


def block_coverage(df: DataFrame, covered: Column, block: list[str], *keys: str) -> DataFrame:
    """Mean over blocks of the share covered in each."""
    one = df.groupBy(*keys, *block).agg(F.avg(covered.cast("double")).alias("c"))
    return one.groupBy(*keys).agg(F.avg("c").alias("coverage"), F.count("*").alias("blocks"))


def conformal_quantile(df: DataFrame, value: str, coverage: float, *keys: str) -> DataFrame:
    """The order statistic at rank ceil((n + 1) * coverage), at most n."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.least(F.ceil((F.col("_n") + 1) * F.lit(float(coverage))), F.col("_n"))).select(*keys, F.col(value).alias("quantile"), F.col("_n").alias("n"))


def leave_one_out_coverage(df: DataFrame, value: str, coverage: float, *keys: str) -> DataFrame:
    """Share of values at or below the order statistic that the other values give, rank ceil(n * coverage) in [1, n-1]."""
    w = Window.partitionBy(*keys)
    d = df.where(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_pos", F.row_number().over(w.orderBy(value)))
    d = d.withColumn("_rank", F.greatest(F.lit(1), F.least(F.ceil(F.col("_n") * F.lit(float(coverage))), F.col("_n") - 1)))
    at = d.withColumn("_at", F.max(F.when(F.col("_pos") == F.col("_rank"), F.col(value))).over(w)).withColumn("_next", F.max(F.when(F.col("_pos") == F.col("_rank") + 1, F.col(value))).over(w))
    threshold = F.when(F.col("_pos") <= F.col("_rank"), F.col("_next")).otherwise(F.col("_at"))
    return at.groupBy(*keys).agg(F.avg((F.col(value) <= threshold).cast("double")).alias("coverage"), F.count("*").alias("n"))


def reliability_weights(channels: DataFrame, nominal: float, *keys: str) -> DataFrame:
    """weight: clip(r2, 0, 1) * exp(-rmse / (1 - nominal)), normalised within keys; equal weights where all vanish."""
    w = Window.partitionBy(*keys)
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r2"))) * F.exp(-F.col("rmse") / (1 - nominal))
    return channels.withColumn("_w", raw).withColumn("weight", F.when(F.sum("_w").over(w) > 0, F.col("_w") / F.sum("_w").over(w)).otherwise(1.0 / F.count("*").over(w))).drop("_w")


def weighted_health(long: DataFrame, value: str, weight: str, *keys: str, min_weight: float = 0.70) -> DataFrame:
    """Weighted mean over observed channels; null where less than min_weight of the weight is observed."""
    seen = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return long.groupBy(*keys).agg(F.when(seen >= min_weight - 1e-12, F.sum(F.col(value) * F.col(weight)) / seen).alias("health"), F.coalesce(seen, F.lit(0.0)).alias("observed_weight"))


def ridge_line(df: DataFrame, x: str, y: str, penalty: float, *keys: str) -> DataFrame:
    """Ridge regression on one driver, the intercept free, from sums that merge map-side; with the fit's R2."""
    n, mx, my = F.count("*").cast("double"), F.avg(x), F.avg(y)
    sxx, sxy, syy = F.var_pop(x) * n, F.covar_pop(x, y) * n, F.var_pop(y) * n
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(n.alias("n"), mx.alias("mx"), my.alias("my"), sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy"))
    slope = F.col("sxy") / (F.col("sxx") + penalty)
    sse = F.col("syy") - 2 * F.col("slope") * F.col("sxy") + F.col("slope") * F.col("slope") * F.col("sxx")
    return out.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).withColumn("r2", F.when(F.col("syy") > 1e-12, 1 - sse / F.col("syy")))


def poisson_bootstrap(assets: DataFrame, key: str, numerator: str, denominator: str, replicates: int) -> DataFrame:
    """(replicate, ratio): clusters drawn with replacement by weights from a hash of key and replicate. The weights
    follow the Poisson law of mean 1, so replicates need no pass over all clusters' number and SQL can repeat them."""
    spark = assets.sparkSession
    digest = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("replicate").cast("string")), 256)
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    drawn = assets.crossJoin(F.broadcast(spark.range(replicates).withColumnRenamed("id", "replicate"))).withColumn("u", u)
    # The cumulative Poisson law of mean 1.
    weight = F.when(F.col("u") < 0.36787944117144233, 0).when(F.col("u") < 0.7357588823428847, 1).when(F.col("u") < 0.9196986029286058, 2).when(F.col("u") < 0.9810118431238462, 3).when(F.col("u") < 0.9963401531726563, 4).otherwise(5)
    return drawn.withColumn("w", weight).groupBy("replicate").agg((F.sum(F.col("w") * F.col(numerator)) / F.nullif(F.sum(F.col("w") * F.col(denominator)), F.lit(0))).alias("ratio"))


def cluster_bootstrap(clusters: DataFrame, key: str, sums: tuple[str, ...], replicates: int, seed: int) -> DataFrame:
    """(replicate and the sums): every replicate draws as many clusters as there are, with replacement. Draw j of a
    replicate is the cluster at the place given by the hash of seed, replicate and j, modulo their number, in the order
    of their keys; so replicates repeat anywhere. Draws are counted by replicate and place before they meet the
    clusters' sums; the clusters are not copied."""
    spark = clusters.sparkSession
    places = clusters.select((F.row_number().over(Window.orderBy(key)) - 1).alias("_place"), *sums)  # one row a cluster
    n = places.count()
    draw, replicate = F.col("id") % F.lit(max(n, 1)), F.floor(F.col("id") / F.lit(max(n, 1)))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), draw.cast("string")), 256)
    drawn = spark.range(replicates * n).select(replicate.alias("replicate"), (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.lit(max(n, 1))).alias("_place"))
    weights = drawn.groupBy("replicate", "_place").agg(F.count("*").alias("_w"))
    return weights.join(places, "_place").groupBy("replicate").agg(*(F.sum(F.col("_w") * F.col(c)).alias(c) for c in sums))


def fold_excluded_quantile(df: DataFrame, value: str, fold: str, p: float, folds: int, *keys: str) -> DataFrame:
    """For every fold the higher quantile of the other folds' values, and the fold's share at or below it. All
    complements come from one aggregation of the values by fold."""
    q = O.complement_quantiles(df, value, fold, folds, (p,), *keys, higher=True).select(*keys, fold, F.get("q", 0).alias("quantile"))
    return df.join(q, [*keys, fold]).groupBy(*keys, fold).agg(F.max("quantile").alias("quantile"), F.avg((F.col(value) <= F.col("quantile")).cast("double")).alias("coverage"))


def interval_scores(df: DataFrame, residual: Column, half_width: Column, alpha: float, scale: Column) -> DataFrame:
    """Exceedance, coverage, width and interval score of residuals under intervals of half_width, in units of scale."""
    r, h = F.abs(residual) / scale, half_width / scale
    return df.withColumn("exceedance", F.greatest(F.abs(residual) / half_width - 1, F.lit(0.0))).withColumn("covered", F.abs(residual) <= half_width).withColumn("width", 2 * h).withColumn(
        "interval_score", 2 * h + 2 / alpha * F.greatest(r - h, F.lit(0.0))
    )


def rank_p(df: DataFrame, value: str, calibration: Column, *keys: str) -> DataFrame:
    """p = (1 + calibration values at or above) / (n + 1); a calibration row leaves itself out of both counts. Ranks
    are those of distinct values, by value ranges."""
    own = calibration.cast("int")
    ranked = O.ordered_sums(df.withColumn("_own", own), value, {"own": F.coalesce("_own", F.lit(0))}, *keys)
    above = F.col("_rank.n") - F.col("_rank.upto") + F.col("_rank.own") - own
    return O.with_ranks(df, ranked, value, "own", *keys).withColumn("p", (1 + above) / (F.col("_rank.n") - own + 1)).drop("_rank")


def gate(metrics: DataFrame, value: str, limit: Column, at_most: bool, *keys: str) -> DataFrame:
    """The worst value of each gate against its limit, and the verdict of all: PASS only if every gate holds."""
    worst = (F.max if at_most else F.min)(value)
    return metrics.groupBy(*keys).agg(worst.alias("worst"), F.max(limit).alias("limit")).withColumn("holds", F.col("worst") <= F.col("limit") if at_most else F.col("worst") >= F.col("limit"))
