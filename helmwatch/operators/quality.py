"""Quality audits, robust statistics and their application."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import order_statistics as O

#: Shares to which the values of a key are dealt.
DEALS = 64

def channel_audit(df: DataFrame, channels: tuple[str, ...], fit: Column, key: str = "case_key") -> DataFrame:
    """One row per case and channel over fit rows: counts, availability, zero share and the structural-zero flag."""
    kept = df.where(fit)
    aggs = []
    for c in channels:
        v = S.number(F.col(c))
        aggs.append(F.struct(
            F.lit(c).alias("channel"), F.count(v).alias("finite_rows"), (F.count("*") - F.count(v)).alias("missing_rows"),
            (F.count(v) / F.count("*")).alias("availability"), F.count_if(v == 0).alias("zero_rows"),
            (F.count_if(v == 0) / F.nullif(F.count(v), F.lit(0))).alias("zero_fraction_of_finite"),
        ))
    return kept.groupBy(key).agg(F.array(*aggs).alias("c")).select(key, F.explode("c").alias("c")).select(key, "c.*")


def channel_rollup(audit: DataFrame) -> DataFrame:
    """Channels over cases: counts, availability's range and median, pooled ratios."""
    rows = F.sum(F.col("finite_rows") + F.col("missing_rows"))
    return audit.groupBy("channel").agg(
        F.countDistinct("case_key").alias("cases"), F.sum("finite_rows").alias("finite_rows"), F.min("availability").alias("min_availability"),
        F.percentile("availability", F.lit(0.5)).alias("median_availability"), F.max("availability").alias("max_availability"),
        (F.sum("finite_rows") / F.greatest(rows, F.lit(1))).alias("pooled_availability"), (F.sum("zero_rows") / F.nullif(F.sum("finite_rows"), F.lit(0))).alias("pooled_zero_fraction"),
    )


def moments(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, sample variance and deviation, extremes, of finite values. Partial sums merge map-side."""
    v = S.number(F.col(value))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


def _on(left: str, right: str, keys: tuple[str, ...]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys] or [F.lit(True)]


def _quartiles(df: DataFrame, v: Column, keys: tuple[str, ...], *more: Column) -> DataFrame:
    """(keys, q, finite and the further aggregates): quartiles by value ranges; null where a key has no value."""
    plain = df.select(*keys, v.alias("_v"))
    rest = df.groupBy(*keys).agg(F.count(v).alias("finite"), *more)
    q = O.linear_quantiles(plain, "_v", (0.25, 0.5, 0.75), *keys)
    return rest.alias("r").join(q.alias("q"), _on("r", "q", keys), "left").select("r.*", F.col("q.q").alias("q"))


def robust_parameters(df: DataFrame, value: str, *keys: str, tiny: float = 1e-12) -> DataFrame:
    """Median and quartiles; the scale is the quartile range, else the population deviation, else 1."""
    v = S.number(F.col(value))
    q = _quartiles(df, v, keys, F.stddev_pop(v).alias("_sd"))
    iqr = F.get("q", 2) - F.get("q", 0)
    scale = F.when(iqr > tiny, iqr).when(F.col("_sd") > tiny, F.col("_sd")).otherwise(1.0)
    return q.select(*keys, F.col("finite").alias("n"), F.get("q", 1).alias("center"), F.get("q", 0).alias("q25"), F.get("q", 2).alias("q75"), scale.alias("scale"))


def fit_ladder(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Center and scale by a ladder: quartile range, 1.4826 times the median deviation, sample deviation, 1; with the
    rung taken. Two aggregations: deviations need the medians first. They are taken of counted values, dealt by value
    too, so that few keys do not bring all rows to few tasks."""
    v = S.number(F.col(value))
    first = _quartiles(df, v, keys, F.stddev_samp(v).alias("sd"), F.count("*").alias("rows"))
    middle = first.select(*keys, F.get("q", 1).alias("_m"), F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("_deal"))
    counts = df.select(*keys, v.alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n")).withColumn("_deal", F.pmod(F.xxhash64("_v"), F.lit(DEALS)).cast("int"))
    off = counts.alias("d").join(middle.alias("m"), _on("d", "m", (*keys, "_deal"))).select(*(F.col(f"d.{k}").alias(k) for k in keys), F.abs(F.col("_v") - F.col("_m")).alias("_off"), "_n")
    ordered = O.ordered_sums(off, "_off", {"rows": F.col("_n")}, *keys)
    mad = ordered.groupBy(*keys).agg(O.linear(0.5, "_off", F.col("rows"), F.col("rows_upto"), F.col("rows_n")).alias("mad"))
    out = first.alias("f").join(mad.alias("m"), _on("f", "m", keys), "left").select("f.*", "m.mad")
    iqr, m = F.get("q", 2) - F.get("q", 0), F.get("q", 1)
    tol = 100 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs(m))
    ladder = [("iqr", iqr), ("mad", 1.4826 * F.col("mad")), ("sd", F.col("sd"))]
    rung, scale = F.lit("unit"), F.lit(1.0)
    for name, s in reversed(ladder):
        rung, scale = F.when(s > tol, name).otherwise(rung), F.when(s > tol, s).otherwise(scale)
    return out.select(*keys, m.alias("center"), scale.alias("scale"), rung.alias("scale_statistic"), (F.col("finite") < F.col("rows")).alias("missing_indicator"), (rung != "unit").alias("keep"))


def robust_transform(df: DataFrame, value: str, parameters: DataFrame, *keys: str) -> DataFrame:
    """value_scaled and value_missing of every row; a missing value takes the center, which becomes 0. Other columns
    stay, whatever their names."""
    fitted = parameters.select(F.struct(*keys).alias("_key"), F.struct("center", "scale").alias("_fitted"))
    joined = df.join(fitted, [F.col(k) == F.col(f"_key.{k}") for k in keys], "left")
    scaled = S.robust_value(F.col(value), F.col("_fitted.center"), F.col("_fitted.scale"))
    return joined.withColumns({f"{value}_scaled": scaled, f"{value}_missing": S.number(F.col(value)).isNull().cast("int")}).drop("_key", "_fitted")


def ordered_counts(df: DataFrame, value: str, *keys: str, buckets: int = 64) -> DataFrame:
    """(keys, value, count, upto, n): every distinct value of a key, how many rows have it, how many have it or less, and
    how many the key has; exact. Values are counted, dealt to ranges between quantiles of all keys' distinct values and
    summed within key and range, so that no task sees more than about a share 1 / buckets of them, however few keys
    there are. Missing values do not count; a key without any other has no row."""
    # side ranges of side ranges, so that a value is compared with 2 * side cuts.
    side = math.isqrt(max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) - 1) + 1
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("count"))
    found = counts.agg(F.percentile_approx(value, F.array(*(F.lit(i / side**2) for i in range(1, side**2)))).alias("_cuts"))
    cuts = found.select("_cuts", F.array(*(F.get("_cuts", i * side - 1) for i in range(1, side))).alias("_coarse"))
    coarse = F.size(F.filter("_coarse", lambda c: c < F.col(value)))
    fine = F.size(F.filter(F.slice("_cuts", F.col("_c") * side + 1, side - 1), lambda c: c < F.col(value)))
    dealt = counts.crossJoin(F.broadcast(cuts)).withColumn("_c", coarse).withColumn("_b", F.col("_c") * side + fine).drop("_cuts", "_coarse", "_c")
    sums = dealt.groupBy(*keys, "_b").agg(F.sum("count").alias("_s"))
    of_key = Window.partitionBy(*keys)
    before = sums.select(*keys, "_b", (F.sum("_s").over(of_key.orderBy("_b")) - F.col("_s")).alias("_before"), F.sum("_s").over(of_key).alias("n"))
    within = F.sum("count").over(Window.partitionBy(*keys, "_b").orderBy(value))
    joined = dealt.withColumn("_u", within).alias("d").join(before.alias("p"), [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys, "_b")])
    return joined.select(*(F.col(f"d.{k}").alias(k) for k in (*keys, value)), "count", (F.col("_before") + F.col("_u")).alias("upto"), "n")


def order_statistic(rank: Column, value: str) -> Column:
    """Aggregate over ordered_counts: the value at a rank counted from 0."""
    return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("count") <= rank), F.col(value)))


def higher_quantile(df: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """The order statistic at ceil(p * (n - 1)), counted from 0."""
    rank = F.ceil(F.lit(float(p)) * (F.col("n") - 1))
    return ordered_counts(df, value, *keys).groupBy(*keys).agg(order_statistic(rank, value).alias("quantile"), F.max("n").alias("n")).where("n > 0")


def equal_block_quantile(df: DataFrame, value: str, block: str, p: float, *keys: str, min_rows: int = 1, min_blocks: int = 1) -> DataFrame:
    """The least value at which blocks of equal mass have p of all mass. Blocks with fewer than min_rows values do not
    count; keys with fewer than min_blocks such blocks have no row."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, block, value)
    kept = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, block))).where(F.col("_n") >= min_rows)
    blocks = kept.groupBy(*keys).agg(F.countDistinct(block).alias("blocks")).where(F.col("blocks") >= min_blocks)
    q = O.weighted_quantiles(kept, value, 1.0 / F.col("_n"), (p,), *keys)
    return q.alias("q").join(blocks.alias("b"), _on("q", "b", keys)).select(*(F.col(f"q.{k}").alias(k) for k in keys), F.get("q.q", 0).alias("quantile"), "b.blocks")


def population_stability(df: DataFrame, value: str, train: Column, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """The population stability index between train and other rows, over bins between the train quantiles."""
    d = df.select(S.number(F.col(value)).alias("v"), train.alias("t")).where("v IS NOT NULL")
    found = []
    for i in range(bins + 1):
        at = F.lit(i / bins) * (F.col("n") - 1)
        share = F.lit(i / bins) * (F.max("n") - 1)
        low, high = order_statistic(F.floor(at), "v"), order_statistic(F.ceil(at), "v")
        found.append(F.when(low == high, low).otherwise((F.ceil(share) - share) * low + (share - F.floor(share)) * high))
    edges = ordered_counts(d.where("t"), "v").agg(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("e"))
    binned = d.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))), lambda x: x < F.col("v"))))
    share = binned.groupBy("bin").agg(F.count_if("t").alias("a"), F.count_if(~F.col("t")).alias("b"), F.max(F.size("e")).alias("edges"))
    total = share.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, q = (F.greatest(F.col(c) / F.col(f"n{c}"), F.lit(eps)) for c in "ab")
    return share.crossJoin(F.broadcast(total)).agg(F.when(F.max("edges") < 3, 0.0).otherwise(F.sum((q - p) * F.log(q / p))).alias("psi"))


def average_rank(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """(column, rank): the mean rank of every distinct value, exact. Values are counted, dealt to ranges between a few
    quantiles, ranked within their range and moved by the ranges before, so no task sees all of them."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    cuts = counts.agg(F.percentile_approx(column, F.array(*(F.lit(i / buckets) for i in range(1, buckets)))).alias("_cuts"))
    dealt = counts.crossJoin(F.broadcast(cuts)).select(column, "_n", F.size(F.filter("_cuts", lambda c: c < F.col(column))).alias("_b"))
    sums = dealt.groupBy("_b").agg(F.sum("_n").alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy("_b").orderBy(column))
    ranked = dealt.withColumn("_u", upto).join(F.broadcast(before), "_b")
    return ranked.select(column, (F.col("_before") + F.col("_u") - (F.col("_n") - 1) / 2).alias("rank"))


def spearman_pairs(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rank correlations of all pairs of columns; ties have their mean rank, a missing value has none."""
    for c in columns:
        df = df.join(average_rank(df, c).withColumnRenamed("rank", f"_{c}"), c, "left")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.corr(f"_{a}", f"_{b}").alias("rho")) for a, b in pairs)).alias("p"))
    return one.select(F.explode("p").alias("p")).select("p.*")
