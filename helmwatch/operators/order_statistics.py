"""Exact quantiles by value ranges: of keys, of fold complements and of weighted rows, from one aggregation.

Rows are summed by key and distinct value first, with one measure a fold (or one of weights). The sums are dealt to
value ranges and added up along the values, within ranges and over the ranges before. What lies at or below a value in
all folds but one is the total less the fold's own, so no row is copied for a complement, and no task holds all values
of a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_sums(df: DataFrame, value: str, measures: dict[str, Column], *keys: str, buckets: int = 64) -> DataFrame:
    """(keys, value, value_range, and for every measure m: m, m_upto, m_n): the measure's sum at a value, at it or below,
    and of the whole key. Ranges are numbered in the order of their values. Missing values do not count; a key without any other has no row."""
    side = math.isqrt(max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) - 1) + 1
    names = list(measures)
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*(F.sum(c).alias(m) for m, c in measures.items()))
    # The filter holds for every row; it keeps the measures in the plan, so that both uses share one exchange.
    every = F.coalesce(*(F.col(m).cast("double") for m in names), F.lit(0.0)) > float("-inf")
    found = sums.where(every).agg(F.percentile_approx(value, F.array(*(F.lit(i / side**2) for i in range(1, side**2)))).alias("_cuts"))
    cuts = found.select("_cuts", F.array(*(F.get("_cuts", i * side - 1) for i in range(1, side))).alias("_coarse"))
    coarse = F.size(F.filter("_coarse", lambda c: c < F.col(value)))
    fine = F.size(F.filter(F.slice("_cuts", F.col("_c") * side + 1, side - 1), lambda c: c < F.col(value)))
    dealt = sums.where(every).crossJoin(F.broadcast(cuts)).withColumn("_c", coarse).withColumn("_range", F.col("_c") * side + fine).drop("_cuts", "_coarse", "_c")
    of_range = dealt.groupBy(*keys, "_range").agg(*(F.sum(m).alias(f"{m}_s") for m in names))
    # One row a key and range: at most side^2 rows a key.
    of_key = Window.partitionBy(*keys)
    before = of_range.select(*keys, "_range", *(c for m in names for c in ((F.sum(f"{m}_s").over(of_key.orderBy("_range")) - F.col(f"{m}_s")).alias(f"{m}_before"), F.sum(f"{m}_s").over(of_key).alias(f"{m}_n"))))
    within = Window.partitionBy(*keys, "_range").orderBy(value)
    run = dealt.select(*keys, "_range", value, *names, *(F.sum(m).over(within).alias(f"{m}_in") for m in names)).alias("d")
    joined = run.join(before.alias("p"), [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys, "_range")])
    return joined.select(*(F.col(f"d.{k}").alias(k) for k in (*keys, value)), F.col("d._range").alias("value_range"), *(c for m in names for c in (F.col(f"d.{m}").alias(m), (F.col(f"p.{m}_before") + F.col(f"d.{m}_in")).alias(f"{m}_upto"), F.col(f"p.{m}_n").alias(f"{m}_n"))))


def at_rank(rank: Column, value: str, own: Column, upto: Column) -> Column:
    """Aggregate over ordered_sums: the value at a rank counted from 0."""
    return F.max(F.when((upto > rank) & (upto - own <= rank), F.col(value)))


def linear(p: float, value: str, own: Column, upto: Column, n: Column) -> Column:
    """Aggregate over ordered_sums: the quantile with linear interpolation between order statistics."""
    at = F.lit(float(p)) * (n - 1)
    low, high = at_rank(F.floor(at), value, own, upto), at_rank(F.ceil(at), value, own, upto)
    part = F.max(at - F.floor(at))
    return low + part * (high - low)


def linear_quantiles(df: DataFrame, value: str, ps: tuple[float, ...], *keys: str) -> DataFrame:
    """(keys, n, q): how many values a key has and its quantiles, exact, interpolated linearly."""
    ordered = ordered_sums(df, value, {"rows": F.lit(1)}, *keys)
    return ordered.groupBy(*keys).agg(F.max("rows_n").alias("n"), F.array(*(linear(p, value, F.col("rows"), F.col("rows_upto"), F.col("rows_n")) for p in ps)).alias("q")).where("n > 0")


def _complement(folds: int, k: int | None) -> tuple[Column, Column, Column]:
    """(own, upto, n) over all folds, or over all but fold k."""
    total = [sum((F.col(f"f{j}{part}") for j in range(folds)), F.lit(0)) for part in ("", "_upto", "_n")]
    return tuple(total if k is None else [t - F.col(f"f{k}{part}") for t, part in zip(total, ("", "_upto", "_n"), strict=True)])


def fold_sums(df: DataFrame, value: str, fold: str, folds: int, *keys: str) -> DataFrame:
    """ordered_sums with one count a fold: f0, f1, ..."""
    return ordered_sums(df, value, {f"f{k}": (F.col(fold) == k).cast("int") for k in range(folds)}, *keys)


def complement_quantiles(df: DataFrame, value: str, fold: str, folds: int, ps: tuple[float, ...], *keys: str, higher: bool = False) -> DataFrame:
    """(keys, fold, n, q): the quantiles of every fold's complement, linear ones or the order statistic at the next
    higher rank. A fold whose complement is empty has no row."""
    found = []
    for k in range(folds):
        own, upto, n = _complement(folds, k)
        one = [at_rank(F.ceil(F.lit(float(p)) * (n - 1)), value, own, upto) if higher else linear(p, value, own, upto, n) for p in ps]
        found.append(F.struct(F.lit(k).alias("fold"), F.max(n).alias("n"), F.array(*one).alias("q")))
    out = fold_sums(df, value, fold, folds, *keys).groupBy(*keys).agg(F.array(*found).alias("_found"))
    return out.select(*keys, F.explode("_found").alias("_f")).select(*keys, F.col("_f.fold").alias(fold), "_f.n", "_f.q").where("n > 0")


def complement_parameters(df: DataFrame, value: str, fold: str, folds: int, *keys: str, tiny: float = 1e-12) -> DataFrame:
    """(keys, fold, n, center, scale): median and quartile range of each fold's complement; where the range vanishes
    the population deviation, else 1. Deviations come from centred sums of the folds, merged."""
    q = complement_quantiles(df, value, fold, folds, (0.25, 0.5, 0.75), *keys)
    part = df.where(F.col(value).isNotNull()).groupBy(*keys, fold).agg(F.count("*").cast("double").alias("_n"), F.avg(value).alias("_m"), (F.var_pop(value) * F.count("*")).alias("_s"))
    parts = part.groupBy(*keys).agg(F.collect_list(F.struct(F.col(fold).alias("k"), "_n", "_m", "_s")).alias("_parts"))
    joined = q.alias("q").join(parts.alias("p"), [F.col(f"q.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]).select("q.*", "p._parts")
    others = F.filter("_parts", lambda x: x["k"] != F.col(fold))
    add = lambda of: F.aggregate(others, F.lit(0.0), lambda s, x: s + of(x))
    mean = add(lambda x: x["_n"] * x["_m"]) / add(lambda x: x["_n"])
    joined = joined.withColumn("_mean", mean)
    sd = F.sqrt(add(lambda x: x["_s"] + x["_n"] * (x["_m"] - F.col("_mean")) * (x["_m"] - F.col("_mean"))) / F.col("n"))
    iqr = F.get("q", 2) - F.get("q", 0)
    return joined.select(*keys, fold, "n", F.get("q", 1).alias("center"), F.when(iqr > tiny, iqr).when(sd > tiny, sd).otherwise(1.0).alias("scale"))


def weighted_quantiles(df: DataFrame, value: str, mass: Column, ps: tuple[float, ...], *keys: str) -> DataFrame:
    """(keys, mass, q): for each p the least value at which the mass so far reaches p of all mass."""
    ordered = ordered_sums(df, value, {"mass": mass}, *keys)
    reach = lambda p: F.lit(float(p)) * F.col("mass_n") - 1e-9
    return ordered.groupBy(*keys).agg(F.max("mass_n").alias("mass"), F.array(*(F.min(F.when(F.col("mass_upto") >= reach(p), F.col(value))) for p in ps)).alias("q"))


def running_extreme(ordered: DataFrame, value: str, of: Column, *keys: str, least_above: bool = False) -> DataFrame:
    """ordered_sums with the column extreme: the greatest `of` at a value or below, or the least at it or above. Within
    ranges and over ranges, as the sums are."""
    best = F.min if least_above else F.max
    rows = ordered.withColumn("_of", of)
    of_range = rows.groupBy(*keys, "value_range").agg(best("_of").alias("_best"))
    frame = Window.partitionBy(*keys).orderBy(F.desc("value_range") if least_above else F.asc("value_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = of_range.select(*keys, "value_range", best("_best").over(frame).alias("_before"))
    within = Window.partitionBy(*keys, "value_range").orderBy(F.desc(value) if least_above else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", best("_of").over(within))
    joined = rows.alias("d").join(before.alias("p"), [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys, "value_range")])
    pick = F.least if least_above else F.greatest
    return joined.select(*(F.col(f"d.{c}").alias(c) for c in ordered.columns), pick(F.col("d._in"), F.coalesce(F.col("p._before"), F.col("d._in"))).alias("extreme"))


def with_ranks(df: DataFrame, ordered: DataFrame, value: str, measure: str, *keys: str) -> DataFrame:
    """df with the struct _rank (own, upto, n and, if there, extreme) of its rows' values; null for missing values."""
    extreme = [F.col("extreme")] if "extreme" in ordered.columns else []
    ranks = ordered.select(F.struct(*keys, F.col(value).alias("_v")).alias("_at"), F.struct(F.col(measure).alias("own"), F.col(f"{measure}_upto").alias("upto"), F.col(f"{measure}_n").alias("n"), *extreme).alias("_rank"))
    return df.join(ranks, [*(F.col(k).eqNullSafe(F.col(f"_at.{k}")) for k in keys), F.col(value) == F.col("_at._v")], "left").drop("_at")
