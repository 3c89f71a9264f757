"""Joins with their guarantees, set operations, grids, rankings and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmwatch.operators import order_statistics as O


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with a column side: both, left_only or right_only; multiple: a key is not unique on its side."""
    a = left.withColumn("_l", F.count("*").over(Window.partitionBy(*keys)))
    b = right.withColumn("_r", F.count("*").over(Window.partitionBy(*keys)))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    multiple = (F.coalesce("_l", F.lit(1)) > 1) | (F.coalesce("_r", F.lit(1)) > 1)
    return a.join(b, keys, "full_outer").withColumn("side", side).withColumn("multiple", multiple).drop("_l", "_r")


def merged_spans(intervals: DataFrame, key: str) -> DataFrame:
    """(key, start, end): intervals that overlap or touch as one, so that no two spans of a key share a time."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = intervals.where(F.col("start") <= F.col("end")).withColumn("_new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    return begins.withColumn("_span", F.sum("_new").over(w)).groupBy(key, "_span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_span")


def in_intervals(rows: DataFrame, intervals: DataFrame, key: str = "case_key", ts: str = "ts", bucket_seconds: int = 86_400) -> DataFrame:
    """in_event: whether a row's time lies in an interval (start, end) of its key. Each row stays one row.

    Spans of merged intervals are dealt to buckets of time and met there by key and bucket; a row can lie in one span
    only, so the join keeps rows. A key may have any number of intervals: a bucket sees its own alone."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    bucket = lambda c: F.floor(F.timestamp_diff("SECOND", epoch, c.cast("timestamp_ntz")) / bucket_seconds)
    spans = merged_spans(intervals.select(key, "start", "end"), key)
    index = spans.select(F.col(key).alias("_key"), "start", "end", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("_at")).select(F.struct("_key", "_at", "start", "end").alias("_span"))
    inside = (F.col(ts) >= F.col("_span.start")) & (F.col(ts) <= F.col("_span.end"))
    joined = rows.join(index, (F.col(key) == F.col("_span._key")) & (bucket(F.col(ts)) == F.col("_span._at")) & inside, "left")
    return joined.withColumn("in_event", F.col("_span").isNotNull()).drop("_span")


def others(assets: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """Each asset with every other one (outer, inner), for up to most assets; sums over the others of more assets are
    totals less the own share."""
    if assets.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} assets: take totals less the own share instead of pairs")
    return assets.select(F.col(key).alias("outer_asset")).join(assets.select(F.col(key).alias("inner_asset")), F.col("outer_asset") != F.col("inner_asset"))


def full_grid(counts: DataFrame, value: str, **levels: list) -> DataFrame:
    """counts over all combinations of levels, 0 where there is none."""
    grid = None
    for name, values in levels.items():
        one = counts.sparkSession.createDataFrame([(v,) for v in values], [name])
        grid = one if grid is None else grid.crossJoin(F.broadcast(one))
    return grid.join(counts, list(levels), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last: resuming keeps the newest result of a trial."""
    return top_per_group(df, [key], [F.desc(order)])


def hash_folds(assets: DataFrame, asset: str, farm: str, seed: int = 42, outer_fold: int = 1, folds: int = 5) -> DataFrame:
    """inner_fold of every asset: per farm in order of a seeded hash, dealt round robin from a start that depends on
    the outer fold and the farm's place. The hash's hexadecimal prefix orders as its number does."""
    h = F.substring(F.sha2(F.concat(F.lit(f"{seed + outer_fold}|"), F.col(asset).cast("string")), 256), 1, 16)
    out = assets.withColumn("_h", h).withColumn("_pos", F.row_number().over(Window.partitionBy(farm).orderBy("_h", asset)) - 1)
    places = assets.select(farm).distinct().withColumn("_farm", F.row_number().over(Window.orderBy(farm)) - 1)
    return out.join(places, farm).withColumn("inner_fold", ((F.col("_pos") + (outer_fold + F.col("_farm")) % folds) % folds + 1).cast("int")).drop("_h", "_pos", "_farm")


def holm(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """holm: step-down adjusted p-values within keys; a missing p stays missing and does not count. Equal p-values have
    one adjusted value, so ranks and the running maximum are those of distinct values, by value ranges."""
    ranked = O.ordered_sums(df, p, {"rows": F.lit(1)}, *keys)
    steps = O.running_extreme(ranked, p, (F.col("rows_n") - F.col("rows_upto") + F.col("rows")) * F.col(p), *keys)
    return O.with_ranks(df, steps, p, "rows", *keys).withColumn("holm", F.least(F.lit(1.0), F.col("_rank.extreme")) * F.when(F.col(p).isNotNull(), 1)).drop("_rank")


def benjamini_hochberg(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """bh: step-up adjusted p-values within keys; a missing p stays missing and does not count."""
    ranked = O.ordered_sums(df, p, {"rows": F.lit(1)}, *keys)
    steps = O.running_extreme(ranked, p, F.col(p) * F.col("rows_n") / F.col("rows_upto"), *keys, least_above=True)
    return O.with_ranks(df, steps, p, "rows", *keys).withColumn("bh", F.least(F.lit(1.0), F.col("_rank.extreme")) * F.when(F.col(p).isNotNull(), 1)).drop("_rank")


def empirical_p(observed: DataFrame, null: DataFrame, value: str, *keys: str) -> DataFrame:
    """p = (1 + null values at or above) / (n + 1) for each observed row, by the ranks of both together: no pair is
    made, and no task holds all values of a key. Without null values p is 1."""
    both = observed.select(*keys, value, F.lit(0).alias("_null")).unionByName(null.select(*keys, value, F.lit(1).alias("_null")))
    ranked = O.ordered_sums(both, value, {"null": F.col("_null")}, *keys)
    r = F.col("_rank")
    return O.with_ranks(observed, ranked, value, "null", *keys).withColumn("p", (1 + r["n"] - r["upto"] + r["own"]) / (r["n"] + 1)).drop("_rank")
