"""Sequence operators: segments, blocks, runs, causal windows and the criticality walk.

Everything is ordered within a case, so one exchange on the case key serves all windows of a plan. Recurrences have
closed forms over window frames; none needs a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _past(*keys: str, order: str = "ts"):
    return Window.partitionBy(*keys).orderBy(order)


def minutes_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later) / 60.0


def strict_segments(df: DataFrame, step_minutes: float = 10, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """segment_id: a new segment begins where the step is not exactly step_minutes, or unknown."""
    w = _past(key, order=ts)
    broken = F.coalesce(minutes_between(F.col(ts), F.lag(ts).over(w)) != step_minutes, F.lit(True))
    return df.withColumn("_b", broken.cast("int")).withColumn("segment_id", (F.sum("_b").over(w) - 1).cast("int")).drop("_b")


def order_audit(df: DataFrame, source_order: str, step_minutes: float = 10, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """Per case, in source order: duplicate, backward and gap steps, the longest step, and segments = gaps + 1."""
    d = minutes_between(F.col(ts), F.lag(ts).over(_past(key, order=source_order)))
    return (
        df.withColumn("_d", d).groupBy(key)
        .agg(
            F.count("*").alias("rows"), F.count_if(F.col(ts).isNull()).alias("missing_timestamps"),
            F.count_if(F.col("_d") == 0).alias("duplicate_timestamps"), F.count_if(F.col("_d") < 0).alias("nonmonotonic_timestamps"),
            F.count_if(F.col("_d") > step_minutes).alias("gap_count"), F.max("_d").alias("maximum_gap_minutes"),
        )
        .withColumn("continuous_segments", F.col("gap_count") + 1)
    )


def runs(df: DataFrame, condition: Column, breaks: Column | None, key: str = "case_key", order: str = "ts", name: str = "run") -> DataFrame:
    """Rows for which condition holds, numbered by their unbroken run. breaks: where a run may not continue."""
    w = _past(key, order=order)
    flag = F.coalesce(condition, F.lit(False))
    cut = ~flag if breaks is None else (~flag | F.coalesce(breaks, F.lit(False)))
    return df.withColumn("_f", flag).withColumn("_c", cut.cast("int")).withColumn(name, F.sum("_c").over(w)).where("_f").drop("_f", "_c")


def longest_run(df: DataFrame, condition: Column, breaks: Column | None = None, key: str = "case_key", order: str = "ts") -> DataFrame:
    """(key, longest_run): the most consecutive rows of condition; 0 for keys without one."""
    found = runs(df, condition, breaks, key, order).groupBy(key, "run").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("n"))
    return df.select(key).distinct().join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("longest_run"))


def counter_rate(df: DataFrame, counter: str, key: str = "case_key", ts: str = "ts", segment: str = "segment_id") -> DataFrame:
    """counter_rate: the first difference within a segment; null at a segment's start, beside missing values and where
    the counter falls."""
    w = _past(key, order=ts)
    d = F.col(counter) - F.lag(counter).over(w)
    return df.withColumn("counter_rate", F.when((F.col(segment) == F.lag(segment).over(w)) & (d >= 0), d))


def temporal_folds(df: DataFrame, block: int = 432, folds: int = 5, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """block_id and fold_id: blocks of a segment's rows, numbered through the case and dealt round robin."""
    pos = F.row_number().over(_past(key, "segment_id", order=ts)) - 1
    out = df.withColumn("_k", F.floor(pos / block))
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy("segment_id", "_k")) - 1
    return out.withColumn("block_id", rank).withColumn("fold_id", F.col("block_id") % folds).drop("_k")


def embargo(df: DataFrame, fold: int, width: int = 144, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """embargoed: rows within width rows of a held-out row of the fold, in its segment; held-out rows included."""
    near = Window.partitionBy(key, "segment_id").orderBy(ts).rowsBetween(-width, width)
    return df.withColumn("embargoed", F.max((F.col("fold_id") == fold).cast("int")).over(near) == 1)


def embargo_bits(df: DataFrame, folds: int = 5, width: int = 144, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """embargo_bits: bit k is set for rows within width rows of a row of fold k, in its segment; rows of k included.
    One window serves all folds."""
    near = Window.partitionBy(key, "segment_id").orderBy(ts).rowsBetween(-width, width)
    bits = [F.shiftleft(F.max((F.col("fold_id") == k).cast("int")).over(near), k) for k in range(folds)]
    return df.withColumn("embargo_bits", reduce(Column.__add__, bits))


def fold_masks(df: DataFrame, fit: Column, folds: int = 5, width: int = 144, min_rows: int = 200, key: str = "case_key") -> DataFrame:
    """(key, fold, train_rows, validation_rows, usable) of every fold: training rows are fit rows outside the embargo."""
    near = Window.partitionBy(key, "segment_id").orderBy("ts").rowsBetween(-width, width)
    flags = [F.max((F.col("fold_id") == k).cast("int")).over(near).alias(f"_e{k}") for k in range(folds)]
    wide = df.select(key, "fold_id", fit.alias("_fit"), *flags)
    counted = wide.groupBy(key).agg(
        F.array(*(F.struct(F.lit(k).alias("fold"), F.count_if(F.col("_fit") & (F.col("fold_id") != k) & (F.col(f"_e{k}") == 0)).alias("train_rows"), F.count_if(F.col("_fit") & (F.col("fold_id") == k)).alias("validation_rows")) for k in range(folds))).alias("f")
    )
    return counted.select(key, F.explode("f").alias("f")).select(key, "f.*").withColumn("usable", (F.col("train_rows") >= min_rows) & (F.col("validation_rows") >= min_rows))


def complete_blocks(df: DataFrame, size: int = 144, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """Rows of complete blocks of size rows with their continuity and block numbers; runs break at row gaps (row_id),
    segments and folds, and a run's incomplete tail is dropped."""
    w = _past(key, order=ts)
    same = (F.col("row_id") - F.lag("row_id").over(w) == 1) & (F.col("segment_id") == F.lag("segment_id").over(w)) & (F.col("fold_id") == F.lag("fold_id").over(w))
    out = df.withColumn("_b", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("continuity_id", F.sum("_b").over(w))
    run = Window.partitionBy(key, "continuity_id")
    out = out.withColumn("_n", F.floor((F.row_number().over(run.orderBy(ts)) - 1) / size)).withColumn("_s", F.count("*").over(run))
    return out.where((F.col("_n") + 1) * size <= F.col("_s")).withColumnRenamed("_n", "block_in_run").drop("_b", "_s")


def causal_median(df: DataFrame, value: str, window: int, run: str = "segment_id", key: str = "case_key", ts: str = "ts") -> DataFrame:
    """smoothed: the median of the last window values of a run; null until the window is full of values."""
    w = Window.partitionBy(key, run).orderBy(ts).rowsBetween(-(window - 1), 0)
    return df.withColumn("smoothed", F.when(F.count(value).over(w) == window, F.percentile(value, F.lit(0.5)).over(w)))


def past_mean(df: DataFrame, value: str, windows: tuple[int, ...], key: str = "case_key", ts: str = "ts") -> DataFrame:
    for n in windows:
        df = df.withColumn(f"{value}_mean_{n}", F.avg(value).over(_past(key, order=ts).rowsBetween(-(n - 1), 0)))
    return df


def criticality_walk(df: DataFrame, alarm: Column, actionable: Column, run: tuple[str, ...] = ("case_key", "segment_id"), order: str = "ts") -> DataFrame:
    """criticality: a walk reflected at 0 that rises by 1 on alarmed and falls by 1 on other actionable rows, rests on
    the rest, and starts afresh with each run. With S the free walk it is S - min(0, least S so far)."""
    w = Window.partitionBy(*run).orderBy(order)
    step = F.when(~F.coalesce(actionable, F.lit(False)), 0).when(F.coalesce(alarm, F.lit(False)), 1).otherwise(-1)
    out = df.withColumn("_s", F.sum(step).over(w))
    return out.withColumn("criticality", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).cast("long")).drop("_s")


def first_crossing(df: DataFrame, threshold: int = 72, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """(key, first_alarm, maximum_criticality, event_alarm)."""
    return df.groupBy(key).agg(
        F.min(F.when(F.col("criticality") >= threshold, F.col(ts))).alias("first_alarm"),
        F.max("criticality").alias("maximum_criticality"),
        F.coalesce(F.max(F.col("criticality") >= threshold), F.lit(False)).alias("event_alarm"),
    )


def sampling_intervals(df: DataFrame, key: str = "case_key", ts: str = "ts", longest: float = 1440) -> DataFrame:
    d = minutes_between(F.col(ts), F.lag(ts).over(_past(key, order=ts)))
    return df.select(key, d.alias("d")).where((F.col("d") > 0) & (F.col("d") <= longest)).groupBy(key).agg(
        F.count("*").alias("intervals"), F.percentile("d", F.lit(0.5)).alias("median_minutes"), F.percentile("d", F.lit(0.95)).alias("p95_minutes"), F.max("d").alias("max_minutes")
    )


def window_index(df: DataFrame, eligible: Column, short: int = 144, long: int = 168, every: int = 6, horizon: int = 6, stride: int = 6, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """Windows that end at each anchor row of a segment, as row numbers, never as tensors.

    The short window is the last short rows, the long one every every-th of the last rows, the target lies horizon
    rows ahead. Counts of eligible rows come from frames, over the segment for the short window and over rows of one
    phase for the long one.
    """
    seg = Window.partitionBy(key, "segment_id")
    span = (long - 1) * every + 1
    pos = F.row_number().over(seg.orderBy(ts)) - 1
    out = df.withColumn("pos", pos).withColumn("_e", F.coalesce(eligible, F.lit(False)).cast("int")).withColumn("_phase", F.col("pos") % every)
    out = out.withColumn("short_eligible", F.sum("_e").over(seg.orderBy(ts).rowsBetween(-(short - 1), 0)))
    out = out.withColumn("long_eligible", F.sum("_e").over(Window.partitionBy(key, "segment_id", "_phase").orderBy(ts).rowsBetween(-(long - 1), 0)))
    out = out.withColumn("target_eligible", F.lead("_e", horizon).over(seg.orderBy(ts)))
    anchors = out.where((F.col("pos") >= span - 1) & ((F.col("pos") - (span - 1)) % stride == 0) & F.col("target_eligible").isNotNull())
    return anchors.select(
        key, "segment_id", F.col("pos").alias("anchor_pos"), (F.col("pos") - short + 1).alias("short_start"), (F.col("pos") - span + 1).alias("long_start"),
        (F.col("pos") + horizon).alias("target_pos"), (F.col("short_eligible") / short).alias("short_fraction"), (F.col("long_eligible") / long).alias("long_fraction"), (F.col("target_eligible") == 1).alias("target_eligible"),
    )
