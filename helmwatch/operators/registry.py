"""Audits of cases and recorded signals, completeness against an expected registry, and the segments of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import order_statistics as O
from helmwatch.operators import sequence as Q

#: Fixed values of recordings: nominal speed and the range a measured one must lie in, in turns a minute.
NOMINAL_RPM, RPM_RANGE = 1750.0, (1500.0, 2000.0)
MIN_NUMERIC, MIN_RPM_SHARE = 0.999, 0.80


def case_audit(df: DataFrame, expected: DataFrame, asset: str, source_order: str, step_minutes: float, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """One row a case: rows by partition, statuses and assets seen, whether the assets are just the expected one, and
    the steps of its timestamps in source order.

    expected: (key, expected_asset), one row a case; a case without one matches none. Missing statuses and assets are
    not listed."""
    part = S.partition_name(F.col("train_test"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ";")  # noqa: E731  few values a case
    counts = df.groupBy(key).agg(
        F.count_if(part == "train").alias("train_rows"), F.count_if(part == "prediction").alias("prediction_rows"), F.count_if(~part.isin("train", "prediction") | part.isNull()).alias("unknown_split_rows"),
        F.count_if(S.fit_mask(F.col("train_test"), F.col("status_type_id"))).alias("training_normal_rows"), listed("status_type_id").alias("status_ids_seen"), listed(asset).alias("asset_ids_seen"),
    )
    out = Q.order_audit(df, source_order, step_minutes, key, ts).join(counts, key).join(expected.select(key, "expected_asset"), key, "left")
    return out.withColumn("asset_matches", F.coalesce(F.col("asset_ids_seen") == F.col("expected_asset").cast("string"), F.lit(False)))


def longest_zero_runs(df: DataFrame, channels: tuple[str, ...], fit: Column, step_minutes: float, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """(key, channel, longest_zero_run) of channels with a zero: most fit rows in a row that are zero. Rows out of fit, other
    values and steps that are none or longer than step_minutes end a run. One sort serves all channels."""
    w = Window.partitionBy(key).orderBy(ts)
    step = Q.minutes_between(F.col(ts), F.lag(ts).over(w))
    marked = df.withColumn("_broken", F.coalesce((step <= 0) | (step > step_minutes), F.lit(True)))
    zero = {c: F.coalesce(fit & (S.number(F.col(c)) == 0), F.lit(False)) for c in channels}
    runs = [F.struct(F.lit(c).alias("channel"), z.alias("zero"), F.sum((F.col("_broken") | ~z).cast("int")).over(w).alias("run")) for c, z in zero.items()]
    found = marked.select(key, F.array(*runs).alias("_r")).select(key, F.explode(F.filter("_r", lambda r: r["zero"])).alias("_r"))
    lengths = found.groupBy(key, "_r.channel", "_r.run").agg(F.count("*").alias("_n"))
    return lengths.groupBy(key, "channel").agg(F.max("_n").alias("longest_zero_run"))


def review_channels(audit: DataFrame, zero_runs: DataFrame, max_run: int = 144, min_availability: float = 0.70, key: str = "case_key") -> DataFrame:
    """audit (quality.channel_audit) with longest_zero_run, 0 where there is none, and the review flag."""
    out = audit.join(zero_runs, [key, "channel"], "left").withColumn("longest_zero_run", F.coalesce("longest_zero_run", F.lit(0)))
    return out.withColumn("review_flag", S.review_flag(F.col("finite_rows"), F.col("zero_rows") == F.col("finite_rows"), F.col("availability"), F.col("longest_zero_run"), min_availability, max_run))


def record_audit(df: DataFrame, record: str, signal: str, rpm: str) -> DataFrame:
    """One row a record: its samples, the share of finite ones, whether that suffices, and its speed: the median of the
    measured ones where enough are finite and it lies in RPM_RANGE, else the nominal one."""
    finite = S.number(F.col(rpm))
    counts = df.groupBy(record).agg(F.count("*").alias("samples"), F.count(S.number(F.col(signal))).alias("numeric"), F.count(finite).alias("_rpm"))
    medians = O.linear_quantiles(df.withColumn("_v", finite), "_v", (0.5,), record).select(record, F.get("q", 0).alias("_median"))
    share = F.col("_rpm") / F.col("samples")
    measured = (share >= MIN_RPM_SHARE) & F.col("_median").between(*RPM_RANGE)
    out = counts.join(medians, record, "left").withColumns({
        "numeric_fraction": F.col("numeric") / F.col("samples"), "usable": F.col("numeric") / F.col("samples") >= MIN_NUMERIC, "rpm_valid_fraction": share,
        "rpm": F.when(measured, F.col("_median")).otherwise(NOMINAL_RPM), "rpm_source": F.when(F.coalesce(measured, F.lit(False)), "measured_median").otherwise("registered_nominal"),
    })
    return out.drop("_rpm", "_median")


def completeness(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """(keys, copies, state) of every expected or found key: complete, missing, duplicate or unexpected."""
    # Both sides are counted by key before they meet, so a key that repeats does not multiply.
    both = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_f")).union(found.select(*keys, F.lit(0), F.lit(1)))
    out = both.groupBy(*keys).agg(F.max("_e").alias("_e"), F.sum("_f").alias("copies"))
    state = F.when(F.col("_e") == 0, "unexpected").when(F.col("copies") == 0, "missing").when(F.col("copies") > 1, "duplicate").otherwise("complete")
    return out.withColumn("state", state).drop("_e")


def segments(records: DataFrame, record: str, samples: str, length: int, salt: str) -> DataFrame:
    """Whole segments of length samples of every record, in place: (record, segment, start, stop, trial_id); trial_id is
    the SHA-256 of salt, record, segment, start and stop, joined by two colons. Shorter records have none."""
    count = F.floor(F.col(samples) / length).cast("int")
    each = records.where(count > 0).select(record, F.explode(F.sequence(F.lit(0), count - 1)).alias("segment"))
    out = each.withColumns({"start": F.col("segment") * length, "stop": (F.col("segment") + 1) * length})
    return out.withColumn("trial_id", F.sha2(F.concat_ws("::", F.lit(salt), record, "segment", "start", "stop"), 256))
