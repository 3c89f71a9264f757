"""Queries of case and record audits, registry completeness and segments, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import quality as A
from helmwatch.operators import registry as R
from helmwatch.sources.tables import CHANNELS, SCADA_SQL, TRAIN_END, scada, table

#: Channel means below this count as zero: the dead band of a sensor.
DEAD_BAND, MAX_RUN, MIN_AVAILABILITY = 25.0, 4, 0.45


def ag1_users(spark, sf_dir):
    """Every user's events as a case, in the order of their ids; the expected asset is the user's remainder by 6."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_key"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.length("event_type").alias("status_type_id"), F.when((F.col("event_type") == "error") & (F.col("user_id") % 4 == 0), 9).otherwise(F.col("user_id") % 6).alias("asset"),
        F.when(F.col("ts") < F.to_timestamp_ntz(F.lit(TRAIN_END)), "train").when(F.col("event_type") == "signup", "held back").otherwise("prediction").alias("train_test"),
    )
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_key"), (F.col("c_custkey") % 6).alias("expected_asset"))
    out = R.case_audit(e, expected, "asset", "event_id", 60)
    return out.withColumn("maximum_gap_minutes", F.round("maximum_gap_minutes", 3))


def ag2_zero_runs(spark, sf_dir):
    s = scada(spark, sf_dir)
    quiet = s.select("case_key", "ts", "train_test", "status_type_id", *(F.when(F.col(c) < DEAD_BAND, 0.0).otherwise(F.col(c)).alias(c) for c in CHANNELS))
    fit = S.fit_mask(F.col("train_test"), F.col("status_type_id"))
    out = R.review_channels(A.channel_audit(quiet, CHANNELS, fit), R.longest_zero_runs(quiet, CHANNELS, fit, 60), MAX_RUN, MIN_AVAILABILITY)
    return out.withColumns({c: F.round(c, 6) for c in ("availability", "zero_fraction_of_finite")})


def _records(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("record"), F.when(F.col("l_orderkey") % 311 != 0, F.col("l_extendedprice").cast("double")).alias("signal"), F.when(F.col("l_linenumber") <= 6, 1400.0 + F.col("l_suppkey") % 5 * 100 + F.col("l_quantity").cast("double")).alias("rpm"))


def b14_records(spark, sf_dir):
    out = R.record_audit(_records(spark, sf_dir), "record", "signal", "rpm")
    return out.withColumns({c: F.round(c, 6) for c in ("numeric_fraction", "rpm_valid_fraction", "rpm")})


def b15_completeness(spark, sf_dir):
    """Brand and size of parts against the grid of all brands and the sizes from 1 to 40."""
    p = table(spark, sf_dir, "part")
    expected = p.select("p_brand").distinct().select("p_brand", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("p_size"))
    return R.completeness(expected, p.select("p_brand", F.col("p_size").cast("int")), "p_brand", "p_size")


def b16_segments(spark, sf_dir):
    return R.segments(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("samples")), "l_suppkey", "samples", 64, "v1")


QUERIES = {
    "ag1_full_case_audit": (ag1_users, f"""WITH e AS (SELECT user_id AS case_key, event_id, ts::TIMESTAMP AS ts, length(event_type) AS st, CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN 9 ELSE user_id % 6 END AS asset, CASE WHEN ts < TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN event_type = 'signup' THEN 'unknown' ELSE 'prediction' END AS part FROM events),
      d AS (SELECT *, trunc(epoch(ts - lag(ts) OVER (PARTITION BY case_key ORDER BY event_id))) / 60 AS d FROM e),
      a AS (SELECT case_key, count(*) AS rows, count(*) FILTER (ts IS NULL) AS missing_timestamps, count(*) FILTER (d = 0) AS duplicate_timestamps, count(*) FILTER (d < 0) AS nonmonotonic_timestamps, count(*) FILTER (d > 60) AS gap_count, round(max(d), 3) AS maximum_gap_minutes, count(*) FILTER (d > 60) + 1 AS continuous_segments,
        count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'prediction') AS prediction_rows, count(*) FILTER (part = 'unknown') AS unknown_split_rows, count(*) FILTER (part = 'train' AND st IN (0, 2)) AS training_normal_rows,
        string_agg(DISTINCT st::VARCHAR, ';' ORDER BY st::VARCHAR) AS status_ids_seen, string_agg(DISTINCT asset::VARCHAR, ';' ORDER BY asset::VARCHAR) AS asset_ids_seen FROM d GROUP BY 1)
      SELECT a.*, c_custkey % 6 AS expected_asset, coalesce(asset_ids_seen = (c_custkey % 6)::VARCHAR, false) AS asset_matches FROM a LEFT JOIN customer ON c_custkey = case_key"""),
    "ag2_pr24_zero_runs": (ag2_zero_runs, f"""WITH {SCADA_SQL}, l AS ({" UNION ALL ".join(f"SELECT case_key, ts, '{c}' AS channel, train_test = 'train' AND status_type_id IN (0, 2) AS fit, CASE WHEN {c} < {DEAD_BAND!r}::DOUBLE THEN 0 ELSE {c} END AS v FROM scada" for c in CHANNELS)}),
      z AS (SELECT *, coalesce(fit AND v = 0, false) AS zero, coalesce(ts - lag(ts) OVER (PARTITION BY case_key, channel ORDER BY ts) > INTERVAL 1 HOUR, true) AS broken FROM l),
      r AS (SELECT *, sum((broken OR NOT zero)::INT) OVER (PARTITION BY case_key, channel ORDER BY ts) AS run FROM z),
      m AS (SELECT case_key, channel, max(n) AS longest FROM (SELECT case_key, channel, run, count(*) AS n FROM r WHERE zero GROUP BY ALL) GROUP BY ALL),
      a AS (SELECT case_key, channel, count(v) AS finite_rows, count(*) - count(v) AS missing_rows, count(v) / count(*) AS availability, count(*) FILTER (v = 0) AS zero_rows FROM l WHERE fit GROUP BY ALL)
      SELECT case_key, channel, finite_rows, missing_rows, round(availability, 6) AS availability, zero_rows, round(zero_rows / nullif(finite_rows, 0), 6) AS zero_fraction_of_finite, coalesce(longest, 0) AS longest_zero_run,
        CASE WHEN finite_rows = 0 THEN 'all_missing' WHEN zero_rows = finite_rows THEN 'structurally_zero' WHEN availability < {MIN_AVAILABILITY!r}::DOUBLE THEN 'low_availability' WHEN coalesce(longest, 0) >= {MAX_RUN} THEN 'sustained_zero_run' ELSE 'pass' END AS review_flag FROM a LEFT JOIN m USING (case_key, channel)"""),
    "b14_record_audit": (b14_records, """WITH s AS (SELECT l_suppkey AS record, CASE WHEN l_orderkey % 311 <> 0 THEN l_extendedprice END AS signal, CASE WHEN l_linenumber <= 6 THEN 1400 + l_suppkey % 5 * 100 + l_quantity::DOUBLE END AS rpm FROM lineitem),
      g AS (SELECT record, count(*) AS samples, count(signal) AS numeric, count(rpm) / count(*) AS share, quantile_cont(rpm, 0.5) AS m FROM s GROUP BY 1)
      SELECT record, samples, numeric, round(numeric / samples, 6) AS numeric_fraction, numeric / samples >= 0.999::DOUBLE AS usable, round(share, 6) AS rpm_valid_fraction, round(CASE WHEN share >= 0.8::DOUBLE AND m BETWEEN 1500 AND 2000 THEN m ELSE 1750 END, 6) AS rpm, CASE WHEN share >= 0.8::DOUBLE AND m BETWEEN 1500 AND 2000 THEN 'measured_median' ELSE 'registered_nominal' END AS rpm_source FROM g"""),
    "b15_registry_completeness": (b15_completeness, """WITH e AS (SELECT b.p_brand, s.p_size FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT unnest(range(1, 41))::INT AS p_size) s), f AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)
      SELECT coalesce(e.p_brand, f.p_brand) AS p_brand, coalesce(e.p_size, f.p_size) AS p_size, coalesce(n, 0) AS copies, CASE WHEN e.p_size IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'complete' END AS state FROM e FULL JOIN f ON e.p_brand = f.p_brand AND e.p_size = f.p_size"""),
    "b16_segments": (b16_segments, """WITH n AS (SELECT l_suppkey, count(*) // 64 AS k FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, unnest(range(0, k))::INT AS segment FROM n)
      SELECT l_suppkey, segment, segment * 64 AS start, (segment + 1) * 64 AS stop, sha256('v1::' || l_suppkey || '::' || segment || '::' || segment * 64 || '::' || (segment + 1) * 64) AS trial_id FROM s"""),
}
