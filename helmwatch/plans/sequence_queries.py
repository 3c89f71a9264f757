"""Queries over the condition-monitoring view that exercise the sequence operators, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import sequence as Q
from helmwatch.sources.tables import SCADA_SQL, scada, table

STEP = 60
SEGMENTS_SQL = f"""{SCADA_SQL},
 numbered AS (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY ts) - 1 AS row_id,
   CASE WHEN ts - lag(ts) OVER (PARTITION BY case_key ORDER BY ts) = INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS b FROM scada),
 seg AS (SELECT * EXCLUDE (b), (sum(b) OVER (PARTITION BY case_key ORDER BY ts) - 1)::INT AS segment_id FROM numbered)"""
FOLDS_SQL = f"""{SEGMENTS_SQL},
 k AS (SELECT *, (row_number() OVER (PARTITION BY case_key, segment_id ORDER BY ts) - 1) // 24 AS kk FROM seg),
 folds AS (SELECT * EXCLUDE (kk), dense_rank() OVER (PARTITION BY case_key ORDER BY segment_id, kk) - 1 AS block_id,
   (dense_rank() OVER (PARTITION BY case_key ORDER BY segment_id, kk) - 1) % 5 AS fold_id FROM k)"""
WALK_SQL = f"""{SEGMENTS_SQL},
 sm AS (SELECT *, CASE WHEN count(click) OVER w = 3 THEN quantile_cont(click, 0.5) OVER w END AS smoothed
   FROM seg WINDOW w AS (PARTITION BY case_key, segment_id ORDER BY ts ROWS 2 PRECEDING)),
 st AS (SELECT *, sum(CASE WHEN status_type_id NOT IN (0, 2) THEN 0 WHEN smoothed > 250 THEN 1 ELSE -1 END) OVER (PARTITION BY case_key, segment_id ORDER BY ts) AS s FROM sm),
 walk AS (SELECT *, (s - least(0, min(s) OVER (PARTITION BY case_key, segment_id ORDER BY ts)))::BIGINT AS criticality FROM st)"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return scada(spark, sf_dir).withColumn("row_id", F.row_number().over(Window.partitionBy("case_key").orderBy("ts")) - 1)


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.strict_segments(_numbered(spark, sf_dir), STEP)


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.temporal_folds(segmented(spark, sf_dir), 24)


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = Q.causal_median(segmented(spark, sf_dir), "click", 3)
    return Q.criticality_walk(smooth, F.col("smoothed") > 250, S.is_normal(F.col("status_type_id")))


def w1_strict_segments(spark, sf_dir):
    return segmented(spark, sf_dir).groupBy("case_key", "segment_id").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def w2_order_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("case_key"), "event_id", "ts")
    return Q.order_audit(e, "event_id", 60).withColumn("maximum_gap_minutes", F.round("maximum_gap_minutes", 6))


def w3_longest_zero_run(spark, sf_dir):
    rows = segmented(spark, sf_dir)
    from pyspark.sql import Window

    broken = F.col("segment_id") != F.lag("segment_id").over(Window.partitionBy("case_key").orderBy("ts"))
    return Q.longest_run(rows, F.col("error").isNull(), broken)


def w4_counter_rates(spark, sf_dir):
    from pyspark.sql import Window

    rows = segmented(spark, sf_dir).withColumn("counter", F.when(F.col("click").isNotNull(), F.sum(F.floor(F.coalesce("click", F.lit(0.0))) % 97 - 20).over(Window.partitionBy("case_key").orderBy("ts"))).cast("double"))
    return Q.counter_rate(rows, "counter").groupBy("case_key").agg(F.count("counter_rate").alias("rates"), F.sum("counter_rate").alias("total_rate"), F.max("counter_rate").alias("max_rate"))


def w5_temporal_folds(spark, sf_dir):
    return folded(spark, sf_dir).groupBy("case_key", "block_id", "fold_id").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"))


def w6_embargo(spark, sf_dir):
    return Q.embargo(folded(spark, sf_dir), 1, 6).groupBy("case_key", "fold_id").agg(F.count_if("embargoed").alias("embargoed_rows"))


def w7_fold_masks(spark, sf_dir):
    return Q.fold_masks(folded(spark, sf_dir), S.fit_mask(F.col("train_test"), F.col("status_type_id")), 5, 6, 20)


def w8_conformal_blocks(spark, sf_dir):
    return Q.complete_blocks(folded(spark, sf_dir).where("train_test = 'train'"), 8).groupBy("case_key", "continuity_id", "block_in_run").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("fold_id").alias("fold_id"))


def w9_continuity(spark, sf_dir):
    rows = folded(spark, sf_dir).where(S.fit_mask(F.col("train_test"), F.col("status_type_id")))
    return Q.complete_blocks(rows, 1).groupBy("case_key", "continuity_id").agg(F.count("*").alias("rows"))


def w10_rolling_median(spark, sf_dir):
    return Q.causal_median(segmented(spark, sf_dir), "click", 3).where("smoothed IS NOT NULL").select("case_key", "ts", F.round("smoothed", 5).alias("smoothed"))


def w11_criticality(spark, sf_dir):
    return walked(spark, sf_dir).select("case_key", "ts", "criticality")


def w12_first_crossing(spark, sf_dir):
    return Q.first_crossing(walked(spark, sf_dir), 2).withColumn("lead_hours", F.timestamp_diff("HOUR", F.col("first_alarm"), F.to_timestamp_ntz(F.lit("2024-01-30"))))


def w13_longest_alarm_run(spark, sf_dir):
    from pyspark.sql import Window

    rows = walked(spark, sf_dir)
    broken = F.col("segment_id") != F.lag("segment_id").over(Window.partitionBy("case_key").orderBy("ts"))
    return Q.longest_run(rows, (F.col("smoothed") > 250) & S.is_normal(F.col("status_type_id")), broken)


def w14_sampling_intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("case_key"), "ts")
    out = Q.sampling_intervals(e)
    return out.select("case_key", "intervals", *(F.round(c, 5).alias(c) for c in ("median_minutes", "p95_minutes", "max_minutes")))


def w15_window_index(spark, sf_dir):
    out = Q.window_index(segmented(spark, sf_dir), S.is_normal(F.col("status_type_id")), 12, 5, 3, 2, 3)
    return out.select(*(F.round(c, 6).alias(c) if c.endswith("fraction") else c for c in out.columns))


def w20_signal_segments(spark, sf_dir):
    """Non-overlapping pieces of 16 samples of every vector, the tail dropped."""
    v = table(spark, sf_dir, "embeddings")
    starts = F.filter(F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(16)), lambda s: s + 16 <= F.size("embedding"))
    pieces = v.select("vec_id", "embedding", F.posexplode(starts).alias("segment_index", "start_sample"))
    return pieces.select("vec_id", "segment_index", "start_sample", F.round(F.aggregate(F.slice("embedding", F.col("start_sample") + 1, 16), F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def w23_past_means(spark, sf_dir):
    out = Q.past_mean(scada(spark, sf_dir), "click", (6, 36))
    return out.select("case_key", "ts", F.round(F.col("click_mean_6") + 1e-9, 5).alias("click_mean_6"), F.round(F.col("click_mean_36") + 1e-9, 5).alias("click_mean_36"))


def entry_alarms(spark: SparkSession, sf_dir: str, slot: str = "hour") -> DataFrame:
    """Flagship: segments, smoothed channel, alarms, criticality, event alarm per case."""
    return Q.first_crossing(walked(spark, sf_dir), 2)


QUERIES = {
    "w1_strict_segments": (w1_strict_segments, f"WITH {SEGMENTS_SQL} SELECT case_key, segment_id, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM seg GROUP BY ALL"),
    "w2_order_audit": (w2_order_audit, """WITH e AS (SELECT user_id % 50 AS case_key, ts, date_diff('second', lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY event_id), ts) AS whole, ts - lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i FROM events),
      d AS (SELECT case_key, ts, trunc(epoch(i)) / 60.0 AS d FROM e)
      SELECT case_key, count(*) AS rows, count(*) FILTER (ts IS NULL) AS missing_timestamps, count(*) FILTER (d = 0) AS duplicate_timestamps, count(*) FILTER (d < 0) AS nonmonotonic_timestamps,
        count(*) FILTER (d > 60) AS gap_count, round(max(d), 6) AS maximum_gap_minutes, count(*) FILTER (d > 60) + 1 AS continuous_segments FROM d GROUP BY 1"""),
    "w3_longest_zero_run": (w3_longest_zero_run, f"""WITH {SEGMENTS_SQL}, c AS (SELECT *, sum(CASE WHEN error IS NOT NULL OR segment_id <> lag_s THEN 1 ELSE 0 END) OVER (PARTITION BY case_key ORDER BY ts) AS run
        FROM (SELECT *, lag(segment_id) OVER (PARTITION BY case_key ORDER BY ts) AS lag_s FROM seg)),
      n AS (SELECT case_key, run, count(*) AS n FROM c WHERE error IS NULL GROUP BY ALL)
      SELECT s.case_key, coalesce(max(n), 0) AS longest_run FROM (SELECT DISTINCT case_key FROM seg) s LEFT JOIN n USING (case_key) GROUP BY 1"""),
    "w4_counter_rates": (w4_counter_rates, f"""WITH {SEGMENTS_SQL}, c AS (SELECT *, CASE WHEN click IS NOT NULL THEN sum(floor(coalesce(click, 0)) % 97 - 20) OVER (PARTITION BY case_key ORDER BY ts) END AS counter FROM seg),
      d AS (SELECT *, CASE WHEN segment_id = lag(segment_id) OVER w AND counter - lag(counter) OVER w >= 0 THEN counter - lag(counter) OVER w END AS r FROM c WINDOW w AS (PARTITION BY case_key ORDER BY ts))
      SELECT case_key, count(r) AS rates, sum(r) AS total_rate, max(r) AS max_rate FROM d GROUP BY 1"""),
    "w5_temporal_folds": (w5_temporal_folds, f"WITH {FOLDS_SQL} SELECT case_key, block_id, fold_id, count(*) AS rows, min(ts) AS first_ts FROM folds GROUP BY ALL"),
    "w6_embargo": (w6_embargo, f"""WITH {FOLDS_SQL}, e AS (SELECT *, max((fold_id = 1)::INT) OVER (PARTITION BY case_key, segment_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM folds)
      SELECT case_key, fold_id, count(*) FILTER (m = 1) AS embargoed_rows FROM e GROUP BY ALL"""),
    "w7_fold_masks": (w7_fold_masks, f"""WITH {FOLDS_SQL}, x AS (SELECT f.*, k.k AS fold, max((fold_id = k.k)::INT) OVER (PARTITION BY case_key, segment_id, k.k ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m,
        (train_test = 'train' AND status_type_id IN (0, 2)) AS fit FROM folds f, (SELECT unnest([0,1,2,3,4]) AS k) k),
      y AS (SELECT case_key, fold, count(*) FILTER (fit AND fold_id <> fold AND m = 0) AS train_rows, count(*) FILTER (fit AND fold_id = fold) AS validation_rows FROM x GROUP BY ALL)
      SELECT *, train_rows >= 20 AND validation_rows >= 20 AS usable FROM y"""),
    "w8_conformal_blocks": (w8_conformal_blocks, f"""WITH {FOLDS_SQL}, b AS (SELECT *, CASE WHEN row_id - lag(row_id) OVER w = 1 AND segment_id = lag(segment_id) OVER w AND fold_id = lag(fold_id) OVER w THEN 0 ELSE 1 END AS b FROM folds WHERE train_test = 'train' WINDOW w AS (PARTITION BY case_key ORDER BY ts)),
      c AS (SELECT *, sum(b) OVER (PARTITION BY case_key ORDER BY ts) AS continuity_id FROM b),
      n AS (SELECT *, (row_number() OVER (PARTITION BY case_key, continuity_id ORDER BY ts) - 1) // 8 AS block_in_run, count(*) OVER (PARTITION BY case_key, continuity_id) AS s FROM c)
      SELECT case_key, continuity_id, block_in_run, count(*) AS rows, min(ts) AS first_ts, max(fold_id) AS fold_id FROM n WHERE (block_in_run + 1) * 8 <= s GROUP BY 1, 2, 3"""),
    "w9_continuity": (w9_continuity, f"""WITH {FOLDS_SQL}, b AS (SELECT *, CASE WHEN row_id - lag(row_id) OVER w = 1 AND segment_id = lag(segment_id) OVER w AND fold_id = lag(fold_id) OVER w THEN 0 ELSE 1 END AS b FROM folds WHERE train_test = 'train' AND status_type_id IN (0, 2) WINDOW w AS (PARTITION BY case_key ORDER BY ts)),
      c AS (SELECT *, sum(b) OVER (PARTITION BY case_key ORDER BY ts) AS continuity_id FROM b) SELECT case_key, continuity_id, count(*) AS rows FROM c GROUP BY ALL"""),
    "w10_rolling_median": (w10_rolling_median, f"WITH {WALK_SQL} SELECT case_key, ts, round(smoothed, 5) AS smoothed FROM sm WHERE smoothed IS NOT NULL"),
    "w11_criticality": (w11_criticality, f"WITH {WALK_SQL} SELECT case_key, ts, criticality FROM walk"),
    "w12_first_crossing": (w12_first_crossing, f"""WITH {WALK_SQL}, a AS (SELECT case_key, min(ts) FILTER (criticality >= 2) AS first_alarm, max(criticality) AS maximum_criticality, coalesce(bool_or(criticality >= 2), false) AS event_alarm FROM walk GROUP BY 1)
      SELECT *, (epoch(TIMESTAMP '2024-01-30' - first_alarm) // 3600)::BIGINT AS lead_hours FROM a"""),
    "w13_longest_alarm_run": (w13_longest_alarm_run, f"""WITH {WALK_SQL}, f AS (SELECT *, coalesce(smoothed > 250, false) AND status_type_id IN (0, 2) AS f, lag(segment_id) OVER (PARTITION BY case_key ORDER BY ts) AS lag_s FROM walk),
      c AS (SELECT *, sum(CASE WHEN NOT f OR segment_id <> lag_s THEN 1 ELSE 0 END) OVER (PARTITION BY case_key ORDER BY ts) AS run FROM f),
      n AS (SELECT case_key, run, count(*) AS n FROM c WHERE f GROUP BY ALL)
      SELECT s.case_key, coalesce(max(n), 0) AS longest_run FROM (SELECT DISTINCT case_key FROM seg) s LEFT JOIN n USING (case_key) GROUP BY 1"""),
    "w14_sampling_intervals": (w14_sampling_intervals, """WITH d AS (SELECT event_type AS case_key, trunc(epoch(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts))) / 60.0 AS d FROM events)
      SELECT case_key, count(*) AS intervals, round(quantile_cont(d, 0.5), 5) AS median_minutes, round(quantile_cont(d, 0.95), 5) AS p95_minutes, round(max(d), 5) AS max_minutes FROM d WHERE d > 0 AND d <= 1440 GROUP BY 1"""),
    "w15_window_index": (w15_window_index, f"""WITH {SEGMENTS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY case_key, segment_id ORDER BY ts) - 1 AS pos, (status_type_id IN (0, 2))::INT AS e FROM seg),
      q AS (SELECT *, sum(e) OVER (PARTITION BY case_key, segment_id ORDER BY ts ROWS 11 PRECEDING) AS se, sum(e) OVER (PARTITION BY case_key, segment_id, pos % 3 ORDER BY ts ROWS 4 PRECEDING) AS le, lead(e, 2) OVER (PARTITION BY case_key, segment_id ORDER BY ts) AS te FROM p)
      SELECT case_key, segment_id, pos AS anchor_pos, pos - 11 AS short_start, pos - 12 AS long_start, pos + 2 AS target_pos, round(se / 12, 6) AS short_fraction, round(le / 5, 6) AS long_fraction, te = 1 AS target_eligible
      FROM q WHERE pos >= 12 AND (pos - 12) % 3 = 0 AND te IS NOT NULL"""),
    "w20_signal_segments": (w20_signal_segments, """SELECT vec_id, (s // 16)::INT AS segment_index, s AS start_sample, round(list_sum(list_transform(embedding[s + 1 : s + 16], lambda x: x::DOUBLE)), 5) AS total
      FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) - 15, 16)) AS s FROM embeddings)"""),
    "w23_past_means": (w23_past_means, f"""WITH {SCADA_SQL} SELECT case_key, ts, round(avg(click) OVER (PARTITION BY case_key ORDER BY ts ROWS 5 PRECEDING) + 1e-9, 5) AS click_mean_6, round(avg(click) OVER (PARTITION BY case_key ORDER BY ts ROWS 35 PRECEDING) + 1e-9, 5) AS click_mean_36 FROM scada"""),
    "entry_alarms": (entry_alarms, f"WITH {WALK_SQL} SELECT case_key, min(ts) FILTER (criticality >= 2) AS first_alarm, max(criticality) AS maximum_criticality, coalesce(bool_or(criticality >= 2), false) AS event_alarm FROM walk GROUP BY 1"),
}
