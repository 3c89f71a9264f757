"""Queries of the conformal calibration of cases and of the health evidence over a grid of configurations.

The panel comes from the event stream: assets are users modulo 6, slots last four hours; a channel's y is the sum of an
event type's values in a slot and its x the number of those events. Cases of even assets are anomalies, with an event
of three days in their prediction period. SQL repeats the whole chain.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import conformal as C
from helmwatch.operators import health as H
from helmwatch.operators import sequence as Q
from helmwatch.sources.files import kept
from helmwatch.sources.tables import CHANNELS, TRAIN_END, table

N = len(CHANNELS)
GRID = H.Grid(coverages=(0.8, 0.9, 0.95), r2=(0.0, 0.1, 0.3), heads=(("all_modellable", (0, 1, 2, 3, 4)), ("some_modellable", (0, 1, 4))), windows=(2, 3, 4), quantiles=(0.8, 0.9, 0.95, 0.98))
FOLDS, BLOCK, MIN_BLOCKS, MIN_OBSERVED, CRITICALITY = 5, 4, 6, 3, 3


def panel(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    asset = F.col("user_id") % 6
    farm = F.element_at(F.array(*map(F.lit, "ABC")), (F.col("user_id") % 3 + 1).cast("int"))
    slot = F.expr("timestampadd(HOUR, hour(ts) div 4 * 4, date_trunc('day', ts))").cast("timestamp_ntz")
    of = lambda c: F.col("event_type") == c
    share = F.count_if(of("error")) / F.count("*")
    slots = events.groupBy(F.concat(F.lit("Wind Farm "), farm, F.lit("/"), asset).alias("case_key"), slot.alias("ts")).agg(
        F.when(share >= 0.4, 3).when(share >= 0.3, 2).otherwise(0).alias("status_type_id"), F.array(*(F.round(F.sum(F.when(of(c), F.col("value"))), 6) for c in CHANNELS)).alias("y"), F.array(*(F.nullif(F.count_if(of(c)), F.lit(0)).cast("double") for c in CHANNELS)).alias("x")
    )
    slots = slots.withColumn("train_test", F.when(F.col("ts") < F.to_timestamp_ntz(F.lit(TRAIN_END)), "train").otherwise("prediction"))
    rows = slots.withColumn("row_id", F.row_number().over(Window.partitionBy("case_key").orderBy("ts")) - 1)
    rows = Q.temporal_folds(Q.strict_segments(rows, 240), 12, FOLDS).drop("block_id")
    return rows.withColumn("fit", S.fit_mask(F.col("train_test"), F.col("status_type_id")))


def outcomes(rows: DataFrame) -> DataFrame:
    start = F.min(F.when(F.col("train_test") == "prediction", F.col("ts"))) + F.expr("INTERVAL 2 DAYS")
    out = rows.groupBy("case_key").agg(start.alias("event_start")).withColumn("asset_id", F.substring_index("case_key", "/", -1))
    return out.select("case_key", "asset_id", (F.col("asset_id").cast("int") % 2 == 0).alias("is_anomaly"), "event_start", (F.col("event_start") + F.expr("INTERVAL 3 DAYS")).alias("event_end"))


class Chain:
    """The panel and what is fitted on it, each step written once: models and case arrays (one row a case), fit rows,
    states (one row a case and channel), thresholds."""

    def __init__(self, spark, sf_dir):
        self.rows = kept(panel(spark, sf_dir), "panel")
        self.models = kept(C.crossfit_lines(self.rows, N, FOLDS), "mean-models")
        self.fit = kept(C.residuals(C.mark_blocks(self.rows, BLOCK), self.models, True), "fit-rows")
        self.states = kept(C.fit_case_conformal(self.fit, GRID.coverages, FOLDS, MIN_BLOCKS, MIN_OBSERVED), "conformal-states")

    @cached_property
    def cases(self) -> DataFrame:
        arrays = C.case_arrays(self.states, N, len(GRID.coverages), FOLDS).join(self.models.select("case_key", "r2", "target_scale"), "case_key")
        arrays = kept(arrays, "case-arrays")
        return kept(arrays.join(H.family_weights(arrays, GRID), "case_key"), "weighted-cases")

    @cached_property
    def thresholds(self) -> DataFrame:
        smooth = H.smooth_families(H.raw_health(self.fit, self.cases, GRID, True), GRID.windows, ("case_key", "run"))
        return kept(H.fit_thresholds(kept(smooth, "fit-health"), GRID, MIN_OBSERVED, MIN_BLOCKS), "thresholds")

    @cached_property
    def candidates(self) -> DataFrame:
        """Prediction rows with health, alarms and interval scores; smoothing runs over all of a case's rows."""
        raw = H.raw_health(C.residuals(self.rows, self.models, False), self.cases, GRID, False)
        smooth = H.smooth_families(raw, GRID.windows, ("case_key", "segment_id")).where("train_test = 'prediction'")
        return kept(H.candidates(smooth, self.cases, self.thresholds, GRID), "candidates")

    @cached_property
    def metrics(self) -> DataFrame:
        return kept(H.case_metrics(self.candidates, outcomes(self.rows), GRID, CRITICALITY), "case-metrics")

    @cached_property
    def selected(self) -> DataFrame:
        inner = outcomes(self.rows).select("asset_id", F.floor(F.col("asset_id").cast("int") / 2).alias("inner_fold"))
        universal = H.availability(self.thresholds).where("universal").select("configuration_id")
        metrics = self.metrics.join(universal, "configuration_id", "left_semi")
        return kept(H.nested_selection(metrics, H.configurations(self.rows.sparkSession, GRID), inner), "selected")


def _rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*(c if c in keep or df.schema[c].dataType.typeName() != "double" else F.round(c, digits).alias(c) for c in df.columns))


def ml4_lines(spark, sf_dir):
    m = C.crossfit_lines(panel(spark, sf_dir), N, FOLDS)
    long = m.select("case_key", F.posexplode(F.arrays_zip("slope", "intercept", "r2", "sd", "target_scale")).alias("channel", "m")).where("m.slope IS NOT NULL")
    return _rounded(long.select("case_key", "channel", "m.*"))


def ml21_conformal(spark, sf_dir):
    """Both heads' states, a row a case, channel, head and coverage."""
    s = Chain(spark, sf_dir).states
    heads = s.select("case_key", "channel", F.explode(F.array(F.struct(F.lit("total").alias("head"), F.col("total").alias("s")), F.struct(F.lit("aleatoric").alias("head"), F.col("aleatoric").alias("s")))).alias("h")).select("case_key", "channel", "h.*")
    names = ("quantiles", "coverage", "simultaneous", "lobo")
    long = heads.select("case_key", "channel", "head", "s.blocks", C.valid_state(F.col("s.quantiles")).alias("valid"), F.posexplode(F.arrays_zip(*(F.col(f"s.{n}").alias(n) for n in names))).alias("level", "v"))
    return _rounded(long.select("case_key", "channel", "head", "blocks", "valid", "level", *(F.col(f"v.{n}").alias(n) for n in names)))


def ml24_folds(spark, sf_dir):
    s = Chain(spark, sf_dir).states.select("case_key", "channel", "total.*")
    folds = s.select("case_key", "channel", F.posexplode(F.arrays_zip("fold_quantiles", "fold_heldout", "fold_coverage")).alias("fold", "f"))
    long = folds.select("case_key", "channel", "fold", F.posexplode(F.arrays_zip(F.col("f.fold_quantiles").alias("quantile"), F.col("f.fold_heldout").alias("heldout"), F.col("f.fold_coverage").alias("pooled"))).alias("level", "v"))
    return _rounded(long.select("case_key", "channel", "fold", "level", "v.*"))


def ml22_score(spark, sf_dir):
    """Stored states applied to the prediction rows."""
    c = Chain(spark, sf_dir)
    rows = C.residuals(c.rows.where("train_test = 'prediction'"), c.models, False)
    return _rounded(C.score_case_conformal(rows, c.cases, GRID.coverages))


def ml25_weights(spark, sf_dir):
    """Reliability weights of all families, from the models' held-out r2 and the held-out coverages' error."""
    w = Chain(spark, sf_dir).cases.select("case_key", F.posexplode("weights").alias("family", "w"))
    return _rounded(w.select("case_key", "family", F.posexplode("w").alias("channel", "weight")))


def ml29_thresholds(spark, sf_dir):
    t = Chain(spark, sf_dir).thresholds
    long = t.select("case_key", F.posexplode(F.arrays_zip("thresholds", "blocks", "timestamps")).alias("configuration_id", "t"))
    return long.select("case_key", "configuration_id", F.round("t.thresholds", 6).alias("threshold"), "t.blocks", "t.timestamps")


def ag38_universal(spark, sf_dir):
    return H.availability(Chain(spark, sf_dir).thresholds).join(H.configurations(spark, GRID), "configuration_id")


def ml29_families(spark, sf_dir):
    return H.family_available(Chain(spark, sf_dir).thresholds, GRID)


def ml30_alarms(spark, sf_dir):
    """Alarms of every configuration a day."""
    rows = Chain(spark, sf_dir).candidates.select("case_key", F.to_date("ts").alias("day"), F.posexplode("alarms").alias("configuration_id", "alarm"))
    return rows.groupBy("case_key", "day", "configuration_id").agg(F.count_if("alarm").alias("alarms"), F.count("alarm").alias("slots")).where("slots > 0")


def ml31_matrix(spark, sf_dir):
    z = F.arrays_zip("health", "observed", "width", "covered", "interval_score")
    return _rounded(Chain(spark, sf_dir).candidates.select("case_key", "ts", F.posexplode(z).alias("family", "z")).select("case_key", "ts", "family", "z.*"))


def ml33_metrics(spark, sf_dir):
    m = Chain(spark, sf_dir).metrics
    doubles = [f.name for f in m.schema if f.dataType.typeName() == "double"]
    return _rounded(m.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in doubles}))


def ml35_selection(spark, sf_dir):
    return _rounded(Chain(spark, sf_dir).selected, "coverage", "minimum_r2", "threshold_quantile")


def ml36_freeze(spark, sf_dir):
    c = Chain(spark, sf_dir)
    return _rounded(H.freeze(c.candidates, outcomes(c.rows), c.selected, c.thresholds, GRID))


def _axis(values) -> str:
    return ", ".join(f"({i}, {v!r}::DOUBLE)" if isinstance(v, float) else f"({i}, {v!r})" for i, v in enumerate(values))


_CH = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CHANNELS))
_HEADS = ", ".join(f"({h}, {c})" for h, (_, members) in enumerate(GRID.heads) for c in members)
PANEL_SQL = f"""ch(channel, event_type) AS (VALUES {_CH}), cov(level, coverage) AS (VALUES {_axis(GRID.coverages)}), kk(k) AS (VALUES {", ".join(f"({k})" for k in range(FOLDS))}),
 ev AS (SELECT 'Wind Farm ' || ['A','B','C'][user_id % 3 + 1] || '/' || (user_id % 6) AS case_key, time_bucket(INTERVAL 4 HOUR, ts)::TIMESTAMP AS ts, event_type, value FROM events),
 slots AS (SELECT case_key, ts, CASE WHEN count(*) FILTER (event_type = 'error') / count(*) >= 0.4::DOUBLE THEN 3 WHEN count(*) FILTER (event_type = 'error') / count(*) >= 0.3::DOUBLE THEN 2 ELSE 0 END AS status,
   CASE WHEN ts < TIMESTAMP '{TRAIN_END}' THEN 'train' ELSE 'prediction' END AS train_test, row_number() OVER (PARTITION BY case_key ORDER BY ts) - 1 AS row_id FROM ev GROUP BY case_key, ts),
 sg AS (SELECT *, sum(b) OVER (PARTITION BY case_key ORDER BY ts) - 1 AS segment_id FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY case_key ORDER BY ts) = INTERVAL 4 HOUR THEN 0 ELSE 1 END AS b FROM slots)),
 fk AS (SELECT *, (row_number() OVER (PARTITION BY case_key, segment_id ORDER BY ts) - 1) // 12 AS kk FROM sg),
 pan AS (SELECT * EXCLUDE (b, kk), (dense_rank() OVER (PARTITION BY case_key ORDER BY segment_id, kk) - 1) % {FOLDS} AS fold, train_test = 'train' AND status IN (0, 2) AS fit FROM fk),
 cells AS (SELECT case_key, ts, channel, round(sum(value), 6) AS y, count(*)::DOUBLE AS x FROM ev JOIN ch USING (event_type) GROUP BY ALL),
 lng AS (SELECT p.*, c.channel, c.y, c.x FROM pan p JOIN cells c USING (case_key, ts)),
 fs AS (SELECT case_key, channel, fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM lng WHERE fit GROUP BY ALL),
 ft AS (SELECT case_key, channel, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM fs GROUP BY ALL),
 fr AS (SELECT f.*, t.n - f.n AS rn, t.sx - f.sx AS rx, t.sy - f.sy AS ry, t.sxx - f.sxx AS rxx, t.sxy - f.sxy AS rxy FROM fs f JOIN ft t USING (case_key, channel)),
 fl AS (SELECT *, (rxy - rx * ry / rn) / (rxx - rx * rx / rn + 1) AS b, ry / rn - (rxy - rx * ry / rn) / (rxx - rx * rx / rn + 1) * rx / rn AS a, ry / rn AS m FROM fr WHERE rn > 0),
 se AS (SELECT case_key, channel, sum(syy - 2*a*sy - 2*b*sxy + n*a*a + 2*a*b*sx + b*b*sxx) AS sse, sum(syy - 2*m*sy + n*m*m) AS base FROM fl GROUP BY ALL),
 iq AS (SELECT case_key, channel, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM lng WHERE fit GROUP BY ALL),
 mod AS (SELECT case_key, channel, (sxy - sx*sy/n) / (sxx - sx*sx/n + 1) AS slope, sy/n - (sxy - sx*sy/n) / (sxx - sx*sx/n + 1) * sx/n AS intercept, sx/n AS mx, sxx - sx*sx/n + 1 AS cxx, n, sqrt(greatest(sse, 0) / n) AS sd,
   CASE WHEN base > 1e-12 THEN 1 - sse / base END AS r2, CASE WHEN iqr > 1e-12 THEN iqr ELSE 1 END AS target_scale FROM ft JOIN se USING (case_key, channel) JOIN iq USING (case_key, channel))"""
FIT_SQL = f"""{PANEL_SQL},
 bm AS (SELECT *, sum(b) OVER (PARTITION BY case_key ORDER BY ts) AS run FROM (SELECT *, CASE WHEN row_id - lag(row_id) OVER w = 1 AND segment_id = lag(segment_id) OVER w AND fold = lag(fold) OVER w THEN 0 ELSE 1 END AS b FROM pan WHERE fit WINDOW w AS (PARTITION BY case_key ORDER BY ts))),
 bl AS (SELECT * EXCLUDE (k, s), CASE WHEN (k + 1) * {BLOCK} <= s THEN run || '/' || k END AS block FROM (SELECT *, (row_number() OVER (PARTITION BY case_key, run ORDER BY ts) - 1) // {BLOCK} AS k, count(*) OVER (PARTITION BY case_key, run) AS s FROM bm)),
 fitr AS (SELECT bl.case_key, bl.ts, bl.fold, bl.run, bl.block, l.channel, l.y - fl.a - fl.b * l.x AS residual, sd * sqrt(1 + greatest(1 / mod.n + (l.x - mx) * (l.x - mx) / cxx, 0)) AS scale, sd AS aleatoric
   FROM bl JOIN lng l ON l.case_key = bl.case_key AND l.ts = bl.ts JOIN fl ON fl.case_key = bl.case_key AND fl.channel = l.channel AND fl.fold = bl.fold JOIN mod ON mod.case_key = bl.case_key AND mod.channel = l.channel),
 sc AS (SELECT case_key, channel, fold, block, h.head, CASE WHEN CASE h.head WHEN 'total' THEN scale ELSE aleatoric END > 0 THEN abs(residual) / CASE h.head WHEN 'total' THEN scale ELSE aleatoric END END AS score FROM fitr, (VALUES ('total'), ('aleatoric')) h(head) WHERE block IS NOT NULL),
 us AS (SELECT * FROM sc WHERE score IS NOT NULL QUALIFY count(*) OVER (PARTITION BY case_key, channel, head, block) >= {MIN_OBSERVED}),
 bk AS (SELECT case_key, channel, head, block, fold, max(score) AS maximum FROM us GROUP BY ALL),
 nb AS (SELECT case_key, channel, head, k, count(*) FILTER (fold <> k) AS b FROM bk, (SELECT k FROM kk UNION ALL SELECT -1) GROUP BY ALL),
 rk AS (SELECT us.case_key, us.channel, us.head, k, score, row_number() OVER w AS rn, count(*) OVER (PARTITION BY us.case_key, us.channel, us.head, k) AS n FROM us, (SELECT k FROM kk UNION ALL SELECT -1) WHERE fold <> k WINDOW w AS (PARTITION BY us.case_key, us.channel, us.head, k ORDER BY score)),
 qs AS (SELECT case_key, channel, head, k, level, b, max(score) FILTER (rn = ceil(greatest(1, least(ceil((b + 1) * coverage), b)) / b * (n - 1)) + 1 AND b >= {MIN_BLOCKS}) AS q FROM rk JOIN nb USING (case_key, channel, head, k), cov GROUP BY ALL),
 sh AS (SELECT us.case_key, us.channel, us.head, us.block, us.fold, p.level, avg((score <= p.q)::INT) AS pooled, avg((score <= h.q)::INT) AS held FROM us JOIN qs p ON p.case_key = us.case_key AND p.channel = us.channel AND p.head = us.head AND p.k = -1 LEFT JOIN qs h ON h.case_key = us.case_key AND h.channel = us.channel AND h.head = us.head AND h.k = us.fold AND h.level = p.level GROUP BY ALL),
 mxr AS (SELECT *, row_number() OVER (PARTITION BY case_key, channel, head ORDER BY maximum) AS rn, count(*) OVER (PARTITION BY case_key, channel, head) AS n FROM bk),
 sim AS (SELECT case_key, channel, head, level, n, max(maximum) FILTER (rn = greatest(1, least(ceil((n + 1) * coverage), n)) AND n >= {MIN_BLOCKS}) AS simultaneous, max(maximum) FILTER (rn = greatest(1, least(ceil(n * coverage), n - 1))) AS own, max(maximum) FILTER (rn = greatest(1, least(ceil(n * coverage), n - 1)) + 1) AS nxt, any_value(greatest(1, least(ceil(n * coverage), n - 1))) AS r FROM mxr, cov GROUP BY ALL),
 lob AS (SELECT m.case_key, m.channel, m.head, level, CASE WHEN any_value(m.n) >= {MIN_BLOCKS} THEN avg((maximum <= CASE WHEN rn <= r THEN nxt ELSE own END)::INT) END AS lobo FROM mxr m JOIN sim USING (case_key, channel, head) GROUP BY ALL)"""
WEIGHT_SQL = f"""{FIT_SQL},
 r2s(ri, least) AS (VALUES {_axis(GRID.r2)}), hd(hi, channel) AS (VALUES {_HEADS}), heads(hi) AS (VALUES {", ".join(f"({h})" for h in range(len(GRID.heads)))}),
 hs AS (SELECT case_key, channel, fold, level, avg(held) AS held FROM sh WHERE head = 'total' GROUP BY ALL),
 er AS (SELECT case_key, channel, level, sqrt(avg((held - coverage) ** 2)) AS rmse FROM hs JOIN cov USING (level) WHERE held IS NOT NULL GROUP BY ALL),
 ok AS (SELECT m.case_key, m.channel, m.r2, coalesce((SELECT count(*) FILTER (q IS NULL OR (q <= 0 AND k >= 0)) = 0 AND count(*) = {(FOLDS + 1) * len(GRID.coverages)} FROM qs WHERE qs.case_key = m.case_key AND qs.channel = m.channel AND head = 'total'), false) AS sane FROM mod m),
 fam AS (SELECT level * {GRID.per_coverage} + ri * {len(GRID.heads)} + hi AS family, level, coverage, least, hi FROM cov, r2s, heads),
 al AS (SELECT f.family, f.level, k.case_key, k.channel, coalesce(sane AND r2 >= least AND hd.channel IS NOT NULL, false) AS allowed, greatest(0, least(1, r2)) * coalesce(exp(-rmse / (1 - coverage)), 0) AS quality FROM fam f CROSS JOIN ok k LEFT JOIN hd ON hd.hi = f.hi AND hd.channel = k.channel LEFT JOIN er ON er.case_key = k.case_key AND er.channel = k.channel AND er.level = f.level),
 aw AS (SELECT *, CASE WHEN allowed THEN coalesce(quality, 0) ELSE 0 END AS raw, sum(CASE WHEN allowed THEN coalesce(quality, 0) ELSE 0 END) OVER (PARTITION BY case_key, family) AS total FROM al),
 ac AS (SELECT *, CASE WHEN total > 1e-12 THEN raw ELSE allowed::INT END AS chosen FROM aw),
 wt AS (SELECT case_key, family, level, channel, CASE WHEN sum(chosen) OVER (PARTITION BY case_key, family) > 1e-12 THEN chosen / sum(chosen) OVER (PARTITION BY case_key, family) ELSE 0 END AS weight FROM ac)"""
_health = lambda src, q, extra: f"SELECT e.case_key, e.ts, w.family{extra}, sum(weight) AS observed, CASE WHEN sum(weight) >= 0.7 - 1e-12 THEN sum(weight * greatest(abs(residual) / (scale * q) - 1, 0)) / sum(weight) END AS health FROM {src} e JOIN wt w ON w.case_key = e.case_key AND w.channel = e.channel AND weight > 0 JOIN qs ON qs.case_key = e.case_key AND qs.channel = e.channel AND qs.level = w.level AND head = 'total' AND k = {q} WHERE scale * q > 0 GROUP BY ALL"
_smooth = lambda src, run: " UNION ALL ".join(f"SELECT *, {i} AS w, CASE WHEN count(health) OVER (PARTITION BY case_key, family, {run} ORDER BY ts ROWS {w - 1} PRECEDING) = {w} THEN quantile_cont(health, 0.5) OVER (PARTITION BY case_key, family, {run} ORDER BY ts ROWS {w - 1} PRECEDING) END AS smoothed FROM {src}" for i, w in enumerate(GRID.windows))
THRESHOLD_SQL = f"""{WEIGHT_SQL}, tq(qi, p) AS (VALUES {_axis(GRID.quantiles)}),
 fh AS ({_health("fitr", "e.fold", "")}),
 fa AS (SELECT bl.case_key, bl.ts, bl.run, bl.block, f.family, fh.health FROM bl CROSS JOIN fam f LEFT JOIN fh ON fh.case_key = bl.case_key AND fh.ts = bl.ts AND fh.family = f.family),
 fsm AS ({_smooth("fa", "run")}),
 fb AS (SELECT *, count(*) OVER (PARTITION BY case_key, family, w, block) AS n FROM fsm WHERE block IS NOT NULL AND smoothed IS NOT NULL QUALIFY n >= {MIN_OBSERVED}),
 fc AS (SELECT *, sum(1.0::DOUBLE / n) OVER (PARTITION BY case_key, family, w ORDER BY smoothed) AS cum, sum(1.0::DOUBLE / n) OVER (PARTITION BY case_key, family, w) AS mass FROM fb),
 th AS (SELECT case_key, family, w, qi, (family * {len(GRID.windows)} + w) * {len(GRID.quantiles)} + qi AS configuration_id, min(smoothed) FILTER (cum >= p * mass - 1e-9) AS threshold, count(DISTINCT block) AS blocks, count(*) AS timestamps FROM fc, tq GROUP BY ALL HAVING count(DISTINCT block) >= {MIN_BLOCKS})"""
_THREE = f"cfg AS (SELECT c::INT AS configuration_id FROM range({GRID.size}) t(c)), cases AS (SELECT DISTINCT case_key FROM th)"
SCORE_SQL = f"""{THRESHOLD_SQL},
 fin AS (SELECT l.case_key, l.ts, l.segment_id, l.channel, l.y - intercept - slope * l.x AS residual, sd * sqrt(1 + greatest(1 / mod.n + (l.x - mx) * (l.x - mx) / cxx, 0)) AS scale, target_scale FROM lng l JOIN mod USING (case_key, channel)),
 ph AS ({_health("fin", "-1", "")}),
 pa AS (SELECT p.case_key, p.ts, p.segment_id, p.train_test, p.status, f.family, ph.health, coalesce(ph.observed, 0) AS observed FROM pan p CROSS JOIN fam f LEFT JOIN ph ON ph.case_key = p.case_key AND ph.ts = p.ts AND ph.family = f.family),
 psm AS ({_smooth("pa", "segment_id")}),
 cand AS (SELECT s.case_key, s.ts, s.segment_id, s.status, s.family, t.configuration_id, t.threshold, s.smoothed, coalesce(s.smoothed > t.threshold, false) AS alarm FROM psm s JOIN th t USING (case_key, family, w) WHERE train_test = 'prediction'),
 iv0 AS (SELECT e.case_key, e.ts, w.family, weight, 2 * scale * q / target_scale AS width, (abs(residual) / target_scale <= scale * q / target_scale)::INT AS covered, 2 * scale * q / target_scale + 2 / (1 - coverage) * greatest(abs(residual) / target_scale - scale * q / target_scale, 0) AS score
   FROM fin e JOIN wt w ON w.case_key = e.case_key AND w.channel = e.channel AND weight > 0 JOIN qs ON qs.case_key = e.case_key AND qs.channel = e.channel AND qs.level = w.level AND head = 'total' AND k = -1 JOIN cov ON cov.level = w.level WHERE q IS NOT NULL),
 ivl AS (SELECT case_key, ts, family, CASE WHEN sum(weight) >= 0.7 - 1e-12 THEN sum(width * weight) / sum(weight) END AS width, CASE WHEN sum(weight) >= 0.7 - 1e-12 THEN sum(covered * weight) / sum(weight) END AS covered, CASE WHEN sum(weight) >= 0.7 - 1e-12 THEN sum(score * weight) / sum(weight) END AS interval_score FROM iv0 GROUP BY ALL)"""
METRIC_SQL = f"""{SCORE_SQL},
 oc AS (SELECT case_key, split_part(case_key, '/', 2) AS asset_id, split_part(case_key, '/', 2)::INT % 2 = 0 AS is_anomaly, min(ts) FILTER (train_test = 'prediction') + INTERVAL 2 DAY AS s, min(ts) FILTER (train_test = 'prediction') + INTERVAL 5 DAY AS e FROM pan GROUP BY ALL),
 cr AS (SELECT c.*, o.asset_id, o.is_anomaly, s, e, is_anomaly AND c.ts BETWEEN s AND e AS truth, (c.case_key LIKE 'Wind Farm A/%' AND is_anomaly) OR status IN (0, 2) AS act, v.width, v.covered, v.interval_score FROM cand c JOIN oc o USING (case_key) LEFT JOIN ivl v ON v.case_key = c.case_key AND v.ts = c.ts AND v.family = c.family),
 ce AS (SELECT *, CASE WHEN truth THEN CASE WHEN epoch(ts - s) / epoch(e - s) <= 0.5 THEN 1.0::DOUBLE ELSE 2 * (1 - epoch(ts - s) / epoch(e - s)) END ELSE 0 END AS early FROM cr),
 wk AS (SELECT *, sum(CASE WHEN NOT act THEN 0 WHEN alarm THEN 1 ELSE -1 END) OVER (PARTITION BY case_key, configuration_id, segment_id ORDER BY ts) AS free FROM ce WHERE NOT is_anomaly OR ts <= e),
 wl AS (SELECT case_key, configuration_id, ts, free - least(0, min(free) OVER (PARTITION BY case_key, configuration_id, segment_id ORDER BY ts)) AS level FROM wk),
 wm AS (SELECT case_key, configuration_id, max(level)::BIGINT AS maximum_criticality, min(ts) FILTER (level >= {CRITICALITY}) AS first FROM wl GROUP BY ALL),
 ct AS (SELECT case_key, asset_id, configuration_id, is_anomaly, any_value(e) AS e, count(*) AS rows, count(*) FILTER (act) AS actionable_rows, count(*) FILTER (act AND NOT truth AND NOT alarm) AS tn, count(*) FILTER (act AND NOT truth AND alarm) AS fp, count(*) FILTER (act AND truth AND NOT alarm) AS fn, count(*) FILTER (act AND truth AND alarm) AS tp,
   sum(early) FILTER (alarm) / nullif(sum(early), 0) AS earliness, avg(width) FILTER (act) AS mean_width, avg(covered) FILTER (act) AS mean_covered, avg(interval_score) FILTER (act) AS mean_interval_score FROM ce GROUP BY case_key, asset_id, configuration_id, is_anomaly),
 met AS (SELECT ct.case_key, asset_id, ct.configuration_id, is_anomaly, rows, actionable_rows, tn, fp, fn, tp, (tn + tp) / (tn + fp + fn + tp) AS accuracy, CASE WHEN is_anomaly THEN CASE WHEN 1.25 * tp + 0.25 * fn + fp > 0 THEN 1.25::DOUBLE * tp / (1.25::DOUBLE * tp + 0.25::DOUBLE * fn + fp) ELSE 0 END END AS coverage_fbeta,
   CASE WHEN is_anomaly THEN coalesce(earliness, 0) END AS earliness, maximum_criticality, maximum_criticality >= {CRITICALITY} AS event_alarm, CASE WHEN is_anomaly THEN epoch(e - first) / 3600 END AS lead_hours, mean_width, mean_covered, mean_interval_score FROM ct JOIN wm USING (case_key, configuration_id))"""
_f = lambda a, n, t: f"CASE WHEN 1.25 * ({a}) + 0.25 * ({t} - ({a})) + ({n}) > 0 THEN 1.25::DOUBLE * ({a}) / (1.25::DOUBLE * ({a}) + 0.25::DOUBLE * ({t} - ({a})) + ({n})) ELSE 0 END"
_agg = f"""count(*) FILTER (is_anomaly) AS a, count(*) FILTER (NOT is_anomaly) AS n, avg(coverage_fbeta) FILTER (is_anomaly) AS f, avg(earliness) FILTER (is_anomaly) AS ws, avg(accuracy) FILTER (NOT is_anomaly) AS acc, count(*) FILTER (is_anomaly AND event_alarm) AS ta, count(*) FILTER (NOT is_anomaly AND event_alarm) AS na, avg(mean_width) FILTER (NOT is_anomaly) AS w"""
_care = f"CASE WHEN a > 0 AND n > 0 THEN CASE WHEN ta + na = 0 THEN 0 WHEN acc < 0.5 THEN acc ELSE (f + ws + {_f('ta', 'na', 'a')} + 2 * acc) / 5 END END"
SELECT_SQL = f"""{METRIC_SQL},
 uni AS (SELECT configuration_id FROM th GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT case_key) FROM th)),
 um AS (SELECT * FROM met WHERE configuration_id IN (FROM uni)), outer_assets AS (SELECT DISTINCT asset_id AS outer_asset FROM um),
 pooled AS (SELECT outer_asset, configuration_id, {_agg} FROM um, outer_assets WHERE asset_id <> outer_asset GROUP BY ALL),
 inn AS (SELECT outer_asset, configuration_id, {_care} AS care FROM (SELECT outer_asset, configuration_id, asset_id::INT // 2 AS fold, {_agg} FROM um, outer_assets WHERE asset_id <> outer_asset GROUP BY ALL)),
 ins AS (SELECT outer_asset, configuration_id, count(care) AS defined_inner_folds, avg(care) AS mean_inner_care, min(care) AS minimum_inner_care FROM inn GROUP BY ALL),
 names(configuration_id, coverage, minimum_r2, evidence_head, smoothing_steps, threshold_quantile) AS (VALUES {", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, '{h}', {w}, {q!r}::DOUBLE)" for i, a, b, h, w, q in GRID.rows())}),
 rated AS (SELECT outer_asset, p.configuration_id, {_care} AS care, acc AS normal_accuracy, {_f('ta', 'na', 'a')} AS event_reliability, w AS mean_width FROM pooled p),
 sel AS (SELECT r.outer_asset, r.configuration_id, care, normal_accuracy, event_reliability, mean_width, defined_inner_folds, mean_inner_care, minimum_inner_care, coverage, minimum_r2, evidence_head, smoothing_steps, threshold_quantile FROM rated r JOIN ins USING (outer_asset, configuration_id) JOIN names USING (configuration_id) WHERE care IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY r.outer_asset ORDER BY round(care, 12) DESC, round(normal_accuracy, 12) DESC, round(event_reliability, 12) DESC, round(mean_width, 9) NULLS LAST, coverage, minimum_r2, evidence_head, smoothing_steps, threshold_quantile, r.configuration_id) = 1)"""
_r = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)

QUERIES = {
    "ml4_ml6_crossfit_lines": (ml4_lines, f"WITH {PANEL_SQL} SELECT case_key, channel, {_r('slope', 'intercept', 'r2', 'sd', 'target_scale')} FROM mod"),
    "ml21_ml22_conformal_fit": (ml21_conformal, f"""WITH {FIT_SQL}, cv AS (SELECT case_key, channel, head, level, avg(pooled) AS coverage FROM sh GROUP BY ALL),
      va AS (SELECT case_key, channel, head, count(*) FILTER (q IS NULL OR q <= 0) = 0 AS valid FROM qs WHERE k = -1 GROUP BY ALL)
      SELECT p.case_key, p.channel, p.head, p.b AS blocks, valid, p.level, round(p.q, 6) AS quantiles, round(cv.coverage, 6) AS coverage, round(simultaneous, 6) AS simultaneous, round(lobo, 6) AS lobo
      FROM qs p JOIN cv USING (case_key, channel, head, level) JOIN sim USING (case_key, channel, head, level) JOIN lob USING (case_key, channel, head, level) JOIN va USING (case_key, channel, head) WHERE p.k = -1"""),
    "ml24_fold_multipliers": (ml24_folds, f"""WITH {FIT_SQL}, st AS (SELECT DISTINCT case_key, channel FROM us WHERE head = 'total'), hh AS (SELECT case_key, channel, fold, level, avg(held) AS heldout, avg(pooled) AS pooled FROM sh WHERE head = 'total' GROUP BY ALL)
      SELECT st.case_key, st.channel, kk.k AS fold, cov.level, round(q, 6) AS quantile, round(heldout, 6) AS heldout, round(pooled, 6) AS pooled FROM st CROSS JOIN kk CROSS JOIN cov LEFT JOIN qs ON qs.case_key = st.case_key AND qs.channel = st.channel AND head = 'total' AND qs.k = kk.k AND qs.level = cov.level
      LEFT JOIN hh ON hh.case_key = st.case_key AND hh.channel = st.channel AND hh.fold = kk.k AND hh.level = cov.level"""),
    "ml22_conformal_score": (ml22_score, f"""WITH {FIT_SQL}, fin AS (SELECT l.case_key, l.channel, l.y - intercept - slope * l.x AS residual, sd * sqrt(1 + greatest(1 / mod.n + (l.x - mx) * (l.x - mx) / cxx, 0)) AS scale FROM lng l JOIN mod USING (case_key, channel) WHERE train_test = 'prediction'),
      cc AS (SELECT DISTINCT case_key FROM us), gr AS (SELECT case_key, ch.channel, level, coverage FROM cc, ch, cov)
      SELECT g.case_key, g.channel, g.coverage, count(residual) FILTER (q IS NOT NULL) AS rows, round(avg((abs(residual) <= scale * q)::INT), 6) AS covered, round(avg(2 * scale * q), 6) AS mean_width FROM gr g LEFT JOIN qs ON qs.case_key = g.case_key AND qs.channel = g.channel AND qs.level = g.level AND head = 'total' AND k = -1 LEFT JOIN fin f ON f.case_key = g.case_key AND f.channel = g.channel GROUP BY ALL"""),
    "ml25_family_weights": (ml25_weights, f"WITH {WEIGHT_SQL}, cc AS (SELECT DISTINCT case_key FROM us) SELECT c.case_key, f.family, ch.channel, round(coalesce(weight, 0), 6) AS weight FROM cc c CROSS JOIN fam f CROSS JOIN ch LEFT JOIN wt ON wt.case_key = c.case_key AND wt.family = f.family AND wt.channel = ch.channel"),
    "ml28_ml29_threshold_cube": (ml29_thresholds, f"WITH {THRESHOLD_SQL}, {_THREE} SELECT c.case_key, g.configuration_id, round(threshold, 6) AS threshold, blocks, timestamps FROM cases c CROSS JOIN cfg g LEFT JOIN th ON th.case_key = c.case_key AND th.configuration_id = g.configuration_id"),
    "ml29_family_availability": (ml29_families, f"WITH {THRESHOLD_SQL}, {_THREE} SELECT c.case_key, coverage, count(threshold) AS available FROM cases c CROSS JOIN cov LEFT JOIN th ON th.case_key = c.case_key AND family = level * {GRID.per_coverage} GROUP BY ALL"),
    "ag38_universal_grid": (ag38_universal, f"""WITH {THRESHOLD_SQL}, {_THREE}, names(configuration_id, coverage, minimum_r2, evidence_head, smoothing_steps, threshold_quantile) AS (VALUES {", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, '{h}', {w}, {q!r}::DOUBLE)" for i, a, b, h, w, q in GRID.rows())}),
      av AS (SELECT g.configuration_id, count(threshold) AS available_cases, count(*) AS cases FROM cases c CROSS JOIN cfg g LEFT JOIN th ON th.case_key = c.case_key AND th.configuration_id = g.configuration_id GROUP BY 1) SELECT *, available_cases = cases AS universal FROM av JOIN names USING (configuration_id)"""),
    "ml30_config_alarms": (ml30_alarms, f"WITH {SCORE_SQL} SELECT case_key, ts::DATE AS day, configuration_id, count(*) FILTER (alarm) AS alarms, count(*) AS slots FROM cand GROUP BY ALL"),
    "ml31_candidate_matrix": (ml31_matrix, f"WITH {SCORE_SQL}, {_THREE} SELECT p.case_key, p.ts, p.family, round(health, 6) AS health, round(observed, 6) AS observed, {_r('width', 'covered', 'interval_score')} FROM pa p JOIN cases USING (case_key) LEFT JOIN ivl v ON v.case_key = p.case_key AND v.ts = p.ts AND v.family = p.family WHERE train_test = 'prediction'"),
    "ml33_case_metrics": (ml33_metrics, f"WITH {METRIC_SQL} SELECT * REPLACE ({_r('accuracy', 'coverage_fbeta', 'earliness', 'lead_hours', 'mean_width', 'mean_covered', 'mean_interval_score')}) FROM met"),
    "ml35_ag31_w18_selection": (ml35_selection, f"WITH {SELECT_SQL} SELECT * REPLACE ({_r('care', 'normal_accuracy', 'event_reliability', 'mean_width', 'mean_inner_care', 'minimum_inner_care')}) FROM sel"),
    "ml36_frozen_predictions": (ml36_freeze, f"WITH {SELECT_SQL} SELECT c.case_key, c.ts, c.configuration_id, round(threshold, 6) AS threshold, round(smoothed, 6) AS smoothed, alarm FROM cand c JOIN oc USING (case_key) JOIN sel ON sel.outer_asset = oc.asset_id AND sel.configuration_id = c.configuration_id"),
}
