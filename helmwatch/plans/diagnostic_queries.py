"""Queries of the audit of the calibrated chain's selected configurations, with their oracles. The limits fit the panel's
widths and scales, so that every branch is taken."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmwatch.operators import conformal as C
from helmwatch.operators import diagnostics as D
from helmwatch.plans import health_queries as q
from helmwatch.sources.files import kept

LIMITS = D.Limits(wide=2.0, extreme=2.9, tiny=100.0, very_tiny=90.0, widest=2)
STEP_MINUTES = 240


class Audit:
    """The audit's steps over a fitted chain; the rows and the cases of it are written once."""

    def __init__(self, chain: q.Chain):
        self.chain, self.outcomes = chain, q.outcomes(chain.rows)

    @cached_property
    def rows(self) -> DataFrame:
        return kept(D.selected_rows(self.chain.candidates, self.outcomes, self.chain.selected, q.GRID), "selected-rows")

    @cached_property
    def cases(self) -> DataFrame:
        return kept(D.case_diagnostics(self.rows, self.chain.metrics, self.chain.selected, STEP_MINUTES, LIMITS), "case-diagnostics")

    @cached_property
    def targets(self) -> DataFrame:
        rows = C.residuals(self.chain.rows.where("train_test = 'prediction'"), self.chain.models, False)
        return kept(D.target_decomposition(rows, self.chain.cases, self.cases, q.GRID, LIMITS), "target-widths")


def _audit(spark, sf_dir) -> Audit:
    return Audit(q.Chain(spark, sf_dir))


def ml39_cases(spark, sf_dir):
    return q._rounded(_audit(spark, sf_dir).cases.drop("nominal"))


def ml39_phases(spark, sf_dir):
    return q._rounded(D.phase_summary(_audit(spark, sf_dir).cases))


def ml39_farms(spark, sf_dir):
    return q._rounded(D.farm_summary(_audit(spark, sf_dir).cases))


def ml39_widths(spark, sf_dir):
    return q._rounded(D.width_concentration(_audit(spark, sf_dir).cases, LIMITS))


def ml39_scales(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return q._rounded(D.scale_census(a.chain.cases, a.cases, q.GRID, LIMITS))


def ml39_targets(spark, sf_dir):
    return q._rounded(_audit(spark, sf_dir).targets)


def ml39_decision(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return q._rounded(D.decision(a.cases, a.targets, LIMITS))


def _limit(v: float) -> str:
    return f"{v!r}::DOUBLE"


AUDIT_SQL = f"""{q.SELECT_SQL},
 sr AS (SELECT cr.*, sel.coverage AS nominal, CASE WHEN NOT cr.is_anomaly THEN NULL WHEN ts < s THEN 'before' WHEN ts <= cr.e THEN 'within' ELSE 'after' END AS phase, act AND alarm AS live FROM cr JOIN sel ON sel.outer_asset = cr.asset_id AND sel.configuration_id = cr.configuration_id),
 rn AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY case_key ORDER BY ts) AS run FROM (SELECT *, coalesce(live AND lag(live) OVER w AND lag(segment_id) OVER w = segment_id AND ts - lag(ts) OVER w = INTERVAL {STEP_MINUTES} MINUTE, false) AS goes_on FROM sr WINDOW w AS (PARTITION BY case_key ORDER BY ts))),
 lr AS (SELECT case_key, max(n) AS longest_alarm_run FROM (SELECT case_key, run, count(*) FILTER (live) AS n FROM rn GROUP BY ALL) GROUP BY 1),
 cc AS (SELECT case_key, asset_id, configuration_id, any_value(is_anomaly) AS is_anomaly, any_value(nominal) AS nominal, any_value(epoch(e - s)) / 3600 AS span, count(*) AS prediction_rows, count(*) FILTER (act) AS actionable_rows, count(*) FILTER (act AND smoothed IS NOT NULL) AS finite_health_rows, count(*) FILTER (live) AS raw_alarm_rows,
   count(*) FILTER (live AND phase = 'before') AS alarm_rows_before, count(*) FILTER (live AND phase = 'within') AS alarm_rows_within, count(*) FILTER (live AND phase = 'after') AS alarm_rows_after, avg(width) FILTER (act) AS mean_width, max(width) FILTER (act) AS maximum_width,
   avg((width > {_limit(LIMITS.wide)})::INT) FILTER (act) AS fraction_wide, avg((width > {_limit(LIMITS.extreme)})::INT) FILTER (act) AS fraction_extreme, avg(interval_score) FILTER (act) AS mean_score, avg(covered) FILTER (act) AS coverage,
   quantile_cont(width, 0.5) FILTER (act) AS median_width, quantile_cont(width, 0.95) FILTER (act) AS p95_width, quantile_cont(width, 0.99) FILTER (act) AS p99_width FROM sr GROUP BY ALL),
 cd AS (SELECT cc.* EXCLUDE (span), split_part(case_key, '/', 1) AS farm, maximum_criticality, event_alarm, accuracy, coverage_fbeta, earliness, longest_alarm_run, raw_alarm_rows / nullif(actionable_rows, 0) AS raw_alarm_fraction, lead_hours AS hours_to_end, CASE WHEN cc.is_anomaly THEN span - lead_hours END AS hours_from_onset,
   CASE WHEN NOT cc.is_anomaly THEN CASE WHEN event_alarm THEN 'false_alarm' ELSE 'correct_normal' END WHEN NOT event_alarm THEN 'missed' WHEN span - lead_hours < 0 THEN 'pre_onset' ELSE 'within_event' END AS detection_phase
   FROM cc JOIN (SELECT case_key, configuration_id, maximum_criticality, event_alarm, accuracy, coverage_fbeta, earliness, lead_hours FROM met) USING (case_key, configuration_id) JOIN lr USING (case_key))"""
_sums = f"SELECT {{key}} {q._agg} FROM cd"
_rates = f"{q._care} AS care, ta / nullif(a, 0) AS event_sensitivity, na / nullif(n, 0) AS false_alarm_rate"
FARM_SQL = f"fm AS (SELECT farm, {_rates} FROM ({_sums.format(key='farm,')} GROUP BY 1))"
CENSUS_SQL = f"""au AS (SELECT cd.case_key, cd.configuration_id, wt.channel, wt.weight AS w, m.target_scale AS sc, m.r2, wt.level FROM cd JOIN wt ON wt.case_key = cd.case_key AND wt.family = cd.configuration_id // {len(q.GRID.windows) * len(q.GRID.quantiles)} JOIN mod m ON m.case_key = cd.case_key AND m.channel = wt.channel WHERE weight > 0 AND m.target_scale > 0)"""
TARGET_SQL = f"""{CENSUS_SQL},
 wd AS (SELECT case_key, row_number() OVER (ORDER BY mean_width DESC, case_key) AS width_rank FROM cd WHERE NOT is_anomaly AND mean_width IS NOT NULL QUALIFY width_rank <= {LIMITS.widest}),
 tl AS (SELECT a.case_key, width_rank, a.channel, a.w AS weight, a.r2, a.sc AS target_scale, f.scale AS total, 2 * f.scale * q / a.sc AS width, 2 * f.scale * q / a.sc + 2 / (1 - coverage) * greatest(abs(f.residual) / a.sc - f.scale * q / a.sc, 0) AS score
   FROM au a JOIN wd USING (case_key) JOIN fin f ON f.case_key = a.case_key AND f.channel = a.channel JOIN (SELECT DISTINCT case_key, ts FROM pan WHERE train_test = 'prediction') p ON p.case_key = f.case_key AND p.ts = f.ts JOIN cov USING (level) JOIN qs ON qs.case_key = a.case_key AND qs.channel = a.channel AND qs.level = a.level AND head = 'total' AND k = -1),
 tm AS (SELECT case_key, width_rank, channel, weight, r2, target_scale, avg(width) AS mean_width, max(width) AS maximum_width, avg(score) AS mean_score, quantile_cont(width, 0.5) AS median_width, quantile_cont(width, 0.99) AS p99_width, quantile_cont(total, 0.99) AS p99_total_scale FROM tl GROUP BY ALL),
 td AS (SELECT *, weight * mean_width AS width_contribution, weight * mean_score AS score_contribution, coalesce(mean_width > {_limit(LIMITS.wide)}, false) AS pathological,
   CASE WHEN NOT coalesce(mean_width > {_limit(LIMITS.wide)}, false) THEN 'not_pathological' WHEN target_scale < {_limit(LIMITS.tiny)} THEN 'near_zero_target_scale' WHEN p99_total_scale / target_scale > {_limit(0.5 * LIMITS.wide)} THEN 'predictive_scale_explosion' ELSE 'combined_or_tail_effect' END AS cause FROM tm)"""
_case_doubles = ("mean_width", "maximum_width", "fraction_wide", "fraction_extreme", "mean_score", "coverage", "median_width", "p95_width", "p99_width", "accuracy", "coverage_fbeta", "earliness", "raw_alarm_fraction", "hours_to_end", "hours_from_onset")

QUERIES = {
    "ml39_case_diagnostics": (ml39_cases, f"WITH {AUDIT_SQL} SELECT * EXCLUDE (nominal) REPLACE ({q._r(*_case_doubles)}) FROM cd"),
    "ml39_detection_phases": (ml39_phases, f"""WITH {AUDIT_SQL}, ps(p) AS (VALUES ('pre_onset'), ('within_event'), ('missed'))
      SELECT p AS detection_phase, count(case_key) AS anomaly_cases, round(count(case_key) / (SELECT nullif(count(*), 0) FROM cd WHERE is_anomaly), 6) AS fraction, round(median(hours_from_onset), 6) AS median_hours_from_onset, round(median(hours_to_end), 6) AS median_hours_to_end
      FROM ps LEFT JOIN cd ON cd.detection_phase = p AND is_anomaly GROUP BY 1"""),
    "ml39_farm_audit": (ml39_farms, f"""WITH {AUDIT_SQL}, {FARM_SQL}
      SELECT farm, count(*) AS cases, count(*) FILTER (is_anomaly) AS anomaly_cases, round(any_value(care), 6) AS care, round(any_value(event_sensitivity), 6) AS event_sensitivity, round(any_value(false_alarm_rate), 6) AS false_alarm_rate,
        count(*) FILTER (detection_phase = 'pre_onset') AS pre_onset, count(*) FILTER (detection_phase = 'within_event') AS within_event, count(*) FILTER (detection_phase = 'missed') AS missed, count(*) FILTER (detection_phase = 'false_alarm') AS false_alarms,
        round(median(raw_alarm_fraction) FILTER (NOT is_anomaly), 6) AS median_normal_alarm_fraction, median(maximum_criticality) FILTER (is_anomaly) AS median_anomaly_criticality, median(maximum_criticality) FILTER (NOT is_anomaly) AS median_normal_criticality FROM cd LEFT JOIN fm USING (farm) GROUP BY 1"""),
    "ml39_width_concentration": (ml39_widths, f"""WITH {AUDIT_SQL}, nw AS (SELECT mean_width AS w, row_number() OVER (ORDER BY mean_width DESC) AS rn FROM cd WHERE NOT is_anomaly AND mean_width IS NOT NULL)
      SELECT count(*) AS normal_cases, round(avg(w), 6) AS mean_of_means, round(median(w), 6) AS median, round(quantile_cont(w, 0.95), 6) AS p95, round(max(w), 6) AS maximum, count(*) FILTER (w > {_limit(LIMITS.wide)}) AS cases_wide, count(*) FILTER (w > {_limit(LIMITS.extreme)}) AS cases_extreme,
        round(max(w) / nullif(sum(w), 0), 6) AS top1_share, round(sum(w) FILTER (rn <= 5) / nullif(sum(w), 0), 6) AS top5_share FROM nw"""),
    "ml39_scale_census": (ml39_scales, f"""WITH {AUDIT_SQL}, {CENSUS_SQL}
      SELECT case_key, configuration_id, count(*) AS active, round(1 / sum(w * w), 6) AS effective, round(min(sc), 6) AS minimum_scale, round(median(sc), 6) AS median_scale, count(*) FILTER (sc < {_limit(LIMITS.tiny)}) AS tiny, count(*) FILTER (sc < {_limit(LIMITS.very_tiny)}) AS very_tiny,
        round(coalesce(sum(w) FILTER (sc < {_limit(LIMITS.tiny)}), 0), 6) AS weight_on_tiny, round(coalesce(sum(w) FILTER (sc < {_limit(LIMITS.very_tiny)}), 0), 6) AS weight_on_very_tiny, round(max(w), 6) AS maximum_weight FROM au GROUP BY ALL"""),
    "ml39_target_decomposition": (ml39_targets, f"WITH {AUDIT_SQL}, {TARGET_SQL} SELECT * REPLACE ({q._r('weight', 'r2', 'target_scale', 'mean_width', 'maximum_width', 'mean_score', 'median_width', 'p99_width', 'p99_total_scale', 'width_contribution', 'score_contribution')}) FROM td"),
    "ml39_decision": (ml39_decision, f"""WITH {AUDIT_SQL}, {FARM_SQL}, {TARGET_SQL}, po AS (SELECT {_rates}, coverage_error, interval_pathology FROM ({_sums.format(key='')}), (SELECT abs(avg(coverage) - avg(nominal)) AS coverage_error, coalesce(max(mean_width) > {_limit(LIMITS.wide)}, false) AS interval_pathology FROM cd WHERE NOT is_anomaly)),
      dn AS (SELECT po.*, (SELECT max(event_sensitivity) - min(event_sensitivity) FROM fm) AS farm_range, (SELECT coalesce(bool_or(pathological), false) FROM td) AS target_pathology FROM po)
      SELECT * REPLACE ({q._r('care', 'event_sensitivity', 'false_alarm_rate', 'coverage_error', 'farm_range')}), coalesce(coverage_error <= {_limit(LIMITS.coverage_error)}, false) AS coverage_publishable, NOT interval_pathology AS width_publishable, NOT coalesce(farm_range > {_limit(LIMITS.farm_range)}, false) AS uniform_farms,
        interval_pathology OR coalesce(false_alarm_rate > {_limit(LIMITS.false_alarms)}, false) OR coalesce(farm_range > {_limit(LIMITS.farm_range)}, false) AS new_experiment FROM dn"""),
}
