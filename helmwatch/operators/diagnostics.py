"""The audit of a finished evaluation: what the selected configurations did in each case, phase and farm, where interval
widths concentrate, which target scales are close to zero, and which channels make the widest cases wide.

Nothing here changes a prediction. A case's rows are ordered once for its alarm runs; quantiles are counted by value
ranges; what follows has one row a case or a case and channel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import order_statistics as O
from helmwatch.operators.health import Grid


@dataclass(frozen=True)
class Limits:
    """Above wide an interval is pathological, below tiny a scale nearly zero; widest cases are decomposed; the rest are
    the greatest coverage error, false alarm rate and range of farm sensitivities that pass."""

    wide: float = 1e6
    extreme: float = 1e12
    tiny: float = 1e-6
    very_tiny: float = 1e-9
    widest: int = 12
    coverage_error: float = 0.02
    false_alarms: float = 0.20
    farm_range: float = 0.20


def _farm(key: str) -> Column:
    return F.substring_index(key, "/", 1)


def selected_rows(rows: DataFrame, outcomes: DataFrame, selected: DataFrame, grid: Grid, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """The candidate rows under the configuration selected for their asset: smoothed, alarm, width, covered and
    interval_score as plain columns, actionable, and phase before, within or after the event (null without one)."""
    per = len(grid.windows) * len(grid.quantiles)
    k = F.col("configuration_id")
    family = F.floor(k / per).cast("int")
    chosen = outcomes.join(selected.select(F.col("outer_asset").alias("asset_id"), "configuration_id"), "asset_id")
    phase = F.when(F.col("is_anomaly"), F.when(F.col(ts) < F.col("event_start"), "before").when(F.col(ts) <= F.col("event_end"), "within").otherwise("after"))
    smoothed = F.get(F.get("smoothed", F.floor(k % per / len(grid.quantiles)).cast("int")), family)
    return rows.join(chosen, key).select(
        key, ts, "segment_id", "asset_id", "is_anomaly", "event_start", "event_end", "configuration_id", phase.alias("phase"),
        S.actionable(_farm(key), F.col("is_anomaly"), F.col("status_type_id")).alias("actionable"), smoothed.alias("smoothed"), F.coalesce(F.get("alarms", k), F.lit(False)).alias("alarm"),
        *(F.get(c, family).alias(c) for c in ("width", "covered", "interval_score")),
    )


def longest_alarm_run(rows: DataFrame, step_minutes: int, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """(key, longest_alarm_run): most actionable alarm rows in a row, one step apart within a segment."""
    w = Window.partitionBy(key).orderBy(ts)
    on = F.col("actionable") & F.col("alarm")
    apart = F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts)) == step_minutes * 60
    goes_on = on & F.lag(on).over(w) & apart & (F.lag("segment_id").over(w) == F.col("segment_id"))
    runs = rows.withColumn("_on", on).withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(w)).groupBy(key, "_run").agg(F.count_if("_on").alias("_n"))
    return runs.groupBy(key).agg(F.max("_n").alias("longest_alarm_run"))


def case_diagnostics(rows: DataFrame, metrics: DataFrame, selected: DataFrame, step_minutes: int, limits: Limits = Limits(), key: str = "case_key", ts: str = "ts") -> DataFrame:
    """One row a case from selected_rows and the case metrics: alarms by phase, the crossing's place relative to the
    event, width, score and coverage over actionable rows. A case without finite widths has null width statistics."""
    act, alarm = F.col("actionable"), F.col("alarm") & F.col("actionable")
    wide = F.when(act, F.col("width"))
    share = lambda limit: F.avg(F.when(wide.isNotNull(), (wide > limit).cast("double")))
    counted = rows.groupBy(key, "asset_id", "is_anomaly", "event_start", "event_end", "configuration_id").agg(
        F.count("*").alias("prediction_rows"), F.count_if(act).alias("actionable_rows"), F.count_if(act & F.col("smoothed").isNotNull()).alias("finite_health_rows"), F.count_if(alarm).alias("raw_alarm_rows"),
        *(F.count_if(alarm & (F.col("phase") == p)).alias(f"alarm_rows_{p}") for p in ("before", "within", "after")),
        F.avg(wide).alias("mean_width"), F.max(wide).alias("maximum_width"), share(limits.wide).alias("fraction_wide"), share(limits.extreme).alias("fraction_extreme"),
        F.avg(F.when(act, F.col("interval_score"))).alias("mean_score"), F.avg(F.when(act, F.col("covered"))).alias("coverage"),
    )
    widths = O.linear_quantiles(rows.where(act), "width", (0.5, 0.95, 0.99), key).select(key, *(F.get("q", i).alias(f"{n}_width") for i, n in enumerate(("median", "p95", "p99"))))
    found = metrics.select(key, "configuration_id", "maximum_criticality", "event_alarm", "accuracy", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("coverage_fbeta", "earliness", "lead_hours")))
    out = counted.join(found, [key, "configuration_id"]).join(widths, key, "left").join(longest_alarm_run(rows, step_minutes, key, ts), key)
    out = out.join(selected.select(F.col("outer_asset").alias("asset_id"), F.col("coverage").alias("nominal")), "asset_id")
    span = F.timestamp_diff("SECOND", F.col("event_start"), F.col("event_end")) / 3600
    onset = F.when(F.col("is_anomaly"), span - F.col("lead_hours"))
    phase = (
        F.when(~F.col("is_anomaly"), F.when(F.col("event_alarm"), "false_alarm").otherwise("correct_normal"))
        .when(~F.col("event_alarm"), "missed").when(onset < 0, "pre_onset").otherwise("within_event")
    )
    return out.withColumns({"farm": _farm(key), "hours_from_onset": onset, "hours_to_end": F.col("lead_hours"), "detection_phase": phase, "raw_alarm_fraction": F.col("raw_alarm_rows") / F.nullif(F.col("actionable_rows"), F.lit(0))}).drop("event_start", "event_end", "lead_hours")


def phase_summary(cases: DataFrame) -> DataFrame:
    """Anomaly cases by detection phase, all three phases, and the median place of the crossing."""
    of = lambda p: F.col("is_anomaly") & (F.col("detection_phase") == p)
    each = F.array(*(
        F.struct(F.lit(p).alias("detection_phase"), F.count_if(of(p)).alias("anomaly_cases"), (F.count_if(of(p)) / F.nullif(F.count_if("is_anomaly"), F.lit(0))).alias("fraction"),
                 F.median(F.when(of(p), F.col("hours_from_onset"))).alias("median_hours_from_onset"), F.median(F.when(of(p), F.col("hours_to_end"))).alias("median_hours_to_end"))
        for p in ("pre_onset", "within_event", "missed")
    ))
    return cases.agg(each.alias("_p")).select(F.inline("_p"))


def _care() -> dict[str, Column]:
    anomaly, alarm = F.col("is_anomaly"), F.col("event_alarm")
    hit, false = F.count_if(anomaly & alarm), F.count_if(~anomaly & alarm)
    score = S.care_score(F.avg(F.when(anomaly, F.col("coverage_fbeta"))), F.avg(F.when(anomaly, F.col("earliness"))), S.f_beta(hit, false, F.count_if(anomaly) - hit), F.avg(F.when(~anomaly, F.col("accuracy"))), hit + false)
    both = (F.count_if(anomaly) > 0) & (F.count_if(~anomaly) > 0)
    return {"care": F.when(both, score), "event_sensitivity": hit / F.nullif(F.count_if(anomaly), F.lit(0)), "false_alarm_rate": false / F.nullif(F.count_if(~anomaly), F.lit(0))}


def farm_summary(cases: DataFrame) -> DataFrame:
    """One row a farm: its score, sensitivity, cases by phase, false alarms, and medians over its cases."""
    anomaly = F.col("is_anomaly")
    return cases.groupBy("farm").agg(
        F.count("*").alias("cases"), F.count_if(anomaly).alias("anomaly_cases"), *(v.alias(n) for n, v in _care().items()),
        *(F.count_if(F.col("detection_phase") == p).alias(n) for p, n in (("pre_onset", "pre_onset"), ("within_event", "within_event"), ("missed", "missed"), ("false_alarm", "false_alarms"))),
        F.median(F.when(~anomaly, F.col("raw_alarm_fraction"))).alias("median_normal_alarm_fraction"),
        F.median(F.when(anomaly, F.col("maximum_criticality"))).alias("median_anomaly_criticality"), F.median(F.when(~anomaly, F.col("maximum_criticality"))).alias("median_normal_criticality"),
    )


def width_concentration(cases: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """How the mean widths of normal cases concentrate: one row, also without cases."""
    w = F.col("mean_width")
    normal = cases.where(~F.col("is_anomaly") & w.isNotNull())
    top = normal.orderBy(F.desc("mean_width")).limit(5).agg(F.max(w).alias("_top1"), F.sum(w).alias("_top5"))
    total = normal.agg(
        F.count("*").alias("normal_cases"), F.avg(w).alias("mean_of_means"), F.median(w).alias("median"), F.percentile(w, 0.95).alias("p95"), F.max(w).alias("maximum"), F.sum(w).alias("_sum"),
        F.count_if(w > limits.wide).alias("cases_wide"), F.count_if(w > limits.extreme).alias("cases_extreme"),
    )
    share = lambda c: F.col(c) / F.nullif(F.col("_sum"), F.lit(0.0))
    return total.join(F.broadcast(top)).withColumns({"top1_share": share("_top1"), "top5_share": share("_top5")}).drop("_top1", "_top5", "_sum")


def _active(grid: Grid) -> Column:
    """Channels of a case with positive weight in the selected family and a positive scale: structs c, w, s."""
    family = F.floor(F.col("configuration_id") / (len(grid.windows) * len(grid.quantiles))).cast("int")
    every = F.zip_with(F.get("weights", family), "target_scale", lambda w, s: F.struct(w.alias("w"), s.alias("s")))
    numbered = F.transform(every, lambda x, c: F.struct(c.alias("c"), x["w"].alias("w"), x["s"].alias("s")))
    return F.filter(numbered, lambda x: (x["w"] > 0) & F.coalesce(x["s"] > 0, F.lit(False)))


def scale_census(models: DataFrame, chosen: DataFrame, grid: Grid, limits: Limits = Limits(), key: str = "case_key") -> DataFrame:
    """One row a case: how many channels carry weight, their effective number, and how much rests on tiny scales.

    models: (key, weights[family][channel], target_scale[channel]); chosen: (key, configuration_id)."""
    a = models.join(chosen.select(key, "configuration_id"), key).withColumn("_a", _active(grid))
    scales = F.array_sort(F.transform("_a", lambda x: x["s"]))
    n = F.size("_a")
    total = lambda of: F.aggregate("_a", F.lit(0.0), lambda t, x: t + of(x))
    below = lambda limit: F.filter("_a", lambda x: x["s"] < limit)
    return a.select(
        key, "configuration_id", n.alias("active"), (1 / F.nullif(total(lambda x: x["w"] * x["w"]), F.lit(0.0))).alias("effective"), F.array_min(scales).alias("minimum_scale"),
        ((F.get(scales, F.floor((n - 1) / 2).cast("int")) + F.get(scales, F.floor(n / 2).cast("int"))) / 2).alias("median_scale"), F.size(below(limits.tiny)).alias("tiny"), F.size(below(limits.very_tiny)).alias("very_tiny"),
        total(lambda x: F.when(x["s"] < limits.tiny, x["w"]).otherwise(0.0)).alias("weight_on_tiny"), total(lambda x: F.when(x["s"] < limits.very_tiny, x["w"]).otherwise(0.0)).alias("weight_on_very_tiny"),
        F.array_max(F.transform("_a", lambda x: x["w"])).alias("maximum_weight"),
    )


def target_decomposition(rows: DataFrame, models: DataFrame, cases: DataFrame, grid: Grid, limits: Limits = Limits(), key: str = "case_key") -> DataFrame:
    """One row a channel of the widest normal cases: its width and score in units of its scale, what it adds to the
    case's means, and the cause where its mean width is pathological.

    rows: prediction rows with residual and scale; models: (key, multipliers, weights, target_scale, r2); cases: case_diagnostics."""
    widest = cases.where(~F.col("is_anomaly") & F.col("mean_width").isNotNull()).orderBy(F.desc("mean_width"), key).limit(limits.widest)
    widest = widest.select(key, "configuration_id", F.row_number().over(Window.orderBy(F.desc("mean_width"), key)).alias("width_rank"))  # at most `widest` rows
    at = F.floor(F.col("configuration_id") / (len(grid.windows) * len(grid.quantiles) * grid.per_coverage)).cast("int")
    m = models.join(widest, key).select(key, "width_rank", F.get("multipliers", at).alias("_m"), F.get(F.array(*map(F.lit, grid.coverages)), at).alias("_coverage"), "r2", _active(grid).alias("_a"))
    long = rows.select(key, "residual", "scale").join(F.broadcast(m), key).withColumn("_x", F.explode("_a")).select(
        key, "width_rank", F.col("_x.c").alias("channel"), F.col("_x.w").alias("weight"), F.get("r2", F.col("_x.c")).alias("r2"), F.col("_x.s").alias("target_scale"), F.get("scale", F.col("_x.c")).alias("total"),
        (F.abs(F.get("residual", F.col("_x.c"))) / F.col("_x.s")).alias("_far"), (2 * F.get("scale", F.col("_x.c")) * F.get("_m", F.col("_x.c")) / F.col("_x.s")).alias("width"), "_coverage",
    )
    beyond = F.col("_far") - F.col("width") / 2
    long = long.withColumn("score", F.col("width") + 2 / (1 - F.col("_coverage")) * F.when(beyond.isNotNull(), F.greatest(beyond, F.lit(0.0))))
    state = [key, "channel"]
    means = long.groupBy(key, "width_rank", "channel", "weight", "r2", "target_scale").agg(F.avg("width").alias("mean_width"), F.max("width").alias("maximum_width"), F.avg("score").alias("mean_score"))
    widths = O.linear_quantiles(long, "width", (0.5, 0.99), *state).select(*state, F.get("q", 0).alias("median_width"), F.get("q", 1).alias("p99_width"))
    scales = O.linear_quantiles(long, "total", (0.99,), *state).select(*state, F.get("q", 0).alias("p99_total_scale"))
    out = means.join(widths, state, "left").join(scales, state, "left")
    return out.withColumns({
        "width_contribution": F.col("weight") * F.col("mean_width"), "score_contribution": F.col("weight") * F.col("mean_score"), "pathological": F.coalesce(F.col("mean_width") > limits.wide, F.lit(False)),
        "cause": S.pathology(F.col("target_scale"), F.col("mean_width"), F.col("p99_total_scale"), limits.wide, limits.tiny),
    })


def decision(cases: DataFrame, targets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row of findings: pooled score and rates, the range of farm sensitivities, and whether coverage and widths may
    be published as they are or a new experiment is due. targets: target_decomposition."""
    normal = ~F.col("is_anomaly")
    pooled = cases.agg(
        *(v.alias(n) for n, v in _care().items()), F.abs(F.avg(F.when(normal, F.col("coverage"))) - F.avg(F.when(normal, F.col("nominal")))).alias("coverage_error"),
        F.coalesce(F.max(F.when(normal, F.col("mean_width"))) > limits.wide, F.lit(False)).alias("interval_pathology"),
    )
    farms = farm_summary(cases).agg((F.max("event_sensitivity") - F.min("event_sensitivity")).alias("farm_range"))
    flagged = targets.agg(F.coalesce(F.bool_or("pathological"), F.lit(False)).alias("target_pathology"))
    out = pooled.join(F.broadcast(farms)).join(F.broadcast(flagged))
    uneven, alarms = F.coalesce(F.col("farm_range") > limits.farm_range, F.lit(False)), F.coalesce(F.col("false_alarm_rate") > limits.false_alarms, F.lit(False))
    return out.withColumns({
        "coverage_publishable": F.coalesce(F.col("coverage_error") <= limits.coverage_error, F.lit(False)), "width_publishable": ~F.col("interval_pathology"),
        "uniform_farms": ~uneven, "new_experiment": F.col("interval_pathology") | alarms | uneven,
    })
