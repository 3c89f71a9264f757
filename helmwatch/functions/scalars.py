"""Column expressions: normalisation, predicates, labels and ladders of the condition-monitoring domain.

All are plain Spark columns, so they stay in generated code and filters on them can be pushed down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain: partition words, normal status ids, statistic suffixes, driver phrases, aliases.
TRAIN_WORDS = ("train", "training", "0", "0.0")
PREDICTION_WORDS = ("test", "prediction", "predict", "1", "1.0")
NORMAL_STATUS = (0.0, 2.0)
DRIVER_PHRASES = ("wind speed", "power", "rotor speed", "generator speed", "ambient temperature", "pitch angle", "wind direction", "nacelle direction")
TRUE_WORDS = ("true", "1", "yes", "y", "t")


def number(c: Column) -> Column:
    """A finite double, or null for missing, non-numeric, NaN and infinite values."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def partition_name(c: Column) -> Column:
    """train, prediction or unknown."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRAIN_WORDS), "train").when(word.isin(*PREDICTION_WORDS), "prediction").otherwise("unknown")


def partition_label(c: Column) -> Column:
    """The same by letters and digits alone; what is unknown is shown, what is missing is named."""
    word = F.regexp_replace(F.lower(c.cast("string")), "[^a-z0-9]", "")
    known = F.when(word.isin("train", "training", "0", "00"), "train").when(word.isin("test", "prediction", "predict", "1", "10"), "prediction")
    return F.when(c.isNull(), "<MISSING>").otherwise(F.coalesce(known, F.concat(F.lit("unrecognized::"), F.trim(c.cast("string")))))


def is_normal(status: Column) -> Column:
    return F.coalesce(number(status).isin(*NORMAL_STATUS), F.lit(False))


def fit_mask(train_test: Column, status: Column) -> Column:
    return (partition_name(train_test) == "train") & is_normal(status)


def row_flags(*signals: Column) -> tuple[Column, Column, Column]:
    """(any finite, all finite and zero, at least one finite and every finite one zero)."""
    values = [number(s) for s in signals]
    some = reduce(Column.__or__, (v.isNotNull() for v in values))
    strict = reduce(Column.__and__, (F.coalesce(v == 0, F.lit(False)) for v in values))
    together = some & reduce(Column.__and__, (F.coalesce(v == 0, F.lit(True)) for v in values))
    return some, strict, together


def cell_class(c: Column) -> Column:
    d = c.try_cast("double")
    return (
        F.when(c.isNull() | (F.trim(c.cast("string")) == ""), "source_missing")
        .when(d.isNull() | F.isnan(d), "non_numeric")
        .when(F.abs(d) == F.lit(float("inf")), "infinite")
        .when(d == 0, "zero")
        .otherwise("finite")
    )


def event_is_anomaly(label: Column) -> Column:
    """true, false, or null for a label of neither kind. Abnormal words are looked for first."""
    word = F.regexp_replace(F.lower(label.cast("string")), "[^a-z0-9]", "")
    yes = word.isin("1", "true", "yes") | word.rlike("anomal|abnormal|fault|failure")
    no = word.isin("0", "false", "no") | word.rlike("normal|healthy")
    return F.when(yes, True).when(no, False)


def identifier(c: Column) -> Column:
    """"7.0" becomes "7"; other values are trimmed."""
    text = F.trim(c.cast("string"))
    d = number(text)
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("long").cast("string")).otherwise(text)


def snake_case(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def slug(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_")), F.lit("_"))


def base_sensor(c: Column) -> Column:
    return F.regexp_replace(c, "_(avg|std|max|min)$", "")


def statistic(c: Column) -> Column:
    found = F.regexp_extract(c, "_(avg|std|max|min)$", 1)
    return F.when(found == "", "unspecified").otherwise(found)


def semantic_role(description: Column, is_angle: Column, is_counter: Column) -> Column:
    text = F.replace(F.lower(F.coalesce(description, F.lit(""))), F.lit("windspeed"), F.lit("wind speed"))
    driver = reduce(Column.__or__, (text.contains(p) for p in DRIVER_PHRASES))
    return (
        F.when(driver, "driver").when(text.rlike(r"\btemp(erature)?\b"), "temperature")
        .when(F.coalesce(is_angle, F.lit(False)), "angle").when(F.coalesce(is_counter, F.lit(False)), "counter")
        .when(F.trim(text) == "", "unclassified").otherwise("other")
    )


def is_reserved_feature(name: Column) -> Column:
    return F.lower(name).rlike("(^|_)(label|target|split|fold|status|anomaly|event|fault|asset|farm|id|index|timestamp|time_stamp)($|_)")


def angle_parts(degrees: Column) -> tuple[Column, Column, Column]:
    """(sine, cosine, missing): a missing angle has parts 0 and the indicator 1."""
    d = number(degrees)
    return F.coalesce(F.sin(F.radians(d)), F.lit(0.0)), F.coalesce(F.cos(F.radians(d)), F.lit(0.0)), d.isNull().cast("int")


def robust_value(x: Column, center: Column, scale: Column) -> Column:
    """(x - center) / scale, a missing x taking the center."""
    return (F.coalesce(number(x), center) - center) / scale


def actionable(farm: Column, is_anomaly: Column, status: Column) -> Column:
    """All rows of farm A's anomaly cases; elsewhere rows of normal status."""
    return ((farm == "Wind Farm A") & is_anomaly) | is_normal(status)


def in_interval(ts: Column, start: Column, end: Column) -> Column:
    return F.coalesce((ts >= start) & (ts <= end), F.lit(False))


def shift_band(psi: Column) -> Column:
    return F.when(psi < 0.10, "small").when(psi < 0.25, "moderate").otherwise("large")


def review_flag(finite: Column, structurally_zero: Column, availability: Column, longest_zero_run: Column, min_availability: float = 0.70, max_run: int = 144) -> Column:
    return (
        F.when(finite == 0, "all_missing").when(structurally_zero, "structurally_zero").when(availability < min_availability, "low_availability")
        .when(longest_zero_run >= max_run, "sustained_zero_run").otherwise("pass")
    )


def detection_phase(is_anomaly: Column, first_alarm: Column, start: Column, end: Column) -> Column:
    return (
        F.when(~is_anomaly, F.when(first_alarm.isNull(), "correct_normal").otherwise("false_alarm"))
        .when(first_alarm.isNull() | (first_alarm > end), "missed").when(first_alarm < start, "pre_onset").otherwise("within_event")
    )


def pathology(scale: Column, mean_width: Column, total_scale: Column, wide: float = 1e6, tiny: float = 1e-6) -> Column:
    """Why a channel's mean width, in units of its scale, is above wide: a scale near zero, else a predictive scale
    (a high quantile of it) that alone makes half the width, else neither."""
    return F.when(~F.coalesce(mean_width > wide, F.lit(False)), "not_pathological").when(scale < tiny, "near_zero_target_scale").when(total_scale / scale > 0.5 * wide, "predictive_scale_explosion").otherwise("combined_or_tail_effect")


def boolean(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def planned_cohort(unit: Column) -> Column:
    return F.when(unit.between(1, 5), "IR").when(unit.between(6, 10), "OR").when(unit.between(11, 15), "B").when(unit.between(16, 20), "C")


def manifest_status(eligible: Column, is_copy: Column) -> Column:
    return F.when(eligible, "eligible").when(is_copy, "exact_copy_excluded").otherwise("other_ineligible")


def first_reason(*ladder: tuple[str, Column]) -> Column:
    """The first reason whose condition holds, else included."""
    return F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in ladder), F.lit("included"))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    top, bottom = (1 + b) * tp, (1 + b) * tp + b * fn + fp
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def care_score(f: Column, ws: Column, ef: Column, accuracy: Column, alarms: Column) -> Column:
    return F.when(alarms == 0, 0.0).when(accuracy < 0.5, accuracy).otherwise((f + ws + ef + 2 * accuracy) / 5)


def earliness_weight(position: Column) -> Column:
    return F.when(position <= 0.5, 1.0).otherwise(2 * (1 - position))


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    n, p = total.cast("double"), successes / total
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
