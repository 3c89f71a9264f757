"""Health evidence over a grid of configurations: thresholds, candidate alarms, case metrics, frozen predictions.

A configuration is a coverage, a least r2, an evidence head, a smoothing window and a threshold quantile. Rows are not
multiplied: a row carries arrays over the families (coverage, r2, head), the smoothed families of every window, and
the alarms of all configurations. Configurations of one window share its frame, and one ordered pass walks the
criticality of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import order_statistics as O

#: Share of the weight that has to be observed.
MIN_WEIGHT = 0.70
TINY = 1e-12


@dataclass(frozen=True)
class Grid:
    """The axes; a configuration's number counts them in this order, the last one fastest. heads: for each evidence
    head the channels that may enter it, by number."""

    coverages: tuple[float, ...] = (0.95, 0.98, 0.99)
    r2: tuple[float, ...] = (0.0, 0.10, 0.30)
    heads: tuple[tuple[str, tuple[int, ...]], ...] = ()
    windows: tuple[int, ...] = (36, 72, 144)
    quantiles: tuple[float, ...] = (0.95, 0.98, 0.99, 0.995)

    @property
    def families(self) -> int:
        return len(self.coverages) * len(self.r2) * len(self.heads)

    @property
    def size(self) -> int:
        return self.families * len(self.windows) * len(self.quantiles)

    @property
    def per_coverage(self) -> int:
        return len(self.r2) * len(self.heads)

    def rows(self) -> list[tuple]:
        axes = product(self.coverages, self.r2, [h for h, _ in self.heads], self.windows, self.quantiles)
        return [(i, *a) for i, a in enumerate(axes)]


def configurations(spark: SparkSession, grid: Grid) -> DataFrame:
    return spark.createDataFrame(grid.rows(), "configuration_id int, coverage double, minimum_r2 double, evidence_head string, smoothing_steps int, threshold_quantile double")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def family_weights(cases: DataFrame, grid: Grid, key: str = "case_key") -> DataFrame:
    """(key, weights[family][channel]) from r2, calibrated, fold_multipliers and heldout of each case.

    A channel is eligible where its r2 reaches the family's, it is calibrated, and the multipliers of every fold are
    there and positive. Its raw weight is r2 in [0, 1] times exp(-e / (1 - coverage)), where e is the root mean square
    of what its held-out coverages miss the nominal one by; weights are raw ones over their sum. Where all vanish the
    eligible channels of the head weigh the same; without any, all weights are 0."""
    sane = F.transform("r2", lambda v, c: F.col("calibrated")[c] & F.forall("fold_multipliers", lambda f: F.forall(f, lambda m: F.coalesce(m[c] > 0, F.lit(False)))) & v.isNotNull())
    found = cases.withColumn("_sane", sane)

    def quality(at: int, coverage: float) -> Column:
        def of(r2: Column, c: Column) -> Column:
            gaps = F.filter(F.transform("heldout", lambda f: f[at][c]), lambda v: v.isNotNull())
            square = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + (v - coverage) * (v - coverage)) / F.size(gaps)
            trust = F.when(F.size(gaps) > 0, F.exp(-F.sqrt(square) / max(1 - coverage, TINY))).otherwise(0.0)
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2)) * trust

        return F.transform("r2", of)

    def allowed(least: float, members: tuple[int, ...]) -> Column:
        return F.transform("r2", lambda v, c: F.col("_sane")[c] & (v >= least) & c.isin(*members))

    weights = []
    for at, coverage in enumerate(grid.coverages):
        found = found.withColumn(f"_quality{at}", quality(at, coverage))
        weights += [F.struct(allowed(least, members).alias("allowed"), F.col(f"_quality{at}").alias("quality")) for least in grid.r2 for _, members in grid.heads]
    raw = F.transform(F.array(*weights), lambda w: F.zip_with(w["allowed"], w["quality"], lambda a, q: F.when(a, q).otherwise(0.0)))
    found = found.withColumn("_allowed", F.transform(F.array(*weights), lambda w: F.transform(w["allowed"], lambda a: F.when(a, 1.0).otherwise(0.0)))).withColumn("_raw", raw)
    chosen = F.zip_with("_raw", "_allowed", lambda r, a: F.when(_total(r) > TINY, r).otherwise(a))
    return found.withColumn("_chosen", chosen).select(key, F.transform("_chosen", lambda w: F.when(_total(w) > TINY, F.transform(w, lambda v: F.coalesce(v, F.lit(0.0)) / _total(w))).otherwise(F.transform(w, lambda v: F.lit(0.0)))).alias("weights"))


def _weighted(values: Column, weights: Column) -> Column:
    """struct(mean, observed): the weighted mean over observed values, null below MIN_WEIGHT of observed weight."""
    pairs = F.filter(F.arrays_zip(values.alias("v"), weights.alias("w")), lambda p: p["v"].isNotNull() & (p["w"] > 0))
    seen = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"])
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["v"] * p["w"])
    return F.struct(F.when(seen >= MIN_WEIGHT - TINY, total / seen).alias("mean"), seen.alias("observed"))


def _exceedance(multipliers: Column) -> Column:
    half = lambda p: p["s"] * p["m"]
    zipped = lambda m: F.arrays_zip(F.col("residual").alias("r"), F.col("scale").alias("s"), m.alias("m"))
    return F.transform(multipliers, lambda m: F.transform(zipped(m), lambda p: F.when((half(p) > 0) & p["r"].isNotNull(), F.greatest(F.abs(p["r"]) / half(p) - 1, F.lit(0.0)))))


def raw_health(rows: DataFrame, cases: DataFrame, grid: Grid, crossfit: bool, key: str = "case_key", fold: str = "fold_id") -> DataFrame:
    """health[family] and observed[family] of every row, from residual and scale; cases has the arrays of
    conformal.case_arrays and weights. crossfit: by the multipliers that did not see the row's fold."""
    joined = rows.join(cases.select(key, "multipliers", "fold_multipliers", "weights"), key)
    multipliers = F.get("fold_multipliers", F.col(fold).cast("int")) if crossfit else F.col("multipliers")
    out = joined.withColumn("_e", _exceedance(multipliers))
    found = F.transform("weights", lambda w, f: _weighted(F.get("_e", F.floor(f / grid.per_coverage).cast("int")), w))
    out = out.withColumn("_h", found)
    return out.withColumns({"health": F.transform("_h", lambda h: h["mean"]), "observed": F.transform("_h", lambda h: h["observed"])}).select(*rows.columns, "health", "observed")


def smooth_families(rows: DataFrame, windows: tuple[int, ...], run: tuple[str, ...], ts: str = "ts") -> DataFrame:
    """smoothed[window][family]: the median of the last window rows of the run; null until the window is full or where
    one of its values is missing. All windows and families share one frame of max(windows) rows."""
    frame = Window.partitionBy(*run).orderBy(ts).rowsBetween(1 - max(windows), 0)
    out = rows.withColumn("_past", F.collect_list("health").over(frame))

    def median(w: int) -> Column:
        def of(f: Column) -> Column:
            values = F.array_sort(F.transform(F.slice("_past", -w, w), lambda h: h[f]))
            middle = (F.get(values, (w - 1) // 2) + F.get(values, w // 2)) / 2
            # Nulls sort last.
            return F.when(F.get(values, w - 1).isNotNull(), middle)

        return F.when(F.size("_past") >= w, F.transform("health", lambda _, f: of(f))).otherwise(F.transform("health", lambda _: F.lit(None).cast("double")))

    return out.withColumn("smoothed", F.array(*map(median, windows))).drop("_past")


def fit_thresholds(rows: DataFrame, grid: Grid, min_observed: int, min_blocks: int, key: str = "case_key") -> DataFrame:
    """(key, thresholds[configuration], blocks and timestamps[configuration]) from cross-fitted rows with smoothed and
    block. A threshold is the least value at which blocks of equal mass have the quantile of all mass; blocks with
    fewer than min_observed smoothed values do not count, and fewer than min_blocks of them give no threshold."""
    wide = rows.where("block IS NOT NULL").select(key, "block", F.posexplode("smoothed").alias("w", "_families"))
    values = wide.select(key, "block", "w", F.posexplode("_families").alias("family", "value")).where("value IS NOT NULL")
    state = (key, "family", "w")
    kept = values.withColumn("_n", F.count("*").over(Window.partitionBy(*state, "block"))).where(F.col("_n") >= min_observed)
    q = O.weighted_quantiles(kept, "value", 1.0 / F.col("_n"), grid.quantiles, *state)
    counts = kept.groupBy(*state, "block").agg(F.count("*").alias("_rows")).groupBy(*state).agg(F.count("*").alias("blocks"), F.sum("_rows").alias("timestamps"))
    found = q.join(counts, list(state)).where(F.col("blocks") >= min_blocks)
    base = (F.col("family") * len(grid.windows) + F.col("w")) * len(grid.quantiles)
    entries = found.select(key, "blocks", "timestamps", base.alias("_base"), F.posexplode("q").alias("_q", "threshold"))
    packed = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("_base") + F.col("_q")).cast("int").alias("k"), F.struct("threshold", "blocks", "timestamps")))).alias("_m"))
    each = lambda field: F.transform(F.sequence(F.lit(0), F.lit(grid.size - 1)), lambda k: F.try_element_at(F.col("_m"), k)[field])
    return packed.select(key, each("threshold").alias("thresholds"), each("blocks").alias("blocks"), each("timestamps").alias("timestamps"))


def availability(thresholds: DataFrame) -> DataFrame:
    """(configuration_id, available_cases, cases, universal): configurations with a threshold in every case."""
    per = thresholds.select(F.posexplode("thresholds").alias("configuration_id", "_t"))
    return per.groupBy("configuration_id").agg(F.count("_t").alias("available_cases"), F.count("*").alias("cases")).withColumn("universal", F.col("available_cases") == F.col("cases"))


def family_available(thresholds: DataFrame, grid: Grid, key: str = "case_key") -> DataFrame:
    """(key, coverage, available): how many configurations of the least r2 and the first head a coverage keeps; an
    alarm policy needs one at least."""
    per = len(grid.windows) * len(grid.quantiles)
    counts = [F.struct(F.lit(float(c)).alias("coverage"), F.size(F.filter(F.slice("thresholds", i * grid.per_coverage * per + 1, per), lambda t: t.isNotNull())).alias("available")) for i, c in enumerate(grid.coverages)]
    return thresholds.select(key, F.explode(F.array(*counts)).alias("_c")).select(key, "_c.*")


def candidates(rows: DataFrame, cases: DataFrame, thresholds: DataFrame, grid: Grid, key: str = "case_key") -> DataFrame:
    """alarms[configuration] of rows with smoothed: true where it exceeds the case's threshold, null where there is no
    threshold; width, covered and interval_score[family]: weighted means over channels of the interval's width, whether
    it holds the residual and its interval score, in units of target_scale, of cases."""
    joined = rows.join(thresholds.select(key, "thresholds"), key).join(cases.select(key, "multipliers", "weights", "target_scale"), key)
    per = len(grid.windows) * len(grid.quantiles)
    value = lambda k: F.get(F.get("smoothed", F.floor(k % per / len(grid.quantiles)).cast("int")), F.floor(k / per).cast("int"))
    alarms = F.transform("thresholds", lambda t, k: F.when(t.isNotNull(), F.coalesce(value(k) > t, F.lit(False))))
    zipped = lambda m: F.arrays_zip(F.col("residual").alias("r"), F.col("scale").alias("s"), m.alias("m"), F.col("target_scale").alias("t"))
    half, far = lambda p: p["s"] * p["m"] / p["t"], lambda p: F.abs(p["r"]) / p["t"]
    out = joined.withColumn("_z", F.transform("multipliers", zipped)).withColumn("alarms", alarms)
    beyond = lambda p: F.greatest(far(p) - half(p), F.when((far(p) - half(p)).isNotNull(), 0.0))
    penalty = F.array(*(F.lit(2 / (1 - c)) for c in grid.coverages))

    def family_means(of) -> Column:
        """Weighted means, a family each, of a value by channel and coverage."""
        values = F.transform("_z", lambda z, c: F.transform(z, lambda p: of(p, c)))
        return F.transform("weights", lambda w, f: _weighted(F.get(values, F.floor(f / grid.per_coverage).cast("int")), w)["mean"])

    out = out.withColumns({
        "width": family_means(lambda p, c: 2 * half(p)),
        "covered": family_means(lambda p, c: (far(p) <= half(p)).cast("double")),
        "interval_score": family_means(lambda p, c: 2 * half(p) + F.get(penalty, c) * beyond(p)),
    })
    return out.select(*rows.columns, "alarms", "width", "covered", "interval_score")


def score_case_health(rows: DataFrame, cases: DataFrame, thresholds: DataFrame, grid: Grid, configuration: int, run: tuple[str, ...] = ("case_key", "segment_id"), key: str = "case_key") -> DataFrame:
    """health, observed, smoothed, threshold and alarm of rows with residual and scale, under one configuration: only
    its family is weighed and only its window smoothed."""
    coverage, least, head, window, quantile = grid.rows()[configuration][1:]
    family = configuration // (len(grid.windows) * len(grid.quantiles))
    at = family // grid.per_coverage
    one = Grid((coverage,), (least,), tuple(h for h in grid.heads if h[0] == head), (window,), (quantile,))
    only = cases.select(key, F.slice("multipliers", at + 1, 1).alias("multipliers"), F.transform("fold_multipliers", lambda f: F.slice(f, at + 1, 1)).alias("fold_multipliers"), F.slice("weights", family + 1, 1).alias("weights"))
    smooth = smooth_families(raw_health(rows, only, one, False), (window,), run)
    joined = smooth.join(thresholds.select(key, F.get("thresholds", configuration).alias("threshold")), key)
    joined = joined.withColumns({"health": F.get("health", 0), "observed": F.get("observed", 0), "smoothed": F.get(F.get("smoothed", 0), 0)})
    return joined.withColumn("alarm", F.coalesce(F.col("smoothed") > F.col("threshold"), F.lit(False))).select(*rows.columns, "health", "observed", "smoothed", "threshold", "alarm")


METRIC_SCHEMA = """case_key string, asset_id string, configuration_id int, is_anomaly boolean, rows long, actionable_rows long, tn long, fp long,
fn long, tp long, accuracy double, coverage_fbeta double, earliness double, maximum_criticality long, event_alarm boolean, lead_hours double,
mean_width double, mean_covered double, mean_interval_score double"""


class _Case:
    """Running sums of one case for all configurations at once, fed in the order of time."""

    def __init__(self, first, configurations: int, families: int, threshold: int):
        self.key, self.asset, self.anomaly, self.threshold = first.case_key, first.asset_id, bool(first.is_anomaly), threshold
        self.per = configurations // families
        self.end = first.event_end
        zeros = lambda kind=np.int64: np.zeros(configurations, kind)
        self.counts = {k: zeros() for k in ("tn", "fp", "fn", "tp")}
        self.early, self.early_all = zeros(float), 0.0
        self.walk, self.top, self.first = zeros(), zeros(), np.full(configurations, np.nan)
        self.segment, self.rows, self.acted = None, 0, 0
        self.sums = {k: [np.zeros(families), np.zeros(families)] for k in ("width", "covered", "interval_score")}
        self.known = None

    def add(self, part: pd.DataFrame) -> None:
        cells = np.array(part["alarms"].tolist(), dtype=object)
        self.known = cells[0] != None if self.known is None else self.known  # noqa: E711  the same for all rows of a case
        alarm = cells.astype(bool)
        act, truth, ts = part["actionable"].to_numpy(bool), part["truth"].to_numpy(bool), part["ts_s"].to_numpy(float)
        self.rows += len(part)
        self.acted += int(act.sum())
        self.counts["tp"] += alarm[act & truth].sum(axis=0)
        self.counts["fn"] += (~alarm[act & truth]).sum(axis=0)
        self.counts["fp"] += alarm[act & ~truth].sum(axis=0)
        self.counts["tn"] += (~alarm[act & ~truth]).sum(axis=0)
        weight = part["early"].to_numpy(float)[truth]
        self.early += weight @ alarm[truth]
        self.early_all += weight.sum()
        for name, (total, seen) in self.sums.items():
            v = np.array(part[name].tolist(), dtype=float)[act]
            total += np.nansum(v, axis=0)
            seen += np.isfinite(v).sum(axis=0)
        scope = ts <= self.end if self.anomaly else np.ones(len(ts), bool)
        segments = part["segment_id"].to_numpy()[scope]
        steps = np.where(act[scope, None], np.where(alarm[scope], 1, -1), 0)
        times = ts[scope]
        for at in np.split(np.arange(len(segments)), np.flatnonzero(np.diff(segments)) + 1) if len(segments) else []:
            if segments[at[0]] != self.segment:
                self.segment, self.walk = segments[at[0]], np.zeros_like(self.walk)
            free = self.walk + np.cumsum(steps[at], axis=0)
            level = free - np.minimum(np.minimum.accumulate(free, axis=0), 0)
            self.walk = level[-1]
            self.top = np.maximum(self.top, level.max(axis=0))
            crossed = level >= self.threshold
            new = np.isnan(self.first) & crossed.any(axis=0)
            self.first[new] = times[at][crossed.argmax(axis=0)[new]]

    def result(self) -> pd.DataFrame:
        c = self.counts
        n, k = sum(c.values()), len(self.walk)
        bottom = 1.25 * c["tp"] + 0.25 * c["fn"] + c["fp"]
        alarm = self.top >= self.threshold
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = {name: np.repeat(total / seen, self.per) for name, (total, seen) in self.sums.items()}
            out = {
                "case_key": self.key, "asset_id": self.asset, "configuration_id": np.arange(k, dtype=np.int32), "is_anomaly": self.anomaly, "rows": self.rows, "actionable_rows": self.acted, **c, "accuracy": (c["tn"] + c["tp"]) / n,
                "coverage_fbeta": np.where(bottom > 0, 1.25 * c["tp"] / bottom, 0.0) if self.anomaly else np.nan, "earliness": self.early / self.early_all if self.anomaly else np.nan, "maximum_criticality": self.top, "event_alarm": alarm,
                "lead_hours": np.where(alarm & self.anomaly, (self.end - self.first) / 3600, np.nan), "mean_width": mean["width"], "mean_covered": mean["covered"], "mean_interval_score": mean["interval_score"],
            }
        return pd.DataFrame(out)[self.known]


def _walk(configurations: int, families: int, threshold: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case = None
        for frame in frames:
            keys = frame["case_key"].to_numpy()
            for at in np.split(np.arange(len(keys)), np.flatnonzero(keys[1:] != keys[:-1]) + 1) if len(keys) else []:
                part = frame.iloc[at]
                if case is None or case.key != keys[at[0]]:
                    if case is not None:
                        yield case.result()
                    case = _Case(next(part.itertuples()), configurations, families, threshold)
                case.add(part)
        if case is not None:
            yield case.result()

    return run


def case_metrics(rows: DataFrame, outcomes: DataFrame, grid: Grid, threshold: int = 72, key: str = "case_key", ts: str = "ts") -> DataFrame:
    """One row per case and available configuration (METRIC_SCHEMA) from candidates' rows.

    outcomes: (key, asset_id, is_anomaly, event_start, event_end). Truth is the event interval; actionable rows are
    those of normal status, all rows of farm A's anomaly cases. Walks restart with each segment, and of anomaly cases
    only rows up to the event's end are walked. Interval means are over actionable rows. A case's rows are streamed in
    the order of time past sums of constant size, so a long case needs no more memory than a short one.
    """
    joined = rows.join(outcomes, key)
    seconds = lambda c: F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c).cast("double")
    truth = F.col("is_anomaly") & S.in_interval(F.col(ts), F.col("event_start"), F.col("event_end"))
    span = F.greatest(seconds(F.col("event_end")) - seconds(F.col("event_start")), F.lit(0.0))
    position = F.when(span > 0, (seconds(F.col(ts)) - seconds(F.col("event_start"))) / span).otherwise(0.0)
    narrow = joined.select(
        F.col(key).alias("case_key"), F.col("asset_id").cast("string"), "is_anomaly", seconds(F.col("event_end")).alias("event_end"), seconds(F.col(ts)).alias("ts_s"), "segment_id", S.actionable(F.substring_index(key, "/", 1), F.col("is_anomaly"), F.col("status_type_id")).alias("actionable"),
        truth.alias("truth"), F.when(truth, S.earliness_weight(position)).otherwise(0.0).alias("early"), "alarms", "width", "covered", "interval_score",
    )
    return narrow.repartition("case_key").sortWithinPartitions("case_key", "ts_s").mapInPandas(_walk(grid.size, grid.families, threshold), METRIC_SCHEMA)


_SUMS = ("a", "n", "f", "ws", "acc", "a_alarm", "n_alarm", "w", "wn")


def nested_selection(metrics: DataFrame, configs: DataFrame, inner: DataFrame) -> DataFrame:
    """(outer_asset, configuration_id, care and the ranking's other keys, inner means) of the configuration that is best
    on all other assets.

    metrics: case_metrics; inner: (asset_id, inner_fold), the folds of the development assets. Scores of the others are
    sums over all assets less the outer one's, and of an inner fold the fold's sums less the outer one's if it lies
    there; a fold with no anomaly or no normal case has no score. The ranking: score, normal accuracy, event
    reliability, narrow intervals, then the least coverage, r2, head, window, quantile and number."""
    anomaly, alarm = F.col("is_anomaly"), F.col("event_alarm")
    parts = metrics.groupBy("asset_id", "configuration_id").agg(
        F.count_if(anomaly).alias("a"), F.count_if(~anomaly).alias("n"), F.coalesce(F.sum(F.when(anomaly, F.col("coverage_fbeta"))), F.lit(0.0)).alias("f"), F.coalesce(F.sum(F.when(anomaly, F.col("earliness"))), F.lit(0.0)).alias("ws"), F.coalesce(F.sum(F.when(~anomaly, F.col("accuracy"))), F.lit(0.0)).alias("acc"),
        F.count_if(anomaly & alarm).alias("a_alarm"), F.count_if(~anomaly & alarm).alias("n_alarm"), F.coalesce(F.sum(F.when(~anomaly & ~F.isnan("mean_width"), F.col("mean_width"))), F.lit(0.0)).alias("w"), F.count_if(~anomaly & ~F.isnan("mean_width")).alias("wn"),
    ).join(inner, "asset_id")
    of_fold = parts.groupBy("configuration_id", "inner_fold").agg(*(F.sum(c).alias(c) for c in _SUMS))
    packed = of_fold.groupBy("configuration_id").agg(F.collect_list(F.struct("inner_fold", *_SUMS)).alias("_folds"))
    own = parts.select("asset_id", "configuration_id", F.struct("inner_fold", *_SUMS).alias("_own"))
    joined = own.join(packed, "configuration_id")
    total = lambda c: F.aggregate(F.transform("_folds", lambda x: x[c].cast("double")), F.lit(0.0), lambda s, v: s + v)
    less = F.transform("_folds", lambda x: F.struct(*((x[c] - F.when(x["inner_fold"] == F.col("_own.inner_fold"), F.col(f"_own.{c}")).otherwise(0)).alias(c) for c in _SUMS)))
    joined = joined.withColumn("_folds", less).withColumn("_all", F.struct(*(total(c).alias(c) for c in _SUMS)))

    def reliability(x: Column) -> Column:
        return S.f_beta(x["a_alarm"], x["n_alarm"], x["a"] - x["a_alarm"])

    def care(x: Column) -> Column:
        return F.when((x["a"] > 0) & (x["n"] > 0), S.care_score(x["f"] / x["a"], x["ws"] / x["a"], reliability(x), x["acc"] / x["n"], x["a_alarm"] + x["n_alarm"]))

    inner_scores = F.filter(F.transform("_folds", care), lambda v: v.isNotNull())
    scored = joined.withColumn("_inner", inner_scores).select(
        F.col("asset_id").alias("outer_asset"), "configuration_id", care(F.col("_all")).alias("care"), F.when(F.col("_all.n") > 0, F.col("_all.acc") / F.col("_all.n")).alias("normal_accuracy"), reliability(F.col("_all")).alias("event_reliability"), F.when(F.col("_all.wn") > 0, F.col("_all.w") / F.col("_all.wn")).alias("mean_width"),
        F.size("_inner").alias("defined_inner_folds"), F.when(F.size("_inner") > 0, _total(F.col("_inner")) / F.size("_inner")).alias("mean_inner_care"), F.array_min("_inner").alias("minimum_inner_care"),
    ).where("care IS NOT NULL").join(F.broadcast(configs), "configuration_id")
    up, down = F.asc_nulls_last, F.desc
    order = [down(F.round("care", 12)), down(F.round("normal_accuracy", 12)), down(F.round("event_reliability", 12)), up(F.round("mean_width", 9)), *(F.asc(c) for c in ("coverage", "minimum_r2", "evidence_head", "smoothing_steps", "threshold_quantile", "configuration_id"))]
    rank = F.row_number().over(Window.partitionBy("outer_asset").orderBy(*order))  # one row a configuration
    return scored.withColumn("_r", rank).where("_r = 1").drop("_r")


def freeze(rows: DataFrame, outcomes: DataFrame, selected: DataFrame, thresholds: DataFrame, grid: Grid, key: str = "case_key") -> DataFrame:
    """(key, ts, configuration_id, threshold, smoothed, alarm) of every candidate row, by the configuration that was
    selected for the row's asset."""
    per = len(grid.windows) * len(grid.quantiles)
    k = F.col("configuration_id")
    chosen = outcomes.select(key, "asset_id").join(selected.select(F.col("outer_asset").alias("asset_id"), "configuration_id"), "asset_id").join(thresholds.select(key, "thresholds"), key)
    chosen = chosen.select(key, "configuration_id", F.get("thresholds", k).alias("threshold"))
    value = F.get(F.get("smoothed", F.floor(k % per / len(grid.quantiles)).cast("int")), F.floor(k / per).cast("int"))
    return rows.join(chosen, key).select(key, "ts", "configuration_id", "threshold", value.alias("smoothed"), F.get("alarms", k).alias("alarm"))
