"""Cross-fitted ridge models of many targets on a nonlinear design that every fold makes for itself.

Rows carry drivers and targets as arrays, and bits that say for which folds they train. All folds are served together:
scalers are quantiles with one measure a fold, Gram matrices are sums by case, fold and observation mask, and the
clipped held-out errors of all penalties are one array a row, summed map-side. A case is never gathered in a task; only
its Gram sums, one row a fold and mask, are solved in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmwatch.functions.scalars import DRIVER_PHRASES
from helmwatch.operators import order_statistics as O
from helmwatch.operators.ridge import PENALTIES, solve

CLIP = 10.0
MIN_ROWS = 200
CORE = 5
TINY = 1e-12


@dataclass(frozen=True)
class Design:
    """Terms over named drivers: the drivers, an indicator of missing values for each of `indicators`, squares, the cube
    of wind speed, and products of pairs of core drivers."""

    drivers: tuple[str, ...]
    indicators: tuple[str, ...] = ()
    nonlinear: bool = True

    def core(self) -> list[int]:
        """Up to CORE drivers: by the first phrase that their names hold, then by name."""
        spoken = {n: n.lower().replace("_", " ") for n in self.drivers}
        rank = {n: next((i for i, phrase in enumerate(DRIVER_PHRASES) if phrase in spoken[n]), len(DRIVER_PHRASES)) for n in self.drivers}
        return [self.drivers.index(n) for n in sorted(self.drivers, key=lambda n: (rank[n], n))[:CORE]]

    def names(self) -> list[str]:
        out = [f"linear::{n}" for n in self.drivers] + [f"missing::{n}" for n in self.indicators]
        if self.nonlinear:
            out += [f"quadratic::{n}" for n in self.drivers]
            out += [f"cubic::{n}" for n in self.drivers if "wind speed" in n.lower().replace("_", " ")]
            out += [f"interaction::{self.drivers[a]}*{self.drivers[b]}" for a, b in combinations(self.core(), 2)]
        return out

    def terms(self, z: list[Column], missing: list[Column]) -> Column:
        """The array of the terms of standardised drivers; missing: 1.0 or 0.0 a driver."""
        out = [*z, *(missing[self.drivers.index(n)] for n in self.indicators)]
        if self.nonlinear:
            out += [v * v for v in z]
            out += [v * v * v for n, v in zip(self.drivers, z, strict=True) if "wind speed" in n.lower().replace("_", " ")]
            out += [z[a] * z[b] for a, b in combinations(self.core(), 2)]
        return F.array(*out)


def training_bits(fit: Column, embargo_bits: Column, folds: int) -> Column:
    """Bit k: the row trains for fold k, being a fit row out of its embargo; bit `folds`: it is a fit row."""
    every = (1 << (folds + 1)) - 1
    return F.when(fit, F.lit(every) - embargo_bits.cast("int").bitwiseAND((1 << folds) - 1)).otherwise(0)


def _bit(k: int) -> Column:
    return F.shiftright("train_bits", k).bitwiseAND(1)


def location_scale(long: DataFrame, value: str, folds: int, *keys: str, fill: bool = False, kept=lambda df, name: df) -> DataFrame:
    """(keys, found): an array over the folds and the whole of (center, scale, active, n) of the rows that train for
    each: median and quartile range, the population deviation where that vanishes, inactive with scale 1 where both do.
    n counts observed values. fill: missing values count as the median. kept: how what is used twice is stored."""
    every = range(folds + 1)
    ordered = kept(O.ordered_sums(long, value, {f"t{k}": _bit(k) for k in every}, *keys), "ordered-values")
    own = lambda k: (F.col(f"t{k}"), F.col(f"t{k}_upto"), F.col(f"t{k}_n"))
    middle = ordered.groupBy(*keys).agg(F.array(*(O.linear(0.5, value, *own(k)) for k in every)).alias("_m"), F.array(*(F.max(f"t{k}_n") for k in every)).alias("_obs"))
    v = F.col(value)
    sums = long.groupBy(*keys).agg(F.array(*(F.sum(_bit(k)) if fill else F.sum(_bit(k) * v.isNotNull().cast("int")) for k in every)).alias("_n"), F.array(*(F.sum(_bit(k) * v) for k in every)).alias("_s1"), F.array(*(F.sum(_bit(k) * v * v) for k in every)).alias("_s2"))
    known = middle.join(sums, list(keys))
    joined = ordered.join(known, list(keys))

    def quantile(p: float, k: int) -> Column:
        n, missing, m = F.get("_n", k), F.get("_n", k) - F.get("_obs", k), F.get("_m", k)

        def at(rank: Column) -> Column:
            low, high = O.at_rank(rank, value, *own(k)[:2]), O.at_rank(rank - missing, value, *own(k)[:2])
            one = F.max(m)
            return F.when(low < one, low).when(high > one, high).otherwise(one)

        place = F.lit(p) * (n - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + F.max(place - F.floor(place)) * (high - low)

    q = joined.groupBy(*keys).agg(F.array(*(quantile(0.75, k) - quantile(0.25, k) for k in every)).alias("_iqr"))
    out = q.join(known, list(keys))

    def state(k: int) -> Column:
        n, m = F.get("_n", k), F.get("_m", k)
        gaps = (F.get("_n", k) - F.get("_obs", k)) * m
        mean = (F.get("_s1", k) + gaps) / n
        sd = F.sqrt(F.greatest((F.get("_s2", k) + gaps * m) / n - mean * mean, F.lit(0.0)))
        iqr = F.get("_iqr", k)
        scale = F.when(iqr > TINY, iqr).when(sd > 1e-7 * F.greatest(F.lit(1.0), F.abs(m)), sd)
        return F.struct(m.alias("center"), F.coalesce(scale, F.lit(1.0)).alias("scale"), (scale.isNotNull() & (F.get("_obs", k) > 0)).alias("active"), F.get("_obs", k).alias("n"))

    return out.select(*keys, F.array(*(state(k) for k in every)).alias("found"))


def _packed(states: DataFrame, key: str, index: str, size: int, folds: int, name: str) -> DataFrame:
    """(key, name[fold][index]) of states (key, index, found[fold])."""
    one = states.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(index, "found"))).alias("_f"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(folds)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(F.try_element_at("_f", i), k)))
    return one.select(key, grid.alias(name))


def scaled_design(rows: DataFrame, design: Design, folds: int, key: str = "case_key", kept=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """rows with design[fold][term] and scaled[fold][target], and the state of each case that made them: drivers
    standardised by what trains for the fold, terms scaled again, terms without a scale zero. kept: how tables that
    are used twice are stored."""
    d = len(design.drivers)
    long = rows.select(key, "train_bits", F.posexplode("drivers").alias("driver", "v"))
    drivers = _packed(location_scale(long, "v", folds, key, "driver", fill=True, kept=kept), key, "driver", d, folds, "driver_state")
    joined = rows.join(kept(drivers, "driver-states"), key)

    def terms(k: int) -> Column:
        state = lambda i: F.get(F.get("driver_state", k), i)
        value = lambda i: F.get("drivers", i)
        z = [F.coalesce((value(i) - state(i)["center"]) / state(i)["scale"], F.lit(0.0)) for i in range(d)]
        return design.terms(z, [value(i).isNull().cast("double") for i in range(d)])

    raw = kept(joined.withColumn("raw", F.array(*map(terms, range(folds + 1)))), "raw-designs")
    p = len(design.names())
    each = raw.select(key, "train_bits", F.posexplode("raw").alias("k", "_r")).where(F.expr("shiftright(train_bits, k) & 1 = 1")).select(key, "k", F.posexplode("_r").alias("term", "v"))
    q = O.linear_quantiles(each, "v", (0.25, 0.5, 0.75), key, "k", "term")
    sd = each.groupBy(key, "k", "term").agg(F.stddev_pop("v").alias("sd"))
    iqr = F.get("q", 2) - F.get("q", 0)
    scale = F.when(iqr > TINY, iqr).when(F.col("sd") > TINY, F.col("sd"))
    term = q.join(sd, [key, "k", "term"]).select(key, "k", "term", F.struct(F.get("q", 1).alias("center"), scale.alias("scale")).alias("s"))
    terms_of = term.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("k") * p + F.col("term")).alias("i"), "s"))).alias("_t"))
    term_state = kept(terms_of.select(key, F.transform(F.sequence(F.lit(0), F.lit(folds)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.try_element_at("_t", k * p + i))).alias("term_state")), "term-states")
    y = rows.select(key, "train_bits", F.posexplode("targets").alias("target", "v"))
    t = rows.agg(F.max(F.size("targets"))).first()[0] or 0
    targets = kept(_packed(location_scale(y, "v", folds, key, "target", kept=kept), key, "target", t, folds, "target_state"), "target-states")
    states = drivers.join(term_state, key).join(targets, key)
    scaled = lambda x, s: F.when(s["scale"].isNotNull(), (x - s["center"]) / s["scale"]).otherwise(0.0)
    full = raw.join(term_state, key).join(targets, key)
    out = full.withColumns({
        "design": F.zip_with("raw", "term_state", lambda r, s: F.zip_with(r, s, scaled)),
        "scaled": F.transform("target_state", lambda s: F.zip_with("targets", s, lambda v, x: F.when(x["active"], (v - x["center"]) / x["scale"]))),
    })
    return out.drop("raw", "term_state", "target_state", "driver_state"), states


def observation_masks(rows: DataFrame, folds: int, key: str = "case_key", row: str = "row_id") -> DataFrame:
    """(key, k, target, mask_id, observed): targets whose training rows for a fold are observed at the same rows share
    a mask_id, the least of them. Masks are compared by an order-free digest: the count, the sum and the exclusive or
    of the observed rows' hashes."""
    long = rows.select(key, row, F.posexplode("scaled").alias("k", "_y"), "train_bits").where(F.expr("shiftright(train_bits, k) & 1 = 1")).select(key, row, "k", F.posexplode("_y").alias("target", "y")).where("y IS NOT NULL")
    h = F.xxhash64(row)
    digest = long.groupBy(key, "k", "target").agg(F.count("*").alias("observed"), F.struct(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("s"), F.bit_xor(h).alias("x")).alias("digest"))
    least = digest.groupBy(key, "k", "digest").agg(F.min("target").alias("mask_id"))
    return digest.join(least, [key, "k", "digest"]).select(key, "k", "target", "mask_id", "observed")


def grams(rows: DataFrame, masks: DataFrame, p: int, key: str = "case_key") -> DataFrame:
    """(key, k, mask_id, n, xx, xy): one Gram matrix, with a constant first, for every fold and distinct mask, and the
    cross products of all targets of the mask, as an array of (target, products)."""
    used = masks.groupBy(key).agg(F.collect_set(F.struct("k", "mask_id")).alias("_masks"))
    x = [F.lit(1.0), *(F.get("_x", i) for i in range(p))]
    wide = rows.join(used, key).select(key, "train_bits", "design", "scaled", F.explode("_masks").alias("_u")).where(F.expr("shiftright(train_bits, _u.k) & 1 = 1"))
    wide = wide.select(key, F.col("_u.k").alias("k"), F.col("_u.mask_id").alias("mask_id"), F.get("design", F.col("_u.k")).alias("_x"), F.get("scaled", F.col("_u.k")).alias("_y")).where(F.get("_y", F.col("mask_id")).isNotNull())
    xx = wide.groupBy(key, "k", "mask_id").agg(F.count("*").alias("n"), F.array(*(F.sum(x[i] * x[j]) for i in range(p + 1) for j in range(i, p + 1))).alias("xx"))
    y = wide.select(key, "k", "mask_id", "_x", F.posexplode("_y").alias("target", "y")).join(masks.select(key, "k", "mask_id", "target"), [key, "k", "mask_id", "target"])
    xy = y.groupBy(key, "k", "mask_id", "target").agg(F.array(*(F.sum(v * F.col("y")) for v in x)).alias("xy")).groupBy(key, "k", "mask_id").agg(F.collect_list(F.struct("target", "xy")).alias("xy"))
    return xx.join(xy, [key, "k", "mask_id"])


def _solve(penalties: tuple[float, ...], min_rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                p = len(r.xy[0]["xy"])
                if r.n < max(min_rows, p + 10):
                    continue
                gram = np.zeros((p, p))
                gram[np.triu_indices(p)] = r.xx
                gram += np.triu(gram, 1).T
                right = np.array([v["xy"] for v in r.xy], float).T
                for j, penalty in enumerate(penalties):
                    found = solve(gram, right, penalty)
                    out += [(r.case_key, r.k, v["target"], j, found[:, i].tolist()) for i, v in enumerate(r.xy)]
            yield pd.DataFrame(out, columns=["case_key", "k", "target", "penalty", "coefficients"])

    return run


def solve_grams(sums: DataFrame, penalties: tuple[float, ...] = PENALTIES, min_rows: int = MIN_ROWS) -> DataFrame:
    """(case_key, k, target, penalty, coefficients) of every Gram with enough rows, all right-hand sides at once."""
    return sums.mapInPandas(_solve(penalties, min_rows), "case_key string, k int, target int, penalty int, coefficients array<double>")


def _with_coefficients(rows: DataFrame, solved: DataFrame, fold: str, key: str) -> DataFrame:
    """One row per row and target: the row's design and scaled value of its own fold, beside the target's solutions."""
    of = solved.groupBy(key, "k", "target").agg(F.map_from_entries(F.collect_list(F.struct("penalty", "coefficients"))).alias("_c"))
    mine = rows.where(F.expr("train_bits > 0")).select(key, F.col(fold).cast("int").alias("k"), "row_id", F.get("design", F.col(fold).cast("int")).alias("_x"), F.posexplode(F.get("scaled", F.col(fold).cast("int"))).alias("target", "y")).where("y IS NOT NULL")
    return mine.join(of, [key, "k", "target"])


def _predicted(coefficients: Column) -> Column:
    return F.get(coefficients, 0) + F.aggregate(F.zip_with("_x", F.slice(coefficients, 2, F.size("_x")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def penalty_errors(rows: DataFrame, solved: DataFrame, penalties: tuple[float, ...] = PENALTIES, key: str = "case_key", fold: str = "fold_id") -> DataFrame:
    """(key, errors, observations, selected): the mean squared held-out residual of every penalty, in units of the
    target's scale and clipped at CLIP, over all folds and targets; of nearly equal ones the last penalty is selected."""
    held = _with_coefficients(rows, solved, fold, key)
    off = lambda j: F.least(F.greatest(F.col("y") - _predicted(F.try_element_at("_c", F.lit(j))), F.lit(-CLIP)), F.lit(CLIP))
    sums = held.groupBy(key).agg(F.array(*(F.avg(off(j) * off(j)) for j in range(len(penalties)))).alias("errors"), F.count("*").alias("observations"))
    near = F.filter(F.transform("errors", lambda e, j: F.when(e <= F.array_min("errors") * (1 + 1e-12) + 1e-12, j)), lambda j: j.isNotNull())
    return sums.withColumn("selected", F.array_max(near))


def held_out_r2(rows: DataFrame, solved: DataFrame, selected: DataFrame, states: DataFrame, min_rows: int = MIN_ROWS, key: str = "case_key", fold: str = "fold_id") -> DataFrame:
    """(key, target, n, r2): held-out squared errors at the selected penalty against those of the training means, in
    raw units, as the folds' scales differ; null below min_rows. states: those of scaled_design."""
    long = rows.select(key, "train_bits", F.posexplode("scaled").alias("k", "_y")).where(F.expr("shiftright(train_bits, k) & 1 = 1")).select(key, "k", F.posexplode("_y").alias("target", "y"))
    means = long.groupBy(key, "k", "target").agg(F.avg("y").alias("mean"))
    units = states.select(key, F.posexplode("target_state").alias("k", "_s")).select(key, "k", F.posexplode("_s").alias("target", "_s")).select(key, "k", "target", F.col("_s.scale").alias("unit"))
    held = _with_coefficients(rows, solved, fold, key).join(selected.select(key, "selected"), key).join(means, [key, "k", "target"]).join(units, [key, "k", "target"])
    off = (F.col("y") - _predicted(F.try_element_at("_c", F.col("selected")))) * F.col("unit")
    base = (F.col("y") - F.col("mean")) * F.col("unit")
    out = held.groupBy(key, "target").agg(F.count("*").alias("n"), F.sum(off * off).alias("_e"), F.sum(base * base).alias("_b"))
    return out.select(key, "target", "n", F.when((F.col("n") >= min_rows) & (F.col("_b") > TINY), 1 - F.col("_e") / F.col("_b")).alias("r2"))
