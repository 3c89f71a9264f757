"""Conformal calibration of a case: channels' intervals at a grid of coverages, fold-excluded check and ablation.

A panel has one row per case and time slot, with arrays over the channels: y and x, and what is made of them, residual,
scale and aleatoric. Models and calibration states are small tables, one row per case or per case and channel; they can
be written, read and joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helmwatch.operators import order_statistics as O

COVERAGES = (0.95, 0.98, 0.99)
FOLDS = 5
MIN_BLOCKS = 30
BLOCK_ROWS = 144
MIN_OBSERVED = 101


def _by_channel(entries: Column, channels: int, get) -> Column:
    """An array over channels from a map of them; channels that are missing are null."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: get(F.try_element_at(entries, c)))


def crossfit_lines(panel: DataFrame, channels: int, folds: int = FOLDS, penalty: float = 1.0, key: str = "case_key", fold: str = "fold_id") -> DataFrame:
    """One mean model a case from its fit rows: y of a channel by a ridge line on its x, the intercept free.

    Arrays over channels: r2 of the held-out errors, target_scale (quartile range of y), sd of the held-out errors, the
    final slope and intercept, mx, sxx and n for the leverage; slopes and intercepts hold an array a fold, of the line
    that did not see it. All comes from sums by case, channel and fold; a fold's line is that of the total less its own
    sums. A channel without a value has nulls."""
    long = panel.where("fit").select(key, fold, F.posexplode(F.arrays_zip("x", "y")).alias("channel", "p"))
    long = long.select(key, fold, "channel", F.col("p.x").cast("double").alias("x"), F.col("p.y").alias("y")).where("y IS NOT NULL AND x IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    s = long.groupBy(key, "channel", fold).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    names = ("n", "sx", "sy", "sxx", "sxy", "syy")
    of_channel = Window.partitionBy(key, "channel")  # at most `folds` rows
    s = s.select("*", *(F.sum(c).over(of_channel).alias(f"t_{c}") for c in names))

    def line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
        slope = (sxy - sx * sy / n) / (sxx - sx * sx / n + penalty)
        return slope, sy / n - slope * sx / n

    rest = [F.col(f"t_{c}") - F.col(c) for c in names[:5]]
    slope, intercept = line(*rest)
    s = s.withColumns({"a": F.when(rest[0] > 0, intercept), "b": F.when(rest[0] > 0, slope), "m": F.when(rest[0] > 0, rest[2] / rest[0])})
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in names)
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    error = syy - 2 * a * sy - 2 * b * sxy + n * a * a + 2 * a * b * sx + b * b * sxx
    base = syy - 2 * m * sy + n * m * m
    one = s.groupBy(key, "channel").agg(
        *(F.max(f"t_{c}").alias(c) for c in names), F.sum(error).alias("sse"), F.sum(base).alias("base"), F.map_from_entries(F.collect_list(F.struct(F.col(fold).cast("int").alias("k"), F.struct("a", "b")))).alias("lines")
    )
    slope, intercept = line(*(F.col(c) for c in names[:5]))
    q = O.linear_quantiles(long, "y", (0.25, 0.75), key, "channel").select(key, "channel", (F.get("q", 1) - F.get("q", 0)).alias("iqr"))
    one = one.join(q, [key, "channel"]).select(
        key, "channel", slope.alias("slope"), intercept.alias("intercept"), (F.col("sx") / F.col("n")).alias("mx"), (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n") + penalty).alias("sxx"), "n", F.sqrt(F.greatest(F.col("sse"), F.lit(0.0)) / F.col("n")).alias("sd"),
        F.when(F.col("base") > 1e-12, 1 - F.col("sse") / F.col("base")).alias("r2"), F.when(F.col("iqr") > 1e-12, F.col("iqr")).otherwise(1.0).alias("target_scale"), "lines",
    )
    fields = ("slope", "intercept", "mx", "sxx", "n", "sd", "r2", "target_scale")
    packed = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct(*fields, "lines")))).alias("_c"))
    of_fold = lambda f: F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: _by_channel(F.col("_c"), channels, lambda c: F.try_element_at(c["lines"], k)[f]))
    return packed.select(key, *(_by_channel(F.col("_c"), channels, lambda c, f=f: c[f]).alias(f) for f in fields), of_fold("b").alias("slopes"), of_fold("a").alias("intercepts"))


def residuals(panel: DataFrame, models: DataFrame, crossfit: bool, key: str = "case_key", fold: str = "fold_id") -> DataFrame:
    """residual, aleatoric and scale of every row: by the line that did not see the row's fold, or by the final one.
    aleatoric is the deviation of the held-out errors; scale adds the leverage of x: sd * sqrt(1 + leverage),
    missing where x is."""
    joined = panel.join(models, key)
    slopes, intercepts = (F.get(c, F.col(fold).cast("int")) for c in ("slopes", "intercepts")) if crossfit else (F.col("slope"), F.col("intercept"))
    z = F.arrays_zip("y", F.col("x").alias("x"), slopes.alias("s"), intercepts.alias("i"), F.col("sd").alias("sd"), F.col("mx").alias("mx"), F.col("sxx").alias("sxx"), F.col("n").alias("n"))
    leverage = lambda v: 1 / v["n"] + (v["x"] - v["mx"]) * (v["x"] - v["mx"]) / v["sxx"]
    joined = joined.withColumn("_z", z)
    out = joined.withColumns({
        "residual": F.transform("_z", lambda v: v["y"] - v["i"] - v["s"] * v["x"]),
        "aleatoric": F.transform("_z", lambda v: v["sd"]),
        "scale": F.transform("_z", lambda v: v["sd"] * F.sqrt(1 + F.when(leverage(v) < 0, 0.0).otherwise(leverage(v)))),
    })
    return out.select(*panel.columns, "residual", "scale", "aleatoric")


def mark_blocks(panel: DataFrame, size: int = BLOCK_ROWS, key: str = "case_key", ts: str = "ts", row: str = "row_id", segment: str = "segment_id", fold: str = "fold_id") -> DataFrame:
    """The fit rows with run (unbroken in row number, segment and fold) and block, the number of the row's complete
    block of size rows within its run, null in a run's incomplete tail."""
    w = Window.partitionBy(key).orderBy(ts)
    same = (F.col(row) - F.lag(row).over(w) == 1) & (F.col(segment) == F.lag(segment).over(w)) & (F.col(fold) == F.lag(fold).over(w))
    out = panel.where("fit").withColumn("_b", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("_b").over(w))
    of_run = Window.partitionBy(key, "run")
    out = out.withColumn("_k", F.floor((F.row_number().over(of_run.orderBy(ts)) - 1) / size)).withColumn("_s", F.count("*").over(of_run))
    return out.withColumn("block", F.when((F.col("_k") + 1) * size <= F.col("_s"), F.concat_ws("/", "run", "_k"))).drop("_b", "_k", "_s")


def fit_case_conformal(rows: DataFrame, coverages: tuple[float, ...] = COVERAGES, folds: int = FOLDS, min_blocks: int = MIN_BLOCKS, min_observed: int = MIN_OBSERVED, key: str = "case_key", fold: str = "fold_id") -> DataFrame:
    """One state per case and channel, from cross-fitted rows with residual, scale, aleatoric and block.

    Scores are absolute residuals in units of scale; of a channel those in blocks with min_observed of them count. The
    quantile at a coverage is the order statistic at ceil(p * (n - 1)), where p = ceil((B + 1) * coverage) / B comes
    from the number of blocks, B; with fewer than min_blocks there is none. Ranks grow with the coverage, so quantiles
    do too. The struct total holds: blocks, quantiles; fold_quantiles, by the blocks of the other folds, and
    fold_heldout, their coverage of the fold; coverage and fold_coverage of the pooled quantiles, where every block
    weighs the same; simultaneous, the quantiles of block maxima, and lobo, their leave-one-block-out coverage. The
    struct aleatoric holds the same with the aleatoric scale, the ablation. A case without a scored block has no row.
    """
    score = lambda scale: F.when(F.col(f"p.{scale}") > 0, F.abs(F.col("p.residual")) / F.col(f"p.{scale}"))
    kinds = F.array(F.struct(F.lit("total").alias("kind"), score("scale").alias("score")), F.struct(F.lit("aleatoric").alias("kind"), score("aleatoric").alias("score")))
    long = rows.where("block IS NOT NULL").select(key, fold, "block", F.posexplode(F.arrays_zip("residual", "scale", "aleatoric")).alias("channel", "p"))
    long = long.select(key, fold, "block", "channel", F.explode(kinds).alias("_k")).select(key, fold, "block", "channel", "_k.*").where("score IS NOT NULL")
    state = (key, "channel", "kind")
    usable = long.withColumn("_n", F.count("*").over(Window.partitionBy(*state, "block"))).where(F.col("_n") >= min_observed).drop("_n")
    block = usable.groupBy(*state, "block", fold).agg(F.max("score").alias("maximum"))
    blocks = block.groupBy(*state).agg(F.count("*").alias("_blocks"), F.array(*(F.count_if(F.col(fold) == k) for k in range(folds))).alias("_own"), F.sort_array(F.collect_list("maximum")).alias("_maxima"))
    rank = lambda b, cov: F.greatest(F.lit(1), F.least(F.ceil((b + 1) * F.lit(float(cov))), b))

    def quantiles(k: int | None) -> Column:
        own, upto, n = O._complement(folds, k)
        b = F.col("_blocks") if k is None else F.col("_blocks") - F.get("_own", k)
        return F.array(*(O.at_rank(F.ceil(rank(b, c) / b * (n - 1)), "score", F.when(b >= min_blocks, own), upto) for c in coverages))

    ordered = O.fold_sums(usable, "score", fold, folds, *state).join(blocks, list(state))
    q = ordered.groupBy(*state).agg(F.max("_blocks").alias("blocks"), quantiles(None).alias("quantiles"), F.array(*(quantiles(k) for k in range(folds))).alias("fold_quantiles"), F.max("_maxima").alias("_maxima"))
    held = usable.join(q.select(*state, "quantiles", "fold_quantiles"), list(state))
    inside = lambda c, q_: F.avg((F.col("score") <= q_).cast("double"))
    c_range = range(len(coverages))
    shares = held.groupBy(*state, "block", fold).agg(*(inside(c, F.get("quantiles", c)).alias(f"_p{c}") for c in c_range), *(inside(c, F.get(F.get("fold_quantiles", F.col(fold).cast("int")), c)).alias(f"_h{c}") for c in c_range))
    mean = lambda name, k=None: F.avg(name if k is None else F.when(F.col(fold) == k, F.col(name)))
    covered = shares.groupBy(*state).agg(
        F.array(*(mean(f"_p{c}") for c in c_range)).alias("coverage"), F.array(*(F.array(*(mean(f"_p{c}", k) for c in c_range)) for k in range(folds))).alias("fold_coverage"),
        F.array(*(F.array(*(mean(f"_h{c}", k) for c in c_range)) for k in range(folds))).alias("fold_heldout"),
    )
    maxima, b = F.col("_maxima"), F.col("blocks")
    lobo = lambda c: F.greatest(F.lit(1), F.least(F.ceil(b * F.lit(float(c))), b - 1))
    threshold = lambda i, c: F.when(i < lobo(c), F.get(maxima, lobo(c).cast("int"))).otherwise(F.get(maxima, (lobo(c) - 1).cast("int")))
    hits = lambda c: F.aggregate(F.transform(maxima, lambda v, i: (v <= threshold(i, c)).cast("double")), F.lit(0.0), lambda s, v: s + v)
    enough = (b >= min_blocks) & (b >= 2)
    done = q.join(covered, list(state)).select(
        *state, "blocks", "quantiles", "fold_quantiles", "coverage", "fold_coverage", "fold_heldout",
        F.array(*(F.when(b >= min_blocks, F.get(maxima, (rank(b, c) - 1).cast("int"))) for c in coverages)).alias("simultaneous"), F.array(*(F.when(enough, hits(c) / b) for c in coverages)).alias("lobo"),
    )
    fields = F.struct(*(c for c in done.columns if c not in state))
    return done.groupBy(key, "channel").agg(*(F.first(F.when(F.col("kind") == kind, fields), ignorenulls=True).alias(kind) for kind in ("total", "aleatoric")))


def valid_state(q: Column) -> Column:
    """Every quantile is there, positive, and none falls as the coverage grows."""
    whole = ~F.exists(q, lambda v: F.coalesce(v, F.lit(0.0)) <= 0)
    return whole & F.forall(F.sequence(F.lit(1), F.size(q) - 1), lambda i: F.get(q, i) >= F.get(q, i - 1) - 1e-12)


def store_state(states: DataFrame, path: str) -> None:
    states.write.parquet(path)


def _load(spark: SparkSession, path: str, case: str | None, key: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored if case is None else stored.where(F.col(key) == case)


def load_case_conformal(spark: SparkSession, path: str, case: str | None = None, key: str = "case_key") -> DataFrame:
    """The stored states, of all cases or of one; the filter reaches the scan."""
    return _load(spark, path, case, key)


def load_case_mean_model(spark: SparkSession, path: str, case: str | None = None, key: str = "case_key") -> DataFrame:
    """The stored mean models of crossfit_lines, of all cases or of one."""
    return _load(spark, path, case, key)


def predict_case_mean(rows: DataFrame, models: DataFrame, key: str = "case_key") -> DataFrame:
    """prediction[channel] by the final lines; missing where x or the model is."""
    joined = rows.join(models.select(key, "slope", "intercept"), key)
    z = F.arrays_zip("x", "slope", "intercept")
    return joined.withColumn("prediction", F.transform(z, lambda v: v["intercept"] + v["slope"] * v["x"])).select(*rows.columns, "prediction")


def case_arrays(states: DataFrame, channels: int, coverages: int, folds: int, key: str = "case_key") -> DataFrame:
    """One row a case: multipliers[coverage][channel], fold_multipliers[fold][coverage][channel], heldout likewise and
    calibrated[channel]; channels without a state are null."""
    packed = states.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("channel", "total"))).alias("_s"))
    grid = lambda n, of: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)
    per = lambda of: _by_channel(F.col("_s"), channels, of)
    usable = lambda s: F.coalesce(s["quantiles"].isNotNull() & ~F.exists(s["quantiles"], lambda v: v.isNull()), F.lit(False))
    return packed.select(
        key, grid(coverages, lambda c: per(lambda s: F.get(s["quantiles"], c))).alias("multipliers"), grid(folds, lambda k: grid(coverages, lambda c: per(lambda s: F.get(F.get(s["fold_quantiles"], k), c)))).alias("fold_multipliers"),
        grid(folds, lambda k: grid(coverages, lambda c: per(lambda s: F.get(F.get(s["fold_heldout"], k), c)))).alias("heldout"), per(usable).alias("calibrated"),
    )


def predict_case_interval(rows: DataFrame, arrays: DataFrame, coverage: int, key: str = "case_key") -> DataFrame:
    """half_width of every channel at one coverage of the grid: scale times the case's multiplier."""
    joined = rows.join(arrays.select(key, F.get("multipliers", coverage).alias("_m")), key)
    return joined.withColumn("half_width", F.zip_with("scale", "_m", lambda s, m: s * m)).drop("_m")


def score_case_conformal(rows: DataFrame, arrays: DataFrame, coverages: tuple[float, ...], key: str = "case_key") -> DataFrame:
    """(key, channel, coverage, rows, covered, mean_width): how the stored intervals fare on rows, all coverages in
    one pass over arrays; only sums leave it."""
    joined = rows.join(arrays.select(key, "multipliers"), key)
    long = joined.select(key, F.posexplode(F.arrays_zip("residual", "scale")).alias("channel", "p"), "multipliers")
    half = lambda c: F.col("p.scale") * F.get(F.get("multipliers", c), F.col("channel"))
    seen = lambda c: F.when(half(c).isNotNull(), F.col("p.residual")).isNotNull()
    one = [F.struct(F.lit(float(v)).alias("coverage"), F.count_if(seen(c)).alias("rows"), F.avg(F.when(seen(c), (F.abs("p.residual") <= half(c)).cast("double"))).alias("covered"), F.avg(F.when(seen(c), 2 * half(c))).alias("mean_width")) for c, v in enumerate(coverages)]
    return long.groupBy(key, "channel").agg(F.array(*one).alias("_c")).select(key, "channel", F.explode("_c").alias("_c")).select(key, "channel", "_c.*")
