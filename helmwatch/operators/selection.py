"""Masks, donor sets, duplicate-safe reductions, policies and digests of the selection stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmwatch.functions import scalars as S

# Tokens of column names and how differing duplicates of such a column are reduced.
MEAN_TOKENS = ("fraction", "rate", "percent", "ratio")
SUM_TOKENS = ("count", "rows", "windows", "points", "values")
#: Least held-out R2 of the modelability masks, and the grid of nominal false-alarm levels.
MODELABILITY = (0.0, 0.1, 0.3)
ALPHAS = (0.02, 0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50, 0.60)


def refused(wrong: Column, message: str) -> Column:
    """A condition for a filter: true for every row, but a row that is wrong fails the query. Unlike a check in a
    column it can not be pruned with the column."""
    return F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def left_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that keeps every left row once: a key of the left side that occurs twice on the right fails the query,
    whatever is read of its result."""
    rest = [c for c in right.columns if c not in keys]
    message = "a key of the right side is not unique"
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in rest))
    checked = one.where(refused(F.col("_n") > 1, message))
    # The second filter reads a column of the right side, so that the join stays when no other column of it is read.
    return left.join(checked, keys, "left").where(refused(F.coalesce("_n", F.lit(1)) > 1, message)).drop("_n")


def with_assignment(rows: DataFrame, assignment: DataFrame, key: str, column: str) -> DataFrame:
    """rows with their key's assignment; a row whose key has none fails the query."""
    joined = rows.join(assignment.select(key, column), key, "left")
    return joined.where(refused(F.col(column).isNull(), "a key has no assignment"))


def masked_means(df: DataFrame, mask: Column, columns: tuple[str, ...], *keys: str) -> DataFrame:
    """Means of the finite values of rows in mask, one column each; a group without any has null."""
    return df.groupBy(*keys).agg(*(F.avg(F.when(mask, S.number(F.col(c)))).alias(c) for c in columns))


def reduction_rule(column: str) -> str:
    name = column.lower()
    return "mean" if any(t in name for t in MEAN_TOKENS) else "sum" if any(t in name for t in SUM_TOKENS) else "median"


def reduce_duplicates(df: DataFrame, columns: tuple[str, ...], *keys: str, rule: str | None = None) -> DataFrame:
    """One value a key and column: equal duplicates are kept as they are, different ones are reduced by rule, or by
    the rule that the column's name tells. Missing values do not count."""

    def reduced(c: str) -> Column:
        v = S.number(F.col(c))
        how = rule or reduction_rule(c)
        other = {"mean": F.avg(v), "sum": F.sum(v), "median": F.percentile(v, F.lit(0.5)), "first": F.first(v, ignorenulls=True)}[how]
        low, high = F.min(v), F.max(v)
        same = high - low <= 1e-12 + 1e-12 * F.abs(low)
        return F.when(same, low).otherwise(other).alias(c)

    return df.groupBy(*keys).agg(*map(reduced, columns))


def scaled_mad(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """1.4826 times the median absolute deviation, plus 1e-12 so that it can divide. Deviations need the medians."""
    v = S.number(F.col(value))
    middle = df.groupBy(*keys).agg(F.percentile(v, F.lit(0.5)).alias("_m"))
    return df.join(middle, list(keys)).groupBy(*keys).agg((1.4826 * F.percentile(F.abs(v - F.col("_m")), F.lit(0.5)) + 1e-12).alias("scaled_mad"))


def modelability_masks(models: DataFrame, r2: str, fitted: Column, thresholds: tuple[float, ...] = MODELABILITY) -> DataFrame:
    """models, each once for every threshold, with modelable: all its fits succeeded and its R2 reaches the threshold."""
    grid = models.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return grid.withColumn("modelable", fitted & S.number(F.col(r2)).isNotNull() & F.coalesce(F.col(r2) >= F.col("threshold"), F.lit(False)))


def head_masks(targets: DataFrame, eligible: Column, temperature: Column) -> DataFrame:
    """targets, each once for both evidence heads, with in_head: eligible, and for the temperature head a temperature."""
    heads = targets.withColumn("evidence_head", F.explode(F.array(F.lit("all_modellable"), F.lit("temperature_modellable"))))
    return heads.withColumn("in_head", eligible & ((F.col("evidence_head") == "all_modellable") | temperature))


def donor_sets(cases: DataFrame, asset: str, normal: Column, value: str) -> DataFrame:
    """(asset, held_out, donors, donor_sum): for cases of an asset, with another asset held out, the normal cases of
    neither asset. Totals less the two assets' own shares: no pair of cases is made, only of assets."""
    own = cases.groupBy(F.col(asset).alias("asset")).agg(F.count_if(normal).alias("n"), F.coalesce(F.sum(F.when(normal, F.col(value))), F.lit(0.0)).alias("s"))
    total = own.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    held = own.select(F.col("asset").alias("held_out"), F.col("n").alias("held_n"), F.col("s").alias("held_s"))
    both = own.crossJoin(held).crossJoin(F.broadcast(total))
    other = (F.col("asset") != F.col("held_out")).cast("int")
    return both.select("asset", "held_out", (F.col("all_n") - F.col("n") - other * F.col("held_n")).alias("donors"), (F.col("all_s") - F.col("s") - other * F.col("held_s")).alias("donor_sum"))


def fold_views(assignment: DataFrame, fold: str) -> DataFrame:
    """(outer_fold, role, and the assignment's columns): each row once for every outer fold, as validation where the
    fold is its own and as development elsewhere. Folds are few by what they are."""
    folds = assignment.select(F.col(fold).alias("outer_fold")).distinct()
    return assignment.crossJoin(F.broadcast(folds)).withColumn("role", F.when(F.col(fold) == F.col("outer_fold"), "validation").otherwise("development"))


def assignment_digest(assignment: DataFrame, asset: str, fold: str, *keys: str, block: int = 1000) -> DataFrame:
    """A digest of a key's assignment that depends on its rows alone: blocks of consecutive asset numbers are hashed in
    order, then the blocks' hashes; no list is longer than a block or than the number of blocks."""
    line = F.concat_ws("|", F.col(asset).cast("string"), F.col(fold).cast("string"))
    ordered = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "\n")
    blocks = assignment.groupBy(*keys, F.floor(F.col(asset) / block).alias("_block")).agg(F.sha2(ordered(F.col(asset), line), 256).alias("_digest"), F.count("*").alias("_rows"))
    return blocks.groupBy(*keys).agg(F.sum("_rows").alias("assets"), F.sha2(ordered(F.col("_block"), F.col("_digest")), 256).alias("digest"))


def alpha_policy(rows: DataFrame, asset: str, p: str, anomaly: Column, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(asset, alpha, score): for each asset the level of the grid with the best F score over all other assets, of
    equal ones the first of the grid. Rows are counted at the first level that alarms them, then levels are summed up,
    so rows are never multiplied by the grid."""
    level = F.size(F.filter(F.array(*map(F.lit, alphas)), lambda a: a < F.col(p)))
    counts = rows.groupBy(F.col(asset).alias("asset"), level.alias("level")).agg(F.count_if(anomaly).alias("hit"), F.count_if(~anomaly).alias("miss"))
    grid = counts.select("asset").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(alphas)))))
    full = grid.join(counts, ["asset", "level"], "left").na.fill(0, ["hit", "miss"])
    w = Window.partitionBy("asset")
    upto = w.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    sums = full.select("asset", "level", F.sum("hit").over(upto).alias("tp"), F.sum("miss").over(upto).alias("fp"), (F.sum("hit").over(w) - F.sum("hit").over(upto)).alias("fn")).where(F.col("level") < len(alphas))
    total = sums.groupBy("level").agg(*(F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")))
    rest = sums.join(total, "level").select("asset", "level", S.f_beta(*(F.col(f"all_{c}") - F.col(c) for c in ("tp", "fp", "fn"))).alias("score"))
    best = rest.groupBy("asset").agg(F.max(F.struct("score", (-F.col("level")).alias("first"))).alias("b"))
    return best.select("asset", F.get(F.array(*map(F.lit, alphas)), -F.col("b.first")).alias("alpha"), F.col("b.score").alias("score"))
