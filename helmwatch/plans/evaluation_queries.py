"""Queries of joins, folds, rankings, multiplicity, calibration and scoring, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import evaluation as E
from helmwatch.operators import quality as A
from helmwatch.operators import relations as R
from helmwatch.plans.sequence_queries import WALK_SQL, walked
from helmwatch.sources.tables import CHANNELS, SCADA_SQL, scada, table

INTERVALS = [("Wind Farm A", "2024-01-10 00:00:00", "2024-01-12 12:00:00"), ("Wind Farm B", "2024-01-15 06:00:00", "2024-01-16 06:00:00"), ("Wind Farm B", "2024-01-25 00:00:00", "2024-01-26 00:00:00")]
INTERVALS_SQL = "iv(case_key, s, e) AS (VALUES " + ", ".join(f"('{k}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for k, a, b in INTERVALS) + ")"


def _intervals(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(INTERVALS, "case_key string, start string, end string")
    return rows.select("case_key", F.to_timestamp_ntz("start").alias("start"), F.to_timestamp_ntz("end").alias("end"))


def j1_one_to_one(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return R.one_to_one(c, o, ["k"]).groupBy("side", "multiple").agg(F.count("*").alias("rows"))


def j3_left_complete(spark, sf_dir):
    """A left join on two keys, with the rows it keeps and those without a partner."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return o.join(li, "l_orderkey", "left").groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.count_if(F.col("lines").isNull()).alias("unmatched"), F.sum("lines").alias("lines"))


def j7_semi_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer")
    kept, rest = c.join(o, "c_custkey", "left_semi").withColumn("kind", F.lit("semi")), c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("anti"))
    return kept.unionByName(rest).groupBy("kind", "c_mktsegment").agg(F.count("*").alias("customers"))


def j8_intervals(spark, sf_dir):
    rows = R.in_intervals(scada(spark, sf_dir), _intervals(spark))
    act = S.actionable(F.col("case_key"), F.col("in_event"), F.col("status_type_id"))
    return rows.groupBy("case_key", "in_event").agg(F.count("*").alias("rows"), F.count_if(act).alias("actionable_rows"))


def j9_leave_one_out(spark, sf_dir):
    """Each supplier's conformal p-value among the other suppliers of its nation, by ranks instead of pairs."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier")
    w = Window.partitionBy("s_nationkey")
    above = F.count("*").over(w.orderBy(F.desc("s_acctbal")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    n = F.count("*").over(w) - 1
    return s.withColumn("p", (1 + above) / (n + 1)).select("s_suppkey", F.round("p", 6).alias("p"), (F.col("p") <= 0.25).alias("alarm"))


def j10_others(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return R.others(n, "n_nationkey").groupBy("outer_asset").agg(F.count("*").alias("inner_assets"), F.sum("inner_asset").alias("key_sum"))


def j12_grid(spark, sf_dir):
    n = table(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return R.full_grid(n, "n", o_orderstatus=["F", "O", "P"], o_orderpriority=["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


def j13_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    m = n.select(F.col("n_nationkey").alias("right_key"), F.col("n_regionkey").alias("r"))
    return n.join(m, (F.col("n_regionkey") == F.col("r")) & (F.col("n_nationkey") < F.col("right_key"))).select(F.col("n_nationkey").alias("left_key"), "right_key", F.round(F.col("n_nationkey") / F.col("right_key"), 6).alias("ratio"))


def j15_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.groupBy("o_custkey").agg(F.count("*").alias("old"))
    b = o.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("new"))
    return a.join(b, "o_custkey", "full_outer").groupBy(F.col("old").eqNullSafe(F.col("new")).alias("equal")).agg(F.count("*").alias("customers"))


def t_ranking(spark, sf_dir):
    """The three largest orders of every segment, ties by key."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return R.top_per_group(o, ["c_mktsegment"], [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 3).select("c_mktsegment", "o_orderkey", "o_totalprice")


def t2_top_k(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(20).select("l_orderkey", "l_linenumber", "l_extendedprice")


def u_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderpriority LIKE '1%'").select("o_custkey")
    one = lambda df, k: df.agg(F.lit(k).alias("operation"), F.count("*").alias("n"), F.sum("o_custkey").alias("key_sum"))
    return one(a.intersect(b), "intersect").union(one(a.subtract(b), "except")).union(one(a.union(b).distinct(), "union")).union(one(a.exceptAll(b), "except_all"))


def k7_resume(spark, sf_dir):
    """Newest row of every trial, and the trials still to run."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("trial_id"), F.col("event_id").alias("seq"), F.round("value", 2).alias("result"))
    return R.latest(e, "trial_id", "seq").select("trial_id", "seq", "result")


def ml40_folds(spark, sf_dir):
    return R.hash_folds(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment").select("c_custkey", "c_mktsegment", "inner_fold")


def w21_w22_multiplicity(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("user_id") % 17 != 0, F.round(F.pmod(F.col("value") * 7919, F.lit(997.0)) / 9970, 8)).alias("p"))
    out = R.benjamini_hochberg(R.holm(p, "p", "event_type"), "p", "event_type")
    return out.select("event_id", F.round("holm", 6).alias("holm"), F.round("bh", 6).alias("bh"))


def b1_empirical(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return R.empirical_p(e.where("event_type = 'error'"), e.where("event_type = 'view'").select("day", "value"), "value", "day").select("event_id", F.round("p", 8).alias("p"))


def _rows(spark, sf_dir):
    rows = R.in_intervals(walked(spark, sf_dir), _intervals(spark)).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rows.withColumn("alarm", F.coalesce(F.col("smoothed") > 250, F.lit(False)))


def ag20_confusion(spark, sf_dir):
    rows = _rows(spark, sf_dir).where(S.actionable(F.col("case_key"), F.col("in_event"), F.col("status_type_id")))
    c = E.confusion(rows, F.col("in_event"), F.col("alarm"), "case_key")
    return c.withColumn("f_beta", F.round(S.f_beta(F.col("tp"), F.col("fp"), F.col("fn")), 6)).withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 6))


def ml32_ml34_care(spark, sf_dir):
    """Days as cases: coverage, earliness, accuracy and alarms, and the score of each farm."""
    act = S.actionable(F.col("case_key"), F.col("in_event"), F.col("status_type_id"))
    pos = F.hour("ts") / 23.0
    w = S.earliness_weight(pos)
    c = _rows(spark, sf_dir).where(act).groupBy("case_key", "day").agg(
        F.max("in_event").alias("is_anomaly"), F.count_if(F.col("in_event") & F.col("alarm")).alias("tp"), F.count_if(~F.col("in_event") & F.col("alarm")).alias("fp"), F.count_if(F.col("in_event") & ~F.col("alarm")).alias("fn"),
        F.coalesce(F.sum(F.when(F.col("alarm"), w)) / F.sum(w), F.lit(0.0)).alias("earliness"), F.avg((F.col("alarm") == F.col("in_event")).cast("double")).alias("accuracy"), F.max(F.col("criticality") >= 2).alias("event_alarm"),
    )
    out = E.care(c.withColumn("coverage_fbeta", S.f_beta(F.col("tp"), F.col("fp"), F.col("fn"))), "case_key")
    return out.select("case_key", "alarms", *(F.round(x, 6).alias(x) for x in ("f", "ws", "ef", "acc", "care")))


def _metrics(spark, sf_dir):
    """Case metrics of a grid of configurations: thresholds over suppliers' parts stand in for alarms."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).alias("asset"), "l_quantity", "l_discount")
    return li.select("asset", F.explode(F.array(F.lit(10), F.lit(25), F.lit(40))).alias("configuration_id"), "l_quantity", "l_discount").groupBy("asset", "configuration_id").agg(
        F.count_if((F.col("l_quantity") > F.col("configuration_id")) & (F.col("l_discount") > 0.05)).alias("tp"), F.count_if((F.col("l_quantity") > F.col("configuration_id")) & (F.col("l_discount") <= 0.05)).alias("fp"),
        F.count_if((F.col("l_quantity") <= F.col("configuration_id")) & (F.col("l_discount") > 0.05)).alias("fn"),
    )


def ml35_nested(spark, sf_dir):
    """For each outer asset the configuration that scores best on the others: sums of all less the asset's own."""
    m = _metrics(spark, sf_dir)
    total = m.groupBy("configuration_id").agg(*(F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")))
    rest = m.join(F.broadcast(total), "configuration_id").select("asset", "configuration_id", S.f_beta(*(F.col(f"all_{c}") - F.col(c) for c in ("tp", "fp", "fn"))).alias("score"))
    best = R.top_per_group(rest, ["asset"], [F.desc("score"), F.asc("configuration_id")])
    return best.select("asset", "configuration_id", F.round("score", 6).alias("score"))


def ag32_selection_frequency(spark, sf_dir):
    return ml35_nested(spark, sf_dir).groupBy("configuration_id").agg(F.count("*").alias("selected"))


def ag23_sufficient(spark, sf_dir):
    return _metrics(spark, sf_dir).groupBy("asset").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count("*").alias("configurations"))


def ml38_bootstrap(spark, sf_dir):
    a = ag23_sufficient(spark, sf_dir).select("asset", F.col("tp").alias("num"), (F.col("tp") + F.col("fp")).alias("den"))
    b = E.poisson_bootstrap(a, "asset", "num", "den", 200)
    return b.agg(F.count("ratio").alias("finite"), F.round(F.percentile("ratio", F.lit(0.025)), 6).alias("lower"), F.round(F.percentile("ratio", F.lit(0.975)), 6).alias("upper"))


def ml38_multinomial(spark, sf_dir):
    """Limits of precision and F-beta over 10,000 draws of n of n assets."""
    b = E.cluster_bootstrap(ag23_sufficient(spark, sf_dir), "asset", ("tp", "fp", "fn"), 10_000, 17)
    b = b.select((F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), S.f_beta(F.col("tp"), F.col("fp"), F.col("fn")).alias("f_beta"))
    limits = [F.round(F.percentile(m, F.lit(p)), 6).alias(f"{m}_{n}") for m in ("precision", "f_beta") for n, p in (("lower", 0.025), ("middle", 0.5), ("upper", 0.975))]
    return b.agg(F.count("precision").alias("finite"), *limits)


def _residuals(spark, sf_dir):
    """Residuals of extended price on quantity, per return flag, by ridge lines."""
    li = table(spark, sf_dir, "lineitem")
    fit = E.ridge_line(li, "l_quantity", "l_extendedprice", 1.0, "l_returnflag").select("l_returnflag", "slope", "intercept")
    return li.join(F.broadcast(fit), "l_returnflag").select("l_returnflag", "l_linenumber", (F.abs(F.col("l_extendedprice") - F.col("intercept") - F.col("slope") * F.col("l_quantity")) / 10000).alias("score"), (F.col("l_orderkey") % 40).alias("block"))


def ml4_ridge(spark, sf_dir):
    out = E.ridge_line(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 1.0, "l_returnflag")
    return out.select("l_returnflag", F.col("n").cast("long").alias("n"), F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


def ml11_leverage(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal IS NOT NULL")
    p = s.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("m"), (F.var_pop("s_acctbal") * F.count("*")).alias("sxx"))
    d = F.col("s_acctbal") - F.col("m")
    return s.join(p, "s_nationkey").select("s_suppkey", F.round(1 / F.col("n") + d * d / (F.col("sxx") + 1), 6).alias("leverage"))


def ml16_ml19_blocks(spark, sf_dir):
    r = _residuals(spark, sf_dir)
    m = E.block_maxima(r, "score", 20, "l_returnflag", "block").where("usable").groupBy("l_returnflag").agg(F.round(F.avg("maximum"), 6).alias("mean_maximum"))
    c = E.block_coverage(r, F.col("score") <= 2, ["block"], "l_returnflag").select("l_returnflag", "blocks", F.round("coverage", 6).alias("coverage"), F.round(E.corrected_probability(F.col("blocks"), 0.95), 6).alias("corrected_p"))
    return m.join(c, "l_returnflag")


def ml20_conformal(spark, sf_dir):
    m = E.block_maxima(_residuals(spark, sf_dir), "score", 1, "l_returnflag", "block")
    q = E.conformal_quantile(m, "maximum", 0.9, "l_returnflag").select("l_returnflag", F.round("quantile", 6).alias("quantile"), "n")
    return q.join(E.leave_one_out_coverage(m, "maximum", 0.9, "l_returnflag").select("l_returnflag", F.round("coverage", 6).alias("loo_coverage")), "l_returnflag")


def ml18_pooled(spark, sf_dir):
    return A.higher_quantile(_residuals(spark, sf_dir), "score", 0.95, "l_returnflag").select("l_returnflag", "n", F.round("quantile", 6).alias("quantile"))


def ml25_ml27_health(spark, sf_dir):
    """Reliability weights of channels and the weighted mean exceedance of each slot."""
    s = scada(spark, sf_dir)
    long = s.unpivot(["case_key", "ts"], list(CHANNELS), "channel", "value")
    stats = long.groupBy("case_key", "channel").agg((F.count("value") / F.count("*")).alias("r2"), (F.stddev_pop("value") / 10000).alias("rmse"))
    w = E.reliability_weights(stats, 0.95, "case_key").select("case_key", "channel", "weight")
    h = E.weighted_health(long.join(F.broadcast(w), ["case_key", "channel"]).withColumn("e", F.greatest(F.abs("value") / 100 - 1, F.lit(0.0))).withColumn("e", F.when(F.col("value").isNotNull(), F.col("e"))), "e", "weight", "case_key", "ts")
    return h.groupBy("case_key").agg(F.count("health").alias("scored"), F.round(F.avg("health"), 5).alias("mean_health"), F.round(F.max("health"), 5).alias("max_health"))


def ml47_donor_policy(spark, sf_dir):
    """The loosest threshold of a grid whose share of healthy days above it stays within the risk."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max("value").alias("top"))
    g = d.select("event_type", F.explode(F.array(*(F.lit(float(q)) for q in (150, 200, 250, 300, 350, 400)))).alias("q"), "top").groupBy("event_type", "q").agg(F.avg((F.col("top") >= F.col("q")).cast("double")).alias("risk"))
    return g.groupBy("event_type").agg(F.coalesce(F.min(F.when(F.col("risk") <= 0.5, F.col("q"))), F.lit(999.0)).alias("threshold"), (F.count_if(F.col("risk") <= 0.5) == 0).alias("infeasible"))


_rows_sql = f"{WALK_SQL}, {INTERVALS_SQL}, x AS (SELECT w.*, EXISTS (SELECT 1 FROM iv WHERE iv.case_key = w.case_key AND w.ts BETWEEN s AND e) AS in_event, coalesce(smoothed > 250, false) AS alarm, strftime(ts, '%Y-%m-%d') AS day FROM walk w), y AS (SELECT * FROM x WHERE (case_key = 'Wind Farm A' AND in_event) OR status_type_id IN (0, 2))"
_fb = lambda tp, fp, fn: f"coalesce(1.25 * ({tp}) / nullif(1.25 * ({tp}) + 0.25 * ({fn}) + ({fp}), 0), 0)"
_metric_sql = """m AS (SELECT l_suppkey % 12 AS asset, c AS configuration_id, count(*) FILTER (l_quantity > c AND l_discount > 0.05::DOUBLE) AS tp, count(*) FILTER (l_quantity > c AND l_discount <= 0.05::DOUBLE) AS fp, count(*) FILTER (l_quantity <= c AND l_discount > 0.05::DOUBLE) AS fn
  FROM lineitem, (SELECT unnest([10, 25, 40]) AS c) GROUP BY ALL)"""
_nested_sql = f"""{_metric_sql}, t AS (SELECT configuration_id, sum(tp) AS a, sum(fp) AS b, sum(fn) AS c FROM m GROUP BY 1), s AS (SELECT asset, m.configuration_id, {_fb("a - tp", "b - fp", "c - fn")} AS score FROM m JOIN t USING (configuration_id)),
  n AS (SELECT asset, configuration_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY asset ORDER BY score DESC, configuration_id) = 1)"""
_ridge_sql = """p AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS sxx, covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy, var_pop(l_extendedprice) * count(*) AS syy FROM lineitem GROUP BY 1), f AS (SELECT *, sxy / (sxx + 1) AS slope FROM p)"""
_res_sql = f"{_ridge_sql}, r AS (SELECT l_returnflag, abs(l_extendedprice - (my - slope * mx) - slope * l_quantity) / 10000 AS score, l_orderkey % 40 AS block FROM lineitem JOIN f USING (l_returnflag))"
_poisson = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 ELSE 5 END"

QUERIES = {
    "j1_one_to_one": (j1_one_to_one, """WITH c AS (SELECT c_custkey AS k, count(*) OVER (PARTITION BY c_custkey) AS l FROM customer), o AS (SELECT o_custkey AS k, count(*) OVER (PARTITION BY o_custkey) AS r FROM orders WHERE o_orderstatus = 'P')
      SELECT CASE WHEN l IS NULL THEN 'right_only' WHEN r IS NULL THEN 'left_only' ELSE 'both' END AS side, coalesce(l, 1) > 1 OR coalesce(r, 1) > 1 AS multiple, count(*) AS rows FROM c FULL JOIN o USING (k) GROUP BY ALL"""),
    "j3_left_complete": (j3_left_complete, "WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (lines IS NULL) AS unmatched, sum(lines)::BIGINT AS lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1"),
    "j7_semi_anti": (j7_semi_anti, "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'semi' ELSE 'anti' END AS kind, c_mktsegment, count(*) AS customers FROM customer GROUP BY ALL"),
    "j8_pr21_pr22_intervals": (j8_intervals, f"WITH {SCADA_SQL}, {INTERVALS_SQL}, x AS (SELECT s0.*, EXISTS (SELECT 1 FROM iv WHERE iv.case_key = s0.case_key AND s0.ts BETWEEN s AND e) AS in_event FROM scada s0) SELECT case_key, in_event, count(*) AS rows, count(*) FILTER ((case_key = 'Wind Farm A' AND in_event) OR status_type_id IN (0, 2)) AS actionable_rows FROM x GROUP BY ALL"),
    "j9_b19_ml45_leave_one_out": (j9_leave_one_out, """WITH p AS (SELECT a.s_suppkey, (1 + count(*) FILTER (b.s_acctbal >= a.s_acctbal)) / (count(b.s_suppkey) + 1) AS p FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1) SELECT s_suppkey, round(p, 6) AS p, p <= 0.25 AS alarm FROM p"""),
    "j10_others": (j10_others, "SELECT a.n_nationkey AS outer_asset, count(*) AS inner_assets, sum(b.n_nationkey)::BIGINT AS key_sum FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey GROUP BY 1"),
    "j12_grid": (j12_grid, """SELECT s AS o_orderstatus, p AS o_orderpriority, count(o_orderkey) AS n FROM (SELECT unnest(['F','O','P']) AS s) CROSS JOIN (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']) AS p)
      LEFT JOIN orders ON o_orderstatus = s AND o_orderpriority = p AND o_totalprice > 400000 GROUP BY ALL"""),
    "j13_pairs": (j13_pairs, "SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key, round(a.n_nationkey / b.n_nationkey, 6) AS ratio FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "j15_compare": (j15_compare, "WITH a AS (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT o IS NOT DISTINCT FROM n AS equal, count(*) AS customers FROM a FULL JOIN b USING (o_custkey) GROUP BY 1"),
    "t1_t3_t4_ranking": (t_ranking, "SELECT c_mktsegment, o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) <= 3"),
    "t2_top_k": (t2_top_k, "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20"),
    "u1_u4_sets": (u_sets, """WITH a AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'), i AS (SELECT * FROM a INTERSECT SELECT * FROM b), d AS (SELECT * FROM a EXCEPT SELECT * FROM b), u AS (SELECT * FROM a UNION SELECT * FROM b), x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
      SELECT 'intersect' AS operation, count(*) AS n, sum(o_custkey)::BIGINT AS key_sum FROM i UNION ALL SELECT 'except', count(*), sum(o_custkey)::BIGINT FROM d UNION ALL SELECT 'union', count(*), sum(o_custkey)::BIGINT FROM u UNION ALL SELECT 'except_all', count(*), sum(o_custkey)::BIGINT FROM x"""),
    "k7_resume": (k7_resume, "SELECT user_id AS trial_id, event_id AS seq, round(value, 2) AS result FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "ml40_folds": (ml40_folds, """WITH h AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('43|' || c_custkey)[1:16], c_custkey) - 1 AS pos, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS farm FROM customer)
      SELECT c_custkey, c_mktsegment, ((pos + (1 + farm) % 5) % 5 + 1)::INT AS inner_fold FROM h"""),
    "w21_w22_multiplicity": (w21_w22_multiplicity, """WITH p AS (SELECT event_id, event_type, CASE WHEN user_id % 17 <> 0 THEN round((value * 7919) % 997.0::DOUBLE / 9970, 8) END AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, p IS NULL ORDER BY p) AS rn, count(*) OVER (PARTITION BY event_type, p IS NULL) AS m FROM p)
      SELECT event_id, CASE WHEN p IS NOT NULL THEN round(least(1, max((m - rn + 1) * p) OVER (PARTITION BY event_type, p IS NULL ORDER BY rn)), 6) END AS holm, CASE WHEN p IS NOT NULL THEN round(least(1, min(p * m / rn) OVER (PARTITION BY event_type, p IS NULL ORDER BY rn DESC)), 6) END AS bh FROM r"""),
    "b1_empirical_p": (b1_empirical, "SELECT a.event_id, round((1 + count(*) FILTER (b.value >= a.value)) / (count(b.value) + 1), 8) AS p FROM events a LEFT JOIN events b ON a.ts::DATE = b.ts::DATE AND b.event_type = 'view' WHERE a.event_type = 'error' GROUP BY 1"),
    "ag20_ag21_confusion": (ag20_confusion, f"""WITH {_rows_sql}, c AS (SELECT case_key, count(*) FILTER (NOT in_event AND NOT alarm) AS tn, count(*) FILTER (NOT in_event AND alarm) AS fp, count(*) FILTER (in_event AND NOT alarm) AS fn, count(*) FILTER (in_event AND alarm) AS tp FROM y GROUP BY 1)
      SELECT *, round({_fb("tp", "fp", "fn")}, 6) AS f_beta, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c"""),
    "ag22_ml32_ml34_care": (ml32_ml34_care, f"""WITH {_rows_sql}, z AS (SELECT *, CASE WHEN hour(ts) / 23.0 <= 0.5 THEN 1.0::DOUBLE ELSE 2 * (1 - hour(ts) / 23.0::DOUBLE) END AS w FROM y),
      c AS (SELECT case_key, day, bool_or(in_event) AS anomaly, count(*) FILTER (in_event AND alarm) AS tp, count(*) FILTER (NOT in_event AND alarm) AS fp, count(*) FILTER (in_event AND NOT alarm) AS fn, coalesce(sum(w) FILTER (alarm) / sum(w), 0) AS earliness, avg((alarm = in_event)::INT) AS accuracy, bool_or(criticality >= 2) AS ea FROM z GROUP BY ALL),
      g AS (SELECT case_key, coalesce(avg({_fb("tp", "fp", "fn")}) FILTER (anomaly), 0) AS f, coalesce(avg(earliness) FILTER (anomaly), 0) AS ws, {_fb("count(*) FILTER (anomaly AND ea)", "count(*) FILTER (NOT anomaly AND ea)", "count(*) FILTER (anomaly AND NOT ea)")} AS ef, coalesce(avg(accuracy) FILTER (NOT anomaly), 0) AS acc, count(*) FILTER (ea) AS alarms FROM c GROUP BY 1)
      SELECT case_key, alarms, round(f, 6) AS f, round(ws, 6) AS ws, round(ef, 6) AS ef, round(acc, 6) AS acc, round(CASE WHEN alarms = 0 THEN 0 WHEN acc < 0.5 THEN acc ELSE (f + ws + ef + 2 * acc) / 5 END, 6) AS care FROM g"""),
    "ml35_ag31_w18_nested": (ml35_nested, f"WITH {_nested_sql} SELECT * FROM n"),
    "ag32_selection_frequency": (ag32_selection_frequency, f"WITH {_nested_sql} SELECT configuration_id, count(*) AS selected FROM n GROUP BY 1"),
    "ag23_sufficient": (ag23_sufficient, f"WITH {_metric_sql} SELECT asset, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) AS configurations FROM m GROUP BY 1"),
    "ml38_bootstrap": (ml38_bootstrap, f"""WITH {_metric_sql}, a AS (SELECT asset, sum(tp) AS num, sum(tp + fp) AS den FROM m GROUP BY 1), d AS (SELECT num, den, r.r, ('0x' || sha256(asset || '|' || r.r)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM a, range(200) r(r)),
      b AS (SELECT r, sum(w * num) / nullif(sum(w * den), 0) AS ratio FROM (SELECT *, {_poisson} AS w FROM d) GROUP BY 1) SELECT count(ratio) AS finite, round(quantile_cont(ratio, 0.025), 6) AS lower, round(quantile_cont(ratio, 0.975), 6) AS upper FROM b"""),
    "ml38_multinomial": (ml38_multinomial, f"""WITH {_metric_sql}, a AS (SELECT asset, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY asset) - 1 AS place, count(*) OVER () AS n FROM a),
      d AS (SELECT r.r, ('0x' || sha256('17|' || r.r || '|' || j.place)[1:12])::BIGINT % j.n AS place FROM p j, range(10000) r(r)), b AS (SELECT r, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM d JOIN p USING (place) GROUP BY 1),
      q AS (SELECT tp / nullif(tp + fp, 0) AS precision, {_fb("tp", "fp", "fn")} AS f_beta FROM b)
      SELECT count(precision) AS finite, {", ".join(f"round(quantile_cont({m}, {v}), 6) AS {m}_{n}" for m in ("precision", "f_beta") for n, v in (("lower", 0.025), ("middle", 0.5), ("upper", 0.975)))} FROM q"""),
    "ml4_ml6_ridge": (ml4_ridge, f"WITH {_ridge_sql} SELECT l_returnflag, n, round(slope, 4) AS slope, round(my - slope * mx, 3) AS intercept, round(1 - (syy - 2 * slope * sxy + slope * slope * sxx) / syy, 6) AS r2 FROM f"),
    "ml11_leverage": (ml11_leverage, "WITH p AS (SELECT s_nationkey, count(*) AS n, avg(s_acctbal) AS m, var_pop(s_acctbal) * count(*) AS sxx FROM supplier GROUP BY 1) SELECT s_suppkey, round(1 / n + (s_acctbal - m) ^ 2 / (sxx + 1), 6) AS leverage FROM supplier JOIN p USING (s_nationkey)"),
    "ml16_ml17_ml19_blocks": (ml16_ml19_blocks, f"""WITH {_res_sql}, b AS (SELECT l_returnflag, block, max(score) AS m, count(*) AS n, avg((score <= 2)::INT) AS c FROM r GROUP BY ALL)
      SELECT l_returnflag, round(avg(m) FILTER (n >= 20), 6) AS mean_maximum, count(*) AS blocks, round(avg(c), 6) AS coverage, round(CASE WHEN count(*) >= 30 THEN greatest(1, least(ceil((count(*) + 1) * 0.95::DOUBLE), count(*))) / count(*) END, 6) AS corrected_p FROM b GROUP BY 1"""),
    "ml18_pooled_quantile": (ml18_pooled, f"WITH {_res_sql}, k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM r) SELECT l_returnflag, n, round(score, 6) AS quantile FROM k WHERE rn = ceil(0.95::DOUBLE * (n - 1)) + 1"),
    "ml20_conformal": (ml20_conformal, f"""WITH {_res_sql}, b AS (SELECT l_returnflag, max(score) AS m FROM r GROUP BY l_returnflag, block), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY m) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM b),
      q AS (SELECT *, greatest(1, least(ceil(n * 0.9::DOUBLE), n - 1)) AS rk FROM k), t AS (SELECT *, max(m) FILTER (rn = rk) OVER (PARTITION BY l_returnflag) AS own, max(m) FILTER (rn = rk + 1) OVER (PARTITION BY l_returnflag) AS nx FROM q)
      SELECT l_returnflag, round(max(m) FILTER (rn = least(ceil((n + 1) * 0.9::DOUBLE), n)), 6) AS quantile, max(n) AS n, round(avg((m <= CASE WHEN rn <= rk THEN nx ELSE own END)::INT), 6) AS loo_coverage FROM t GROUP BY 1"""),
    "ml25_ml27_ag24_health": (ml25_ml27_health, f"""WITH {SCADA_SQL}, l AS ({" UNION ALL ".join(f"SELECT case_key, ts, '{c}' AS channel, {c} AS v FROM scada" for c in CHANNELS)}),
      s AS (SELECT case_key, channel, count(v) / count(*) * exp(-(stddev_pop(v) / 10000) / (1 - 0.95::DOUBLE)) AS w FROM l GROUP BY ALL), w AS (SELECT *, w / sum(w) OVER (PARTITION BY case_key) AS weight FROM s),
      h AS (SELECT l.case_key, ts, CASE WHEN sum(weight) FILTER (v IS NOT NULL) >= 0.7 - 1e-12 THEN sum(weight * greatest(abs(v) / 100 - 1, 0)) FILTER (v IS NOT NULL) / sum(weight) FILTER (v IS NOT NULL) END AS health FROM l JOIN w ON w.case_key = l.case_key AND w.channel = l.channel GROUP BY ALL)
      SELECT case_key, count(health) AS scored, round(avg(health), 5) AS mean_health, round(max(health), 5) AS max_health FROM h GROUP BY 1"""),
    "ml47_threshold_policy": (ml47_donor_policy, """WITH d AS (SELECT event_type, max(value) AS top FROM events GROUP BY event_type, ts::DATE), g AS (SELECT event_type, q::DOUBLE AS q, avg((top >= q)::INT) AS risk FROM d, (SELECT unnest([150, 200, 250, 300, 350, 400]) AS q) GROUP BY ALL)
      SELECT event_type, coalesce(min(q) FILTER (risk <= 0.5), 999.0::DOUBLE) AS threshold, count(*) FILTER (risk <= 0.5) = 0 AS infeasible FROM g GROUP BY 1"""),
}
