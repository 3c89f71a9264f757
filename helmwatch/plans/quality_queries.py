"""Queries of scans, predicates, quality audits, robust statistics and drift, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helmwatch.functions import scalars as S
from helmwatch.operators import order_statistics as O
from helmwatch.operators import quality as A
from helmwatch.sources.tables import CHANNELS, SCADA_SQL, scada, table



def fit():
    return S.fit_mask(F.col("train_test"), F.col("status_type_id"))


FIT_SQL = "train_test = 'train' AND status_type_id IN (0, 2)"


def r(name, digits=5):
    return F.round(F.col(name) + 1e-9, digits).alias(name)


def pr_partition_status(spark, sf_dir):
    return scada(spark, sf_dir).groupBy(S.partition_name(F.col("train_test")).alias("partition"), S.partition_label(F.col("train_test")).alias("label"), S.is_normal(F.col("status_type_id")).alias("normal")).agg(F.count("*").alias("rows"))


def pr_row_flags(spark, sf_dir):
    some, strict, together = S.row_flags(*map(F.col, CHANNELS))
    return scada(spark, sf_dir).groupBy("case_key").agg(F.count_if(some).alias("any_finite"), F.count_if(strict).alias("strict_all_zero"), F.count_if(together).alias("synchronous_all_zero"))


def pr_cell_class(spark, sf_dir):
    v = F.when(F.col("event_id") % 11 == 0, "abc").when(F.col("event_id") % 11 == 1, "inf").when(F.col("event_id") % 11 == 2, "0").when(F.col("event_id") % 11 == 3, " ").when(F.col("event_id") % 11 == 4, F.lit(None)).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").groupBy(S.cell_class(v).alias("class")).agg(F.count("*").alias("cells"))


def pr_labels(spark, sf_dir):
    """Event labels, identifiers, slugs and name parts of order rows."""
    o = table(spark, sf_dir, "orders")
    label = F.element_at(F.array(*map(F.lit, ("Anomaly", "normal", "abnormal", "Healthy", "gearbox fault", "1", "0", "other"))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    name = F.concat(F.lit("Sensor "), (F.col("o_orderkey") % 5).cast("string"), F.element_at(F.array(*map(F.lit, ("_avg", "_std", "_max", "_min", ""))), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return o.groupBy(S.event_is_anomaly(label).alias("is_anomaly"), S.identifier(F.format_string("%d.0", F.col("o_orderkey") % 3)).alias("identifier"), S.snake_case(name).alias("snake"), S.base_sensor(name).alias("base"), S.statistic(name).alias("statistic")).agg(F.count("*").alias("rows"))


def pr_roles(spark, sf_dir):
    """Semantic roles by description, reserved names, cohorts, manifest states, booleans."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 24)
    text = F.element_at(F.array(*map(F.lit, ("Windspeed avg", "Gear oil temperature", "Pitch angle", "Counter of starts", "", "Grid voltage"))), (F.col("k") % 6 + 1).cast("int"))
    return o.groupBy("k").agg(
        F.first(S.semantic_role(text, F.col("k") % 6 == 2, F.col("k") % 6 == 3)).alias("role"), F.first(S.planned_cohort(F.col("k"))).alias("cohort"),
        F.first(S.manifest_status(F.col("k") < 10, F.col("k") < 15)).alias("manifest"), F.first(S.boolean(F.when(F.col("k") % 2 == 0, "Yes").otherwise("no"))).alias("flag"),
        F.first(S.shift_band(F.col("k") / 60)).alias("band"), F.first(S.is_reserved_feature(F.when(F.col("k") % 3 == 0, "fault_label").otherwise("power_avg"))).alias("reserved"),
    )


def pr15_angles(spark, sf_dir):
    day = F.when(F.dayofyear("o_orderdate") % 10 != 0, F.dayofyear("o_orderdate").cast("double"))
    s, c, m = S.angle_parts(day)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.avg(s), 6).alias("mean_sin"), F.round(F.avg(c), 6).alias("mean_cos"), F.sum(m).alias("missing"))


def pr20_exclusion(spark, sf_dir):
    reason = S.first_reason(("prediction", F.col("train_test") != "train"), ("abnormal_status", ~S.is_normal(F.col("status_type_id"))), ("missing_click", F.col("click").isNull()), ("missing_view", F.col("view").isNull()))
    return scada(spark, sf_dir).groupBy("case_key", reason.alias("reason")).agg(F.count("*").alias("rows"))


def ag1_case_audit(spark, sf_dir):
    s = scada(spark, sf_dir)
    return s.groupBy("case_key").agg(
        F.count("*").alias("rows"), F.count_if(F.col("train_test") == "train").alias("train_rows"), F.count_if(F.col("train_test") == "prediction").alias("prediction_rows"),
        F.count_if(fit()).alias("training_normal_rows"), F.array_join(F.sort_array(F.collect_set(F.col("status_type_id").cast("string"))), ",").alias("status_ids_seen"),
    )


def ag2_channel_audit(spark, sf_dir):
    a = A.channel_audit(scada(spark, sf_dir), CHANNELS, fit())
    flag = S.review_flag(F.col("finite_rows"), F.col("zero_rows") == F.col("finite_rows"), F.col("availability"), F.lit(0))
    return a.withColumn("review_flag", flag).withColumn("availability", F.round("availability", 6)).withColumn("zero_fraction_of_finite", F.round("zero_fraction_of_finite", 6))


def ag3_channel_rollup(spark, sf_dir):
    out = A.channel_rollup(A.channel_audit(scada(spark, sf_dir), CHANNELS, fit()))
    return out.select("channel", "cases", "finite_rows", *(F.round(c, 6).alias(c) for c in out.columns[3:]))


def ag5_moments(spark, sf_dir):
    out = A.moments(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag", "l_linestatus")
    return out.select("l_returnflag", "l_linestatus", "n", *(F.round(c, 3).alias(c) for c in ("mean", "sd", "min", "max")), F.round(F.col("variance") / 1e6, 3).alias("variance_m"))


def ag6_usable(spark, sf_dir):
    s = scada(spark, sf_dir).where(fit())
    long = s.unpivot("case_key", list(CHANNELS), "channel", "value")
    m = A.moments(long, "value", "case_key", "channel").join(s.groupBy("case_key").agg(F.count("*").alias("fit_rows")), "case_key")
    return m.select("case_key", "channel", "fit_rows", ((F.col("n") / F.col("fit_rows") >= 0.70) & (F.col("n") > 1) & (F.col("variance") > 0)).alias("usable"))


def ag8_robust(spark, sf_dir):
    out = A.robust_parameters(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")
    return out.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("center", "q25", "q75", "scale")))


def ag9_fit_ladder(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_linestatus") == "F", F.lit(3.0)).when(F.col("l_linenumber") > 1, F.col("l_tax")))
    out = A.fit_ladder(d, "v", "l_returnflag", "l_linestatus")
    return out.withColumn("center", F.round("center", 6)).withColumn("scale", F.round("scale", 6))


def ag11_reservoir(spark, sf_dir):
    """A seeded sample of rows: those of smallest hash, kept per task before they meet."""
    e = table(spark, sf_dir, "events").withColumn("h", F.substring(F.sha2(F.concat(F.lit("29|"), F.col("event_id").cast("string")), 256), 1, 16))
    return e.orderBy("h", "event_id").limit(100).select("event_id", "user_id", "event_type")


def ag12_operational(spark, sf_dir):
    return scada(spark, sf_dir).groupBy("case_key", "status_type_id", "train_test").agg(F.count("*").alias("rows"), F.count_if(F.col("click").isNull()).alias("missing_click"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def ag14_duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).where("copies > 1")


def ag15_higher_quantile(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return A.higher_quantile(e, "value", 0.9, "event_type", "day")


def ag16_q90(spark, sf_dir):
    q = O.linear_quantiles(table(spark, sf_dir, "events"), "value", (0.9, 0.5), "event_type")
    return q.select("event_type", F.round(F.get("q", 0), 5).alias("q90"), F.round(F.get("q", 1), 5).alias("median"))


def ag17_pivot(spark, sf_dir):
    """Orders by status and priority with zeros filled, and each cell's share of its row."""
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)
    total = F.nullif(F.col("F") + F.col("O") + F.col("P"), F.lit(0))
    return p.select("o_orderpriority", F.col("F").alias("n_f"), F.col("O").alias("n_o"), F.col("P").alias("n_p"), F.round(F.col("F") / total, 6).alias("share_f"))


def ag18_balance(spark, sf_dir):
    from pyspark.sql import Window

    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 6))


def ag26_concentration(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count("*").alias("n"))
    c = c.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    ranked = c.withColumn("rn", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("v"), "o_custkey")))
    return ranked.groupBy("c_mktsegment").agg(
        F.round(F.sum(F.when(F.col("rn") <= 1, F.col("v"))) / F.sum("v"), 6).alias("top1_share"), F.round(F.sum(F.when(F.col("rn") <= 5, F.col("v"))) / F.sum("v"), 6).alias("top5_share"),
        F.count_if(F.col("v") > 1e6).alias("over_1e6"), F.round(F.pow(F.sum("v"), 2) / F.sum(F.col("v") * F.col("v")), 3).alias("effective_number"),
    )


def ag28_wilson(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("successes"), F.count("*").alias("total"))
    lo, hi = S.wilson(F.col("successes"), F.col("total"))
    return g.select("o_orderpriority", "successes", "total", F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"))


def ag33_spearman(spark, sf_dir):
    out = A.spearman_pairs(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ("c_custkey", "c_nationkey", "c_acctbal"))
    return out.select("left", "right", F.round("rho", 6).alias("rho"))


def ag34_psi(spark, sf_dir):
    out = A.population_stability(table(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_linenumber") <= 3)
    return out.select(F.round("psi", 6).alias("psi"), S.shift_band(F.col("psi")).alias("band"))


def ag35_ecdf(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.round(F.cume_dist().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal")), 6).alias("ecdf"))


def ag41_moments(spark, sf_dir):
    """Kurtosis, skewness, crest factor and log root mean square of every vector, as a signal."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    return v.groupBy("vec_id").agg(F.round(F.kurtosis("x"), 4).alias("kurtosis"), F.round(F.skewness("x"), 4).alias("skew"), F.round(F.max(F.abs("x")) / rms, 4).alias("crest"), F.round(F.log(rms), 4).alias("log_rms"))


def pr17_robust_transform(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_linenumber") != 2, F.col("l_quantity"))).select("l_returnflag", "l_linenumber", "q")
    t = A.robust_transform(li, "q", A.robust_parameters(li, "q", "l_returnflag"), "l_returnflag")
    return t.groupBy("l_returnflag").agg(F.sum("q_missing").alias("missing"), F.round(F.avg("q_scaled"), 6).alias("mean_scaled"), F.round(F.max("q_scaled"), 6).alias("max_scaled"))


def ml28_equal_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return A.equal_block_quantile(e, "value", "day", 0.95, "event_type")


_cells = "CASE event_id % 11 WHEN 0 THEN 'abc' WHEN 1 THEN 'inf' WHEN 2 THEN '0' WHEN 3 THEN ' ' WHEN 4 THEN NULL ELSE value::VARCHAR END"
_audit = f"""a AS (SELECT case_key, channel, count(v) AS finite_rows, count(*) - count(v) AS missing_rows, count(v) / count(*) AS availability, count(*) FILTER (v = 0) AS zero_rows, count(*) FILTER (v = 0) / nullif(count(v), 0) AS zero_fraction_of_finite
  FROM ({" UNION ALL ".join(f"SELECT case_key, '{c}' AS channel, {c} AS v FROM scada WHERE {FIT_SQL}" for c in CHANNELS)}) GROUP BY ALL)"""
_robust = "CASE WHEN q75 - q25 > 1e-12 THEN q75 - q25 WHEN sd > 1e-12 THEN sd ELSE 1 END"

QUERIES = {
    "pr1_pr3_partition_status": (pr_partition_status, f"WITH {SCADA_SQL} SELECT train_test AS partition, train_test AS label, status_type_id IN (0, 2) AS normal, count(*) AS rows FROM scada GROUP BY ALL"),
    "pr6_row_flags": (pr_row_flags, f"""WITH {SCADA_SQL} SELECT case_key, count(*) FILTER (coalesce(click, error, purchase, signup, view) IS NOT NULL) AS any_finite, count(*) FILTER ({" AND ".join(f"{c} = 0" for c in CHANNELS)}) AS strict_all_zero,
      count(*) FILTER (coalesce(click, error, purchase, signup, view) IS NOT NULL AND {" AND ".join(f"coalesce({c}, 0) = 0" for c in CHANNELS)}) AS synchronous_all_zero FROM scada GROUP BY 1"""),
    "pr7_cell_class": (pr_cell_class, f"""WITH c AS (SELECT {_cells} AS t FROM events), d AS (SELECT t, try_cast(t AS DOUBLE) AS d FROM c)
      SELECT CASE WHEN t IS NULL OR trim(t) = '' THEN 'source_missing' WHEN d IS NULL THEN 'non_numeric' WHEN isinf(d) THEN 'infinite' WHEN d = 0 THEN 'zero' ELSE 'finite' END AS class, count(*) AS cells FROM d GROUP BY 1"""),
    "pr8_pr12_labels": (pr_labels, """WITH o AS (SELECT ['Anomaly','normal','abnormal','Healthy','gearbox fault','1','0','other'][o_orderkey % 8 + 1] AS l, (o_orderkey % 3)::VARCHAR AS identifier, o_orderkey % 5 AS s, ['_avg','_std','_max','_min',''][o_orderkey % 5 + 1] AS x FROM orders)
      SELECT CASE WHEN l IN ('Anomaly', 'abnormal', 'gearbox fault', '1') THEN true WHEN l IN ('normal', 'Healthy', '0') THEN false END AS is_anomaly, identifier, 'sensor_' || s || x AS snake, 'Sensor ' || s AS base, CASE WHEN x = '' THEN 'unspecified' ELSE x[2:] END AS statistic, count(*) AS rows FROM o GROUP BY ALL"""),
    "pr13_pr29_roles": (pr_roles, """WITH k AS (SELECT DISTINCT o_orderkey % 24 AS k FROM orders)
      SELECT k, CASE k % 6 WHEN 0 THEN 'driver' WHEN 1 THEN 'temperature' WHEN 2 THEN 'driver' WHEN 3 THEN 'counter' WHEN 4 THEN 'unclassified' ELSE 'other' END AS role,
        CASE WHEN k BETWEEN 1 AND 5 THEN 'IR' WHEN k BETWEEN 6 AND 10 THEN 'OR' WHEN k BETWEEN 11 AND 15 THEN 'B' WHEN k BETWEEN 16 AND 20 THEN 'C' END AS cohort,
        CASE WHEN k < 10 THEN 'eligible' WHEN k < 15 THEN 'exact_copy_excluded' ELSE 'other_ineligible' END AS manifest, k % 2 = 0 AS flag,
        CASE WHEN k / 60 < 0.1 THEN 'small' WHEN k / 60 < 0.25 THEN 'moderate' ELSE 'large' END AS band, k % 3 = 0 AS reserved FROM k"""),
    "pr15_angles": (pr15_angles, """WITH d AS (SELECT o_orderstatus, CASE WHEN dayofyear(o_orderdate) % 10 <> 0 THEN dayofyear(o_orderdate)::DOUBLE END AS d FROM orders)
      SELECT o_orderstatus, round(avg(coalesce(sin(radians(d)), 0)), 6) AS mean_sin, round(avg(coalesce(cos(radians(d)), 0)), 6) AS mean_cos, count(*) FILTER (d IS NULL) AS missing FROM d GROUP BY 1"""),
    "pr17_robust_transform": (pr17_robust_transform, f"""WITH l AS (SELECT l_returnflag, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS q FROM lineitem),
      p AS (SELECT l_returnflag, quantile_cont(q, 0.5) AS m, quantile_cont(q, 0.25) AS q25, quantile_cont(q, 0.75) AS q75, stddev_pop(q) AS sd FROM l GROUP BY 1)
      SELECT l_returnflag, count(*) FILTER (q IS NULL) AS missing, round(avg((coalesce(q, m) - m) / {_robust}), 6) AS mean_scaled, round(max((coalesce(q, m) - m) / {_robust}), 6) AS max_scaled FROM l JOIN p USING (l_returnflag) GROUP BY 1"""),
    "pr20_exclusion": (pr20_exclusion, f"WITH {SCADA_SQL} SELECT case_key, CASE WHEN train_test <> 'train' THEN 'prediction' WHEN status_type_id NOT IN (0, 2) THEN 'abnormal_status' WHEN click IS NULL THEN 'missing_click' WHEN view IS NULL THEN 'missing_view' ELSE 'included' END AS reason, count(*) AS rows FROM scada GROUP BY ALL"),
    "ag1_case_audit": (ag1_case_audit, f"WITH {SCADA_SQL} SELECT case_key, count(*) AS rows, count(*) FILTER (train_test = 'train') AS train_rows, count(*) FILTER (train_test = 'prediction') AS prediction_rows, count(*) FILTER ({FIT_SQL}) AS training_normal_rows, string_agg(DISTINCT status_type_id::VARCHAR, ',' ORDER BY status_type_id::VARCHAR) AS status_ids_seen FROM scada GROUP BY 1"),
    "ag2_channel_audit": (ag2_channel_audit, f"WITH {SCADA_SQL}, {_audit} SELECT * REPLACE (round(availability, 6) AS availability, round(zero_fraction_of_finite, 6) AS zero_fraction_of_finite), CASE WHEN finite_rows = 0 THEN 'all_missing' WHEN zero_rows = finite_rows THEN 'structurally_zero' WHEN availability < 0.7 THEN 'low_availability' ELSE 'pass' END AS review_flag FROM a"),
    "ag3_channel_rollup": (ag3_channel_rollup, f"""WITH {SCADA_SQL}, {_audit} SELECT channel, count(DISTINCT case_key) AS cases, sum(finite_rows)::BIGINT AS finite_rows, round(min(availability), 6) AS min_availability, round(quantile_cont(availability, 0.5), 6) AS median_availability, round(max(availability), 6) AS max_availability,
      round(sum(finite_rows) / greatest(sum(finite_rows + missing_rows), 1), 6) AS pooled_availability, round(sum(zero_rows) / nullif(sum(finite_rows), 0), 6) AS pooled_zero_fraction FROM a GROUP BY 1"""),
    "ag5_moments": (ag5_moments, "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS sd, round(min(l_extendedprice), 3) AS min, round(max(l_extendedprice), 3) AS max, round(var_samp(l_extendedprice) / 1e6, 3) AS variance_m FROM lineitem GROUP BY ALL"),
    "ag6_usable": (ag6_usable, f"""WITH {SCADA_SQL}, f AS (SELECT * FROM scada WHERE {FIT_SQL}), l AS ({" UNION ALL ".join(f"SELECT case_key, '{c}' AS channel, {c} AS v FROM f" for c in CHANNELS)})
      SELECT case_key, channel, count(*) AS fit_rows, coalesce(count(v) / count(*) >= 0.7 AND count(v) > 1 AND var_samp(v) > 0, false) AS usable FROM l GROUP BY ALL"""),
    "ag8_robust": (ag8_robust, f"WITH p AS (SELECT l_returnflag, count(l_quantity) AS n, quantile_cont(l_quantity, 0.5) AS m, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.75) AS q75, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY 1) SELECT l_returnflag, n, round(m, 6) AS center, round(q25, 6) AS q25, round(q75, 6) AS q75, round({_robust}, 6) AS scale FROM p"),
    "ag9_fit_ladder": (ag9_fit_ladder, """WITH d AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_linestatus = 'F' THEN 3.0::DOUBLE WHEN l_linenumber > 1 THEN l_tax END AS v FROM lineitem),
      p AS (SELECT l_returnflag, l_linestatus, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, mad(v) AS mad, stddev_samp(v) AS sd, count(v) < count(*) AS missing_indicator FROM d GROUP BY ALL),
      t AS (SELECT *, 100 * 2.220446049250313e-16 * greatest(1, abs(m)) AS tol FROM p)
      SELECT l_returnflag, l_linestatus, round(m, 6) AS center, round(CASE WHEN iqr > tol THEN iqr WHEN 1.4826 * mad > tol THEN 1.4826 * mad WHEN sd > tol THEN sd ELSE 1 END, 6) AS scale,
        CASE WHEN iqr > tol THEN 'iqr' WHEN 1.4826 * mad > tol THEN 'mad' WHEN sd > tol THEN 'sd' ELSE 'unit' END AS scale_statistic, missing_indicator, (iqr > tol OR 1.4826 * mad > tol OR sd > tol) AS keep FROM t"""),
    "ag11_reservoir": (ag11_reservoir, "SELECT event_id, user_id, event_type FROM events ORDER BY sha256('29|' || event_id)[1:16], event_id LIMIT 100"),
    "ag12_operational": (ag12_operational, f"WITH {SCADA_SQL} SELECT case_key, status_type_id, train_test, count(*) AS rows, count(*) FILTER (click IS NULL) AS missing_click, min(ts) AS first_ts, max(ts) AS last_ts FROM scada GROUP BY ALL"),
    "ag14_duplicate_keys": (ag14_duplicate_keys, "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "ag15_higher_quantile": (ag15_higher_quantile, """WITH r AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, value, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type, ts::DATE) AS n FROM events)
      SELECT event_type, day, value AS quantile, n FROM r WHERE r = ceil(CAST(0.9 AS DOUBLE) * (n - 1)) + 1"""),
    "ag16_q90": (ag16_q90, "SELECT event_type, round(quantile_cont(value, 0.9), 5) AS q90, round(quantile_cont(value, 0.5), 5) AS median FROM events GROUP BY 1"),
    "ag17_pivot": (ag17_pivot, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS share_f FROM orders GROUP BY 1"),
    "ag18_balance": (ag18_balance, "SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS fraction FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)"),
    "ag26_ag27_concentration": (ag26_concentration, """WITH c AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), r AS (SELECT c_mktsegment, v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY v DESC, o_custkey) AS rn FROM c JOIN customer ON c_custkey = o_custkey)
      SELECT c_mktsegment, round(sum(v) FILTER (rn <= 1) / sum(v), 6) AS top1_share, round(sum(v) FILTER (rn <= 5) / sum(v), 6) AS top5_share, count(*) FILTER (v > 1e6) AS over_1e6, round(sum(v) ^ 2 / sum(v * v), 3) AS effective_number FROM r GROUP BY 1"""),
    "ag28_wilson": (ag28_wilson, """WITH g AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS successes, count(*) AS total FROM orders GROUP BY 1), w AS (SELECT *, successes / total AS p, 1.959963984540054::DOUBLE AS z FROM g)
      SELECT o_orderpriority, successes, total, round((p + z*z/(2*total) - z * sqrt(p*(1-p)/total + z*z/(4*total*total))) / (1 + z*z/total), 6) AS lower, round((p + z*z/(2*total) + z * sqrt(p*(1-p)/total + z*z/(4*total*total))) / (1 + z*z/total), 6) AS upper FROM w"""),
    "ag33_spearman": (ag33_spearman, """WITH r AS (SELECT rank() OVER (ORDER BY c_custkey) + (count(*) OVER (PARTITION BY c_custkey) - 1) / 2 AS a, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2 AS b, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS c FROM customer)
      SELECT 'c_custkey' AS left, 'c_nationkey' AS right, round(corr(a, b), 6) AS rho FROM r UNION ALL SELECT 'c_custkey', 'c_acctbal', round(corr(a, c), 6) FROM r UNION ALL SELECT 'c_nationkey', 'c_acctbal', round(corr(b, c), 6) FROM r"""),
    "ag34_psi": (ag34_psi, f"""WITH d AS (SELECT l_extendedprice AS v, l_linenumber <= 3 AS t FROM lineitem), e AS (SELECT list_sort(list_distinct(quantile_cont(v, [{", ".join(str(i / 10) for i in range(11))}]))) AS e FROM d WHERE t),
      b AS (SELECT t, len(list_filter(e[2 : len(e) - 1], lambda x: x < v)) AS bin FROM d, e), s AS (SELECT bin, count(*) FILTER (t) AS a, count(*) FILTER (NOT t) AS b FROM b GROUP BY 1),
      f AS (SELECT greatest(a / sum(a) OVER (), 1e-6) AS p, greatest(b / sum(b) OVER (), 1e-6) AS q FROM s), r AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM f)
      SELECT round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'small' WHEN psi < 0.25 THEN 'moderate' ELSE 'large' END AS band FROM r"""),
    "ag35_ecdf": (ag35_ecdf, "SELECT s_suppkey, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS ecdf FROM supplier"),
    "ag41_signal_moments": (ag41_moments, """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, avg(x) AS mu FROM v GROUP BY 1), c AS (SELECT vec_id, avg((x - mu)^2) AS m2, avg((x - mu)^3) AS m3, avg((x - mu)^4) AS m4, sqrt(avg(x * x)) AS rms, max(abs(x)) AS top FROM v JOIN m USING (vec_id) GROUP BY 1)
      SELECT vec_id, round(m4 / m2^2 - 3, 4) AS kurtosis, round(m3 / m2^1.5, 4) AS skew, round(top / rms, 4) AS crest, round(ln(rms), 4) AS log_rms FROM c"""),
    "ml28_equal_block_quantile": (ml28_equal_blocks, """WITH m AS (SELECT event_type, ts::DATE AS day, value, 1.0::DOUBLE / count(*) OVER (PARTITION BY event_type, ts::DATE) AS m FROM events), c AS (SELECT *, sum(m) OVER (PARTITION BY event_type ORDER BY value) AS c FROM m), b AS (SELECT event_type, count(DISTINCT day) AS blocks FROM m GROUP BY 1)
      SELECT event_type, min(value) AS quantile, max(blocks) AS blocks FROM c JOIN b USING (event_type) WHERE c >= 0.95::DOUBLE * blocks - 1e-9 GROUP BY 1"""),
}
