"""Queries of masks, donor sets, duplicate-safe reductions, policies and digests, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helmwatch.operators import evaluation as E
from helmwatch.operators import quality as A
from helmwatch.operators import relations as R
from helmwatch.operators import selection as X
from helmwatch.plans.quality_queries import FIT_SQL, fit
from helmwatch.sources.tables import CHANNELS, SCADA_SQL, scada, table

TEMPERATURES = ("error", "view")


def ag13_integrity(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("suppliers"), (F.countDistinct("l_returnflag") == 1).alias("one_flag"))
    return per.groupBy("suppliers", "one_flag").agg(F.count("*").alias("orders"))


def ag19_reduction(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").alias("discount_rate"), F.col("l_quantity").alias("quantity_count"), F.col("l_tax").alias("tax"))
    out = X.reduce_duplicates(li, ("discount_rate", "quantity_count", "tax"), "l_orderkey")
    return out.select("l_orderkey", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in out.columns[1:]))


def ag25_masked_means(spark, sf_dir):
    out = X.masked_means(scada(spark, sf_dir), F.col("status_type_id") == 0, CHANNELS, "case_key")
    return out.select("case_key", *(F.round(c, 4).alias(c) for c in CHANNELS))


def ag40_localisation(spark, sf_dir):
    """Truth against localisation over all categories, also those that never occur."""
    said = F.when(F.col("o_totalprice") > 250000, "F").when(F.col("o_totalprice") > 100000, "O").otherwise("P")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("truth"), said.alias("predicted")).agg(F.count("*").alias("n"))
    return R.full_grid(n, "n", truth=["F", "O", "P"], predicted=["F", "O", "P", "INDETERMINATE"])


def w19_cumulative(spark, sf_dir):
    day = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("orders"))
    return day.withColumn("so_far", F.sum("orders").over(Window.partitionBy("o_orderstatus").orderBy("day")))


def j2_j5_left(spark, sf_dir):
    """Customers with the totals of their orders, one to one, then those with few."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return X.left_one_to_one(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), o, ["c_custkey"]).where("orders IS NULL OR orders < 8")


def j4_by_index(spark, sf_dir):
    """Every user's events with the time of the event one hundred places on, by index."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.row_number().over(w).alias("i"))
    later = e.select("user_id", (F.col("i") - 100).alias("i"), F.col("time").alias("later"))
    return e.join(later, ["user_id", "i"], "left").select("event_id", "i", "time", "later")


def j6_split_map(spark, sf_dir):
    folds = R.hash_folds(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "s_nationkey")
    return X.with_assignment(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), folds, "l_suppkey", "inner_fold").groupBy("inner_fold").agg(F.count("*").alias("rows"), F.sum("l_quantity").cast("long").alias("quantity"))


def j11_donors(spark, sf_dir):
    d = X.donor_sets(table(spark, sf_dir, "customer"), "c_nationkey", F.col("c_acctbal") > 0, "c_acctbal")
    return d.withColumn("donor_sum", F.round("donor_sum", 2))


def _models(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    parts = [E.ridge_line(li, driver, "l_extendedprice", 1.0, "l_returnflag", "l_linenumber").select(F.lit(driver).alias("driver"), "l_returnflag", "l_linenumber", "n", "r2") for driver in ("l_quantity", "l_tax")]
    return parts[0].union(parts[1])


def ml13_modelability(spark, sf_dir):
    return X.modelability_masks(_models(spark, sf_dir), "r2", F.col("n") >= 30).groupBy("driver", "threshold").agg(F.count("*").alias("models"), F.count_if("modelable").alias("modelable"))


def ml26_heads(spark, sf_dir):
    audit = A.channel_audit(scada(spark, sf_dir), CHANNELS, fit())
    return X.head_masks(audit, F.col("availability") >= 0.7, F.col("channel").isin(*TEMPERATURES)).groupBy("case_key", "evidence_head").agg(F.count_if("in_head").alias("targets"))


def _folds(spark, sf_dir):
    return R.hash_folds(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


def ml41_fold_views(spark, sf_dir):
    return X.fold_views(_folds(spark, sf_dir), "inner_fold").groupBy("outer_fold", "role").agg(F.count("*").alias("assets"), F.countDistinct("inner_fold").alias("folds"), F.sum("c_custkey").alias("key_sum"))


def ml44_digest(spark, sf_dir):
    return X.assignment_digest(_folds(spark, sf_dir), "c_custkey", "inner_fold", "c_mktsegment")


def ml48_alpha(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).alias("supplier_group"), (F.col("l_quantity") / 50).alias("p"), "l_discount")
    return X.alpha_policy(li, "supplier_group", "p", F.col("l_discount") > 0.05).withColumn("score", F.round("score", 6))


def b2_scaled_mad(spark, sf_dir):
    return X.scaled_mad(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey").withColumn("scaled_mad", F.round("scaled_mad", 3))


_fold_sql = """f AS (SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('43|' || c_custkey)[1:16], c_custkey) - 1 + (1 + dense_rank() OVER (ORDER BY c_mktsegment) - 1) % 5) % 5 + 1)::INT AS inner_fold FROM customer)"""
_line = lambda driver: f"SELECT '{driver}' AS driver, count(*) AS n, avg({driver}) AS mx, avg(l_extendedprice) AS my, var_pop({driver}) * count(*) AS sxx, covar_pop(l_extendedprice, {driver}) * count(*) AS sxy, var_pop(l_extendedprice) * count(*) AS syy FROM lineitem GROUP BY l_returnflag, l_linenumber"
_fb = "coalesce(1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0), 0)"
_either = lambda c, other: f"round(CASE WHEN max({c}) - min({c}) <= 1e-12 + 1e-12 * abs(min({c})) THEN min({c}) ELSE {other}({c}) END + 1e-9, 5)"

QUERIES = {
    "ag13_integrity": (ag13_integrity, "SELECT suppliers, one_flag, count(*) AS orders FROM (SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) = 1 AS one_flag FROM lineitem GROUP BY l_orderkey) GROUP BY ALL"),
    "ag19_duplicate_safe": (ag19_reduction, f"SELECT l_orderkey, {_either('l_discount', 'avg')} AS discount_rate, {_either('l_quantity', 'sum')} AS quantity_count, {_either('l_tax', 'median')} AS tax FROM lineitem GROUP BY 1"),
    "ag25_masked_means": (ag25_masked_means, f"WITH {SCADA_SQL} SELECT case_key, {', '.join(f'round(avg({c}) FILTER (status_type_id = 0), 4) AS {c}' for c in CHANNELS)} FROM scada GROUP BY 1"),
    "ag40_localisation": (ag40_localisation, """SELECT t AS truth, p AS predicted, count(o_orderkey) AS n FROM (SELECT unnest(['F','O','P']) AS t) CROSS JOIN (SELECT unnest(['F','O','P','INDETERMINATE']) AS p)
      LEFT JOIN orders ON o_orderstatus = t AND p = CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END GROUP BY ALL"""),
    "w19_cumulative": (w19_cumulative, "WITH d AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS orders FROM orders GROUP BY ALL) SELECT *, (sum(orders) OVER (PARTITION BY o_orderstatus ORDER BY day))::BIGINT AS so_far FROM d"),
    "j2_j5_left_one_to_one": (j2_j5_left, "WITH o AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) SELECT c_custkey, c_nationkey, orders FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE orders IS NULL OR orders < 8"),
    "j4_left_by_index": (j4_by_index, "WITH e AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT a.event_id, a.i, a.time, b.time AS later FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.i = a.i + 100"),
    "j6_split_map": (j6_split_map, """WITH f AS (SELECT s_suppkey, ((row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('43|' || s_suppkey)[1:16], s_suppkey) - 1 + (dense_rank() OVER (ORDER BY s_nationkey)) % 5) % 5 + 1)::INT AS inner_fold FROM supplier)
      SELECT inner_fold, count(*) AS rows, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN f ON s_suppkey = l_suppkey GROUP BY 1"""),
    "j11_donor_sets": (j11_donors, """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer) SELECT x.k AS asset, y.k AS held_out, count(*) FILTER (c_acctbal > 0) AS donors, round(coalesce(sum(c_acctbal) FILTER (c_acctbal > 0), 0), 2) AS donor_sum
      FROM a x CROSS JOIN a y JOIN customer ON c_nationkey <> x.k AND c_nationkey <> y.k GROUP BY ALL"""),
    "ml13_modelability": (ml13_modelability, f"""WITH m AS ({_line("l_quantity")} UNION ALL {_line("l_tax")}), s AS (SELECT *, sxy / (sxx + 1) AS b FROM m), r AS (SELECT driver, n, 1 - (syy - 2 * b * sxy + b * b * sxx) / nullif(syy, 0) AS r2 FROM s)
      SELECT driver, t::DOUBLE AS threshold, count(*) AS models, count(*) FILTER (n >= 30 AND r2 >= t) AS modelable FROM r, (SELECT unnest([0.0, 0.1, 0.3]::DOUBLE[]) AS t) GROUP BY ALL"""),
    "ml26_head_masks": (ml26_heads, f"""WITH {SCADA_SQL}, l AS ({" UNION ALL ".join(f"SELECT case_key, '{c}' AS channel, count({c}) / count(*) AS a FROM scada WHERE {FIT_SQL} GROUP BY 1" for c in CHANNELS)})
      SELECT case_key, h AS evidence_head, count(*) FILTER (a >= 0.7 AND (h = 'all_modellable' OR channel IN ('error', 'view'))) AS targets FROM l, (SELECT unnest(['all_modellable', 'temperature_modellable']) AS h) GROUP BY ALL"""),
    "ml41_fold_views": (ml41_fold_views, f"WITH {_fold_sql}, o AS (SELECT DISTINCT inner_fold AS outer_fold FROM f) SELECT outer_fold, CASE WHEN inner_fold = outer_fold THEN 'validation' ELSE 'development' END AS role, count(*) AS assets, count(DISTINCT inner_fold) AS folds, sum(c_custkey)::BIGINT AS key_sum FROM f, o GROUP BY ALL"),
    "ml44_assignment_digest": (ml44_digest, f"""WITH {_fold_sql}, b AS (SELECT c_mktsegment, c_custkey // 1000 AS block, sha256(string_agg(c_custkey || '|' || inner_fold, chr(10) ORDER BY c_custkey)) AS d, count(*) AS n FROM f GROUP BY ALL)
      SELECT c_mktsegment, sum(n)::BIGINT AS assets, sha256(string_agg(d, chr(10) ORDER BY block)) AS digest FROM b GROUP BY 1"""),
    "ml48_alpha_policy": (ml48_alpha, f"""WITH g AS (SELECT unnest({list(X.ALPHAS)}::DOUBLE[]) AS alpha, unnest(range({len(X.ALPHAS)})) AS level), m AS (SELECT l_suppkey % 12 AS asset, level, alpha, count(*) FILTER (l_quantity / 50 <= alpha AND l_discount > 0.05::DOUBLE) AS tp, count(*) FILTER (l_quantity / 50 <= alpha AND l_discount <= 0.05::DOUBLE) AS fp, count(*) FILTER (l_quantity / 50 > alpha AND l_discount > 0.05::DOUBLE) AS fn FROM lineitem, g GROUP BY ALL),
      t AS (SELECT asset, level, alpha, sum(tp) OVER l - tp AS tp, sum(fp) OVER l - fp AS fp, sum(fn) OVER l - fn AS fn FROM m WINDOW l AS (PARTITION BY level)), s AS (SELECT *, {_fb} AS s FROM t)
      SELECT asset, alpha, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY asset ORDER BY s DESC, level) = 1"""),
    "b2_scaled_mad": (b2_scaled_mad, "WITH m AS (SELECT *, median(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) SELECT o_custkey, round(1.4826::DOUBLE * median(abs(o_totalprice - m)) + 1e-12, 3) AS scaled_mad FROM m GROUP BY 1"),
}
