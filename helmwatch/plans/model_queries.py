"""Queries of the ridge, uncertainty, vibration and simulation operators, with oracles where SQL has the words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.operators import bearing as B
from helmwatch.operators import crossfit as X
from helmwatch.operators import quality as A
from helmwatch.operators import ridge as G
from helmwatch.operators import sequence as Q
from helmwatch.operators import spectral as P
from helmwatch.plans.quality_queries import FIT_SQL, fit
from helmwatch.plans.sequence_queries import FOLDS_SQL, folded
from helmwatch.sources.files import kept
from helmwatch.sources.tables import table

#: Parts as bearings: balls, ball and pitch diameter, contact angle.
_GEO_SQL = "g AS (SELECT p_partkey AS bearing, (7 + p_partkey % 7)::DOUBLE AS n, 5 + p_size / 20.0::DOUBLE AS d, 30 + (p_partkey % 40) / 2.0::DOUBLE AS p, (p_partkey % 2 * 15)::DOUBLE AS a FROM part), c AS (SELECT *, d / p * cos(radians(a)) AS c FROM g)"


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("bearing"), (7 + k % 7).cast("double").alias("n"), (5 + F.col("p_size") / 20).alias("d"), (30 + k % 40 / 2).alias("p"), (k % 2 * 15).cast("double").alias("a"))


def _design(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """Rows with folds and embargo, robustly scaled drivers and their basis. Scalers are those of the case's fit rows."""
    rows = kept(Q.embargo_bits(folded(spark, sf_dir), width=6), "embargoed-rows")
    scalers = {c: A.robust_parameters(rows.where(fit()), c, "case_key") for c in ("click", "view")}
    for c, parameters in scalers.items():
        rows = A.robust_transform(rows, c, parameters, "case_key")
    return kept(rows, "scaled-rows"), G.basis([F.col("click_scaled"), F.col("view_scaled")])


def ml5_ml6_penalties(spark, sf_dir):
    """The held-out error of every penalty, of one driver on fit rows, with an embargo around held-out rows."""
    rows = Q.embargo_bits(folded(spark, sf_dir), width=6).where(fit() & F.col("click").isNotNull())
    m = G.crossfit(rows, [F.lit(1.0), F.col("click")], F.col("purchase"), min_rows=30)
    each = m.select("case_key", "rows", F.explode(F.arrays_zip(F.array(*map(F.lit, G.PENALTIES)).alias("penalty"), F.col("errors").alias("error"))).alias("e"))
    return each.select("case_key", "rows", F.col("e.penalty").alias("penalty"), F.round("e.error", 1).alias("held_out_error"))


def ml8_crossfit(spark, sf_dir):
    rows, terms = _design(spark, sf_dir)
    m = G.crossfit(rows.where(fit()), terms, F.col("purchase"), min_rows=30)
    return m.select("case_key", "penalty", "rows", F.round("r2", 6).alias("r2"), F.transform("coefficients", lambda x: F.round(x, 5)).alias("coefficients"))


def ml10_ml14_uncertainty(spark, sf_dir):
    """Held-out residuals, the log-variance model, leverage support and the total scale of every observed row."""
    rows, terms = _design(spark, sf_dir)
    mean = G.predict(rows, G.crossfit(rows.where(fit()), terms, F.col("purchase"), min_rows=30), terms).withColumn("residual", F.col("purchase") - F.col("prediction")).drop("leverage")
    mean = kept(mean, "mean-residuals")
    scaled = mean.join(A.robust_parameters(mean.where(fit()), "residual", "case_key").select("case_key", F.col("scale").alias("reference")), "case_key")
    scaled = kept(scaled, "scaled-residuals")
    target = G.log_variance_target(F.col("residual"), F.col("reference"))
    spread = G.predict(scaled.drop("prediction"), G.crossfit(scaled.where(fit()), terms, target, min_rows=30), terms)
    spread = kept(spread, "log-variances")
    support = A.robust_parameters(spread.where(fit()), "leverage", "case_key").select("case_key", F.col("center").alias("_c"), F.col("scale").alias("_s"))
    out = spread.join(support, "case_key").withColumn("aleatoric", G.aleatoric_scale(F.col("prediction"))).withColumn("total", G.total_scale(F.col("aleatoric"), (F.col("leverage") - F.col("_c")) / F.col("_s")))
    return out.where("residual IS NOT NULL").select("case_key", "ts", F.round("residual", 4).alias("residual"), F.round("aleatoric", 4).alias("aleatoric"), F.round("total", 4).alias("total"), F.round(F.abs("residual") / F.nullif(F.col("total"), F.lit(0.0)), 4).alias("score"))


_TARGETS = ("purchase", "signup", "view")
_MIN = 15


def _training(spark: SparkSession, sf_dir: str, *drivers: str) -> DataFrame:
    rows = Q.embargo_bits(folded(spark, sf_dir), width=6)
    rows = rows.select("case_key", "ts", "row_id", "fold_id", X.training_bits(fit(), F.col("embargo_bits"), 5).alias("train_bits"), F.array(*drivers).alias("drivers"), F.array(*_TARGETS).alias("targets"))
    return kept(rows, "training-rows")


def _fitted(spark: SparkSession, sf_dir: str):
    """One driver, linear: rows with their design, states, masks and all solutions."""
    rows, states = X.scaled_design(_training(spark, sf_dir, "click"), X.Design(("click",), nonlinear=False), 5, kept=kept)
    rows = kept(rows, "designed-rows")
    masks = kept(X.observation_masks(rows, 5), "masks")
    return rows, states, masks, kept(X.solve_grams(X.grams(rows, masks, 1), min_rows=_MIN), "solutions")


def ml1_design(spark, sf_dir):
    """Two drivers with indicators, squares and their product: center and scale of every term, fold by fold."""
    design = X.Design(("click", "view"), ("click", "view"))
    states = X.scaled_design(_training(spark, sf_dir, "click", "view"), design, 5, kept=kept)[1]
    long = states.select("case_key", F.posexplode("term_state").alias("k", "_t")).select("case_key", "k", F.posexplode("_t").alias("i", "_t"))
    names = F.array(*map(F.lit, design.names()))
    return long.select("case_key", "k", F.get(names, F.col("i")).alias("term"), (F.round("_t.center", 5) + 0.0).alias("center"), F.round("_t.scale", 5).alias("scale"))


def ml3_masks(spark, sf_dir):
    return _fitted(spark, sf_dir)[2]


def ml5_clipped(spark, sf_dir):
    rows, _, _, solved = _fitted(spark, sf_dir)
    e = X.penalty_errors(rows, solved)
    return e.select("case_key", "observations", "selected", F.posexplode("errors").alias("penalty", "error")).withColumn("error", F.round("error", 6))


def ml6_masked_r2(spark, sf_dir):
    rows, states, _, solved = _fitted(spark, sf_dir)
    r2 = X.held_out_r2(rows, solved, X.penalty_errors(rows, solved), states, _MIN)
    return r2.withColumn("r2", F.round("r2", 6))


def _spectral(spark, sf_dir):
    """A constant and one driver, three responses in deviations of the fit rows."""
    rows = Q.embargo_bits(folded(spark, sf_dir), width=6).withColumn("train_bits", X.training_bits(fit(), F.col("embargo_bits"), 5))
    on = rows.where(fit())
    center = on.groupBy("case_key").agg(F.median("click").alias("_m"), *(c for t in _TARGETS for c in (F.avg(t).alias(f"{t}_mean"), F.stddev_pop(t).alias(f"{t}_sd"))))
    filled = on.join(center.select("case_key", "_m"), "case_key").groupBy("case_key").agg(F.avg(F.coalesce("click", "_m")).alias("_mean"), F.stddev_pop(F.coalesce("click", "_m")).alias("_sd"))
    joined = rows.join(center, "case_key").join(filled, "case_key")
    z = P.standardised(F.col("click"), F.col("_m"), F.col("_mean"), F.col("_sd"))
    y = F.array(*((F.col(t) - F.col(f"{t}_mean")) / F.col(f"{t}_sd") for t in _TARGETS))
    rows = kept(joined.select("case_key", "ts", "fold_id", "train_bits", F.array(F.lit(1.0), z).alias("phi"), y.alias("responses")), "spectral-rows")
    return rows, kept(P.solve_path(P.fold_grams(rows, 2, 3, 5)), "spectral-path")


def ml49_path(spark, sf_dir):
    rows, solved = _spectral(spark, sf_dir)
    c = P.choose_penalty(rows, solved, 3)
    return c.select("case_key", "penalty", F.posexplode(F.arrays_zip("r2", "sd")).alias("response", "_v")).select("case_key", "penalty", "response", F.round("_v.r2", 6).alias("r2"), F.round("_v.sd", 6).alias("sd"))


def ml49_scores(spark, sf_dir):
    rows, solved = _spectral(spark, sf_dir)
    out = P.path_scores(rows, solved, P.choose_penalty(rows, solved, 3), 5)
    return out.select("case_key", "ts", F.round("leverage", 8).alias("leverage"), F.posexplode("scores").alias("response", "score")).where("score IS NOT NULL").withColumn("score", F.round("score", 5))


def b3_orders(spark, sf_dir):
    g = _geometry(spark, sf_dir)
    return g.select("bearing", *(F.round(c, 6).alias(k) for k, c in B.characteristic_orders(F.col("n"), F.col("d"), F.col("p"), F.col("a")).items()))


def b4_usability(spark, sf_dir):
    g = _geometry(spark, sf_dir)
    o = B.characteristic_orders(F.col("n"), F.col("d"), F.col("p"), F.col("a"))
    long = g.select("bearing", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), c.alias("order_value")) for k, c in o.items() if k != "ftf"))).alias("o")).select("bearing", "o.*")
    bins, ok = B.order_usable(F.col("order_value"), F.lit(54.0), 2.62)
    return long.select("bearing", "name", F.round(bins, 4).alias("bins"), ok.alias("usable"))


def _orders(spark, sf_dir) -> DataFrame:
    g = _geometry(spark, sf_dir)
    o = B.characteristic_orders(F.col("n"), F.col("d"), F.col("p"), F.col("a"))
    return g.select("bearing", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.round(c, 9).alias("order_value")) for k, c in o.items()))).alias("o")).select("bearing", "o.*")


def b5_b6_nulls(spark, sf_dir):
    """One set of nulls for every order of every part, as its size, pool and sums."""
    o = _orders(spark, sf_dir)
    nulls = B.matched_nulls(o, B.forbidden_centres(o), "case-1", 49, 5_001)
    return nulls.groupBy("bearing", "name").agg(F.max("pool").alias("pool"), F.count("*").alias("nulls"), F.sum("grid_id").alias("grid_ids"), F.round(F.min("order_value"), 6).alias("least"), F.round(F.max("order_value"), 6).alias("greatest"))


def b17_resolution(spark, sf_dir):
    return B.resolution_search(_orders(spark, sf_dir))


def b7_b10_features(spark, sf_dir):
    """Features of the vectors as signals of 64 samples a second, each at the orders of the part of its number."""
    v = table(spark, sf_dir, "embeddings")
    spectra = B.envelope_spectra(v, "vec_id", "embedding", 64.0, (8.0, 28.0)).withColumnRenamed("vec_id", "bearing")
    out = B.order_features(spectra, _orders(spark, sf_dir), ["bearing"], 4.0)
    return out.select(F.col("bearing").alias("vec_id"), "name", *(F.round(c, 5).alias(c) for c in ("peak", "floor", "score", "harmonics", "sidebands")))


def b8_b9_spectra(spark, sf_dir):
    """Envelope peaks of the vectors as signals."""
    f = B.envelope_peaks(64.0, [(2.0, 16.0), (16.0, 31.0)], {"bpfo": 3.05, "bpfi": 4.95}, 2.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", f("embedding").alias("f")).select("vec_id", F.round("f.bpfo", 3).alias("bpfo"), F.round("f.bpfi", 3).alias("bpfi"))


def ag29_clopper_pearson(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    # The limits depend on the two counts alone, and few pairs of counts occur.
    limits = o.select("k", "n").distinct().withColumn("c", B.clopper_pearson(F.col("k"), F.col("n")))
    return o.join(limits, ["k", "n"]).select("o_custkey", "k", "n", F.round("c.lower", 6).alias("lower"), F.round("c.upper", 6).alias("upper"))


_ORDERS_SQL = f"""{_GEO_SQL}, ob AS (SELECT bearing, unnest(['ftf', 'bpfo', 'bpfi', 'bsf']) AS name, unnest([0.5 * (1 - c), n / 2 * (1 - c), n / 2 * (1 + c), p / (2 * d) * (1 - c * c)]) AS o FROM c),
 os AS (SELECT bearing, name, round(o, 9) AS v, abs(round(o, 9) - greatest(1, round_even(round(o, 9), 0))) AS zeta FROM ob)"""
_SP_SQL = f"""{FOLDS_SQL}, ks(k) AS (VALUES (0), (1), (2), (3), (4)), em AS (SELECT f.*, k, max((fold_id = k)::INT) OVER (PARTITION BY case_key, segment_id, k ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM folds f, ks),
 on_ AS (SELECT * FROM folds WHERE train_test = 'train' AND status_type_id IN (0, 2)), ce AS (SELECT case_key, median(click) AS m, avg(purchase) AS m0, stddev_pop(purchase) AS s0, avg(signup) AS m1, stddev_pop(signup) AS s1, avg(view) AS m2, stddev_pop(view) AS s2 FROM on_ GROUP BY 1),
 fi AS (SELECT case_key, avg(coalesce(click, m)) AS mz, stddev_pop(coalesce(click, m)) AS sz FROM on_ JOIN ce USING (case_key) GROUP BY 1),
 al AS (SELECT f.case_key, f.ts, f.fold_id, train_test = 'train' AND status_type_id IN (0, 2) AS fit, greatest(-8, least(8, (coalesce(click, m) - mz) / sz)) AS z, t.response, CASE response WHEN 0 THEN (purchase - m0) / s0 WHEN 1 THEN (signup - m1) / s1 ELSE (view - m2) / s2 END AS y FROM folds f JOIN ce USING (case_key) JOIN fi USING (case_key), (VALUES (0), (1), (2)) t(response)),
 tr AS (SELECT al.*, em.k FROM al JOIN em ON em.case_key = al.case_key AND em.ts = al.ts WHERE em.m = 0 AND al.fit UNION ALL SELECT al.*, 5 FROM al WHERE fit),
 gm AS (SELECT case_key, k, response, count(*)::DOUBLE AS a, sum(z) AS b, sum(z * z) AS c, sum(coalesce(y, 0)) AS u, sum(z * coalesce(y, 0)) AS v FROM tr GROUP BY ALL),
 pa(j, l) AS (VALUES {", ".join(f"({j}, {v!r}::DOUBLE)" for j, v in enumerate(P.PATH))}),
 co AS (SELECT case_key, k, response, j, ((c + l) * u - b * v) / ((a + l) * (c + l) - b * b) AS c0, ((a + l) * v - b * u) / ((a + l) * (c + l) - b * b) AS c1, a, b, c, l FROM gm, pa),
 he AS (SELECT al.case_key, al.response, j, al.y, al.y - c0 - c1 * z AS off FROM al JOIN co ON co.case_key = al.case_key AND co.response = al.response AND co.k = al.fold_id WHERE fit AND al.y IS NOT NULL),
 rr AS (SELECT case_key, response, j, 1 - sum(off * off) / (var_pop(y) * count(*)) AS r2, greatest(stddev_pop(off), 1e-6) AS sd FROM he GROUP BY ALL),
 ch AS (SELECT case_key, j AS penalty FROM (SELECT case_key, j, median(r2) AS md FROM rr GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY case_key ORDER BY md DESC, j) = 1)"""
_scale = lambda iqr, sd: f"CASE WHEN {iqr} > 1e-12 THEN {iqr} WHEN {sd} > 1e-7 THEN {sd} END"
_TR_SQL = f"""{FOLDS_SQL}, ks(k) AS (VALUES (0), (1), (2), (3), (4)), em AS (SELECT f.*, k, max((fold_id = k)::INT) OVER (PARTITION BY case_key, segment_id, k ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM folds f, ks),
 fitted AS (SELECT * FROM folds WHERE train_test = 'train' AND status_type_id IN (0, 2)),
 tr AS (SELECT case_key, ts, row_id, k, click, view, purchase, signup FROM em WHERE m = 0 AND train_test = 'train' AND status_type_id IN (0, 2) UNION ALL SELECT case_key, ts, row_id, 5, click, view, purchase, signup FROM fitted),
 md AS (SELECT case_key, k, median(click) AS mc, median(view) AS mv FROM tr GROUP BY ALL),
 fl AS (SELECT tr.*, mc, mv, coalesce(click, mc) AS c, coalesce(view, mv) AS v FROM tr JOIN md USING (case_key, k)),
 ds AS (SELECT case_key, k, any_value(mc) AS mc, any_value(mv) AS mv, coalesce({_scale("quantile_cont(c, 0.75) - quantile_cont(c, 0.25)", "stddev_pop(c)")}, 1) AS sc, coalesce({_scale("quantile_cont(v, 0.75) - quantile_cont(v, 0.25)", "stddev_pop(v)")}, 1) AS sv FROM fl GROUP BY ALL),
 zz AS (SELECT fl.*, (c - ds.mc) / sc AS zc, (v - ds.mv) / sv AS zv FROM fl JOIN ds USING (case_key, k))"""
_CF_SQL = f"""{_TR_SQL}, tm AS (SELECT case_key, k, median(zc) AS tc, {_scale("quantile_cont(zc, 0.75) - quantile_cont(zc, 0.25)", "stddev_pop(zc)")} AS ts_ FROM zz GROUP BY ALL),
 yl AS (SELECT case_key, row_id, k, zc, t.target, CASE t.target WHEN 0 THEN purchase WHEN 1 THEN signup ELSE view END AS y FROM zz, (VALUES (0), (1), (2)) t(target)),
 ys AS (SELECT case_key, k, target, median(y) AS yc, {_scale("quantile_cont(y, 0.75) - quantile_cont(y, 0.25)", "stddev_pop(y)")} AS sy, count(y) AS observed FROM yl GROUP BY ALL),
 xy AS (SELECT yl.case_key, yl.row_id, yl.k, yl.target, CASE WHEN ts_ IS NULL THEN 0 ELSE (zc - tc) / ts_ END AS x, (y - yc) / sy AS y FROM yl JOIN tm ON tm.case_key = yl.case_key AND tm.k = yl.k JOIN ys ON ys.case_key = yl.case_key AND ys.k = yl.k AND ys.target = yl.target WHERE y IS NOT NULL AND sy IS NOT NULL),
 mo AS (SELECT case_key, k, target, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM xy GROUP BY ALL HAVING count(*) >= {_MIN}),
 va AS (SELECT f.case_key, f.row_id, f.fold_id AS k, t.target, CASE WHEN ts_ IS NULL THEN 0 ELSE ((coalesce(click, mc) - mc) / sc - tc) / ts_ END AS x, (CASE t.target WHEN 0 THEN purchase WHEN 1 THEN signup ELSE view END - yc) / sy AS y, sy
   FROM fitted f CROSS JOIN (VALUES (0), (1), (2)) t(target) JOIN ds ON ds.case_key = f.case_key AND ds.k = f.fold_id JOIN tm ON tm.case_key = f.case_key AND tm.k = f.fold_id JOIN ys ON ys.case_key = f.case_key AND ys.k = f.fold_id AND ys.target = t.target),
 er AS (SELECT va.case_key, va.target, penalty, sy, va.y, va.y - my - sxy / (sxx + lam) * (va.x - mx) AS off, my FROM va JOIN mo USING (case_key, k, target), (VALUES {", ".join(f"({j}, {v!r}::DOUBLE)" for j, v in enumerate(G.PENALTIES))}) l(penalty, lam) WHERE va.y IS NOT NULL),
 pe AS (SELECT case_key, penalty, count(*) AS observations, avg(greatest(-10, least(10, off)) ** 2) AS error FROM er GROUP BY ALL),
 se AS (SELECT case_key, max(penalty) AS selected FROM (SELECT *, min(error) OVER (PARTITION BY case_key) AS least FROM pe) WHERE error <= least * (1 + 1e-12) + 1e-12 GROUP BY 1)"""

QUERIES = {
    "ml49_spectral_path": (ml49_path, f"WITH {_SP_SQL} SELECT case_key, penalty, response, round(r2, 6) AS r2, round(sd, 6) AS sd FROM rr JOIN ch USING (case_key) WHERE j = penalty"),
    "ml49_spectral_scores": (ml49_scores, f"""WITH {_SP_SQL}, iv AS (SELECT co.*, sd, (c + l) / ((a + l) * (c + l) - b * b) AS p, -b / ((a + l) * (c + l) - b * b) AS q, (a + l) / ((a + l) * (c + l) - b * b) AS r FROM co JOIN ch USING (case_key) JOIN rr USING (case_key, response, j) WHERE j = penalty AND k = 5),
      hh AS (SELECT al.case_key, al.ts, al.response, al.y - c0 - c1 * z AS off, sd, (p + q * z) * (p + q * z) * a + 2 * (p + q * z) * (q + r * z) * b + (q + r * z) * (q + r * z) * c AS h FROM al JOIN iv ON iv.case_key = al.case_key AND iv.response = al.response WHERE al.y IS NOT NULL)
      SELECT case_key, ts, response, round(h, 8) AS leverage, round(abs(off) / (sd * sqrt(1 + h)), 5) AS score FROM hh"""),
    "ml1_pr18_pr19_design": (ml1_design, f"""WITH {_TR_SQL}, te AS (SELECT case_key, k, t.term, CASE t.term WHEN 'linear::click' THEN zc WHEN 'linear::view' THEN zv WHEN 'missing::click' THEN (click IS NULL)::INT WHEN 'missing::view' THEN (view IS NULL)::INT WHEN 'quadratic::click' THEN zc * zc WHEN 'quadratic::view' THEN zv * zv ELSE zc * zv END AS x
        FROM zz, (VALUES ('linear::click'), ('linear::view'), ('missing::click'), ('missing::view'), ('quadratic::click'), ('quadratic::view'), ('interaction::click*view')) t(term))
      SELECT case_key, k, term, round(median(x), 5) + 0.0 AS center, round({_scale("quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", "stddev_pop(x)")}, 5) AS scale FROM te GROUP BY ALL"""),
    "ml3_shared_masks": (ml3_masks, f"""WITH {_CF_SQL}, rl AS (SELECT case_key, k, target, count(*) AS observed, string_agg(row_id, ',' ORDER BY row_id) AS rows FROM xy GROUP BY ALL) SELECT case_key, k, target, min(target) OVER (PARTITION BY case_key, k, rows) AS mask_id, observed FROM rl"""),
    "ml5_ml8_clipped_penalties": (ml5_clipped, f"WITH {_CF_SQL} SELECT case_key, observations, selected, penalty, round(error, 6) AS error FROM pe JOIN se USING (case_key)"),
    "ml6_masked_r2": (ml6_masked_r2, f"""WITH {_CF_SQL} SELECT case_key, target, count(*) AS n, round(CASE WHEN count(*) >= {_MIN} AND sum((y - my) ** 2 * sy * sy) > 1e-12 THEN 1 - sum(off ** 2 * sy * sy) / sum((y - my) ** 2 * sy * sy) END, 6) AS r2 FROM er JOIN se ON se.case_key = er.case_key AND se.selected = er.penalty GROUP BY ALL""".replace("SELECT case_key, target, count(*) AS n", "SELECT er.case_key, target, count(*) AS n")),
    "ml5_ml6_penalties": (ml5_ml6_penalties, f"""WITH {FOLDS_SQL}, x AS (SELECT f.*, k.k AS fold, max((fold_id = k.k)::INT) OVER (PARTITION BY case_key, segment_id, k.k ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM folds f, (SELECT unnest([0,1,2,3,4]) AS k) k),
      y AS (SELECT * FROM x WHERE {FIT_SQL} AND click IS NOT NULL AND purchase IS NOT NULL), t AS (SELECT case_key, fold, avg(click) AS mx, avg(purchase) AS my, var_pop(click) * count(*) AS sxx, covar_pop(purchase, click) * count(*) AS sxy FROM y WHERE m = 0 GROUP BY ALL),
      e AS (SELECT y.case_key, p AS penalty, power(purchase - my - sxy / (sxx + p) * (click - mx), 2) AS e FROM y JOIN t ON t.case_key = y.case_key AND t.fold = y.fold AND y.fold_id = y.fold, (SELECT unnest({list(G.PENALTIES)}::DOUBLE[]) AS p))
      SELECT case_key, count(*) AS rows, penalty, round(sum(e), 1) AS held_out_error FROM e GROUP BY ALL HAVING count(*) >= 30"""),
    "ml1_ml8_crossfit": (ml8_crossfit, None),
    "ml9_ml15_uncertainty": (ml10_ml14_uncertainty, None),
    "b3_orders": (b3_orders, f"WITH {_GEO_SQL} SELECT bearing, round(0.5 * (1 - c), 6) AS ftf, round(n / 2 * (1 - c), 6) AS bpfo, round(n / 2 * (1 + c), 6) AS bpfi, round(p / (2 * d) * (1 - c * c), 6) AS bsf FROM c"),
    "b4_usability": (b4_usability, f"""WITH {_GEO_SQL}, o AS (SELECT bearing, 'bpfo' AS name, n / 2 * (1 - c) AS v FROM c UNION ALL SELECT bearing, 'bpfi', n / 2 * (1 + c) FROM c UNION ALL SELECT bearing, 'bsf', p / (2 * d) * (1 - c * c) FROM c)
      SELECT bearing, name, round(abs(v - greatest(round(v), 1)) * 54, 4) AS bins, abs(v - greatest(round(v), 1)) * 54 >= 2.62 AS usable FROM o"""),
    "b5_b6_null_orders": (b5_b6_nulls, f"""WITH {_ORDERS_SQL}, ct AS (SELECT bearing, k * v + s AS c FROM os, range(1, 4) t(k), (VALUES (-1.0::DOUBLE), (0.0), (1.0)) x(s) WHERE name <> 'ftf' OR (k = 1 AND s = 0)), cl AS (SELECT bearing, list(c) FILTER (c BETWEEN 1.25 AND 8) AS cs FROM ct GROUP BY 1),
      gr AS (SELECT i AS grid_id, 1.25::DOUBLE + i * (6.75::DOUBLE / 5000) AS g FROM range(5001) t(i)), gz AS (SELECT *, abs(g - greatest(1, round_even(g, 0))) AS z FROM gr),
      fr AS (SELECT os.bearing, name, grid_id, g FROM os JOIN gz ON z BETWEEN zeta - 0.015::DOUBLE AND zeta + 0.015::DOUBLE AND abs(z - zeta) <= 0.015::DOUBLE JOIN cl ON cl.bearing = os.bearing WHERE name <> 'ftf' AND len(list_filter(cs, lambda c: abs(c - g) <= 0.04::DOUBLE)) = 0),
      rk AS (SELECT *, count(*) OVER (PARTITION BY bearing, name) AS pool, row_number() OVER (PARTITION BY bearing, name ORDER BY md5('case-1|' || bearing || '|' || name || '|' || grid_id), grid_id) AS r FROM fr)
      SELECT bearing, name, max(pool) AS pool, count(*) AS nulls, sum(grid_id)::BIGINT AS grid_ids, round(min(g), 6) AS least, round(max(g), 6) AS greatest FROM rk WHERE r <= 49 AND pool >= 49 GROUP BY ALL"""),
    "b17_resolution": (b17_resolution, f"WITH {_ORDERS_SQL}, r AS (SELECT bearing, greatest(26, ceil(2.62::DOUBLE / nullif(min(zeta), 0)))::BIGINT AS n, min(zeta) AS z FROM os WHERE name <> 'ftf' GROUP BY 1) SELECT bearing, CASE WHEN z > 0 AND n <= 200 THEN n END AS revolutions FROM r"),
    "b7_b10_order_features": (b7_b10_features, f"""WITH {_ORDERS_SQL}, e AS (SELECT vec_id, embedding, list_avg(embedding::DOUBLE[]) AS m FROM embeddings), tt AS (SELECT i FROM range(64) t(i)),
      xs AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE - m AS x FROM e, tt), bi AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im FROM xs, range(8, 29) b(k) GROUP BY ALL),
      an AS (SELECT vec_id, i, (sum(re * cos(2 * pi() * k * i / 64) - im * sin(2 * pi() * k * i / 64)) / 32) ** 2 + (sum(re * sin(2 * pi() * k * i / 64) + im * cos(2 * pi() * k * i / 64)) / 32) ** 2 AS env FROM bi, tt GROUP BY ALL),
      wn AS (SELECT vec_id, i, (env - avg(env) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS w FROM an),
      sp AS (SELECT vec_id, k, sqrt(sum(w * cos(2 * pi() * k * i / 64)) ** 2 + sum(w * sin(2 * pi() * k * i / 64)) ** 2) / 32 AS a FROM wn, range(33) b(k) GROUP BY ALL),
      wd AS (SELECT bearing AS vec_id, name, h, s, 4 * v * h + 4 * s AS f FROM os, range(1, 4) t(h), (VALUES (-1), (0), (1)) x(s) WHERE name <> 'ftf' AND bearing IN (SELECT vec_id FROM embeddings) AND (h = 1 OR s = 0)),
      ft AS (SELECT wd.vec_id, name, h, s, max(a) FILTER (abs(k - f) <= 1.5 + 1e-9) AS peak, median(a) FILTER (abs(k - f) BETWEEN 4.5 - 1e-9 AND 15 + 1e-9) AS floor FROM wd JOIN sp USING (vec_id) GROUP BY ALL)
      SELECT vec_id, name, round(max(peak) FILTER (h = 1 AND s = 0), 5) AS peak, round(max(floor) FILTER (h = 1 AND s = 0), 5) AS floor, round(max(peak / (floor + 1e-12)) FILTER (h = 1 AND s = 0), 5) AS score, round(avg(peak / (floor + 1e-12)) FILTER (s = 0), 5) AS harmonics,
        round(coalesce(sum(peak) FILTER (s <> 0), 0) / (max(peak) FILTER (h = 1 AND s = 0) + 1e-12), 5) AS sidebands FROM ft GROUP BY ALL"""),
    "b8_envelope_peaks": (b8_b9_spectra, None),
    "ag29_clopper_pearson": (ag29_clopper_pearson, None),
}
