"""Case audits, zero runs, record audits and registries by hand."""

from pyspark.sql import functions as F

from helmwatch.operators import registry as R


def timed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).selectExpr("*", "timestampadd(MINUTE, m, timestamp_ntz'2024-01-01 00:00:00') AS ts")


def test_zero_runs_end_at_gaps_values_and_rows_out_of_fit(spark):
    rows = [("a", m, z, ok) for m, z, ok in [(0, 0.0, True), (10, 0.0, True), (30, 0.0, True), (40, 0.0, True), (50, 0.0, True), (60, 1.0, True), (70, 0.0, True), (80, 0.0, False), (90, 0.0, True), (100, None, True), (110, 0.0, True)]]
    df = timed(spark, [*rows, ("b", 0, 1.0, True)], "case_key string, m int, x double, ok boolean").withColumn("y", F.lit(0.0))
    got = {(r[0], r[1]): r[2] for r in R.longest_zero_runs(df, ("x", "y"), F.col("ok"), 10).collect()}
    assert got == {("a", "x"): 3, ("a", "y"): 5, ("b", "y"): 1}


def test_case_audit_in_source_order(spark):
    rows = [("a", 0, 0, "train", 0, "7"), ("a", 1, 10, "train", 3, "7"), ("a", 2, 10, "prediction", None, "7"), ("a", 3, 5, "other", 2, None), ("a", 4, 50, None, 0, "7"), ("b", 0, None, "train", 0, "8")]
    df = timed(spark, rows, "case_key string, n int, m int, train_test string, status_type_id int, asset string")
    got = {r["case_key"]: r for r in R.case_audit(df, spark.createDataFrame([("a", 7)], "case_key string, expected_asset int"), "asset", "n", 10).collect()}
    a = got["a"]
    assert (a["rows"], a["train_rows"], a["prediction_rows"], a["unknown_split_rows"], a["training_normal_rows"]) == (5, 2, 1, 2, 1)
    assert (a["duplicate_timestamps"], a["nonmonotonic_timestamps"], a["gap_count"], a["maximum_gap_minutes"], a["continuous_segments"]) == (1, 1, 1, 45.0, 2)
    assert (a["status_ids_seen"], a["asset_ids_seen"], a["asset_matches"]) == ("0;2;3", "7", True)
    assert got["b"]["missing_timestamps"] == 1 and not got["b"]["asset_matches"]


def test_speeds_and_shares_of_records(spark):
    rows = [("measured", 1.0, 1600.0)] * 8 + [("measured", 1.0, None)] * 2 + [("few", 1.0, 1600.0)] * 7 + [("few", float("nan"), None)] * 3 + [("fast", 1.0, 2500.0)] + [("none", None, None)]
    got = {r["record"]: (r["usable"], r["rpm"], r["rpm_source"]) for r in R.record_audit(spark.createDataFrame(rows, "record string, s double, rpm double"), "record", "s", "rpm").collect()}
    assert got == {"measured": (True, 1600.0, "measured_median"), "few": (False, 1750.0, "registered_nominal"), "fast": (True, 1750.0, "registered_nominal"), "none": (False, 1750.0, "registered_nominal")}


def test_completeness_and_segments(spark):
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, n int")
    found = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 1)], "k string, n int")
    assert {(r[0], r[1]): (r[2], r[3]) for r in R.completeness(expected, found, "k", "n").collect()} == {("a", 1): (2, "duplicate"), ("a", 2): (0, "missing"), ("b", None): (1, "complete"), ("c", 1): (1, "unexpected")}
    parts = R.segments(spark.createDataFrame([("x", 25), ("y", 9)], "r string, n int"), "r", "n", 10, "v").orderBy("segment").collect()
    assert [(p["r"], p["segment"], p["start"], p["stop"]) for p in parts] == [("x", 0, 0, 10), ("x", 1, 10, 20)] and len({p["trial_id"] for p in parts}) == 2
