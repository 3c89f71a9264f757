"""Scans, sinks and the streaming walk."""

import json
import os
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helmwatch.sources import csv_scan as C
from helmwatch.sources import sinks as K
from helmwatch.streaming.criticality import criticality_stream


def test_event_file_of_unknown_dialect(spark, tmp_path):
    farm = tmp_path / "Wind Farm A"
    farm.mkdir()
    path = farm / "12.csv"
    path.write_text("time_stamp;asset_id;ID;Train Test;status_type_id;power_avg\n13/01/2024 00:10:00;7.0;0;train;0;1.5\n2024-01-13 00:20:00;7.0;1;train;2;\nnever;7.0;2;prediction;x;3\n")
    dialect = C.sniff_header(spark, str(path))
    assert dialect["separator"] == ";" and dialect["names"][2:4] == ["id", "train_test"]
    rows = C.scan(spark, str(path), dialect, ["id", "time_stamp", "power_avg"]).orderBy("id").collect()
    assert [str(r["time_stamp"]) for r in rows] == ["2024-01-13 00:10:00", "2024-01-13 00:20:00", "None"]
    with pytest.raises(ValueError):
        C.sniff_header(spark, str(path), ("nowhere",))
    (farm / "feature_description.csv").write_text("made by hand\n\nfeature_name,feature_description,empty\npower_avg,Active power,\n")
    table = C.metadata_table(spark, str(farm / "feature_description.csv"), ("feature_name", "feature_description"))
    assert table.columns == ["feature_name", "feature_description"] and table.count() == 1
    found = {r["kind"]: r["farm"] for r in C.discover(spark, str(tmp_path)).collect()}
    assert found == {"event": "Wind Farm A", "feature": "Wind Farm A"}


def test_record_names_and_row_identity(spark):
    files = spark.createDataFrame([("a/H-03-0.csv", "x"), ("b/H-3-0.csv", "x"), ("b/I-1-2.csv", "y"), ("b/notes.csv", "z")], "path string, sha256 string")
    got = {r["record_id"]: (r["path"], r["conflict"]) for r in C.record_names(files).collect()}
    assert got == {"H-3-0": ("a/H-03-0.csv", False), "I-1-2": ("b/I-1-2.csv", False)}
    raw = spark.createDataFrame([(10, "t0"), (11, "t1")], "id long, time_stamp string")
    for index, name in ((0, "zero"), (1, "one"), (10, "id")):
        manifest = spark.createDataFrame([(index, "t0"), (index + 1, "t1")], "source_row_index long, timestamp_utc string")
        assert C.row_identity(raw, manifest, "id") == name


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a_b", 0.5), (2, None, float("nan"))], "k int, t string, v double")
    K.write_table(df, str(tmp_path / "t"), partition_by=("k",))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert K.table_digest(df, ["k"]) == K.table_digest(df.orderBy(F.desc("k")), ["k"]) != K.table_digest(df.limit(1), ["k"])
    assert json.loads(K.strict_json({"b": float("nan"), "a": [1]})) == {"a": [1], "b": None}
    assert K.receipt(spark, str(tmp_path / "r.json"), {"a": 1}) == K.receipt(spark, str(tmp_path / "r.json"), {"a": 1})
    with pytest.raises(ValueError):
        K.receipt(spark, str(tmp_path / "r.json"), {"a": 2})
    assert r"a\_b" in K.latex_table(df)


def test_streaming_walk_is_that_of_a_batch(spark, tmp_path):
    """Rows of three cases, shuffled within the delay over many files, with copies, gaps and a row that is too late."""
    from helmwatch.operators import sequence as Q

    rng = np.random.default_rng(6)
    start, rows = datetime(2024, 1, 1), []
    for case in "abc":
        minute = 0
        for _ in range(60):
            minute += 10 if rng.random() < 0.93 else 30
            rows.append((minute + rng.uniform(0, 55), (case, start + timedelta(minutes=minute), float(rng.integers(0, 2)), bool(rng.random() < 0.6), bool(rng.random() < 0.9))))
    # What arrives when: up to 55 minutes late, and 60 are waited for.
    arrived = [r for _, r in sorted(rows, key=lambda r: r[0])]
    arrived.insert(20, arrived[18])
    source, schema = tmp_path / "in", "case_key string, ts timestamp, value double, alarm boolean, actionable boolean"
    source.mkdir()
    for k in range(0, len(arrived), 12):
        part = spark.createDataFrame(arrived[k : k + 12], schema)
        part.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    flush = [(c, start + timedelta(days=9), 1.0, False, False) for c in "abc"]
    spark.createDataFrame(flush, schema).coalesce(1).write.parquet(str(tmp_path / "part900"))
    spark.createDataFrame([("a", start + timedelta(minutes=5), 0.0, True, True)], schema).coalesce(1).write.parquet(str(tmp_path / "part901"))
    for k, folder in enumerate(sorted(tmp_path.glob("part*"), key=lambda f: int(f.name[4:]))):
        file = next(folder.glob("*.parquet"))
        place = file.rename(source / f"{k:04d}.parquet")
        os.utime(place, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(source))
    query = criticality_stream(stream, 600, "60 minutes").writeStream.format("memory").queryName("walk").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(300)
    got = {(r["case_key"], r["ts"]): (r["criticality"], r["zero_run"]) for r in spark.table("walk").collect() if r["ts"] < start + timedelta(days=8)}
    batch = Q.strict_segments(spark.createDataFrame([r for _, r in rows], schema), 10)
    walked = {(r["case_key"], r["ts"]): r["criticality"] for r in Q.criticality_walk(batch, F.col("alarm"), F.col("actionable")).collect()}
    assert {k: c for k, (c, _) in got.items()} == walked and len(got) == 180
    zeros, before = {}, {}
    for case, ts, value, _, _ in sorted((r for _, r in rows), key=lambda r: (r[0], r[1])):
        same = before.get(case) == ts - timedelta(minutes=10)
        zeros[case, ts] = (zeros[case, before[case]] if same else 0) + 1 if value == 0 else 0
        before[case] = ts
    assert {k: z for k, (_, z) in got.items()} == zeros


def test_metadata_rows_like_the_preamble_stay(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a;1\nname;value\na;1\nb;2\nname;value\n")
    got = [tuple(r) for r in C.metadata_table(spark, str(tmp_path / "m.csv"), ("name", "value")).collect()]
    assert sorted(got) == [("a", "1"), ("b", "2"), ("name", "value")]


def test_lines_of_split_files(spark, tmp_path):
    for name, n in (("x", 4000), ("y", 1), ("z", 777)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}-{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = C.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4778 and all(r["value"].split("-")[1] == str(r["line_number"]) for r in got)


def test_one_of_several_files_and_the_newest_of_a_name(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for folder, value in (("a", 1), ("b", 2)):
        (tmp_path / folder / "scores.csv").write_text(f"asset,score\nx,{value}\n")
        time.sleep(0.02)
    (tmp_path / "other.csv").write_text("note\nx\n")
    paths = [str(tmp_path / "other.csv"), str(tmp_path / "a" / "scores.csv")]
    assert C.select_unique(spark, paths, ("asset", "score")) == paths[1]
    for bad in (paths[:1], [*paths, str(tmp_path / "b" / "scores.csv")]):
        with pytest.raises(ValueError):
            C.select_unique(spark, bad, ("asset", "score"))
    assert C.latest_table(spark, str(tmp_path), "scores", ("asset",)).first()["score"] == "2"
    with pytest.raises(ValueError):
        C.latest_table(spark, str(tmp_path), "scores", ("nothing",))
    with pytest.raises(ValueError):
        C.latest_table(spark, str(tmp_path), "nowhere")


def test_mapping_needs_every_key_once(spark):
    a = spark.createDataFrame([(0, "t0"), (1, "t1")], "source_row_index long, timestamp string")
    b = spark.createDataFrame([("7", 0, "u0")], "event_key string, source_row_index long, timestamp string")
    expected = spark.createDataFrame([("5", 0), ("5", 1), ("7", 0)], "event_key string, source_row_index long")
    got = C.keyed_mapping({"5": a, "rest": b}, expected).collect()
    assert sorted((r["event_key"], r["source_row_index"], r["timestamp"]) for r in got) == [("5", 0, "t0"), ("5", 1, "t1"), ("7", 0, "u0")]
    for frames, keys in (({"5": a}, expected), ({"5": a.union(a), "rest": b}, expected), ({"5": a, "rest": b}, expected.where("event_key = '5'"))):
        if keys.count() == 2:
            assert C.keyed_mapping(frames, keys).count() == 3
        else:
            with pytest.raises(Exception, match="a key"):
                C.keyed_mapping(frames, keys).collect()
