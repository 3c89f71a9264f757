"""Queries of scans and sinks: tables are written in the forms that the scans must tell apart, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from helmwatch.sources import csv_scan as C
from helmwatch.sources import files
from helmwatch.sources import sinks as K
from helmwatch.sources.tables import SCADA_SQL, scada, table

FARMS = ("A", "B", "C")


def sc1_sc2_scan(spark, sf_dir):
    """The condition-monitoring view as delimited files with other column names: the dialect is told by the header."""
    path = files.shared_place(spark, "scan")
    rows = scada(spark, sf_dir).select(F.date_format("ts", "dd.MM.yyyy HH:mm").alias("Time Stamp"), F.col("case_key").alias("asset-id"), F.hash("ts").alias("ID"), F.col("train_test").alias("Train Test"), F.col("status_type_id").alias("status_type_id"), "click")
    rows.write.option("header", "true").option("sep", ";").csv(path)
    dialect = C.sniff_header(spark, path)
    out = C.scan(spark, path, dialect, ["asset_id", "time_stamp", "train_test", "status_type_id"])
    return out.withColumn("status_type_id", F.col("status_type_id").cast("int")).withColumn("separator", F.lit(dialect["separator"]))


def sc3_metadata(spark, sf_dir):
    """A small table behind a preamble, with a column without values."""
    path = f"{files.shared_place(spark, 'metadata')}/feature_description.csv"
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name", "n_regionkey").collect()
    files.write_text(spark, path, "made by hand\n\nsensor_name;Feature Description;empty\n" + "".join(f"{r[0]};region {r[1]};\n" for r in rows))
    return C.metadata_table(spark, path, ("sensor_name", "feature_description"))


def sc4_unique_file(spark, sf_dir):
    """Of the files of all regions the one that shows the required columns."""
    root = files.shared_place(spark, "candidates")
    paths = []
    for k, r in enumerate(table(spark, sf_dir, "region").orderBy("r_regionkey").collect()):
        files.write_text(spark, f"{root}/{k}.csv", f"{'asset,score' if k == 1 else 'note,text'}\n{r['r_regionkey']},{r['r_name']}\n")
        paths.append(f"{root}/{k}.csv")
    path = C.select_unique(spark, paths, ("asset", "score"))
    return spark.read.option("header", "true").csv(path).select(F.col("asset").cast("int").alias("asset"), "score")


def sc5_sc6_discovery(spark, sf_dir):
    """Files of three farms, one a nation and one a region: their farm, kind, size and hash."""
    root = files.shared_place(spark, "discovery")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        files.write_text(spark, f"{root}/Wind Farm {FARMS[r['n_regionkey'] % 3]}/{r['n_nationkey']}.csv", f"event of {r['n_name']}\n")
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():
        files.write_text(spark, f"{root}/Wind Farm {FARMS[r['r_regionkey'] % 3]}/{r['r_name']}/feature_description.csv", f"features of {r['r_name']}\n")
    return C.discover(spark, root).select("farm", "kind", "size_bytes", "sha256")


def sc7_row_identity(spark, sf_dir):
    """For each farm the numbering of its rows that gives the manifest its times; manifests are made from 0, 1 and ids."""
    s = scada(spark, sf_dir).select("case_key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_stamp"))
    w = F.row_number().over(C.Window.partitionBy("case_key").orderBy("time_stamp"))
    raw = s.select("*", (w * 10).cast("long").alias("id"), w.alias("n"))
    out = []
    for farm, index in zip(FARMS, ("n - 1", "n", "id"), strict=True):
        own = raw.where(F.col("case_key") == f"Wind Farm {farm}")
        manifest = own.where("n % 5 = 2").select("case_key", F.expr(index).cast("long").alias("source_row_index"), F.col("time_stamp").alias("timestamp_utc"))
        out.append((f"Wind Farm {farm}", C.row_identity(own.drop("n"), manifest, "time_stamp", "case_key")))
    return spark.createDataFrame(out, "case_key string, numbering string")


def sc7_split_rows(spark, sf_dir):
    """Row numbers of order lines in files, one a status, read in splits."""
    path = files.shared_place(spark, "numbered")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"), "o_orderkey")
    o.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey").select("o_orderstatus", "value").write.partitionBy("o_orderstatus").text(path)
    lines = C.numbered_lines(spark, path)
    return lines.select(F.regexp_extract("file", "o_orderstatus=(.)", 1).alias("o_orderstatus"), "line_number", F.split_part("value", F.lit(";"), F.lit(1)).cast("long").alias("o_orderkey"))


def sc8_mapping(spark, sf_dir):
    """Events by farm, one frame keyed by its name and one by its rows, as one mapping with every key once."""
    w = C.Window.partitionBy("case_key").orderBy("ts")
    rows = scada(spark, sf_dir).select("case_key", (F.row_number().over(w) - 1).cast("long").alias("source_row_index"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    first = rows.where("case_key = 'Wind Farm A'").drop("case_key")
    others = rows.where("case_key <> 'Wind Farm A'").withColumnRenamed("case_key", "event_key")
    return C.keyed_mapping({"Wind Farm A": first, "others": others}, rows.withColumnRenamed("case_key", "event_key"))


def sc10_record_names(spark, sf_dir):
    """Records of parts by name; byte-identical copies are one, different ones conflict."""
    p = table(spark, sf_dir, "part")
    path = F.format_string("d%d/%s-%02d-%d.csv", F.col("p_partkey") % 2, F.element_at(F.array(*map(F.lit, "HIOBC")), (F.col("p_partkey") % 5 + 1).cast("int")), (F.floor(F.col("p_partkey") / 2) % 15).cast("int"), F.lit(0))
    return C.record_names(p.select(path.alias("path"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise("y").alias("sha256"))).select("record_id", "path", "conflict")


def sc11_latest(spark, sf_dir):
    """The newest file of a name, of two."""
    root = files.shared_place(spark, "latest")
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    for folder in ("a", "b"):
        files.write_text(spark, f"{root}/{folder}/region_table_x.csv", "r_regionkey,r_name\n" + "".join(f"{r['r_regionkey']},{folder} {r['r_name']}\n" for r in rows))
    fs, p = files._system(spark, f"{root}/a/region_table_x.csv")
    fs.setTimes(p, 1_000_000, -1)
    out = C.latest_table(spark, root, "region_table_x", ("r_regionkey",))
    return out.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


def k1_k2_write(spark, sf_dir):
    """A table and its arrays written in two forms and read back."""
    root = files.shared_place(spark, "sinks")
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))
    K.write_table(o.drop("priorities"), f"{root}/table", "csv")
    K.write_table(o, f"{root}/arrays", "parquet", ("o_orderstatus",))
    a = spark.read.option("header", "true").csv(f"{root}/table").select("o_orderstatus", F.col("orders").cast("long").alias("orders"))
    b = spark.read.parquet(f"{root}/arrays").select("o_orderstatus", F.array_join("priorities", "|").alias("priorities"))
    return a.join(b, "o_orderstatus")


def k3_k6_receipts(spark, sf_dir):
    """A receipt of a table's counts as strict JSON, and its digest."""
    path = f"{files.shared_place(spark, 'receipts')}/receipt.json"
    n = {r["o_orderstatus"]: r["n"] for r in table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()}
    digest = K.receipt(spark, path, n)
    if K.receipt(spark, path, dict(reversed(n.items()))) != digest:
        raise ValueError("a receipt depends on the order of its content")
    return spark.createDataFrame([(digest, K.strict_json(n))], "sha256 string, content string")


_w = "row_number() OVER (PARTITION BY case_key ORDER BY ts)"

QUERIES = {
    "sc1_sc2_sc9_scan": (sc1_sc2_scan, f"WITH {SCADA_SQL} SELECT case_key AS asset_id, ts AS time_stamp, train_test, status_type_id, ';' AS separator FROM scada"),
    "sc3_metadata": (sc3_metadata, "SELECT n_name AS sensor_name, 'region ' || n_regionkey AS feature_description FROM nation"),
    "sc4_unique_file": (sc4_unique_file, "SELECT r_regionkey AS asset, r_name AS score FROM region WHERE r_regionkey = 1"),
    "sc5_sc6_discovery": (sc5_sc6_discovery, """WITH t AS (SELECT n_regionkey AS k, 'event' AS kind, 'event of ' || n_name || chr(10) AS t FROM nation UNION ALL SELECT r_regionkey, 'feature', 'features of ' || r_name || chr(10) FROM region)
      SELECT 'Wind Farm ' || ['A', 'B', 'C'][k % 3 + 1] AS farm, kind, length(t) AS size_bytes, sha256(t) AS sha256 FROM t"""),
    "sc7_row_identity": (sc7_row_identity, f"WITH {SCADA_SQL} SELECT DISTINCT case_key, CASE case_key WHEN 'Wind Farm A' THEN 'zero' WHEN 'Wind Farm B' THEN 'one' ELSE 'id' END AS numbering FROM scada"),
    "sc7_split_rows": (sc7_split_rows, "SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS line_number, o_orderkey FROM orders"),
    "sc8_keyed_mapping": (sc8_mapping, f"WITH {SCADA_SQL} SELECT case_key AS event_key, {_w} - 1 AS source_row_index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM scada"),
    "sc10_record_names": (sc10_record_names, """WITH p AS (SELECT 'HIOBC'[p_partkey % 5 + 1] AS c, (p_partkey // 2) % 15 AS k, p_partkey % 2 AS d, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE 'y' END AS h FROM part)
      SELECT c || '-' || k || '-0' AS record_id, min('d' || d || '/' || c || '-' || lpad(k::VARCHAR, 2, '0') || '-0.csv') AS path, min(h) <> max(h) AS conflict FROM p GROUP BY c, k"""),
    "sc11_latest_table": (sc11_latest, "SELECT r_regionkey, 'b ' || r_name AS r_name FROM region"),
    "k1_k2_write_read": (k1_k2_write, "SELECT o_orderstatus, count(*) AS orders, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1"),
    "k3_k6_receipts": (k3_k6_receipts, """WITH n AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT '{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}' AS c FROM n) SELECT sha256(c) AS sha256, c AS content FROM t"""),
}
