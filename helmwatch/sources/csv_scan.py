"""Delimited files of unknown dialect: header sniffing, metadata tables, discovery and hashing.

Only the first lines of one file are looked at on the driver; all rows are read by Spark's own reader, with the
columns that a query needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helmwatch.operators.selection import refused
from helmwatch.sources import files

# What a file may be encoded in and separated by, in order of preference.
ENCODINGS = ("UTF-8", "ISO-8859-1", "UTF-16", "US-ASCII")
SEPARATORS = (";", ",", "\t", "|")
REQUIRED = ("time_stamp", "asset_id", "id", "train_test", "status_type_id")


def canonical(name: str) -> str:
    out = "".join(c if c.isalnum() else "_" for c in name.strip().lower())
    return "_".join(p for p in out.split("_") if p)


def sniff_header(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> dict:
    """The encoding and separator under which the header has most required columns, then most columns."""
    best: tuple = ()
    for encoding in ENCODINGS:
        try:
            first = spark.read.option("encoding", encoding).option("header", "false").option("sep", "\u0001").csv(path).limit(1).collect()
        except Exception as error:  # an encoding that this JVM cannot read a file in
            if "encoding" not in str(error).lower():
                raise
            continue
        line = (first[0][0] or "") if first else ""
        for sep in SEPARATORS:
            raw = [c.strip().strip('"') for c in line.split(sep)]
            names = [canonical(c) for c in raw]
            rank = (sum(r in names for r in required), len(names))
            if not best or rank > best[0]:
                best = (rank, {"raw": raw, "names": names, "encoding": encoding, "separator": sep})
    if not best or best[0][0] < len(required):
        raise ValueError(f"{path}: no dialect shows the columns {required}")
    return best[1]


def scan(spark: SparkSession, path: str, dialect: dict, columns: list[str] | None = None) -> DataFrame:
    """The rows under canonical names; columns prunes the read. Values are text, time_stamp is parsed."""
    df = spark.read.option("header", "true").option("sep", dialect["separator"]).option("encoding", dialect["encoding"]).csv(path)
    df = df.toDF(*dialect["names"])
    df = df.select(*(columns or df.columns))
    return df.withColumn("time_stamp", timestamp(F.col("time_stamp"))) if "time_stamp" in df.columns else df


def timestamp(c: Column) -> Column:
    """Times in mixed formats, day first where the order is open; null for what is no time."""
    text = F.trim(c.cast("string"))
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy-MM-dd", "dd/MM/yyyy")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value): the lines of text files, numbered from 0 within each file. Large files are read in
    splits; a split's lines are counted, and its first number is the count of the file's splits before it. No window
    runs over a file's lines, only over its splits."""
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_place", place)
    # A task reads the lines of a split one after the other, so their places follow each other.
    splits = lines.groupBy("file", "_block").agg(F.min("_place").alias("_least"), F.count("*").alias("_lines"))
    before = F.sum("_lines").over(Window.partitionBy("file").orderBy("_block")) - F.col("_lines")
    first = splits.select("file", "_block", "_least", before.alias("_before"))
    return lines.join(first, ["file", "_block"]).select("file", (F.col("_before") + F.col("_place") - F.col("_least")).alias("line_number"), "value")


def metadata_table(spark: SparkSession, path: str, required: tuple[str, ...], max_skip: int = 19) -> DataFrame:
    """A small table behind up to max_skip lines of preamble; rows and columns without values are dropped. Rows are
    those behind the header's line, whatever they hold."""
    top = [r[0] or "" for r in spark.read.text(path).limit(max_skip + 1).collect()]
    for skip, line in enumerate(top):
        for sep in SEPARATORS:
            names = [canonical(c.strip().strip('"')) for c in line.split(sep)]
            if all(r in names for r in required):
                behind = numbered_lines(spark, path).where(F.col("line_number") > skip)
                rows = behind.select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep}).alias("r")).select("r.*").na.drop("all")
                kept = rows.agg(*(F.count(c).alias(c) for c in rows.columns)).first()
                return rows.select(*(c for c in rows.columns if kept[c]))
    raise ValueError(f"{path}: no header with {required}")


def discover(spark: SparkSession, root: str, first_bytes: int = 65_536) -> DataFrame:
    """Files below root: path, farm, kind (event, feature, event_info, other) and the hash of their first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    stem = F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    kind = F.when(stem.rlike(r"^\d+$"), "event").when(stem.contains("feature"), "feature").when(stem.contains("event"), "event_info").otherwise("other")
    farm = F.regexp_extract(F.regexp_replace("path", "%20", " "), r"(Wind Farm [A-Z])", 1)
    return files.select("path", farm.alias("farm"), kind.alias("kind"), F.col("length").alias("size_bytes"), F.sha2(F.substring("content", 1, first_bytes), 256).alias("sha256"))


def record_names(files: DataFrame) -> DataFrame:
    """Names such as H-3-0 in parts; of byte-identical copies the first path stays, different ones are marked."""
    name = F.regexp_extract("path", r"([HIOBC])[-_](\d{1,2})[-_]([012])\.[^./]+$", 0)
    part = lambda k: F.regexp_extract("path", r"([HIOBC])[-_](\d{1,2})[-_]([012])\.[^./]+$", k)
    named = files.where(name != "").select("*", F.concat_ws("-", part(1), part(2).cast("int").cast("string"), part(3)).alias("record_id"))
    w = Window.partitionBy("record_id")
    return named.withColumn("conflict", F.min("sha256").over(w) != F.max("sha256").over(w)).withColumn("_r", F.row_number().over(w.orderBy("path"))).where("_r = 1").drop("_r")


def select_unique(spark: SparkSession, paths: list[str], required: tuple[str, ...]) -> str:
    """The one path of paths whose header has the required columns; none or several are an error."""
    found = []
    for path in paths:
        try:
            sniff_header(spark, path, required)
            found.append(path)
        except ValueError:
            continue
    if len(found) != 1:
        raise ValueError(f"{len(found)} of {len(paths)} files show the columns {required}, not one")
    return found[0]


def latest_table(spark: SparkSession, root: str, name: str, required: tuple[str, ...] = ()) -> DataFrame:
    """The temporary view of that name if there is one, else the newest file name.csv below root; its columns must
    include required."""
    if spark.catalog.tableExists(name):
        df = spark.table(name)
    elif path := files.newest(spark, root, f"{name}.csv"):
        df = spark.read.option("header", "true").csv(path)
    else:
        raise ValueError(f"no view and no file of the name {name}")
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{name} has no columns {missing}")
    return df


def keyed_mapping(frames: dict[str, DataFrame], expected: DataFrame, keys: tuple[str, ...] = ("event_key", "source_row_index")) -> DataFrame:
    """The rows of named frames under one schema, event_key taken from the frame's name where it has none. A key that
    occurs twice, and one of expected that occurs nowhere, fail the query."""
    whole = None
    for name, frame in sorted(frames.items()):
        one = frame if keys[0] in frame.columns else frame.withColumn(keys[0], F.lit(name))
        whole = one if whole is None else whole.unionByName(one, allowMissingColumns=True)
    rest = [c for c in whole.columns if c not in keys]
    grouped = whole.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in rest))
    joined = expected.select(*keys).join(grouped, list(keys), "full_outer")
    checked = joined.where(refused(F.col("_n").isNull(), "a key has no row in the mapping")).where(refused(F.col("_n") > 1, "a key occurs twice in the mapping"))
    return checked.select(F.col(keys[0]).cast("string").alias(keys[0]), *keys[1:], *rest)


def row_identity(raw: DataFrame, manifest: DataFrame, order: str, key: str | None = None) -> str:
    """Which numbering of raw rows (zero, one, id) gives every manifest row (source_row_index, timestamp_utc) its time.
    With key, rows are numbered within each file or event."""
    n = F.row_number().over((Window.partitionBy(key) if key else Window).orderBy(order))
    on = [key] if key else []
    for name, index in (("zero", n - 1), ("one", n), ("id", F.col("id").cast("long"))):
        joined = manifest.join(raw.select(*on, index.alias("source_row_index"), "time_stamp"), [*on, "source_row_index"], "left")
        if joined.where("NOT (time_stamp <=> timestamp_utc)").limit(1).count() == 0:
            return name
    raise ValueError("no numbering of the rows gives all manifest times")
