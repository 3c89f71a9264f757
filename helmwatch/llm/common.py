"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one on one machine; on a
    cluster that is an error, since executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="helmwatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later reads neither recompute it nor depend on
    the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Write df to the shared folder in buckets of column and read it back: groups and joins on column need no shuffle
    of it. The catalog forgets the table at once; the files stay for the plans that read them."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").bucketBy(shuffle_parts(spark), column).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved while the catalog knows it
    spark.sql(f"DROP TABLE {name}")
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, faster, where every character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """Inner join of groups (one row per key) to rows. The join is on a value derived from the key, so both sides are
    exchanged for the join itself, and adaptive execution can split a hot key's partition."""
    left = rows.withColumn("_deal", F.xxhash64(key))
    right = groups.withColumnRenamed(key, "_key").withColumn("_deal2", F.xxhash64("_key"))
    return left.join(right, (F.col("_deal") == F.col("_deal2")) & (F.col(key) == F.col("_key"))).drop("_deal", "_deal2", "_key")


#: Numbers of 8 bytes that are broadcast at most: 8 MB.
BROADCAST_KEYS = 1 << 20


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in gone (id_col). Few ids are broadcast, so that texts stay where they lie;
    more are met by a shuffle."""
    gone = written(gone.select(id_col), "ids-that-go")
    few = gone.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed differences, byte by byte: the leading bytes are mostly zero."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return len(keys).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack_sorted(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _crc_entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def crc32_sql(text: str) -> str:
    """DuckDB's SQL for the unsigned crc32 of a text's UTF-8 bytes; it has no such function."""
    table = f"({[_crc_entry(b) for b in range(256)]}::BIGINT[])"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda d: ('0x' || d)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"
