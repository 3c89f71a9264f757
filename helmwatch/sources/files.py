"""Small files through Hadoop's file system: they are where the cluster's folders are, not on the driver's disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _system(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file: first beside its place, then by a rename, so that readers see all of it or none."""
    fs, part = _system(spark, f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    place = _system(spark, path)[1]
    fs.delete(place, False)
    if not fs.rename(part, place):
        raise OSError(f"{path}: the file could not be put in its place")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def newest(spark: SparkSession, root: str, name: str) -> str | None:
    """The path of the file of that name below root that was changed last; of equal times the last path."""
    fs, p = _system(spark, root)
    found, listed = [], fs.listFiles(p, True)
    while listed.hasNext():
        status = listed.next()
        if status.getPath().getName() == name:
            found.append((status.getModificationTime(), status.getPath().toString()))
    return max(found)[1] if found else None


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; below a temporary one where that is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="helmwatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new shared place and read back: what is built on it neither repeats its work nor
    depends on the executors that did it."""
    path = shared_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
