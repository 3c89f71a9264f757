"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows are grouped by length, then by a hash of a short prefix, then by a hash of the whole text. Each step looks only
at rows whose group in the step before had more than one member. Lengths and prefixes are counted in place and combine
on the map side; whole texts are hashed where they lie, those of surviving groups only; the last step groups hashes.
No text crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.llm.common import attach, lower_ascii, read_table, text_or_empty, without, written

PREFIX_CHARS = 64
#: The filter of shared prefixes has 2^FILTER_BITS bits, 16 MB, in rows of 2^ROW_BITS bits.
FILTER_BITS = 27
ROW_BITS = 15


def _bit(step: str) -> Column:
    return F.col(step).bitwiseAND((1 << FILTER_BITS) - 1)


def _filter(steps: DataFrame) -> DataFrame:
    """(_row, _bits): a Bloom filter of one hash over _step, whose size does not follow the table's."""
    in_row = _bit("_step").bitwiseAND((1 << ROW_BITS) - 1)
    return steps.groupBy(F.shiftright(_bit("_step"), ROW_BITS).alias("_row")).agg(F.bitmap_construct_agg(in_row).alias("_bits"))


def _hit(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """rows with _alike: whether the filter may hold their _step. What it holds it always finds."""
    in_row = _bit("_step").bitwiseAND((1 << ROW_BITS) - 1).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(in_row, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_row", F.shiftright(_bit("_step"), ROW_BITS)).join(F.broadcast(bits), "_row", "left")
    return found.withColumn("_alike", F.coalesce(F.getbit(byte, in_row.bitwiseAND(7)) == 1, F.lit(False))).drop("_row", "_bits")


def _digests(docs: DataFrame, id_col: str, text_col: str, all_digests: bool) -> DataFrame:
    """(_id, _digest, _alike) per row: _alike holds where another row has the same length and prefix, and for
    some lone rows; without it there is no digest unless all_digests."""
    text = text_or_empty(text_col)
    length = F.octet_length(text)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        length.alias("_len"),
        F.xxhash64(length, lower_ascii(F.substring(text, 1, PREFIX_CHARS))).alias("_step"),
        F.unhex(F.sha2(lower_ascii(text), 256)).alias("_whole"),
    )
    counted = rows.groupBy("_len", "_step").agg(F.count("*").alias("_n"))
    lengths = counted.groupBy("_len").agg(F.sum("_n").alias("_rows")).where("_rows > 1").select("_len")
    steps = attach(counted, "_len", lengths).where("_n > 1").select("_step")
    # The filter goes to the texts; where it takes a lone text for one of a group, that costs a hash and no more.
    rows = _hit(rows, written(_filter(steps), "shared-prefixes"))
    digest = F.col("_whole") if all_digests else F.when(F.col("_alike"), F.col("_whole"))
    return written(rows.select("_id", digest.alias("_digest"), "_alike"), "digests")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest_col: str | None = None) -> DataFrame:
    """One row (id_col, keep_id, group_size, kept) per row of docs; with digest_col also the text's SHA-256 in hex.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and empty texts are equal to
    each other. Of equal texts the row with the largest (keep="max") or smallest id stays. Rows that share an id are
    each judged by their own text; those that share id and text count in group_size and stay or go together. id_col
    must not be null. An empty table gives an empty result; other columns are ignored.
    """
    best = {"max": F.max, "min": F.min}[keep]
    digests = _digests(docs, id_col, text_col, digest_col is not None)
    alike = digests.where("_alike").select("_id", "_digest")
    groups = alike.groupBy("_digest").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"))
    single = digests.where("NOT _alike").select("_id", "_digest", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = attach(alike, "_digest", groups).select(*single.columns).union(single)
    columns = [F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("keep_id") == F.col("_id")).alias("kept")]
    return out.select(*columns, *([F.lower(F.hex("_digest")).alias(digest_col)] if digest_col else []))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that share an id stay together if one of them stays."""
    gone = duplicate_groups(docs, id_col, text_col, keep).groupBy(id_col).agg(F.bool_or("kept").alias("_kept")).where("NOT _kept")
    return without(docs, id_col, gone)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(read_table(spark, sf_dir, "documents"), digest_col="text_sha256")


OP6_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
