"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of their id and content. A keyed permutation of the numbers 0 to N - 1 shuffles them: a
Feistel network permutes the numbers of 2 * h bits, the least such range that holds N, and a number that lands at N or
beyond is sent through the network again until it lands below. The permuted number p of a row gives its shard, p mod
shards, and its slot there, p div shards. So the law is `rows`: shards differ by one row at most. Shard and slot of any
row number can be computed without the table, and the other way round (locate, row_at): a reader that resumes or looks
up a sample needs no index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from helmwatch.llm.common import crc32_sql, read_table
from helmwatch.llm.numbering import numbered

SHARDS = 40
SEED = 2024
ROUNDS = 6
#: Bytes that a row counts besides its text.
ROW_BYTES = 16

_WORD = (1 << 32) - 1
#: Odd multiplier of the mixing rounds; with 32-bit operands products stay below 2^63, as SQL's integers need.
_MIX = 73244475


def half_bits(n: int) -> int:
    """h: the Feistel network permutes the numbers of 2 * h bits, at most four times as many as n."""
    h = max(1, -(-max(n - 1, 1).bit_length() // 2))
    if h > 31:
        raise ValueError("more than 2^62 rows")
    return h


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:4], "big") for k in range(rounds)]


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) & np.uint64(_WORD)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(_MIX)) & np.uint64(_WORD)
    return x ^ (x >> np.uint64(16))


def _feistel(x: np.ndarray, h: int, keys: list[int], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << h) - 1), np.uint64(h)
    left, right = x >> shift, x & mask
    if back:
        for k in reversed(keys):
            left, right = right ^ (_mixed(left, k) & mask), left
    else:
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & mask)
    return (left << shift) | right


def permute(numbers: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permuted numbers of 0 <= number < n, or with back=True the numbers that are permuted to them."""
    if len(numbers) and not (0 <= int(numbers.min()) and int(numbers.max()) < n):
        raise ValueError("row numbers lie outside 0 to n - 1")
    h, keys = half_bits(n), round_keys(seed)
    out = _feistel(numbers.astype(np.uint64), h, keys, back)
    while len(beyond := np.flatnonzero(out >= np.uint64(n))):
        out[beyond] = _feistel(out[beyond], h, keys, back)
    return out.astype(np.int64)


def locate(row_number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number among n rows, without the table."""
    p = int(permute(np.array([row_number]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that lies in a slot of a shard: the inverse of locate."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def permuted(row_number: Column, n: int, seed: int = SEED) -> Column:
    @pandas_udf("long")
    def run(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return run(row_number)


def _digests(text: Column) -> tuple[Column, Column, Column]:
    return (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES, F.crc32(F.coalesce(text, F.lit(""))), F.xxhash64(text))


def _placed(rows: DataFrame, order: list[str], shards: int, seed: int, name: str) -> DataFrame:
    found, n = numbered(rows, *order, name=name)
    found = found.withColumn("_p", permuted(F.col("row_number"), n, seed))
    return found.withColumn("shard", (F.col("_p") % shards).cast("int")).withColumn("slot", F.expr(f"_p div {shards}")).drop("_p")


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, size, text_crc32, row_number, shard, slot) per row of docs; texts stay where they lie.

    Row numbers follow id, size and two checksums of the text, so rows that tie are copies of each other (up to a
    collision of both checksums) and may trade places without a change in the result. A null text has size ROW_BYTES
    and the checksum of the empty text, and stands apart from it in the order; a null id comes first. Repeated rows
    each get a slot of their own. An empty table gives an empty result; other columns are ignored. With fewer rows
    than shards the shards behind the last row stay empty.
    """
    size, crc, digest = _digests(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("_id"), size.alias("_size"), crc.alias("_crc"), digest.alias("_digest"))
    found = _placed(rows, ["_id", "_size", "_crc", "_digest"], shards, seed, "shard-numbers")
    return found.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "row_number", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet to path/_shard=K, every shard's rows in the order of their slots, with the column _slot.
    Rows are dealt by shard and slot, so a large shard is many files, in order of their slots. All columns of docs
    are kept; it must have none named _shard or _slot, which is refused. Texts move twice: into the order of the row
    numbers and into their shards."""
    if {"_shard", "_slot"} & set(docs.columns):
        raise ValueError("the table has a column _shard or _slot already")
    size, crc, digest = _digests(F.col(text_col).cast("string"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), size.alias("_size"), crc.alias("_crc"), digest.alias("_digest"))
    found = _placed(rows, ["_id", "_size", "_crc", "_digest"], shards, seed, "shard-rows")
    out = found.select("_row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law `rows`; grown_shard belongs to another law and is null. Equal texts form
    no groups here: a permutation deals every row by itself."""
    found = assign_shards(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP11_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents
), counted AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS row_number, count(*) OVER () AS n FROM sized
), network AS (
  SELECT max(n) AS n, greatest(1, (length(ltrim(bin(greatest(max(n) - 1, 1)), '0')) + 1) // 2) AS h FROM counted
), keys AS (
  SELECT [{", ".join(map(str, round_keys(SEED)))}]::BIGINT[] AS key
), walk AS (
  SELECT row_number, row_number AS x, 0 AS k, row_number >> h AS l, row_number & ((1::BIGINT << h) - 1) AS r, n, h FROM counted JOIN network USING (n)
  UNION ALL
  SELECT row_number, (l << h) | r, CASE WHEN k = {ROUNDS} THEN 0 ELSE k + 1 END,
    CASE WHEN k = {ROUNDS} THEN l ELSE r END,
    CASE WHEN k = {ROUNDS} THEN r ELSE xor(l, list_reduce([(r + key[k + 1]) & {_WORD}, 0, 0, 1]::BIGINT[],
      lambda a, last: CASE WHEN last = 1 THEN xor(a, a >> 16) ELSE (xor(a, a >> 16) * {_MIX}) & {_WORD} END) & ((1::BIGINT << h) - 1)) END,
    n, h
  FROM walk, keys WHERE k < {ROUNDS} OR ((l << h) | r) >= n
), landed AS (
  SELECT row_number, (l << h) | r AS p FROM walk WHERE k = {ROUNDS} AND ((l << h) | r) < n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {SHARDS})::INT AS shard, p // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM counted JOIN landed USING (row_number)
"""
