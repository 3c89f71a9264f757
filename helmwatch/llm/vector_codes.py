"""Compression of vectors to short codes: every part of a vector becomes the index of the nearest entry of its codebook.

Vectors are scaled to integers and cut into equal parts. Codebooks start as the parts of the vectors with the smallest
ids and are refined in rounds: parts are assigned to their nearest entry, entries become the floored mean of their
parts. Sums of a round are taken in the tasks, one row an entry and task, and meet per entry.

The nearest entry is found by segment-mean lower bounds. A part is cut into blocks; by Cauchy and Schwarz the squared
distance of two parts is at least, summed over blocks, the block's length times the squared difference of its means
plus the squared difference of the norms of what its means leave over. Bounds are taken from coarse blocks (the whole
part) to fine ones (two components); entries whose bound exceeds an exact distance already known are out. The others
receive exact integer distances, so bounds only save work and never decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.llm.common import BROADCAST_KEYS, read_table, written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Components are integers below this size, so that squared distances of long vectors are exact 64-bit integers.
LARGEST = 1 << 26
BATCH_ROWS = 8_192


def blocks_of(d: int) -> list[np.ndarray]:
    """Where blocks begin, from coarse to fine: 1, 2, 4, ... blocks of d components, of two components at least."""
    out, n = [], 1
    while n == 1 or d // n >= 2:
        out.append(np.arange(n) * d // n)
        n *= 2
    return out


def _summaries(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block lengths, and of every row the blocks' means times the root of their length and their residual norms."""
    lengths = np.diff(np.append(begins, x.shape[1]))
    sums = np.add.reduceat(x, begins, axis=1)
    squares = np.add.reduceat(x * x, begins, axis=1)
    # length * squares - sums^2 is exact in integers and not negative.
    rest = np.sqrt((lengths * squares - sums * sums) / lengths)
    return lengths, sums / np.sqrt(lengths), rest


def nearest(x: np.ndarray, entries: np.ndarray, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of entries for each row of x, and the exact squared distance; ties go to the lower
    index. Both hold integers. seen, if given, counts the exact distances under "exact" and all pairs under "pairs"."""
    n, k = len(x), len(entries)
    if not n or not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    levels = blocks_of(x.shape[1])

    def bound(level: np.ndarray, rows, cols) -> np.ndarray:
        _, mean_x, rest_x = _summaries(x, level)
        _, mean_e, rest_e = _summaries(entries, level)
        low = np.zeros(np.broadcast(rows, cols).shape)
        for b in range(len(level)):
            low += (mean_x[rows, b] - mean_e[cols, b]) ** 2 + (rest_x[rows, b] - rest_e[cols, b]) ** 2
        # Rounding must not push a bound above the distance.
        return low * (1 - 1e-9) - 1e-6 * (1 + low * 1e-9)

    def distances(at: np.ndarray, of: np.ndarray) -> np.ndarray:
        gap = x[at] - entries[of]
        return (gap * gap).sum(axis=1)

    def first_least(values: np.ndarray, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of every row's run of pairs the first with the least value. Every row has one."""
        least = np.minimum.reduceat(values, begins)
        return np.minimum.reduceat(np.where(values == least[rows], np.arange(len(values)), len(values)), begins)

    each = np.arange(n)
    low = bound(levels[0], each[:, None], np.arange(k)[None, :])
    known = distances(each, low.argmin(axis=1))
    rows, cols = np.nonzero(low <= known[:, None])
    asked = n
    for level in levels[1:]:
        # The entry with the least bound so far is measured: a distance to hold all others against.
        low = bound(level, rows, cols)
        likely = first_least(low, rows, np.searchsorted(rows, each))
        known = np.minimum(known, distances(rows[likely], cols[likely]))
        asked += n
        keep = low <= known[rows]
        rows, cols = rows[keep], cols[keep]
    exact = distances(rows, cols)
    if seen is not None:
        seen["exact"] = seen.get("exact", 0) + len(exact) + asked
        seen["pairs"] = seen.get("pairs", 0) + n * k
    best = first_least(exact, rows, np.searchsorted(rows, each))
    return cols[best], exact[best]


def _integers(vectors: pa.Array, length: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * SCALE)
    if len(whole) and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"a component reaches {LARGEST // SCALE}: squared distances would not be exact")
    return whole.astype(np.int64).reshape(-1, length)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


SUM_SCHEMA = "part int, entry int, n long, sums array<long>"
CODE_SCHEMA = "id long, label long, code string, error long"


def _sums(codebooks: np.ndarray):
    """Counts and component sums of the parts assigned to each entry, in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, d = codebooks.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for batch in _slices(batches):
            x = _integers(batch["vector"], parts * d).reshape(-1, parts, d)
            for p in range(parts):
                which, _ = nearest(x[:, p], codebooks[p])
                count[p] += np.bincount(which, minlength=entries)
                np.add.at(total[p], which, x[:, p])
        at, of = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(of, pa.int32()), pa.array(count[at, of], pa.int64()), pa.array(list(total[at, of]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"]
        )

    return run


def _codes(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, d = codebooks.shape
        for batch in _slices(batches):
            x = _integers(batch["vector"], parts * d).reshape(-1, parts, d)
            found, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                which, distance = nearest(x[:, p], codebooks[p])
                found[:, p] = which
                error += distance
            digits = found.tobytes().hex()
            code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """Rows (id, label, vector) whose vector is a list of finite numbers."""
    v = F.col(vector_col).cast("array<double>")
    label = F.col(label_col).cast("long") if label_col else F.lit(None).cast("long")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), v.alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(finite)


def _first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(parts, entries, components) of the smallest ids: at most `entries` rows come to the driver."""
    first = rows.where("id IS NOT NULL").orderBy("id", "vector", "label").select("vector").limit(entries).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    if length % parts:
        raise ValueError(f"vectors of {length} components can not be cut into {parts} equal parts")
    first = [r["vector"] for r in first if len(r["vector"]) == length]
    whole = _integers(pa.array(first, pa.list_(pa.float64())), length)
    return np.ascontiguousarray(whole.reshape(len(whole), parts, -1).transpose(1, 0, 2))


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray | None:
    """Integer codebooks (parts, entries, components a part), None if no vector can be used; see encode."""
    if not 0 < entries <= 256:
        raise ValueError("entries must fit in two hexadecimal digits")
    rows = _usable(vectors, id_col, vector_col, None)
    codebooks = _first_codebooks(rows, parts, entries)
    if codebooks is None:
        return None
    rows = rows.where(F.size("vector") == codebooks.shape[0] * codebooks.shape[2]).select("vector")
    for _ in range(rounds):
        d = codebooks.shape[2]
        sums = rows.mapInArrow(_sums(codebooks), SUM_SCHEMA).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", i)) for i in range(d))).alias("sums"))
        codebooks = codebooks.copy()
        for r in sums.collect():  # parts * entries rows at most
            codebooks[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return codebooks


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, codebooks: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, label, code, error) of every usable row: code has two hexadecimal digits a part, error is the summed
    squared distance to the entries.

    Rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are those of another
    length than the codebooks'. Components become floor(256 * x). Repeated rows are each coded; ids and labels may be
    null. An empty table gives an empty result; other columns are ignored. Components that reach LARGEST / 256 are an
    error, since distances would not be exact.
    """
    rows = _usable(vectors, id_col, vector_col, label_col).where(F.size("vector") == codebooks.shape[0] * codebooks.shape[2])
    return rows.mapInArrow(_codes(codebooks), CODE_SCHEMA).withColumnRenamed("id", id_col)


def decode(code: str, codebooks: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([codebooks[p, i] for p, i in enumerate(bytes.fromhex(code))]) / SCALE


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error: error summed over the rows of a label; rows without a label are one group. Sums of up to
    BROADCAST_KEYS labels are broadcast; more are met by a shuffle whose hot labels adaptive execution splits."""
    sums = written(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_KEYS:
        sums, deal = F.broadcast(sums), F.lit(True)
    else:
        sums, deal = sums.withColumn("_deal", F.xxhash64("_label")), F.xxhash64("label") == F.col("_deal")
    return coded.join(sums, deal & F.col("label").eqNullSafe(F.col("_label"))).drop("_label", "_deal")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    codebooks = train_codebooks(vectors)
    if codebooks is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(encode(vectors, codebooks), "vector-codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """Codebooks round by round, every distance of a part to every entry."""

    def assigned(round_: int) -> str:
        return f"""a{round_} AS (
  SELECT vec_id, label, part, v, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance
  FROM (SELECT p.*, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS distance FROM parts p JOIN c{round_} c USING (part))
  GROUP BY ALL
)"""

    rounds = []
    for k in range(ROUNDS):
        rounds.append(assigned(k))
        rounds.append(f"""m{k} AS (
  SELECT part, entry, list(mean ORDER BY i) AS v
  FROM (SELECT part, entry, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS mean FROM a{k}, range(1, (SELECT max(length(v)) FROM parts) + 1) AS t(i) GROUP BY ALL)
  GROUP BY ALL
), c{k + 1} AS (
  SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry)
)""")
    parts = ",\n".join([*rounds, assigned(ROUNDS)])
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e, row_number() OVER (ORDER BY vec_id) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, r, p AS part, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS v FROM kept, range({PARTS}) AS t(p)
), c0 AS (
  SELECT part, r AS entry, v FROM parts WHERE r < {ENTRIES}
), {parts}, books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}
), coded AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""


OP13_SQL = _sql()
