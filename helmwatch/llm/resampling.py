"""Importance resampling of documents towards a target distribution, over hashed word features.

A document's features are its runs of words; each falls into a bucket by its checksum. A bucket's gain is the smoothed
log ratio of its share in the target texts and in the documents. A document's weight is the mean gain of its features.
Noise of a Gumbel distribution turns the largest scores into a draw without replacement.

Identical texts are collapsed first: the table is grouped by its full text, features are counted once for each distinct
text, and the corpus counts take them times the number of copies. Weights depend on the text alone and are joined back
to the documents by the text's checksum; only then the noise of each document is added.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.llm.common import attach, crc32_sql, read_table, text_or_empty, written
from helmwatch.llm.numbering import numbered

BUCKETS = 10_000
MAX_RUN = 1
SEED = 2024
MIN_WORDS = 20
#: Drawn documents, as a share of those with enough words.
SHARE = (10, 100)

#: A task's sums are sent in blocks of so many buckets.
BLOCK = 100
#: Bytes of text that are split into words at once.
SPLIT_BYTES = 1 << 20
BATCH_ROWS = 2_000

FEATURE_SCHEMA = "digest binary, n_words long, n_features long, buckets array<int>, counts array<long>, totals array<array<long>>"
#: Bytes of words stay, A-Z become a-z, all others become blanks: 0-9, a-z and every byte of a character above ASCII.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()


def bucket_counts(data: bytes, buckets: int, max_run: int = 1, split: int = SPLIT_BYTES) -> tuple[int, np.ndarray, np.ndarray]:
    """Words of a text's bytes, and which buckets its features fall into how often. Long texts are split in parts
    between words; runs of words go on across parts."""
    data = data.translate(_WORD_BYTES)
    n_words, at, carry, parts = 0, 0, [], []
    while at < len(data):
        end = data.find(b" ", at + split)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        n_words += len(words)
        at = end
        whole = carry + words
        for n in range(1, max_run + 1):
            # Runs that end in this part: the first ones begin in the words carried over.
            own = words if n == 1 else [b" ".join(whole[i : i + n]) for i in range(max(0, len(carry) - n + 1), len(whole) - n + 1)]
            parts.append(np.fromiter(map(zlib.crc32, own), np.uint32, len(own)) % np.uint32(buckets))
        carry = whole[-(max_run - 1) :] if max_run > 1 else []
        if len(parts) > 64:
            parts = [np.concatenate(parts)]
    which, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint32), np.empty(0, np.int64))
    return n_words, which, counts


def _features(buckets: int, max_run: int):
    names = [f.split()[0] for f in FEATURE_SCHEMA.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)

        def cut(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows, digests, copies = [], batch["digest"], batch["copies"].to_pylist()
            for i, n in enumerate(copies):
                n_words, which, counts = bucket_counts(batch["data"][i].as_py(), buckets, max_run)
                totals[which] += counts * n
                rows.append((digests[i].as_py(), n_words, int(counts.sum()), which.astype(np.int32), counts, None))
                if len(rows) == BATCH_ROWS:
                    yield cut(rows)
                    rows = []
            if rows:
                yield cut(rows)
        # A task's sums are a row of its own, without a digest.
        yield cut([(None, None, None, None, None, [totals[i : i + BLOCK] for i in range(0, buckets, BLOCK)])])

    return run


def _counted(texts: DataFrame, buckets: int, max_run: int, name: str) -> DataFrame:
    """FEATURE_SCHEMA for every distinct text of texts (text), and a row of totals for every task."""
    distinct = texts.groupBy("text").agg(F.count("*").alias("copies"))
    data = F.encode("text", "utf-8")
    rows = distinct.select(F.unhex(F.sha2(data, 256)).alias("digest"), "copies", data.alias("data"))
    return written(rows.mapInArrow(_features(buckets, max_run), FEATURE_SCHEMA), name)


def _totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: at most `buckets` numbers come to the driver."""
    blocks = counted.where("digest IS NULL").select(F.posexplode("totals").alias("block", "sums"))
    out = np.zeros(buckets, np.int64)
    for r in blocks.groupBy("block").agg(F.array(*(F.sum(F.get("sums", i)) for i in range(min(BLOCK, buckets)))).alias("sums")).collect():
        at = r["block"] * BLOCK
        out[at : at + BLOCK] = r["sums"][: buckets - at]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of every bucket, in doubles; B is their number."""
    b = len(source)
    wide, aimed = float(source.sum()) + b, float(target.sum()) + b
    return [math.floor(1000 * math.log((t + 1.0) * wide / ((s + 1.0) * aimed))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_features, weight) of every row of docs, learnt from all its texts and all of target's.

    Words are runs of digits, letters and characters above ASCII after lower-casing A-Z. A null or empty text has no
    features and weight 0, and so has every text of an empty table's target: with no target texts all buckets' gains
    compare with the even distribution. Rows that share an id are weighted each by their own text. Other columns of
    docs are ignored. The digest that joins weights to documents is SHA-256 of the text.
    """
    learnt = _counted(docs.select(text_or_empty(text_col).alias("text")), buckets, max_run, "resampling-documents")
    aimed = _counted(target.select(text_or_empty(text_col).alias("text")), buckets, max_run, "resampling-target")
    gains = bucket_gains(_totals(learnt, buckets), _totals(aimed, buckets))
    gains = F.broadcast(docs.sparkSession.createDataFrame([(gains,)], "_gains array<int>"))  # one row of `buckets` numbers
    own = F.aggregate(F.arrays_zip("buckets", "counts"), F.lit(0).cast("long"), lambda s, x: s + F.get(F.col("_gains"), x["buckets"]) * x["counts"])
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.floor(own / F.col("n_features"))).cast("long")
    weights = learnt.where("digest IS NOT NULL").crossJoin(gains).select("digest", "n_words", "n_features", weight.alias("weight"))
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(F.encode(text_or_empty(text_col), "utf-8"), 256)).alias("digest"))
    return attach(rows, "digest", weights).select(F.col("_id").alias(id_col), "n_words", "n_features", "weight")


def gumbel_score(weight, seed: int, key) -> F.Column:
    """weight plus floor(-1000 * ln(-ln(u))), where u comes from the first 32 bits of sha256 of `seed:key`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, max_run: int = MAX_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, n_features, weight, score, rank) per row of docs: see importance_weights. Of the N rows with at
    least min_words words the floor(share * N) with the highest scores are drawn and ranked from 1; ties go to the
    smaller id. All other ranks are null. A null id has a null score; such a row is never drawn and does not count
    in N. Rows that repeat an id share its noise; those that tie in score and id take ranks one after the other. An
    empty table gives an empty result. SHARE is a pair (numerator, denominator).
    """
    weights = importance_weights(docs, target, buckets, max_run, id_col, text_col).withColumnRenamed(id_col, "_id")
    scored = written(weights.withColumn("score", gumbel_score(F.col("weight"), seed, F.col("_id"))), "resampling-scores")
    able = (F.col("n_words") >= min_words) & F.col("_id").isNotNull()
    ranked, n = numbered(scored.where(able), F.col("score").desc(), "_id", "weight", "n_features", name="resampling-ranks")
    drawn = n * share[0] // share[1]
    rank = F.when(F.col("row_number") < drawn, F.col("row_number") + 1).cast("long")
    rest = scored.where(~able).withColumn("row_number", F.lit(n).cast("long"))
    return ranked.unionByName(rest).select(F.col("_id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM benchmark
), dw AS (
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY ALL
), bw AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY ALL
), lexicon AS (
  SELECT w, {crc32_sql("w")} % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), s AS (
  SELECT bucket, sum(n) AS s FROM dw JOIN lexicon USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n) AS t FROM bw JOIN lexicon USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM dw) + {BUCKETS})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM bw) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), summed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM dw JOIN lexicon USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN summed USING (doc_id)
)
SELECT *, CASE WHEN n_features >= {MIN_WORDS} AND row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id)
    <= {SHARE[0]} * (SELECT count(*) FROM scored WHERE n_features >= {MIN_WORDS}) // {SHARE[1]}
  THEN row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) END AS rank
FROM scored
"""
