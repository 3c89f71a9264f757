"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide over the whole text. Their responses are max-pooled over overlapping chunks of two blocks
of BLOCK bytes, and the mean, the maximum and the minimum over a text's chunks are combined into one probability. The network is
fitted on the driver on a bounded sample of labelled rows and then scores every text where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.llm.common import read_table, text_or_empty
from helmwatch.llm.textscan import chunks, utf8

WIDTH = 6
FILTERS = 16
BLOCK = 256
#: The sample: at most so many labelled rows, of each the whole text.
SAMPLE_ROWS = 3000
#: At least so many passes over the sample and, for small samples, about so many gradient steps.
EPOCHS = 8
STEPS = 400
BATCH = 64
SPAN_BYTES = 1 << 18


@dataclass
class Network:
    """kernel: response of each filter to each byte at each place; head: weights of the pooled responses."""

    kernel: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    head: np.ndarray  # 3 * FILTERS
    offset: float

    @classmethod
    def constant(cls, probability: float) -> Network:
        odds = np.log(np.clip(probability, 1e-3, 1 - 1e-3) / (1 - np.clip(probability, 1e-3, 1 - 1e-3)))
        return cls(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS), float(odds))

    def pair_tables(self) -> list[np.ndarray]:
        """Responses to pairs of neighbouring bytes, so that a window takes WIDTH / 2 lookups."""
        return [(self.kernel[j][:, None, :] + self.kernel[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)]


def _block_starts(sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of texts (one at least for each) begin, and how many each text has."""
    n = np.maximum(-(-sizes // BLOCK), 1)
    first = np.cumsum(n) - n
    within = np.arange(int(n.sum())) - np.repeat(first, n)
    return np.repeat(begins, n) + within * BLOCK, n


def _chunked(blocks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of neighbouring blocks of each text, and how many chunks each text has; a text of one block is a chunk."""
    last = np.cumsum(n) - 1
    pooled = np.maximum(blocks, np.vstack([blocks[1:], blocks[-1:]]))
    pooled[last] = blocks[last]
    keep = np.ones(len(blocks), dtype=bool)
    keep[last[n > 1]] = False
    return pooled[keep], np.maximum(n - 1, 1)


def _scores(net: Network, tables: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of a few texts. Between texts lie zero bytes, so that no window holds two texts' bytes."""
    sizes = np.diff(offsets)
    begins = offsets[:-1] - offsets[0] + np.arange(len(sizes)) * WIDTH
    padded = np.zeros(int(sizes.sum()) + len(sizes) * WIDTH + BLOCK, np.uint8)
    where = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)) * WIDTH, sizes)
    padded[where] = data
    between = np.ones(len(padded), dtype=bool)
    between[where] = False
    starts, n = _block_starts(sizes, begins)
    ends = np.append(starts[1:], begins[-1] + max(int(sizes[-1]), 1))
    best = np.empty((len(starts), FILTERS), np.float32)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(starts, starts[i] + SPAN_BYTES)), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        span = padded[a : b + WIDTH].astype(np.int32)
        pairs = span[:-1] * 256 + span[1:]
        response = tables[0][pairs[: b - a]]
        for k, table in enumerate(tables[1:], 1):
            response += table[pairs[2 * k : 2 * k + b - a]]
        response[between[a:b]] = -np.inf
        best[i:j] = np.maximum.reduceat(response, starts[i:j] - a, axis=0)
        i = j
    pooled, m = _chunked(best, n)
    active = np.maximum(pooled + net.bias, 0)
    first = np.cumsum(m) - m
    features = np.hstack([np.add.reduceat(active, first, axis=0) / m[:, None], np.maximum.reduceat(active, first, axis=0), np.minimum.reduceat(active, first, axis=0)])
    features[sizes == 0] = 0
    return 1 / (1 + np.exp(-(features @ net.head + net.offset)))


def _winners(kernel: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter in each block and where it is, some blocks at a time."""
    best = np.empty((len(blocks), FILTERS), kernel.dtype)
    where = np.empty((len(blocks), FILTERS), np.int64)
    for a in range(0, len(blocks), SPAN_BYTES // BLOCK):
        span = blocks[a : a + SPAN_BYTES // BLOCK]
        response = kernel[0][span[:, :BLOCK]]
        for j in range(1, WIDTH):
            response += kernel[j][span[:, j : j + BLOCK]]
        at = response.argmax(1)
        where[a : a + len(span)] = at
        best[a : a + len(span)] = np.take_along_axis(response, at[:, None, :], 1)[:, 0]
    return best, where


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit by stochastic gradient steps; through a maximum the gradient reaches only the window that won."""
    if not len(labels) or labels.min() == labels.max():
        return Network.constant(float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    kernel = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    bias, head, offset = np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 3 * FILTERS), float(np.log(labels.mean() / (1 - labels.mean())))
    own = []
    for t in texts:
        raw = np.frombuffer(t, np.uint8)
        n = max(-(-len(raw) // BLOCK), 1)
        padded = np.zeros(n * BLOCK + WIDTH, np.uint8)
        padded[: len(raw)] = raw
        own.append(np.lib.stride_tricks.sliding_window_view(padded, BLOCK + WIDTH - 1)[: n * BLOCK : BLOCK])
    params = {"kernel": kernel, "bias": bias, "head": head, "offset": np.array([offset])}
    moments = {k: (np.zeros_like(v, dtype=np.float64), np.zeros_like(v, dtype=np.float64)) for k, v in params.items()}
    step, places = 0, np.arange(WIDTH)[:, None, None]
    epochs = min(max(EPOCHS, STEPS * BATCH // len(own)), 10 * EPOCHS)
    for epoch in range(epochs):
        order = rng.permutation(len(own))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            blocks = np.concatenate([own[i] for i in batch])
            n = np.array([len(own[i]) for i in batch])
            best, where = _winners(params["kernel"], blocks)
            # Chunks: which block of the two won.
            m = np.maximum(n - 1, 1)
            left = np.concatenate([np.arange(f, f + k) for f, k in zip(np.cumsum(n) - n, m, strict=True)])
            right = np.concatenate([np.minimum(np.arange(f, f + k) + 1, f + c - 1) for f, k, c in zip(np.cumsum(n) - n, m, n, strict=True)])
            winner = np.where(best[left] >= best[right], left[:, None], right[:, None])
            pooled = np.maximum(best[left], best[right]) + params["bias"]
            active = np.maximum(pooled, 0)
            first = np.cumsum(m) - m
            mean = np.add.reduceat(active, first, axis=0) / m[:, None]
            top = np.maximum.reduceat(active, first, axis=0)
            low = np.minimum.reduceat(active, first, axis=0)
            features = np.hstack([mean, top, low])
            p = 1 / (1 + np.exp(-(features @ params["head"] + params["offset"][0])))
            d = (p - labels[batch]) / len(batch)
            grads = {"head": features.T @ d + 1e-4 * params["head"], "offset": np.array([d.sum()])}
            d_mean, d_top, d_low = np.split(d[:, None] * params["head"], 3, axis=1)
            d_mean = d_mean / m[:, None]
            doc = np.repeat(np.arange(len(batch)), m)
            d_active = d_mean[doc]
            for end, d_end in ((top, d_top), (low, d_low)):
                hit = active == end[doc]
                d_active += hit * (d_end / np.add.reduceat(hit.astype(np.int64), first, axis=0))[doc]
            d_active *= pooled > 0
            grads["bias"] = d_active.sum(0)
            filters = np.broadcast_to(np.arange(FILTERS), winner.shape)
            column = where[winner, filters]
            seen = blocks[winner[None], column[None] + places]
            kernel_grad = np.zeros((WIDTH, 256, FILTERS))
            np.add.at(kernel_grad, (np.broadcast_to(places, seen.shape), seen, np.broadcast_to(filters, seen.shape)), d_active)
            grads["kernel"] = kernel_grad
            step += 1
            for k, g in grads.items():
                a, b = moments[k]
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                rate = 0.03 * (1 - epoch / epochs)
                params[k] = (params[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(params[k].dtype)
    return Network(params["kernel"], params["bias"], params["head"], float(params["offset"][0]))


def fit_on_labels(docs: DataFrame, labels: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Network:
    """Fit on the whole texts of at most sample_rows labelled ids, drawn by a hash of their ids; held_out is SQL over
    labels and leaves rows out.

    Labels that repeat count once; an id with two labels trains with both. Of rows that share an id the smallest text
    trains. Null texts count as empty; labels without a row, null ids and null labels are left out. Without labels, or
    with labels of one kind, the network is a constant.
    """
    drawn = (
        labels.where(~F.expr(held_out)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
        .where("_id IS NOT NULL AND _label IS NOT NULL").distinct()
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample_rows)
    )
    sample = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("_text")).join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))
    rows = sample.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    rows.sort(key=lambda r: (r["_id"], r["_label"]))
    return fit([r["_text"].encode() for r in rows], np.array([r["_label"] for r in rows]))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, score) per row of docs: the probability of label 1, from the bytes of the whole text alone.

    A null text counts as empty; empty texts have the score of a text without any response. Repeated rows score
    alike; an empty table gives an empty result. id_col must be a non-null integer.
    """
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        tables = net.pair_tables()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = [_scores(net, tables, data[offsets[a] : offsets[b]], offsets[a : b + 1]) for a, b in chunks(offsets, SPAN_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, network: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score of threshold or more, with all their columns, in one pass without a shuffle.
    Null texts count as empty; repeated rows stay or go together; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held.value.pair_tables()
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            found = [_scores(held.value, tables, data[offsets[a] : offsets[b]], offsets[a : b + 1]) for a, b in chunks(offsets, SPAN_BYTES)]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) >= threshold))

    return docs.mapInArrow(run, docs.schema)


HELD_OUT = "crc32(cast(doc_id AS string)) % 3 = 1"


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    network = fit_on_labels(docs, read_table(spark, sf_dir, "labels"), HELD_OUT)
    return score(docs, network).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
