"""Mixture-controlled packing of documents into token sequences of bounded length.

Documents are tokenised once and dealt to blocks of some BLOCK_TOKENS tokens by a hash of their id, so that every block
holds all sources in about their proportions, however the table is ordered. In a block each source is a queue of its
documents' tokens. Deficit round-robin fills one window after the other: every window credits each source its target
share of the window, a source is served when its credit is worth a piece, and what it was not served stays as its
deficit. The deficits with which a block starts are those that all blocks before it leave, worked out from the blocks'
token totals alone, so all blocks are packed in parallel.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helmwatch.llm.common import read_table, written

WINDOW = 1024
MIN_PIECE = 64
BLOCK_TOKENS = 3_000_000
BATCH_TOKENS = 1_000_000
#: Deficits are summed along chains of this many blocks, and along the chains.
CHAIN_BLOCKS = 64

TOKEN_SCHEMA = "id long, copy long, source string, length long, tokens binary"
PIECE_SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(ranks_path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file, one per worker process, with the public end-of-text token as its last id."""
    if ranks_path not in _encoders:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if len(ranks) > 0xFFFF:
            raise ValueError("ids are kept in two bytes: the vocabulary has more than 65,535 entries")
        _encoders[ranks_path] = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _encoders[ranks_path]


def _tokenise(ranks_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode_to_numpy
        seen, rows, size = Counter(), [], 0

        def cut() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in TOKEN_SCHEMA.split(", ")])

        for batch in batches:
            for i, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.empty(0, np.uint32) if not text else encode(text, allowed_special="all")
                rows.append((i, seen[i], source or "", len(found) + 1, np.append(found, end_id).astype("<u2").tobytes()))
                seen[i] += 1
                size += len(found) + 1
                if size >= BATCH_TOKENS:
                    yield cut()
                    rows, size = [], 0
        if rows:
            yield cut()

    return run


def fill_windows(remaining: list[int], shares: list[float], deficits: list[float], window: int = WINDOW, min_piece: int = MIN_PIECE) -> list[list[tuple[int, int]]]:
    """Windows as lists of (source, tokens) that use up all sources' tokens. Every window but the last is full."""
    remaining, credit, out = list(remaining), list(deficits), []
    left, first = sum(remaining), 0
    n = len(remaining)
    while left:
        room, taken = min(window, left), []
        alive = [s for s in range(n) if remaining[s]]
        scale = room / sum(shares[s] for s in alive)
        for s in alive:
            credit[s] += shares[s] * scale
        for s in alive[first % len(alive) :] + alive[: first % len(alive)]:
            take = min(int(credit[s]), remaining[s], room)
            if take >= min_piece or take and take == remaining[s]:
                taken.append((s, take))
                credit[s] -= take
                remaining[s] -= take
                room -= take
        # What is still free goes to the sources with the largest credit, on account of later windows.
        while room:
            s = max((s for s in alive if remaining[s]), key=lambda s: credit[s])
            take = min(room, remaining[s], max(min_piece, int(credit[s])))
            taken.append((s, take))
            credit[s] -= take
            remaining[s] -= take
            room -= take
        left -= sum(t for _, t in taken)
        first += 1
        out.append(taken)
    return out


def split_tail(windows: list[list[tuple[int, int]]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """The last window, if it is not full, as sequences whose lengths are powers of two: they need no padding."""
    if not windows or (size := sum(t for _, t in windows[-1])) == window:
        return windows
    out, rest = windows[:-1], list(windows[-1])
    while size:
        room = 1 << (size.bit_length() - 1)
        size -= room
        part = []
        while room:
            s, t = rest.pop(0)
            take = min(t, room)
            part.append((s, take))
            room -= take
            if take < t:
                rest.insert(0, (s, t - take))
        out.append(part)
    return out


def _pack(docs_of: pa.Table, targets: pa.Table) -> pa.Table:
    out = []
    aims = {r["queue"]: (r["share"], r["deficit"]) for r in targets.to_pylist()}
    if docs_of.num_rows:
        rows = docs_of.sort_by([("id", "ascending"), ("copy", "ascending"), ("length", "ascending")])
        bid, ids, lengths = rows["bid"][0].as_py(), rows["id"].to_numpy(), rows["length"].to_numpy()
        begins = np.cumsum(lengths) - lengths
        tokens = np.frombuffer(b"".join(rows["tokens"].to_pylist()), "<u2").astype("<u4")
        data = memoryview(tokens).cast("B")
        names = sorted(aims)
        source = np.array(list(map({s: k for k, s in enumerate(names)}.get, rows["source"].to_pylist())))
        by_source = np.argsort(source, kind="stable")
        docs = [d.tolist() for d in np.split(by_source, np.searchsorted(source[by_source], np.arange(1, len(names))))]
        source_tokens = np.bincount(source, weights=lengths, minlength=len(names)).astype(np.int64).tolist()
        windows = split_tail(fill_windows(source_tokens, *zip(*(aims[s] for s in names), strict=True)))
        at, used = [0] * len(docs), [0] * len(docs)
        size, begin = lengths.tolist(), begins.tolist()
        doc, start, length, crc, seq, offset = [], [], [], [], [], []
        for k, window in enumerate(windows):
            place = 0
            for s, take in window:
                while take:
                    d = docs[s][at[s]]
                    n = min(take, size[d] - used[s])
                    b = 4 * (begin[d] + used[s])
                    doc.append(d)
                    start.append(used[s])
                    length.append(n)
                    crc.append(zlib.crc32(data[b : b + 4 * n]))
                    seq.append(k)
                    offset.append(place)
                    place += n
                    take -= n
                    used[s] += n
                    if used[s] == size[d]:
                        at[s], used[s] = at[s] + 1, 0
        which = np.array(doc)
        columns = (ids[which], start, length, crc, lengths[which], np.array(seq, np.int64) + (bid << 22), offset)
        out.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECE_SCHEMA.split(", ")]))
    return pa.Table.from_batches(out, schema=pa.schema([(f.split()[0], pa.int64()) for f in PIECE_SCHEMA.split(", ")]))


def block_targets(totals: DataFrame, shares: DataFrame) -> DataFrame:
    """(block, source, share, deficit) from block totals (bid, source, n): a source's deficit at the start of a block
    is its share of all tokens in the blocks before less its own tokens there. Sums run within a chain of blocks, and
    every chain starts from the summed totals of the chains before it."""
    before = lambda order, *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda *window: F.coalesce(F.sum("n").over(before(*window)), F.lit(0))
    totals = totals.withColumn("chain", F.floor(F.col("bid") / CHAIN_BLOCKS))
    chains = totals.groupBy("chain").agg(F.sum("n").alias("n")).select("chain", running("chain").alias("chain_past"))
    queues = totals.groupBy("chain", "source").agg(F.sum("n").alias("n")).select("chain", "source", running("chain", "source").alias("chain_served"))
    of_block = totals.groupBy("chain", "bid").agg(F.sum("n").alias("n")).select("chain", "bid", running("bid", "chain").alias("past"))
    of_block = of_block.join(chains, "chain").select("bid", (F.col("past") + F.col("chain_past")).alias("past"))
    of_source = totals.select("chain", "bid", "source", running("bid", "chain", "source").alias("served"))
    of_source = of_source.join(queues, ["chain", "source"]).select("bid", "source", (F.col("served") + F.col("chain_served")).alias("served"))
    return of_source.join(of_block, "bid").join(shares, "source", "left").select(
        F.col("bid").alias("block"), "source", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(1e-9)).alias("share"), (F.coalesce("share", F.lit(0.0)) * F.col("past") - F.col("served")).alias("deficit")
    )


def pack(docs: DataFrame, ranks_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shares: DataFrame | None = None) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token of every document, and the end id behind it, lies in exactly one piece; sequences hold at most WINDOW
    tokens and only a block's last ones fewer, with lengths that are powers of two. A null text is empty and packs its
    end id alone; a null source counts as the empty one. Repeated rows are packed as often as they
    occur, and a file's repeats of an id are dealt apart; an empty table gives no pieces. The target shares are the sources' shares of all tokens, or those of the
    table shares (source, share). id_col must be a non-null integer.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    tokens = written(rows.mapInArrow(_tokenise(ranks_path, end_id), TOKEN_SCHEMA), "packing-tokens")
    count = -(-(tokens.agg(F.sum("length")).first()[0] or 1) // BLOCK_TOKENS)
    dealt = tokens.withColumn("bid", F.pmod(F.xxhash64("id", "copy"), F.lit(count)))
    totals = dealt.groupBy("bid", "source").agg(F.sum("length").alias("n"))
    if shares is None:
        whole = totals.agg(F.sum("n").alias("all"))
        shares = totals.groupBy("source").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(whole)).select("source", (F.col("n") / F.col("all")).alias("share"))
    targets = block_targets(totals, shares).withColumnRenamed("source", "queue")
    pieces = dealt.groupBy("bid").cogroup(targets.groupBy("block")).applyInArrow(_pack, PIECE_SCHEMA)
    return pieces.withColumnRenamed("id", id_col)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
