"""Removal of passages that repeat across documents, by threshold-bounded interval expansion on a Burrows-Wheeler
transform.

A window is a string of LENGTH bytes; its key is the least hash of the SEED-byte strings in it, so equal windows have
equal keys wherever they stand. Runs of neighbouring windows of one key are one strip of text.

1. Documents are cut into blocks of bounded size. Blocks ask, bucket by bucket of the hash space, which of their keys
   more than one document holds; all other text is settled.
2. Blocks send the distinct strips of shared keys. Equal strips meet first: all but the smallest document's are
   repeats as a whole. Keys that are left with several different strips go, strips together, through the transform.
   There common prefixes are derived breadth-first by increasing length: the boundaries between suffixes with a common
   prefix of length n give, by one backward extension, those of length n + 1. The search stops at LENGTH: suffixes
   without a boundary between them share a window.
3. The windows to remove go back to the blocks as bit masks, and every block cuts its own documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.llm.common import bucketed, pack_sorted, read_table, unpack_sorted, written
from helmwatch.llm.textscan import _P, _P_INV, chunks, mix, utf8

LENGTH = 50
SEED = 24
RUN = LENGTH - SEED + 1
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 20
#: Text per transform.
BATCH_BYTES = 1 << 20
_VALUES = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial in the bytes' values, and the inverse powers that take a range back to its start."""
    n = len(data)
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 100)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, p)])) for p in (_P, _P_INV)]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers[0][:n], out=sums[1:])
    return sums, _powers[1]


def _range_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def strips(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, windows, key, hash) of every strip of some texts, in order."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data) - LENGTH + 1
    if n <= 0:
        return empty
    sums, down = _sums(data)
    seeds = mix((sums[SEED:] - sums[:-SEED]) * down[: len(data) - SEED + 1])
    low, width = seeds, 1
    while 2 * width <= RUN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < RUN:
        low = np.minimum(low[: len(seeds) - RUN + 1], low[RUN - width : RUN - width + len(seeds) - RUN + 1])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(n) + LENGTH <= offsets[1:][row]
    if not valid.any():
        return empty
    cut = np.ones(n, dtype=bool)
    cut[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, n))
    first, size = first[valid[first]], size[valid[first]]
    pieces = -(-size // RUN)
    within = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + within * RUN
    windows = np.minimum(np.repeat(first + size, pieces) - start, RUN)
    return row[start], start, windows, low[start], _range_hash(sums, down, start, start + windows + LENGTH - 1)


BLOCK_SCHEMA = "bid long, ids binary, lengths binary, text binary"
ASK_SCHEMA = "bucket long, bid long, keys binary, many binary"
TOLD_SCHEMA = "bid long, bucket long, answer binary"
SENT_SCHEMA = "bucket long, bid long, keys binary, docs binary, windows binary, text binary"
CUT_SCHEMA = "id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, size = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        ids, lengths, text = (np.concatenate(x) for x in zip(*held, strict=True))
        return _batch(BLOCK_SCHEMA, [((part << 32) | number, ids.tobytes(), lengths.tobytes(), _zip(text.tobytes()))])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = utf8(batch.column(1))
        for a, b in chunks(offsets, BLOCK_BYTES - size if BLOCK_BYTES > size else 1):
            held.append((ids[a:b], np.diff(offsets[a : b + 1]), data[offsets[a] : offsets[b]]))
            size += int(offsets[b] - offsets[a])
            if size >= BLOCK_BYTES:
                yield block()
                held, size, number = [], 0, number + 1
    if held:
        yield block()


def _block_strips(row: dict) -> Iterator[tuple]:
    """Chunk by chunk of a block: (first row, data, offsets, strips)."""
    data = np.frombuffer(_unzip(row["text"]), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], np.int64))])
    for a, b in chunks(offsets, CHUNK):
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, own, at, strips(own, at)


def _block_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct keys, sorted, and whether more than one of its documents holds them."""
    keys, rows = [], []
    for a, _, _, (r, _, _, k, _) in _block_strips(row):
        keys.append(k)
        rows.append(r + a)
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(keys)) - 1 if len(keys) else first
    return keys[first], rows[first] != rows[last]


def _cuts(keys: np.ndarray, bits: int) -> list[int]:
    inner = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() if bits else []
    return [0, *inner, len(keys)]


def _asker(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, many = _block_keys(row)
                at = _cuts(keys, bits)
                yield _batch(ASK_SCHEMA, [(b, row["bid"], pack_sorted(keys[s:e]), np.packbits(many[s:e]).tobytes()) for b, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)) if e > s])

    return ask


def _tell(table: pa.Table) -> pa.Table:
    """Which of the keys of one bucket more than one document holds, for every block that asked."""
    rows = table.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(k)) for r, k in zip(rows, keys, strict=True)])
    flat = np.concatenate(keys)
    order = np.argsort(flat)
    first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    size = np.diff(np.append(first, len(flat)))
    shared = (size > 1) | (np.maximum.reduceat(many[order], first) > 0)
    answer = np.zeros(len(flat), np.uint8)
    answer[order] = np.repeat(shared, size)
    ends = np.cumsum([len(k) for k in keys])
    return pa.Table.from_batches([_batch(TOLD_SCHEMA, [(r["bid"], r["bucket"], np.packbits(answer[e - len(k) : e]).tobytes()) for r, k, e in zip(rows, keys, ends.tolist(), strict=True)])])


def _shared_keys(row: dict, told: list[dict], bits: int) -> np.ndarray:
    keys, _ = _block_keys(row)
    at = _cuts(keys, bits)
    flags = np.zeros(len(keys), dtype=bool)
    for r in told:
        s, e = at[r["bucket"]], at[r["bucket"] + 1]
        flags[s:e] = np.unpackbits(np.frombuffer(r["answer"], np.uint8), count=e - s)
    return keys[flags]


def _distinct_strips(row: dict, shared: np.ndarray) -> tuple[dict, np.ndarray]:
    """The block's strips of shared keys: arrays of all of them, and which stand for the distinct ones (by key, then
    hash), each the one of its smallest document. place: each strip's number among the distinct ones."""
    ids = np.frombuffer(row["ids"], np.int64)
    found: dict[str, list] = {c: [] for c in ("row", "start", "windows", "key", "hash", "text")}
    base = 0
    for a, data, _, (r, start, windows, key, own) in _block_strips(row):
        at = np.searchsorted(shared, key)
        hit = np.flatnonzero((at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == key)) if len(shared) else np.zeros(0, np.int64)
        for c, v in (("row", r[hit] + a), ("start", start[hit] + base), ("windows", windows[hit]), ("key", key[hit]), ("hash", own[hit])):
            found[c].append(v)
        base += len(data)
    s = {c: np.concatenate(v) for c, v in found.items() if c != "text"}
    s["doc"] = ids[s["row"]]
    order = np.lexsort((s["doc"], s["hash"], s["key"]))
    key, own = s["key"][order], s["hash"][order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    s["place"] = np.empty(len(order), np.int64)
    s["place"][order] = np.cumsum(first) - 1
    return s, order[first]


def _texts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one after the other."""
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return data[at]


def _sender(bits: int):
    def send(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            s, pick = _distinct_strips(row, _shared_keys(row, told.to_pylist(), bits))
            data = np.frombuffer(_unzip(row["text"]), np.uint8)
            at = _cuts(s["key"][pick], bits)
            rows = []
            for b, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if hi > lo:
                    p = pick[lo:hi]
                    text = _texts(data, s["start"][p], s["windows"][p] + LENGTH - 1)
                    rows.append((b, row["bid"], pack_sorted(s["key"][p]), _zip(s["doc"][p].tobytes()), _zip(s["windows"][p].astype(np.uint8).tobytes()), _zip(text.tobytes())))
            out.append(_batch(SENT_SCHEMA, rows))
        return pa.Table.from_batches(out)

    return send


def suffix_array(text: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The suffixes of strings laid end to end, in order; last marks the strings' ends, each smaller than any byte and
    than all later ends. Ranks by the first 1, 2, 4, ... bytes, until no two are equal."""
    n = len(text)
    ends = np.cumsum(last)
    rank = np.where(last, ends - 1, text.astype(np.int64) + int(ends[-1]))
    step = 1
    while True:
        pair = rank * (int(rank.max()) + 2)
        pair[: n - step] += rank[step:] + 1
        order = np.argsort(pair)
        fresh = np.ones(n, dtype=np.int64)
        fresh[1:] = pair[order][1:] != pair[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        step *= 2


def prefix_classes(text: np.ndarray, last: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class of each of its entries): neighbours are of one class if their suffixes share length bytes.

    Works on the Burrows-Wheeler transform. open_ holds the entries whose boundary to the entry before is not known
    yet. A boundary at common prefix n between two entries that the same byte precedes is, one backward step on, a
    boundary at n + 1; so level after level the boundaries known so far yield the next ones, until length."""
    order = suffix_array(text, last)
    n = len(text)
    before = np.where(order > 0, text[order - 1].astype(np.int64), 256)
    before[last[order - 1] & (order > 0)] = 256  # an end precedes: no step back across strings
    by_byte = np.argsort(before, kind="stable")
    by_byte = by_byte[before[by_byte] < 256]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    target = place[order[by_byte] - 1]
    same = np.zeros(len(by_byte), dtype=bool)
    same[1:] = before[by_byte[1:]] == before[by_byte[:-1]]
    boundary = np.zeros(n, dtype=bool)
    # Level 0: where the first byte changes, and before and after every end.
    head = np.where(last[order], -1, text[order].astype(np.int64))
    boundary[0] = True
    boundary[1:] = (head[1:] != head[:-1]) | (head[1:] < 0)
    left, right, step = np.append(-1, by_byte[:-1])[same], by_byte[same], target[same]
    open_ = ~boundary[step]
    left, right, step = left[open_], right[open_], step[open_]
    for _ in range(1, length):
        crossed = np.cumsum(boundary)
        hit = crossed[right] > crossed[left]
        if not hit.any():
            break
        boundary[step[hit]] = True
        left, right, step = left[~hit], right[~hit], step[~hit]
    return order, np.cumsum(boundary) - 1


def repeated_windows(texts: np.ndarray, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For strips of some documents, bit masks of the windows that also start in a strip of a smaller document."""
    size = windows + LENGTH - 1
    n = int(size.sum()) + len(size)
    ends = np.cumsum(size + 1) - 1
    last = np.zeros(n, dtype=bool)
    last[ends] = True
    text = np.zeros(n, np.uint8)
    text[~last] = texts
    strip = np.repeat(np.arange(len(size)), size + 1)
    within = np.arange(n) - (ends - size)[strip]
    order, classes = prefix_classes(text, last)
    real = within[order] < windows[strip[order]]
    doc = np.where(real, docs[strip[order]], np.iinfo(np.int64).max)
    first = np.flatnonzero(np.diff(classes, prepend=-1))
    gone = real & (np.minimum.reduceat(doc, first)[classes] < doc)
    masks = np.zeros(len(size), np.uint32)
    at = order[gone]
    np.bitwise_or.at(masks, strip[at], np.uint32(1) << within[at].astype(np.uint32))
    return masks


def _judge(table: pa.Table) -> pa.Table:
    """One bucket's strips: bit masks of the windows to remove, for every block that sent."""
    rows = table.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    windows = np.concatenate([np.frombuffer(_unzip(r["windows"]), np.uint8) for r in rows]).astype(np.int64)
    docs = np.concatenate([np.frombuffer(_unzip(r["docs"]), np.int64) for r in rows])
    data = np.frombuffer(b"".join(_unzip(r["text"]) for r in rows), np.uint8)
    flat = np.concatenate(keys)
    size = windows + LENGTH - 1
    start = np.cumsum(size) - size
    own = np.empty(len(flat), np.uint64)
    for a, b in chunks(np.append(start, len(data)), CHUNK):
        sums, down = _sums(data[start[a] : start[b - 1] + size[b - 1]])
        own[a:b] = _range_hash(sums, down, start[a:b] - start[a], start[a:b] - start[a] + size[a:b])
    order = np.lexsort((docs, own, flat))
    key, mark = flat[order], own[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
    pick, which = order[new], np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    # Keys with several different strips, of several documents.
    k = flat[pick]
    group = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]])) - 1
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least, most = np.minimum.reduceat(docs[pick], first), np.maximum.reduceat(docs[pick], first)
    several = (least < most)[group]
    masks = np.zeros(len(pick), np.uint32)
    todo = np.flatnonzero(several)
    ends = np.cumsum(size[pick[todo]])
    at = 0
    while at < len(todo):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES)) + 1
        to = min(to, len(todo))
        while to < len(todo) and group[todo[to]] == group[todo[to - 1]]:
            to += 1
        p = pick[todo[at:to]]
        masks[todo[at:to]] = repeated_windows(_texts(data, start[p], size[p]), windows[p], docs[p])
        at = to
    out = np.where(docs > docs[pick][which], np.uint32(0xFFFFFFFF), masks[which])
    stops = np.cumsum([len(x) for x in keys])
    return pa.Table.from_batches([_batch(TOLD_SCHEMA, [(r["bid"], r["bucket"] + (1 << 40), _zip(out[e - len(x) : e].tobytes())) for r, x, e in zip(rows, keys, stops.tolist(), strict=True)])])


def _cutter(bits: int):
    def cut(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        answers = told.to_pylist()
        for row in blocks.to_pylist():
            shared = _shared_keys(row, [r for r in answers if r["bucket"] < 1 << 40], bits)
            s, pick = _distinct_strips(row, shared)
            masks = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(_unzip(r["answer"]), np.uint32) for r in sorted((r for r in answers if r["bucket"] >= 1 << 40), key=lambda r: r["bucket"]))])
            # A strip that equals one of a smaller document of the same block is a repeat as a whole.
            mask = np.where(s["doc"] > s["doc"][pick][s["place"]], np.uint32(0xFFFFFFFF), masks[s["place"]]) if len(pick) else np.zeros(0, np.uint32)
            data = np.frombuffer(_unzip(row["text"]), np.uint8)
            change = np.zeros(len(data) + 1, np.int32)
            for bit in range(RUN):
                hit = s["start"][(mask >> np.uint32(bit) & 1).astype(bool) & (s["windows"] > bit)] + bit
                change[hit] += 1
                change[hit + LENGTH] -= 1
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            del change
            lengths = np.frombuffer(row["lengths"], np.int64)
            stops = np.cumsum(lengths)
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            begins = stops - lengths
            filled = lengths > 0
            edge[begins[filled]] = gone[begins[filled]]
            removed, spans = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            if filled.any():
                removed[filled] = np.add.reduceat(gone, begins[filled], dtype=np.int64)
                spans[filled] = np.add.reduceat(edge, begins[filled], dtype=np.int64)
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
            out.append(_batch(CUT_SCHEMA, list(zip(np.frombuffer(row["ids"], np.int64).tolist(), lengths.tolist(), removed.tolist(), spans.tolist(), kept, strict=True))))
        return pa.Table.from_batches(out)

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, n_bytes, n_removed, n_spans, kept) per row of docs; kept holds the bytes that remain.

    A byte goes if it lies in a string of LENGTH bytes that also starts in a row with a smaller id; all is judged on
    the input. Null texts count as empty; texts shorter than LENGTH keep all. Rows of equal id never remove each
    other's bytes. An empty table gives an empty result; id_col must be a non-null integer; other columns are ignored.
    """
    # In buckets by block number: they are joined to answers three times without a shuffle.
    blocks = bucketed(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_blocks, BLOCK_SCHEMA), "bid", "text_blocks")
    bits = max(4 * blocks.count() - 1, 1).bit_length()
    told = written(blocks.mapInArrow(_asker(bits), ASK_SCHEMA).groupBy("bucket").applyInArrow(_tell, TOLD_SCHEMA), "shared-keys")
    sent = blocks.groupBy("bid").cogroup(told.groupBy("bid")).applyInArrow(_sender(bits), SENT_SCHEMA)
    judged = written(sent.groupBy("bucket").applyInArrow(_judge, TOLD_SCHEMA), "window-masks")
    cut = blocks.groupBy("bid").cogroup(told.union(judged).groupBy("bid")).applyInArrow(_cutter(bits), CUT_SCHEMA)
    return cut.withColumnRenamed("id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

