"""Language-model scoring with a weighted backoff automaton learnt from the whole corpus.

The model is a smoothed trigram model over words and one end token per document. Its automaton has a state for every
pair of words seen in training, one for every word seen and a root. A state's arcs are the n-grams seen after its
words; a token without an arc there takes the failure arc, from a pair to its last word and from a word to the root,
whose arcs are the smoothed unigrams. A failure arc weighs prior / (n + prior) for a state seen n times, and what lies
behind it also adds to the arcs that are there. The two priors, of states of one word and of two, are those of a grid
under which the training texts are likeliest when each is scored by a model without it: a text lies whole in one block,
so its own n-grams are taken off the totals there. Held-out texts have no part in the choice. One left-to-right traversal of a text carries the state and adds up
log-probabilities. The first token of a text starts from the end's state, without a word before.

The n-gram counts grow with the corpus and are never gathered in one place. Documents are cut into blocks, each with
its own numbered vocabulary. A block asks, per bucket of the hash space, for the counts of its distinct n-grams, the
training counts of all blocks meet in that bucket, and the totals go back to the blocks that asked. So an n-gram
crosses the network once per block that holds it, not once per occurrence, however frequent it is, and each block
then walks the part of the automaton that its own texts can reach. Words and n-grams are 64-bit hashes: a collision would
merge the counts of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.llm.common import bucketed, pack_sorted, read_table, unpack_sorted, written
from helmwatch.llm.textscan import chunks, mix, utf8, words

BLOCK_BYTES = 16 << 20
DISCOUNT = 0.75
#: What the failure arcs of one-word and two-word states may weigh, as a number of occurrences.
WORD_PRIORS = (10.0, 100.0, 1000.0, 10000.0)
PAIR_PRIORS = (0.25, 1.0, 4.0, 16.0)
#: Tokens that are scored at once.
SLICE_TOKENS = 1 << 18
BASE_PRIOR = 0.1
END = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xD1342543DE82EF95)
_TRIPLE = np.uint64(0xAF251AF3B0F025B5)

BLOCK_SCHEMA = "bid long, ids binary, train binary, lengths binary, stream binary, vocab binary"
ASK_SCHEMA = "bucket long, bid long, kind int, keys binary, counts binary"
TOLD_SCHEMA = "bid long, kind int, bucket long, totals binary, tokens long, types long"
SCORE_SCHEMA = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, inner array<double>"
SCORE_SCHEMA_HEAD = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score")
CODEC = "zstd"


def _pack(a: np.ndarray) -> bytes:
    """An array compressed byte by byte of its values: the leading bytes are mostly zero."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), CODEC, asbytes=True)


def _unpack(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(b[8:], n * size, CODEC, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a partition's documents into blocks of about BLOCK_BYTES of text, as numbered token streams."""
    part, number, size = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        ids, train, lengths, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.cumsum(lengths) - 1
        stream = np.full(int(lengths.sum()), END, dtype=np.uint64)
        inner = np.ones(len(stream), dtype=bool)
        inner[ends] = False
        stream[inner] = hashes
        vocab, stream = np.unique(stream, return_inverse=True)
        return _table(BLOCK_SCHEMA, [((part << 32) | number, _pack(ids), _pack(train), _pack(lengths.astype(np.int64)), _pack(stream.astype(np.int32)), pack_sorted(vocab))])

    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ids, train = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
        for first, last in chunks(offsets):
            hashes, counts = words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            held.append((ids[first:last], train[first:last], counts + 1, hashes))
            size += int(offsets[last] - offsets[first])
            if size >= BLOCK_BYTES:
                yield block()
                held, size, number = [], 0, number + 1
    if held:
        yield block()


@dataclass
class Grams:
    """Distinct n-grams of a block of one order. place: each token's n-gram; keys: their hashes; order: the n-grams by
    their hashes, as they are asked and told."""

    place: np.ndarray
    keys: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.keys)

    def spread(self, told: np.ndarray) -> np.ndarray:
        """Totals in order of the hashes, put in order of the n-grams. The hashes are not needed after that and go."""
        out = np.empty_like(told)
        out[self.order] = told
        del self.order, self.keys
        return out


def _longer(place: np.ndarray, lower: np.ndarray, keys: np.ndarray, vocab: np.ndarray, factor: np.uint64) -> Grams:
    """The n-grams that tokens (place: their words) make with the n-grams lower that end before them."""
    n = np.int64(len(vocab))
    codes, at = np.unique(lower.astype(np.int64) * n + place, return_inverse=True)
    state = codes // n
    return Grams(at.astype(np.int32), mix(keys[state] * factor + vocab[codes % n]))


def _grams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Grams]]:
    """A block's (lengths, training mark of every token, which tokens are not the first of their text, n-grams by
    order). Trigrams are those of the marked tokens only."""
    stream, vocab, lengths = _unpack(row["stream"], np.int32), unpack_sorted(row["vocab"]), _unpack(row["lengths"], np.int64)
    train = np.repeat(_unpack(row["train"], np.uint8), lengths) > 0
    inner = np.ones(len(stream), dtype=bool)
    inner[np.cumsum(lengths) - lengths] = False
    before = np.empty_like(stream)
    before[0], before[1:] = np.searchsorted(vocab, END), stream[:-1]
    one = Grams(stream, vocab)
    two = _longer(stream, before, vocab, vocab, _PAIR)
    three = _longer(stream[inner], two.place[np.flatnonzero(inner) - 1], two.keys, vocab, _TRIPLE)
    return lengths, train, inner, [one, two, three]


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket (the top bits of a hash) begins among sorted keys, and the end."""
    if bits == 0:
        return np.array([0, len(keys)])
    return np.concatenate([[0], np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(keys)]])


def _asker(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, train, inner, grams = _grams(row)
                for kind, g in enumerate(grams, 1):
                    counts = np.bincount(g.place[train if kind < 3 else train[inner]], minlength=len(g.keys))
                    keys, counts = g.keys[g.order], counts[g.order]
                    at = _cuts(keys, bits)
                    counts = counts.astype(np.uint32)
                    yield _table(ASK_SCHEMA, [(b, row["bid"], kind, pack_sorted(keys[s:e]), _pack(counts[s:e])) for b, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if e > s])

    return ask


def _tell(table: pa.Table) -> pa.Table:
    """Add up one bucket's counts and answer every block that asked."""
    out = []
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["bid"]))
    for kind in (1, 2, 3):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        asked = [unpack_sorted(r["keys"]) for r in own]
        keys = np.concatenate(asked)
        counts = np.concatenate([_unpack(r["counts"], np.uint32) for r in own]).astype(np.int64)
        order = np.argsort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        sums = np.add.reduceat(counts[order], first)
        totals = np.empty(len(keys), dtype=np.int64)
        totals[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        at = 0
        for i, r in enumerate(own):
            n = len(asked[i])
            whole = (int(sums.sum()), int((sums > 0).sum())) if kind == 1 and i == 0 else (0, 0)
            out.append((r["bid"], kind, r["bucket"], _pack(totals[at : at + n]), *whole))
            at += n
    return pa.Table.from_batches([_table(TOLD_SCHEMA, out)])


def _by_settings(root: np.ndarray, seen: tuple[np.ndarray, ...], starts: np.ndarray, priors: tuple[tuple, tuple]) -> np.ndarray:
    """Log-probabilities of texts, a row a setting of the priors. root: each token's unigram probability; seen: how often
    its pair, the word before, its triple and the pair before were seen, the last two 0 for a text's first token."""
    pair, word, triple, before = seen
    out = []
    for a in priors[0]:
        two = (pair + a * root) / (word + a)
        out += [np.add.reduceat(np.log10((triple + b * two) / (before + b)), starts) for b in priors[1]]
    return np.array(out)


def _shifted(counts: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """What the token before has, and first for a text's first token."""
    out = np.empty_like(counts)
    out[1:] = counts[:-1]
    out[starts] = first
    return out


def _own(text: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """How often each token's n-gram occurs in its own text."""
    _, at, n = np.unique(text * (np.int64(grams.max()) + 1) + grams, return_inverse=True, return_counts=True)
    return n[at]


def _scorer(tokens: int, types: int, priors: tuple[tuple, tuple]):
    def root(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        """The root's arcs: discounted unigrams; what the discount frees is the unknown word's."""
        total = np.maximum(total, 0)
        return np.where(total > 0, np.where(count > 0, count - DISCOUNT, DISCOUNT * types) / np.maximum(total, 1), 1.0)

    def score(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            lengths, _, inner, grams = _grams(row)
            answers = sorted((r["kind"], r["bucket"], r["totals"]) for r in told.select(["kind", "bucket", "totals"]).to_pylist())
            one, two, three = grams
            end = np.searchsorted(one.keys, END)
            count, pairs, triples = (g.spread(np.concatenate([np.zeros(0, np.int64), *(_unpack(t, np.int64) for k, _, t in answers if k == kind)])) for kind, g in enumerate(grams, 1))
            ends = count[end]
            del answers
            ids, trained = _unpack(row["ids"], np.int64), _unpack(row["train"], np.uint8) > 0
            stops = np.concatenate([[0], np.cumsum(lengths)])
            known, base, scores, without = [], [], [], np.zeros(len(priors[0]) * len(priors[1]))
            for first, last in chunks(stops, SLICE_TOKENS):
                a, b = stops[first], stops[last]
                starts, text = stops[first:last] - a, np.repeat(np.arange(last - first), lengths[first:last])
                word, pair, rest = one.place[a:b], two.place[a:b], inner[a:b]
                triple = three.place[a - first : b - last]  # the first token of a text has none
                c1, c2, c3 = count[word], pairs[pair], np.zeros(b - a, np.int64)
                c3[rest] = triples[triple]
                known.append(np.add.reduceat((c1 > 0).astype(np.int64), starts))
                base.append(np.add.reduceat(np.log10((c1 + BASE_PRIOR) / (tokens + BASE_PRIOR * (types + 1))), starts))
                scores.append(_by_settings(root(c1, tokens), (c2, _shifted(c1, starts, ends), c3, _shifted(c2, starts, 0)), starts, priors))
                if trained[first:last].any():
                    o1, o2, o3 = _own(text, word), _own(text, pair), np.zeros(b - a, np.int64)
                    if len(triple):
                        o3[rest] = _own(text[rest], triple)
                    c1, c2, c3 = (np.maximum(c - o, 0) for c, o in ((c1, o1), (c2, o2), (c3, o3)))
                    left = root(c1, (tokens - lengths[first:last])[text])
                    alone = _by_settings(left, (c2, _shifted(c1, starts, max(ends - 1, 0)), c3, _shifted(c2, starts, 0)), starts, priors)
                    without += alone[:, trained[first:last]].sum(1)
            flat = np.concatenate(scores, axis=1).T
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel()))
            chosen = pa.array([without.tolist()] + [None] * (len(ids) - 1), pa.list_(pa.float64()))
            columns = (ids, ~trained, lengths, np.concatenate(known), np.full(len(lengths), tokens), np.concatenate(base))
            out.append(pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), listed, chosen], names=[f.split()[0] for f in SCORE_SCHEMA.split(", ")]))
        names = [f.split() for f in SCORE_SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
        return pa.Table.from_batches(out, schema=pa.schema([(n, kinds[k]) for n, k in names]))

    return score


def score_texts(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", priors: tuple[tuple, tuple] = (WORD_PRIORS, PAIR_PRIORS)) -> DataFrame:
    """One row (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, word_prior, pair_prior) per row of docs.

    held_out is a SQL condition over docs; the model learns from the rows for which it does not hold (a null
    condition counts as not held out). A null text is empty: it has the end token alone. Repeated rows count as often
    as they occur. priors holds the two lists to choose from; of settings equally good the first is taken. Where nothing
    is left to learn from, every token has probability 1. An empty table gives an empty result. id_col must be a non-null integer; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (~F.coalesce(F.expr(held_out), F.lit(False))).alias("train"), F.col(text_col).cast("string").alias("text"))
    blocks = bucketed(rows.mapInArrow(_blocks, BLOCK_SCHEMA), "bid", "lm_blocks")
    bits = max(blocks.count() - 1, 1).bit_length() + 1
    told = written(blocks.mapInArrow(_asker(bits), ASK_SCHEMA).groupBy("bucket").applyInArrow(_tell, TOLD_SCHEMA), "lm-told")
    whole = told.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types"))).first()
    scored = blocks.groupBy("bid").cogroup(told.groupBy("bid")).applyInArrow(_scorer(whole["tokens"], whole["types"], priors), SCORE_SCHEMA)
    scored = written(scored, "lm-scores")
    settings = [(a, b) for a in priors[0] for b in priors[1]]
    sums = scored.agg(*(F.coalesce(F.sum(F.col("inner")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(len(settings)))).first()
    best = max(range(len(settings)), key=lambda k: (sums[k], -k))
    word, pair = settings[best]
    return scored.select(F.col("id").alias(id_col), *SCORE_SCHEMA_HEAD, F.col("scores")[best].alias("score"), F.lit(word).alias("word_prior"), F.lit(pair).alias("pair_prior"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), "crc32(cast(doc_id AS string)) % 10 = 0")
