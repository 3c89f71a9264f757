"""Byte-level BPE encoding and decoding.

Texts are cut into words by the split pattern, and each distinct word is encoded once where its texts lie: a fold of
ranked merges over the word's bytes joins the neighbouring parts of lowest rank until none has a rank. Decoding
concatenates the parts' bytes. No step shuffles.

encode_word is that fold as Spark higher-order functions over a literal rank map: one row beside the words, dealt into
slots by a checksum so that a lookup scans one small map. It gives the same ids, but takes some 40 times as long a
word, so whole corpora go through WordCoder; the README has the figures.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmwatch.llm.common import read_table

#: Slots of the rank map, a power of two. 50,000 ranks leave most slots with one entry or none.
SLOTS = 1 << 15
#: Words of more bytes than this go to the tiktoken library, whose heap keeps the cost of a long word low.
LONG_WORD = 48
NONE = 2**31 - 1

# The contractions and the order of alternatives of the public split pattern, for texts made of ASCII
# (without the separators U+001C to U+001F) and Latin-1 letters only. Other texts take the pattern itself.
_OTHER = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]")
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_SLOW = regex.compile(public_tokenizers.PATTERN)


def split(text: str) -> list[str]:
    """A text's words: the matches of public_tokenizers.PATTERN."""
    return (_SLOW if _OTHER.search(text) else _FAST).findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row: ranks, an array of SLOTS maps from a token's bytes to its rank. Its size is the vocabulary's."""
    slots: list[dict[bytes, int]] = [{} for _ in range(SLOTS)]
    for token, rank in ranks.items():
        slots[zlib.crc32(token) & (SLOTS - 1)][token] = rank
    kind = T.StructType([T.StructField("ranks", T.ArrayType(T.MapType(T.BinaryType(), T.IntegerType())))])
    return spark.createDataFrame([(slots,)], kind)


def rank_of(token: Column, ranks: Column) -> Column:
    slot = (F.crc32(token).bitwiseAND(F.lit(SLOTS - 1)) + 1).cast("int")
    return F.element_at(F.element_at(ranks, slot), token)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once: expressions in lambdas are evaluated wherever they stand."""
    return F.get(F.transform(F.array(value), then), 0)


def encode_word(word: Column, ranks: Column) -> Column:
    """struct(ids array<int>, decoded binary) of a word's bytes, by repeated merges of the pair of lowest rank (of
    equal ranks the leftmost)."""
    size = F.octet_length(word)
    none = F.lit(NONE)

    def pair(parts: Column, i: Column) -> Column:
        return F.coalesce(rank_of(F.concat(F.get(parts, i), F.get(parts, i + 1)), ranks), none)

    def state(parts: Column, found: Column) -> Column:
        return _let(found, lambda f: F.struct(parts.alias("parts"), f.alias("found"), F.coalesce(F.array_min(f), none).alias("least")))

    def begin(pieces: Column) -> Column:
        return state(pieces, F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), lambda i: pair(pieces, i)))

    def merge(s: Column) -> Column:
        return _let(
            (F.array_position(s["found"], s["least"]) - 1).cast("int"),
            lambda at: _let(
                F.concat(
                    F.slice(s["parts"], F.lit(1), at),
                    F.array(F.concat(F.get(s["parts"], at), F.get(s["parts"], at + 1))),
                    F.slice(s["parts"], at + 3, F.greatest(F.size(s["parts"]) - at - 2, F.lit(0))),
                ),
                lambda joined: state(joined, renewed(s["found"], joined, at)),
            ),
        )

    def renewed(found: Column, joined: Column, at: Column) -> Column:
        """Ranks of neighbours after a merge at place at: only the pairs beside the new part are looked up."""
        left = F.when(at > 0, F.array(pair(joined, at - 1))).otherwise(F.array().cast("array<int>"))
        right = F.when(at < F.size(joined) - 1, F.array(pair(joined, at))).otherwise(F.array().cast("array<int>"))
        return F.concat(
            F.slice(found, F.lit(1), F.greatest(at - 1, F.lit(0))), left, right,
            F.slice(found, at + 3, F.greatest(F.size(found) - at - 2, F.lit(0))),
        )

    def folded(pieces: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(pieces) - 1), begin(pieces),
            lambda s, _: F.when(s["least"] == none, s).otherwise(merge(s)),
            lambda s: s["parts"],
        )

    pieces = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))
    parts = F.when((size == 1) | rank_of(word, ranks).isNotNull(), F.array(word)).otherwise(_let(pieces, folded))
    return _let(parts, lambda p: F.struct(
        F.transform(p, lambda t: rank_of(t, ranks)).alias("ids"),
        F.aggregate(p, F.lit(b""), lambda a, t: F.concat(a, t)).alias("decoded"),
    ))


def encode_words(words: DataFrame, ranks_path: str, word_col: str = "word") -> DataFrame:
    """words with a column coded, the fold above over word_col (binary, at most LONG_WORD bytes, not empty; a null
    gives a null). The rank table has one row, whatever the input."""
    table = rank_table(words.sparkSession, read_ranks(ranks_path))
    coded = words.crossJoin(F.broadcast(table.withColumnRenamed("ranks", "_ranks")))
    return coded.withColumn("coded", F.when(F.col(word_col).isNotNull(), encode_word(F.col(word_col), F.col("_ranks")))).drop("_ranks")


class WordCoder:
    """The same fold in the workers' Python, over the distinct words that a worker meets. The table of words met is
    bounded: it starts afresh when full."""

    LIMIT = 300_000

    def __init__(self, ranks_path: str):
        self.ranks = read_ranks(ranks_path)
        self.library = tiktoken.Encoding("long", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def fold(self, word: bytes) -> list[int]:
        rank = self.ranks.get
        if (whole := rank(word)) is not None:
            return [whole]
        if len(word) > LONG_WORD:
            return self.library._encode_single_piece(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        found = [rank(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while found and (least := min(found)) != NONE:
            at = found.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = rank(parts[at - 1] + parts[at], NONE)
            if at < len(found):
                found[at] = rank(parts[at] + parts[at + 1], NONE)
        return [self.ranks[p] for p in parts]

    def code(self, text: str) -> tuple[bytes, bytes]:
        """A text's ids, as little-endian 32-bit integers, and the bytes they decode to."""
        known = self.known
        words = split(text)
        for word in set(words).difference(known):
            ids = self.fold(word.encode())
            known[word] = array("I", ids).tobytes(), self.library.decode_bytes(ids)
        pairs = [known[w] for w in words]
        if len(known) > self.LIMIT:
            self.known = {}
        return b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])


_coders: dict[str, WordCoder] = {}


def _coder(ranks_path: str) -> WordCoder:
    if ranks_path not in _coders:
        _coders[ranks_path] = WordCoder(ranks_path)
    return _coders[ranks_path]


def _encoded(docs: DataFrame, ranks_path: str, id_col: str, text_col: str, finish: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path)
        for batch in batches:
            rows = [finish(i, *coder.code(t.as_py() or "")) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ddl)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, ids array<int>, decoded binary) per row of docs, as the tiktoken library encodes without
    special tokens. A null or empty text has no ids and decodes to nothing. Repeated rows are encoded alike; an empty
    table gives an empty result; id_col must be a non-null integer; other columns are ignored."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    out = _encoded(docs, ranks_path, id_col, text_col, lambda i, ids, decoded: (i, np.frombuffer(ids, "<u4").astype(np.int32), decoded), schema, "id long, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def _digest(i: int, ids: bytes, decoded: bytes) -> tuple:
    return i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return _encoded(read_table(spark, sf_dir, "documents"), path, "doc_id", "text", _digest, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
