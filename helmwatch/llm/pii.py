"""Personal data: fixed forms, plus identifiers found by bootstrapped contextual extraction.

Seed entities (the fixed forms and a few shapes of credentials) are looked up in the corpus. What stands directly
before an entity - a cue word with its separator, such as `password=` - is a lexical pattern; so are the two words
before and the two words behind a seed, which are induced from the seeds and then looked up in all documents. Patterns
and the values they extract form a bipartite graph that Spark scores in a few rounds: a pattern is trusted as far as
the values it extracts are, and the values of trusted patterns are seeds of the next round. Every value of a trusted
pattern is then reported, also values of no known shape.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.llm.common import read_table, written
from helmwatch.llm.textscan import has_any, utf8

# The contract's forms of personal data, in the contract's order.
KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Shapes of credentials that serve as further seeds: access keys and long hexadecimal strings.
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
_HEX = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}")
# A cue word, a separator, and the value that they introduce.
_CUED = re.compile(r"(?<![A-Za-z_])([A-Za-z_]{2,}+)(\x20?[:=]\x20?[\"']?)([^\s\"',;<>]{4,}+)")

ROUNDS = 3
MIN_CONFIDENCE = 0.6
MIN_SEEDS = 3

SCAN_SCHEMA = "id long, seen array<struct<pattern:string,value:string,seed:boolean,start:int,end:int>>, around array<struct<pattern:string,value:string>>"
SLOT_SCHEMA = "pattern string, value string, seed boolean"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, sorted. For each kind the matches are leftmost and do not overlap; a
    match that fails its test is dropped, and the search goes on behind it.

    An address is looked up from its @: it starts where the run of name characters before it starts, or where the
    match before it ended. That makes the search linear in the text's length."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            free = m.end()
            found.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_TOKEN = re.compile(r"\S+")
_QUOTES = "\"'`()[]{}<>,;:.!?"


def _slots(text: str, seeds: list[tuple[int, int]]) -> Iterator[tuple[tuple[str, str, str], tuple[str, str, str], int, int, bool]]:
    """(left, right, start, end, seed) of each token: the two words before it and the two behind it, and its place
    without quotes and punctuation. A seed that starts where its token does is one slot, whatever tokens it covers."""
    ends = dict(seeds)
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    words = ["", "", *text.lower().split(), "", ""]
    last = -1
    for j, (a, b) in enumerate(tokens):
        if a < last:
            continue
        while a < b and text[a] in _QUOTES:
            a += 1
        seed, k = a in ends, j
        if seed:
            b = last = ends[a]
            while k + 1 < len(tokens) and tokens[k + 1][0] < b:
                k += 1
        else:
            while b > a and text[b - 1] in _QUOTES:
                b -= 1
        if a < b:
            yield ("<", words[j], words[j + 1]), (">", words[k + 3], words[k + 4]), a, b, seed


def _seed_spans(text: str) -> tuple[list[tuple[int, int, int]], list[re.Match], list[tuple[int, int]]]:
    spans, own = base_spans(text), list(_KEY.finditer(text))
    return spans, own, [(s, e) for s, _, e in spans] + [m.span() for m in own]


def _plain_slots(text: str, contexts: frozenset[tuple[str, str, str]], pairs: frozenset[tuple[str, str]]) -> Iterator[tuple[tuple[str, str, str], int, int]]:
    """(context, start, end) of the contexts' occurrences in a text without seeds: _slots, only where a pair stands."""
    words = ["", "", *text.lower().split(), "", ""]
    if hits := [q for q, c in enumerate(zip(words, words[1:])) if c in pairs]:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        for q in hits:
            for side, j in (("<", q), (">", q - 3)):
                if 0 <= j < len(tokens) and (c := (side, words[q], words[q + 1])) in contexts:
                    word = text[slice(*tokens[j])].lstrip(_QUOTES)
                    a = tokens[j][1] - len(word)
                    if word := word.rstrip(_QUOTES):
                        yield c, a, a + len(word)


def _places(text: str, digit: bool, contexts: frozenset[tuple[str, str, str]], pairs: frozenset[tuple[str, str]]) -> Iterator[tuple[tuple[str, str, str], int, int, bool]]:
    """(context, start, end, seed) of the contexts' occurrences in a text; digit: whether it has a digit or @."""
    if digit and (seeds := _seed_spans(text)[2]):
        for left, right, a, b, seed in _slots(text, seeds):
            if left in contexts:
                yield left, a, b, seed
            if right in contexts:
                yield right, a, b, seed
    else:
        for c, a, b in _plain_slots(text, contexts, pairs):
            yield c, a, b, False


def _all_places(batches: Iterator[pa.RecordBatch], contexts: frozenset[tuple[str, str, str]]) -> Iterator[tuple[str, Iterator]]:
    pairs = frozenset(c[1:] for c in contexts)
    for batch in batches:
        digits = has_any(*utf8(batch.column(1)), b"0123456789@").tolist()
        for text, digit in zip(batch.column(1), digits, strict=True):
            text = text.as_py() or ""
            yield text, _places(text, digit, contexts, pairs)


def _count_places(contexts: frozenset[tuple[str, str, str]]):
    """How often each of contexts occurs in a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(c for _, found in _all_places(batches, contexts) for c, *_ in found)
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(c) for c in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "places"])

    return run


def _find_slots(contexts: frozenset[tuple[str, str, str]]):
    """The distinct slots of contexts in a task's texts, as rows of SLOT_SCHEMA; sent on whenever there are many."""

    def rows(slots: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in slots], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["pattern", "value", "seed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: set[tuple[str, str, bool]] = set()
        for text, found in _all_places(batches, contexts):
            slots.update((" ".join(c), text[a:b], seed) for c, a, b, seed in found)
            if len(slots) >= 100_000:
                yield rows(slots)
                slots = set()
        yield rows(slots)

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("id", pa.int64()),
        ("seen", pa.list_(pa.struct([("pattern", pa.string()), ("value", pa.string()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))),
        ("around", pa.list_(pa.struct([("pattern", pa.string()), ("value", pa.string())]))),
    ])
    for batch in batches:
        column = batch.column(1)
        data, offsets = utf8(column)
        digits, cues = has_any(data, offsets, b"0123456789@"), has_any(data, offsets, b":=")
        n = len(batch)
        seen, around = ([[] for _ in range(n)] for _ in range(2))
        for i in np.flatnonzero(digits | cues).tolist():
            text = column[i].as_py() or ""
            known = _seed_spans(text)[2] if digits[i] else []
            if known:
                around[i] = [{"pattern": " ".join(c), "value": text[a:b]} for *sides, a, b, seed in _slots(text, known) if seed for c in sides if any(c[1:])]
            if cues[i]:
                starts = {s for s, _ in known}
                seen[i] = [{"pattern": p, "value": text[a:b], "seed": a in starts or bool(_HEX.fullmatch(text, a, b)), "start": a, "end": b} for p, a, b in _cued(text)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(seen, schema[1].type), pa.array(around, schema[2].type)], schema=schema)


def trusted_patterns(seen: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """Patterns (pattern, confidence, seeds) worth trusting, from occurrences (pattern, value, seed).

    Scores alternate: a pattern's is the mean score of the distinct values it extracts. A value's is 1 if it is a
    seed, and every value of a trusted pattern is a seed from the next round on; else it is half of the best score
    among the patterns that extract it. Distinct pairs are made before any join.
    """
    edges = written(
        seen.groupBy("pattern", F.xxhash64("value").alias("value")).agg(F.max(F.col("seed").cast("double")).alias("seed")),
        "pii-edges",
    )
    trusted = (F.col("seeds") >= min_seeds) & (F.col("trust") >= min_confidence)
    scored = edges.select("pattern", "value", "seed", F.col("seed").alias("score"))
    for _ in range(rounds):
        patterns = scored.groupBy("pattern").agg(F.avg("score").alias("trust"), F.sum("seed").alias("seeds")).where(F.col("seeds") >= min_seeds)
        values = edges.join(patterns, "pattern", "left").groupBy("value").agg(
            F.greatest(F.max("seed"), F.max(F.when(trusted, 1.0).otherwise(0.0))).alias("seed"), F.coalesce(F.max("trust"), F.lit(0.0)).alias("found")
        )
        values = values.where((F.col("seed") > 0) | (F.col("found") > 0))
        known = edges.select("pattern", "value").join(values, "value", "left").withColumn("seed", F.coalesce("seed", F.lit(0.0)))
        scored = written(known.select("pattern", "value", "seed", F.greatest("seed", F.coalesce("found", F.lit(0.0)) * 0.5).alias("score")), "pii-scores")
    return (
        scored.groupBy("pattern")
        .agg(F.avg("score").alias("confidence"), F.sum("seed").alias("seeds"))
        .where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= min_confidence))
    )


#: Patterns that are looked up in one pass over the texts.
PATTERNS = 1 << 18


def _blocks(patterns: DataFrame) -> list[frozenset[str]]:
    """The patterns in blocks of bounded size."""
    rows = written(patterns, "pii-patterns")
    parts = -(-rows.count() // PATTERNS)
    return [frozenset(r["pattern"] for r in rows.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k).collect()) for k in range(parts)]


def _contexts(patterns: frozenset[str]) -> frozenset[tuple[str, str, str]]:
    return frozenset(tuple(p.split(" ")) for p in patterns if p.count(" ") == 2)


def learn_patterns(rows: DataFrame) -> list[frozenset[str]]:
    """The trusted patterns of all rows (id, text), in blocks."""
    scan = written(rows.mapInArrow(_scan, SCAN_SCHEMA), "pii-scan")
    seen = scan.where(F.size("seen") > 0).select(F.explode("seen").alias("o")).select("o.pattern", "o.value", "o.seed")
    # A context is a pattern if enough seeds stand in it, and if they are a share of all its places, in all texts, with
    # which it can be trusted at all: a value that is no seed scores half at most.
    around = scan.where(F.size("around") > 0).select(F.explode("around").alias("o")).groupBy("o.pattern")
    induced = written(around.agg(F.countDistinct("o.value").alias("seeds"), F.count("*").alias("held")).where(F.col("seeds") >= MIN_SEEDS), "pii-contexts")
    for block in _blocks(induced.select("pattern")):
        places = rows.mapInArrow(_count_places(_contexts(block)), "pattern string, places long").groupBy("pattern").agg(F.sum("places").alias("places"))
        likely = induced.join(places, "pattern").where(F.col("held") >= (MIN_CONFIDENCE - 0.5) / 0.5 * F.col("places"))
        for some in _blocks(likely.select("pattern")):
            seen = seen.unionByName(written(rows.mapInArrow(_find_slots(_contexts(some)), SLOT_SCHEMA), "pii-slots"))
    return _blocks(trusted_patterns(seen).select("pattern"))


def added_spans(base: list[tuple[int, int, int]], found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """What found (start, end) adds to base spans, sorted: the parts outside base spans, without those that lie inside
    another one. Linear in both after sorting."""
    free, at = [], 0
    for start, _, end in sorted(base):
        if start > at:
            free.append((at, start))
        at = max(at, end)
    free.append((at, 1 << 62))
    begins, parts = [a for a, _ in free], set()
    for start, end in found:
        k = max(bisect_right(begins, start) - 1, 0)
        while k < len(free) and free[k][0] < end:
            if (a := max(start, free[k][0])) < (b := min(end, free[k][1])):
                parts.add((a, b))
            k += 1
    out, most = [], -1
    for a, b in sorted(parts, key=lambda x: (x[0], -x[1])):
        if b > most:
            out.append((a, 4, b))
            most = b
    return out


def _cued(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _CUED.finditer(text):
        yield m[1].lower() + m[2].replace(" ", ""), m.start(3), m.end(3)


class Finder:
    """Finds the spans of a text by the fixed forms and by trusted patterns."""

    def __init__(self, blocks: list[frozenset[str]]):
        self.cues = frozenset(p for b in blocks for p in b if p.count(" ") != 2)
        self.contexts = frozenset().union(*map(_contexts, blocks))
        self.pairs = frozenset(c[1:] for c in self.contexts)

    def spans(self, text: str, digit: bool, cue: bool) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base, added), both sorted; digit and cue tell whether the text has a digit or @, and a colon or =."""
        base, keys, _ = _seed_spans(text) if digit else ([], [], [])
        found = [m.span() for m in keys]
        if cue and self.cues:
            found += [(a, b) for pattern, a, b in _cued(text) if pattern in self.cues]
        if self.contexts:
            found += [(a, b) for _, a, b, _ in _places(text, digit, self.contexts, self.pairs)]
        return base, added_spans(base, found) if found else []


def _found(batches: Iterator[pa.RecordBatch], column: int, blocks) -> Iterator[tuple[pa.RecordBatch, list[tuple[list, list]]]]:
    finder = Finder(blocks.value)
    for batch in batches:
        texts = batch.column(column)
        data, offsets = utf8(texts)
        digits, cues = has_any(data, offsets, b"0123456789@").tolist(), has_any(data, offsets, b":=").tolist()
        yield batch, [finder.spans(t.as_py() or "", d, c) for t, d, c in zip(texts, digits, cues, strict=True)]


SPAN_TYPE = "array<struct<start:int,kind:int,end:int>>"


def _find(blocks):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"start": s, "kind": k, "end": e} for s, k, e in spans]
        for batch, found in _found(batches, 1, blocks):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_rows(b) for b, _ in found], kind), pa.array([as_rows(sorted(b + a)) for b, a in found], kind)], names=["id", "base", "spans"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def find_identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, base, spans) per row of docs: arrays of struct(start, kind, end), sorted, offsets in code
    points, kind an index into KINDS. spans holds base and what the method adds.

    A null text counts as empty and has no spans. Every row is judged by its own text, also where rows repeat or share
    an id. Of an added span that overlaps base spans the parts outside them are added; an added span inside another
    added one is part of it. An empty table gives an empty result; id_col must be an integer; other columns are ignored.
    """
    rows = _texts(docs, id_col, text_col)
    blocks = docs.sparkSession.sparkContext.broadcast(learn_patterns(rows))
    found = rows.mapInArrow(_find(blocks), f"id long, base {SPAN_TYPE}, spans {SPAN_TYPE}")
    return found.select(F.col("id").alias(id_col), "base", "spans")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with spans (start, kind, end), sorted, replaced by their kinds; of spans that overlap the first is named."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _mask(blocks, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _found(batches, column, blocks):
            texts = batch.column(column)
            if any(b or a for b, a in found):
                out = [masked(t.as_py(), sorted(b + a)) if b or a else t.as_py() for t, (b, a) in zip(texts, found, strict=True)]
                batch = batch.set_column(column, batch.schema.field(column), pa.array(out, texts.type))
            yield batch

    return run


def mask_identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every identifier in text_col, a string, replaced by its kind in brackets; all rows and columns stay, a
    null stays null. Patterns are learnt from all rows, then every text is masked where it lies."""
    blocks = docs.sparkSession.sparkContext.broadcast(learn_patterns(_texts(docs, id_col, text_col)))
    return docs.mapInArrow(_mask(blocks, docs.columns.index(text_col)), docs.schema)


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_identifiers(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def spans_digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of spans (start, kind, end); for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
