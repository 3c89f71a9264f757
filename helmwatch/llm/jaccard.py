"""Near-duplicate join of documents by the Jaccard similarity of their word shingles, with prefix trees.

Shingles have one global order: rarest first, by a frequency table of fixed size counted over all documents, then by
hash. Two sets above the threshold share a shingle among the first quarter of both, so sets meet only under those.

1. One pass counts the frequency table and gives every document its set's size and fingerprint. Equal sets form one
   class; from here on classes are joined, and no list of copies is ever expanded.
2. Each class deals its first quarter by hash to buckets. Shingles held by one class alone, nearly all, end there.
   Others become lists of classes, each led by its most central member (the one whose rarest shingles are most
   frequent, such as the original of edited copies).
3. Leaders are joined with their lists: candidates' sets, in global order from the frequent end, form a prefix tree
   that the leader's set traverses, sharing partial overlaps and pruning subtrees that can no longer reach the
   threshold by the lengths that remain. Links make components by alternating star contraction.
4. Three rounds: every class with the most central of its leaders; then, in lists whose members still lie in different
   components, the list's leader with the others; then the pairs across components that are left in such lists and
   that places and sizes allow (see _across). Pairs within a component need no test, so no link between components is
   lost.

Before sets are loaded, a pair must pass its classes' bit marks: every shingle flips one of MARKS bits, so two marks
differ in no more bits than the sets differ in shingles. Pairs whose marks differ in too many bits cannot link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.llm.common import attach, pack_sorted, read_table, unpack_sorted, without, written
from helmwatch.llm.textscan import chunks, mix, utf8, words

SHINGLE = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 3, 4
TABLE_BITS = 20
BLOCK_BYTES = 24 << 20
BUCKET_ROWS = 1 << 20
GROUP = 256
#: Rows of four numbers that are broadcast at most, 32 MB.
BROADCAST_ROWS = 1 << 20
#: Bits of a class's mark, and of the folded mark that members of a list carry.
MARKS, FOLDED = 2048, 512
#: Sizes are dealt to bands this much apart.
BAND = 0.05
#: Places of shingles in a set's order are kept as parts of its size in this unit, rounded down.
PLACES = 1020
_STEPS = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(SHINGLE)]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle in order, shingles per row). A row of fewer words than SHINGLE has one, of all its
    words; a row without words has none."""
    found, counts = words(data, offsets)
    n = len(found)
    ends = np.cumsum(counts)
    many = np.maximum(counts - SHINGLE + 1, 0)
    rolled = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled += found[k : k + len(rolled)] * _STEPS[k]
    rolled = mix(rolled)
    keep = np.ones(n, dtype=bool)
    for k in range(1, SHINGLE):
        keep[np.maximum(ends - k, 0)[counts >= k]] = False
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    out = np.where(many > 0, many, (counts > 0).astype(np.int64))
    if not len(few):
        return rolled[keep[: len(rolled)]], out
    result = np.zeros(int(out.sum()), np.uint64)
    short = np.zeros(len(result), dtype=bool)
    begins = np.cumsum(out) - out
    short[begins[few]] = True
    result[~short] = rolled[keep[: len(rolled)]]
    for r in few.tolist():
        own = found[ends[r] - counts[r] : ends[r]]
        result[begins[r]] = mix(np.array([(own * np.array(_STEPS[: len(own)])).sum() + np.uint64(len(own))], np.uint64))[0]
    return result, out


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles sorted by hash, row after row; set sizes)."""
    found, counts = shingles(data, offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[first], np.bincount(row[first], minlength=len(counts))


def _fingerprints(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x6A09E667F3BCC909)))])
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def _marks(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One mark per row: which of MARKS bits an odd number of the row's shingles have, as 64-bit numbers."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = (mix(tokens ^ np.uint64(0xBB67AE8584CAA73B)) & np.uint64(MARKS - 1)).astype(np.int64)
    out, step = [], 1024
    ends = np.append(0, np.cumsum(sizes))
    for a in range(0, len(sizes), step):
        b = min(a + step, len(sizes))
        s, e = int(ends[a]), int(ends[b])
        odd = np.bincount((row[s:e] - a) * MARKS + bit[s:e], minlength=(b - a) * MARKS) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * (MARKS // 64), pa.int32()), pa.array(flat))


COUNT_SCHEMA = "doc long, n long, cls long, mark array<long>, part int, counts binary"
PARTS = 16


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, n, cls) for documents, and at the end the task's share of the frequency table as (part, counts)."""
    table = np.zeros(1 << TABLE_BITS, np.int32)
    names = [f.split()[0] for f in COUNT_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    any_rows = False
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = utf8(batch.column(1))
        for a, b in chunks(offsets):
            tokens, sizes = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            table += np.bincount((tokens & np.uint64(len(table) - 1)).astype(np.int64), minlength=len(table)).astype(np.int32)
            n = b - a
            any_rows = True
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], kinds[0]), pa.array(sizes, kinds[1]), pa.array(_fingerprints(tokens, sizes), kinds[2]), _marks(tokens, sizes), pa.nulls(n, kinds[4]), pa.nulls(n, kinds[5])], names=names)
    if any_rows:
        step = len(table) // PARTS
        rows = [table[p * step : (p + 1) * step].tobytes() for p in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, kinds[0]), pa.nulls(PARTS, kinds[1]), pa.nulls(PARTS, kinds[2]), pa.nulls(PARTS, kinds[3]), pa.array(range(PARTS), kinds[4]), pa.array(rows, kinds[5])], names=names)


def _sum_counts(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << TABLE_BITS) // PARTS, np.int64)
    for c in table.column("counts"):
        total += np.frombuffer(c.as_py(), np.int32 if len(c.as_py()) == total.size * 4 else np.int64)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "counts": [total.tobytes()]})


def frequency_table(counted: DataFrame) -> np.ndarray:
    """The frequency table, of 2**TABLE_BITS counters whatever the input's size; shares are added up in two steps."""
    kind = "part int, salt int, counts binary"
    shares = counted.where("part IS NOT NULL").select("part", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt"), "counts")
    rows = shares.groupBy("part", "salt").applyInArrow(_sum_counts, kind).groupBy("part").applyInArrow(_sum_counts, kind).collect()
    total = np.zeros((PARTS, (1 << TABLE_BITS) // PARTS), np.int64)
    for r in rows:
        total[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return total.ravel()


def _ordered(tokens: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets' shingles in global order, rarest first, and their counts."""
    counts = table[(tokens & np.uint64(len(table) - 1)).astype(np.int64)]
    order = np.lexsort((tokens, counts, np.repeat(np.arange(len(sizes)), sizes)))
    return tokens[order], counts[order]


def _poster(held, bits: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class's first quarter, dealt by hash: (bucket, tokens, classes, centralities)."""
        table = held.value
        seen: set[int] = set()  # classes of the block at hand
        kept: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, *others = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.argsort(tokens)
            tokens, others = tokens[order], [x[order] for x in others]
            cuts = [0, len(tokens)] if not bits else [0, *np.searchsorted(tokens, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(tokens)]
            rows = [(b, pack_sorted(tokens[s:e]), *(x[s:e].tobytes() for x in others)) for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3, 4))], names=["bucket", "tokens", "classes", "centre", "place"])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in chunks(offsets):
                tokens, sizes = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                classes = _fingerprints(tokens, sizes)
                fresh = np.array([n > 0 and c not in seen and not seen.add(c) for c, n in zip(classes.tolist(), sizes.tolist(), strict=True)])
                mask = np.repeat(fresh, sizes)
                tokens, sizes, classes = tokens[mask], sizes[fresh], classes[fresh]
                if not len(sizes):
                    continue
                tokens, counts = _ordered(tokens, sizes, table)
                first = np.cumsum(sizes) - sizes
                length = sizes - -(-NUM * sizes // DEN) + 1
                take = np.repeat(first, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                centre = np.log2(1.0 + np.add.reduceat(counts[take], np.cumsum(length) - length) / length)
                place = (take - np.repeat(first, length)) * PLACES // np.repeat(sizes, length)
                kept.append((tokens[take], np.repeat(classes, length), np.repeat((centre * 1000).astype(np.uint16), length), place.astype(np.uint8)))
                size += int(offsets[b] - offsets[a])
                if size >= BLOCK_BYTES:
                    yield flush()
                    kept, size = [], 0
                    seen.clear()
        if kept:
            yield flush()

    return post


LIST_SCHEMA = "list long, leader long, centre int, cls long, place int"


def _lists(table: pa.Table) -> pa.Table:
    """The lists of a bucket's shared shingles: (list, leader, centre, cls). Shingles with the same classes make one list."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["classes"], r["tokens"]))
    tokens = np.concatenate([unpack_sorted(r["tokens"]) for r in rows])
    classes = np.concatenate([np.frombuffer(r["classes"], np.int64) for r in rows])
    centre = np.concatenate([np.frombuffer(r["centre"], np.uint16) for r in rows]).astype(np.int32)
    place = np.concatenate([np.frombuffer(r["place"], np.uint8) for r in rows]).astype(np.int32)
    order = np.argsort(tokens)
    sorted_tokens = tokens[order]
    shared = np.zeros(len(tokens), dtype=bool)
    same = sorted_tokens[1:] == sorted_tokens[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    order = order[np.lexsort((classes[order], -centre[order], tokens[order]))]
    tokens, classes, centre, place = tokens[order], classes[order], centre[order], place[order]
    first = np.ones(len(tokens), dtype=bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
    tokens, classes, centre, place = tokens[first], classes[first], centre[first], place[first]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(tokens)))
    ids = np.add.reduceat(mix(classes.view(np.uint64)), starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)
    several = sizes > 1
    of = np.repeat(ids, sizes)[np.repeat(several, sizes)]
    leader = np.repeat(classes[starts], sizes)[np.repeat(several, sizes)]
    central = np.repeat(centre[starts], sizes)[np.repeat(several, sizes)]
    classes, place = (x[np.repeat(several, sizes)] for x in (classes, place))
    order = np.lexsort((place, classes, of))
    of, leader, central, classes, place = (x[order] for x in (of, leader, central, classes, place))
    first = np.ones(len(of), dtype=bool)
    first[1:] = (of[1:] != of[:-1]) | (classes[1:] != classes[:-1])
    return pa.table({"list": of[first], "leader": leader[first], "centre": central[first], "cls": classes[first], "place": place[first]})


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts that are of the class asked for: rows that share an id need not share a text."""
    for batch in batches:
        data, offsets = utf8(batch.column(3))
        for a, b in chunks(offsets):
            tokens, sizes = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = np.append(0, np.cumsum(sizes)).tolist()
            sets = pa.array([tokens[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
            found = pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in range(3)), sets], names=["probe", "salt", "cls", "tokens"])
            yield found.filter(pa.array(_fingerprints(tokens, sizes) == found.column("cls").to_numpy(zero_copy_only=False)))


class PrefixTree:
    """Sets of ranks in ascending order, sorted so that a node is a range of sets with a common beginning."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])

    def _split(self, lo: int, hi: int, depth: int) -> int:
        """The depth to which the sets lo..hi-1, equal to depth, stay equal."""
        a, b = self.sets[lo], self.sets[hi - 1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        return depth + int(differ[0]) if len(differ) else n

    def partners(self, probe: np.ndarray, universe: int) -> list[int]:
        """Numbers of the sets whose similarity with probe reaches NUM / DEN."""
        mask = np.zeros(universe + 1, dtype=bool)
        mask[probe] = True
        behind = np.concatenate([np.cumsum(mask[::-1])[::-1], [0]])  # how many of probe's ranks are at or behind a rank
        need = lambda size: -(-NUM * (len(probe) + size) // (NUM + DEN))
        found, stack = [], [(0, len(self.sets), 0, 0)]
        while stack:
            lo, hi, depth, overlap = stack.pop()
            down = self._split(lo, hi, depth)
            edge = self.sets[lo][depth:down]
            overlap += int(np.count_nonzero(mask[edge]))
            # The subtree's best case: all that remains of its longest set, or of the probe, still matches; its
            # shortest set asks for the least.
            last = int(self.sets[lo][down - 1]) + 1 if down else 0
            sizes = self.sizes[lo:hi]
            if overlap + min(int(sizes.max()) - down, int(behind[last])) < need(int(sizes.min())):
                continue
            while lo < hi and self.sizes[lo] == down:
                if overlap >= need(down):
                    found.append(self.order[lo])
                lo += 1
            while lo < hi:
                token, end = self.sets[lo][down], hi
                if self.sets[hi - 1][down] != token:
                    a, b = lo, hi - 1
                    while b - a > 1:
                        mid = (a + b) // 2
                        a, b = (mid, b) if self.sets[mid][down] == token else (a, mid)
                    end = b
                stack.append((lo, end, down, overlap))
                lo = end
        return found


def _joiner(held):
    def join(table: pa.Table) -> pa.Table:
        """A group's probe against the prefix tree of its other sets: links (a, b)."""
        counts = held.value
        probe = table.column("probe")[0].as_py()
        classes, raw = table.column("cls").to_pylist(), table.column("tokens").to_pylist()
        own = next(np.frombuffer(t, np.uint64) for c, t in zip(classes, raw, strict=True) if c == probe)
        rest = {c: np.frombuffer(t, np.uint64) for c, t in zip(classes, raw, strict=True) if c != probe}
        names = [c for c, t in rest.items() if DEN * min(len(t), len(own)) >= NUM * max(len(t), len(own))]
        if not names:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        flat = np.concatenate([own, *(rest[c] for c in names)])
        vocab, local = np.unique(flat, return_inverse=True)
        rank = np.empty(len(vocab), np.int64)
        rank[np.lexsort((vocab, -counts[(vocab & np.uint64(len(counts) - 1)).astype(np.int64)]))] = np.arange(len(vocab))
        ranked = np.split(rank[local], np.cumsum([len(own), *(len(rest[c]) for c in names)])[:-1])
        ranked = [np.sort(r) for r in ranked]
        links = [names[i] for i in PrefixTree(ranked[1:]).partners(ranked[0], len(vocab))]
        return pa.table({"a": pa.array([probe] * len(links), pa.int64()), "b": pa.array(links, pa.int64())})

    return join


def _within_reach(words: int, suffixes: tuple[str, str], mark: str):
    """Whether sizes and marks allow a link: sets above the threshold differ in at most (DEN - NUM) / (DEN + NUM) of
    their sizes' sum."""
    n, m = ([F.col(f"{c}_{s}") for s in suffixes] for c in ("n", mark))
    differ = sum((F.bit_count(m[0][i].bitwiseXOR(m[1][i])) for i in range(words)), F.lit(0))
    return (DEN * F.least(*n) >= NUM * F.greatest(*n)) & ((DEN + NUM) * differ <= (DEN - NUM) * (n[0] + n[1]))


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (probe, cls) that their classes' sizes and marks do not rule out."""
    of = lambda key, s: classes.select(F.col("cls").alias(key), F.col("n").alias(f"n_{s}"), F.col("mark").alias(f"mark_{s}"))
    both = attach(attach(pairs, "probe", of("probe", "x")), "cls", of("cls", "y"))
    return both.where(_within_reach(MARKS // 64, ("x", "y"), "mark")).select("probe", "cls")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, held) -> DataFrame:
    """The links among pairs (probe, cls), written. A probe with many partners meets them in several groups.

    Sets are made anew from a class's text where it lies. The classes to load are broadcast to the texts while they
    are few, and joined by a shuffle beyond that."""
    degree = pairs.groupBy("probe").agg(F.count("*").alias("_n"))
    salted = attach(pairs, "probe", degree).select("probe", "cls", F.pmod(F.xxhash64("cls"), F.ceil(F.col("_n") / GROUP).cast("long")).alias("salt"))
    members = salted.union(salted.select("probe", F.col("probe").alias("cls"), "salt").distinct())
    wanted = written(members.join(classes.select("cls", "doc"), "cls").select("doc", "probe", "salt", "cls"), "pairs-to-test")
    few = wanted.count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("doc")).select("probe", "salt", "cls", "text")
    loaded = texts.mapInArrow(_load, "probe long, salt long, cls long, tokens binary")
    return written(loaded.groupBy("probe", "salt").applyInArrow(_joiner(held), "a long, b long"), "links")


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members lie in different components, with each member's root."""
    labelled = lists.join(roots, F.col("cls") == F.col("node"), "left").select("list", "leader", "cls", "place", F.coalesce("root", "cls").alias("root"))
    mixed = labelled.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list")
    return written(attach(labelled, "list", mixed), "open-lists")


def _across(left: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (probe, cls) of members of a list in different components that may link by where the list stands in
    both sets, by their sizes and by their folded marks.

    The list's first shingle at place p of a set of n leaves n - p that two sets can share, if it is the first they
    share; so a partner has at most (4 n - 7 p) / 3 shingles (for a threshold of 3/4), and two sets that both have this
    bound below their own size never link. Sets outside their list's largest component ask the bands of sizes within
    their reach; each set answers in its own band.
    """
    words = FOLDED // 64
    fold = F.array(*(reduce(Column.bitwiseXOR, (F.col("mark")[i] for i in range(k, MARKS // 64, words))) for k in range(words)))
    sized = attach(left, "cls", classes.select("cls", "n", fold.alias("fold")))
    before = F.ceil(F.col("n") * F.col("place") / PLACES)
    reach = F.floor(((DEN + NUM) * (F.col("n") - before) - NUM * F.col("n")) / NUM)
    members = written(sized.select("list", "cls", "root", "n", "fold", reach.cast("long").alias("reach")).where(reach >= F.ceil(F.col("n") * NUM / DEN)), "list-members")
    sizes = members.groupBy("list", "root").agg(F.count("*").alias("rows"))
    largest = sizes.groupBy("list").agg(F.max(F.struct("rows", "root"))["root"].alias("most"))
    band = lambda n: F.floor(F.log(n.cast("double")) / np.log1p(BAND)).cast("int")
    asking = attach(members, "list", largest).where("root <> most")
    asking = asking.withColumn("band", F.explode(F.sequence(band(F.ceil(F.col("n") * NUM / DEN)), band(F.col("reach")))))
    x = asking.select(F.xxhash64("list", "band").alias("deal"), *(F.col(c).alias(f"{c}_x") for c in ("list", "cls", "root", "n", "reach", "fold")))
    y = members.select(F.xxhash64("list", band(F.col("n"))).alias("deal"), *(F.col(c).alias(f"{c}_y") for c in ("list", "cls", "root", "n", "reach", "fold")))
    fits = (F.col("list_x") == F.col("list_y")) & (F.col("root_x") != F.col("root_y")) & (F.col("n_y") <= F.col("reach_x")) & (F.col("n_x") <= F.col("reach_y"))
    return x.join(y, "deal").where(fits & _within_reach(words, ("x", "y"), "fold")).select(F.col("cls_x").alias("probe"), F.col("cls_y").alias("cls"))


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root) for every node of edges (a, b), root being its component's smallest node; by alternating large
    and small stars (Kiveris et al.), each step written to the shared folder."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = attach(both, "a", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = attach(large, "a", least)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), name)
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if last == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, n_shingles, component_id) per row of docs.

    Two documents link when their shingle sets' similarity is NUM / DEN or more; component_id is the smallest id
    reachable by links, the document's own included. Null, empty and wordless texts have no shingles and link with
    nothing, not with each other either. Equal texts link. An empty table gives an empty result. Rows that share an id
    are each judged by their own text, repeated rows give repeated rows; id_col must be a non-null integer; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = written(rows.mapInArrow(_count, COUNT_SCHEMA), "shingle-counts")
    held = spark.sparkContext.broadcast(frequency_table(counted))
    marked = counted.where("part IS NULL")
    own = marked.select("doc", "n", "cls")
    first = own.where("n > 0").groupBy("cls").agg(F.min("doc").alias("doc"))
    leading = marked.select(F.col("doc").alias("_doc"), F.col("cls").alias("_cls"), "n", "mark")
    classes = written(first.join(leading, (F.col("doc") == F.col("_doc")) & (F.col("cls") == F.col("_cls"))).dropDuplicates(["cls"]).select("cls", "doc", "n", "mark"), "shingle-classes")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(int(total) // (DEN * BUCKET_ROWS // (DEN - NUM)), 1).bit_length()
    posted = rows.select("text").mapInArrow(_poster(held, bits), "bucket long, tokens binary, classes binary, centre binary, place binary")
    lists = written(posted.groupBy("bucket").applyInArrow(_lists, LIST_SCHEMA).groupBy("list", "leader", "centre", "cls").agg(F.min("place").alias("place")), "shingle-lists")

    stars = lists.where("cls <> leader")
    pairs = stars.groupBy("cls").agg(F.max(F.struct("centre", "leader")).alias("m")).select(F.col("m.leader").alias("probe"), "cls")
    tested = pairs = written(_plausible(pairs, classes), "first-pairs")
    links = _verified(pairs, rows, classes, held)
    for whole in (False, True):
        left = _open(lists, components(links, "components"))
        if not left.take(1):
            break
        if whole:
            pairs = _across(left, classes)
        else:
            heads = left.where("cls = leader").select("list", F.col("root").alias("_root"))
            pairs = attach(left, "list", heads).where("root <> _root").select(F.col("leader").alias("probe"), "cls")
        ends = lambda df: df.select(F.least("probe", "cls").alias("probe"), F.greatest("probe", "cls").alias("cls"))
        fresh = written(_plausible(ends(pairs).distinct().join(ends(tested), ["probe", "cls"], "left_anti"), classes), "more-pairs")
        tested = tested.union(fresh)
        links = links.union(_verified(fresh, rows, classes, held))
    ends = components(links, "components")

    rooted = classes.join(ends, F.col("cls") == F.col("node"), "left").select("cls", "doc", F.coalesce("root", "cls").alias("root"))
    named = attach(rooted.select("cls", "root"), "root", rooted.groupBy("root").agg(F.min("doc").alias("component"))).select("cls", "component")
    out = attach(own.where("n > 0"), "cls", named).select("doc", "n", "component").union(own.where("n = 0").select("doc", "n", F.col("doc").alias("component")))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest id stays. Where
    rows share an id, they stay together if one of them stays."""
    gone = near_duplicates(docs, id_col, text_col).groupBy(id_col).agg(F.every(F.col(id_col) != F.col("component_id")).alias("_gone")).where("_gone")
    return without(docs, id_col, gone)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
