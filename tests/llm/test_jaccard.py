from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helmwatch.llm import jaccard
from helmwatch.llm.common import pack_sorted, unpack_sorted


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows):
    """All pairs that share a shingle, tested one by one."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for a, b in {(a, b) for g in by.values() for a in g for b in g if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def run(spark, rows):
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cls string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table).collect()}


def test_documents_match_brute_force(spark, documents):
    assert run(spark, documents) == brute(documents)


def test_larger_table_matches_brute_force(spark, monkeypatch, in_workers, small_batches):
    in_workers(jaccard)
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 4000)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 50_000)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_chains_of_edits(spark):
    """Copies that link only through others, and groups above the size of one prefix tree."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 3)), replace=False):
            words[at] = f"x{rng.integers(1 << 40)}"
        rows.append((1000 + i, " ".join(words)))
    step = list(base[::-1])
    for i in range(25):
        step[2 * i] = f"y{i}"
        rows.append((i, " ".join(step)))
    want = brute(rows)
    assert run(spark, rows) == want


def test_many_different_texts_in_one_list(spark, monkeypatch):
    """Texts that share most of one original, too far from each other to link: the last round tests few of their pairs."""
    asked = []
    across = jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda *a: asked.append(across(*a)) or asked[-1])
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(124)]
    rows = [(1, " ".join(base))]
    for i in range(500):
        words = list(base)
        for at in rng.choice(12, int(rng.integers(2, 7)), replace=False):
            words[10 * at + 2] = f"x{rng.integers(1 << 40)}" if rng.random() < 0.9 else "x"
        rows.append((10 + i, " ".join(words[int(rng.integers(0, 3)) :])))
    assert run(spark, rows) == brute(rows)
    assert asked and asked[0].distinct().count() < 5000


def test_repeated_ids_and_clashing_columns(spark):
    text, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(1, text), (1, text), (2, text + " more"), (3, other), (3, text), (4, other)]
    docs = spark.createDataFrame([(i, t, 0, 0, 0, 0, 0) for i, t in rows], "doc_id long, text string, _gone int, id int, component_id int, n_shingles int, cls int")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 3), (4, 3)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3, 3]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=1, max_size=12), st.sets(st.integers(0, 25), min_size=1))
def test_prefix_tree_equals_all_pairs(sets, probe):
    arrays = [np.array(sorted(s)) for s in sets]
    got = jaccard.PrefixTree(arrays).partners(np.array(sorted(probe)), 26)
    assert sorted(got) == [i for i, s in enumerate(sets) if 4 * len(s & probe) >= 3 * len(s | probe)]


def test_marks_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 7, 400, 3000, 3000])
    tokens = rng.integers(0, 1 << 64, int(sizes.sum()), dtype=np.uint64)
    tokens[-3000:-100] = tokens[-6000:-3100]
    marks = [np.array(m, np.int64).view(np.uint64) for m in jaccard._marks(tokens, sizes).to_pylist()]
    sets = [set(x.tolist()) for x in np.split(tokens, np.cumsum(sizes)[:-1])]
    for a, x in zip(marks, sets, strict=True):
        for b, y in zip(marks, sets, strict=True):
            assert int(np.bitwise_count(a ^ b).sum()) <= len(x ^ y)
    assert int(np.bitwise_count(marks[4] ^ marks[5]).sum()) > 150 and not marks[0].any()


def test_empty_table(spark):
    assert run(spark, [(1, None)]) == {1: (0, 1)}
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_sorted_keys_round_trip(n):
    keys = np.sort(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(keys)) == keys).all()
