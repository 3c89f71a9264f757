import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helmwatch.llm import vector_codes as v


def brute_nearest(x, entries):
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 20), st.integers(1, 23), st.integers(0, 1000), st.sampled_from([2, 50, 1 << 25]))
def test_bounds_never_lose_the_nearest(n, k, d, seed, span):
    rng = np.random.default_rng(seed)
    x, e = rng.integers(-span, span, (n, d)), rng.integers(-span, span, (k, d))
    e[rng.integers(0, k)] = e[0]
    x[0] = e[-1]
    for got, want in zip(v.nearest(x, e), brute_nearest(x, e), strict=True):
        assert got.tolist() == want.tolist()


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (64, 32))
    x = centres[rng.integers(0, 64, 2000)] + rng.integers(-200, 200, (2000, 32))
    seen = {}
    got, _ = v.nearest(x, centres, seen)
    assert got.tolist() == brute_nearest(x, centres)[0].tolist()
    assert seen["exact"] < seen["pairs"] / 10


def loop(rows, parts, entries, rounds):
    kept = [(i, label, [math.floor(256 * c) for c in e]) for i, e, label in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    kept.sort(key=lambda r: (r[0], r[2], r[1] is not None, r[1] or 0))
    d = len(kept[0][2]) // parts
    cut = [(i, label, [tuple(e[p * d : p * d + d]) for p in range(parts)]) for i, label, e in kept]
    books = [[r[2][p] for r in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for r in cut:
                groups.setdefault(best(r[2][p], book)[1], []).append(r[2][p])
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)) if k in groups else entry for k, entry in enumerate(book)]
    out = [(i, label, [best(r_[p], books[p]) for p in range(parts)]) for i, label, r_ in cut]
    return books, [(i, label, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)) for i, label, found in out]


def table(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", 1, True) for i, e, label in rows], "vec_id long, embedding array<float>, label int, code string, error int, _label boolean").repartition(3)


@pytest.mark.parametrize("few", [True, False])
def test_matches_loops(spark, monkeypatch, few):
    monkeypatch.setattr(v, "BROADCAST_KEYS", 1 << 20 if few else 0)
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 0.3, 12)], [None, 0, 1, 7][i % 4]) for i in rng.permutation(80)]
    rows += [(0, rows[5][1], 3), (200, rows[6][1], None), (200, rows[6][1], None), (201, None, 1), (202, [1.0] * 11 + [None], 1), (203, [float("nan")] * 12, 1), (204, [float("-inf")] + [0.0] * 11, 2), (205, [], 1), (-5, [0.5] * 12, 1)]
    books, want = loop(rows, 4, 9, 2)
    vectors = table(spark, rows)
    trained = v.train_codebooks(vectors, 4, 9, 2)
    assert trained.tolist() == [[list(e) for e in b] for b in books]
    got = v.with_label_error(v.encode(vectors, trained)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted((i, c, e) for i, _, c, e in want)
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    assert {(r["label"], r["label_error"]) for r in got} == set(sums.items()) and len(got) == len(want)
    assert np.allclose(v.decode("00" * 4, trained), trained[:, 0].ravel() / 256)


def test_fewer_vectors_than_entries_and_other_lengths(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [3.0, 4.0], 1), (3, [5.0, 6.0, 7.0, 8.0], 1)]
    trained = v.train_codebooks(table(spark, rows), 2, 64, 2)
    assert trained.shape == (2, 2, 1)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in v.encode(table(spark, rows), trained).collect()) == [(1, "0000", 0), (2, "0101", 0)]
    with pytest.raises(ValueError):
        v.train_codebooks(table(spark, rows), 3)
    with pytest.raises(ValueError):
        v.train_codebooks(table(spark, rows), 2, 300)


def test_query_matches_sql(spark):
    got = sorted(tuple(r) for r in v.op13_vector_codes(spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    assert got == sorted(con.execute(v.OP13_SQL).fetchall())


def test_empty_table(spark, tmp_path):
    none = table(spark, [])
    assert v.train_codebooks(none) is None
    none.select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert v.op13_vector_codes(spark, str(tmp_path)).count() == 0
