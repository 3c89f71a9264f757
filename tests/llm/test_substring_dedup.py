import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helmwatch.llm import substring_dedup as s


def brute(rows, length=50):
    """(n_bytes, n_removed, n_spans, kept) by a dictionary of all windows."""
    texts = {i: (t or "").encode() for i, t in rows}
    least = {}
    for i, b in texts.items():
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            least[w] = min(i, least.get(w, i))
    out = {}
    for i, b in texts.items():
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[i] = (len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def run(spark, rows):
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bid int")
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in s.remove_repeats(table).collect()}


def hard():
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcd "), 3000))
    rows = [(i, base[a : a + n]) for i, (a, n) in enumerate(zip(rng.integers(0, 2900, 60).tolist(), rng.integers(1, 400, 60).tolist(), strict=True))]
    rows += [(100, "ab" * 200), (101, "x" + "ba" * 90), (102, "a" * 500), (103, "a" * 49), (104, "a" * 50), (105, base), (106, base), (107, "é" * 200), (90, "é" * 30)]
    # One passage with different surroundings, and strips that share only a part.
    rows += [(200 + i, "".join(rng.choice(list("wxyz"), 40)) + base[1000:1120] + "".join(rng.choice(list("wxyz"), 40))) for i in range(150)]
    return rows


def test_hard_cases(spark):
    assert run(spark, hard()) == brute(hard())


def test_documents(spark, documents, monkeypatch, in_workers):
    """In many blocks and chunks, with the sizes set in the workers too."""
    in_workers(s)
    monkeypatch.setattr(s, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(s, "CHUNK", 5_000)
    cut = []
    bucketed = s.bucketed
    monkeypatch.setattr(s, "bucketed", lambda *a: cut.append(bucketed(*a)) or cut[-1])
    assert run(spark, documents) == brute(documents)
    assert cut[0].count() > 8


def test_rows_of_one_id_leave_each_other_alone(spark):
    text = "".join(np.random.default_rng(1).choice(list("abcd"), 120))
    rows = [(5, text), (5, text), (5, "x" + text), (6, text[10:90])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in s.remove_repeats(table).collect())
    assert got == [(5, 120, 0, 0), (5, 120, 0, 0), (5, 121, 0, 0), (6, 80, 80, 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=14), min_size=2, max_size=12))
def test_classes_share_the_prefix(strings):
    joined = [(i, k, t[k : k + 4]) for i, t in enumerate(strings) for k in range(len(t) + 1)]
    last = np.concatenate([np.append(np.zeros(len(t), bool), True) for t in strings])
    text = np.frombuffer("".join(t + "\0" for t in strings).encode(), np.uint8)
    order, classes = s.prefix_classes(text, last, 4)
    of = {}
    for at, c in zip(order.tolist(), classes.tolist(), strict=True):
        if len(joined[at][2]) == 4:
            of.setdefault(joined[at][2], set()).add(c)
    assert all(len(c) == 1 for c in of.values())
    assert len({c for v in of.values() for c in v}) == len(of)


def test_empty_table(spark):
    assert run(spark, [(1, None)]) == {1: (0, 0, 0, b"")}
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
