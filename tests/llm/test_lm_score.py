import math
import zlib
from collections import Counter

from helmwatch.llm import lm_score

SPLIT = bytes(range(0x09, 0x0E)) + b" "


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def counted(texts):
    uni = Counter(w for d in texts for w in d)
    bi = Counter((a, b) for d in texts for a, b in zip([None, *d], d))
    tri = Counter(t for d in texts for t in zip([None, *d], d, d[1:]))
    return uni, bi, tri


def log_probability(text, uni, bi, tri, n, v, a, b):
    score, before = 0.0, (None,)
    for w in text:
        p = ((uni[w] - 0.75) / n if uni[w] else 0.75 * v / n) if n else 1.0
        p = (bi[before[-1], w] + a * p) / (uni[before[-1]] + a)
        if len(before) == 2:
            p = (tri[*before, w] + b * p) / (bi[before] + b)
        score += math.log10(p)
        before = (before[-1], w)
    return score


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows, priors=(lm_score.WORD_PRIORS, lm_score.PAIR_PRIORS)):
    """The same model, with dictionaries and a loop over each text; the priors by leaving out one training text at a time."""
    train = [tokens(t) for i, t in rows if not held(i)]
    uni, bi, tri = counted(train)
    n, v = sum(uni.values()), len(uni)
    sums = Counter()
    for d in train:
        less = [whole.copy() for whole in (uni, bi, tri)]
        for whole, own in zip(less, counted([d]), strict=True):
            whole.subtract(own)
        for a in priors[0]:
            for b in priors[1]:
                sums[a, b] += log_probability(d, *less, n - len(d), v, a, b)
    best = max(sums, key=sums.get)
    out = {}
    for i, t in rows:
        d = tokens(t)
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in d)
        out[i] = (held(i), len(d), sum(uni[w] > 0 for w in d), n, base, log_probability(d, uni, bi, tri, n, v, *best))
    return out, best


def same(got, want, best):
    assert len(got) == len(want)
    for r in got:
        x = want[r["doc_id"]]
        assert tuple(r)[1:5] == x[:4] and (r["word_prior"], r["pair_prior"]) == best
        assert math.isclose(r["base_score"], x[4], rel_tol=1e-9) and math.isclose(r["score"], x[5], rel_tol=1e-9, abs_tol=1e-9)


def test_scores_match_brute_force(docs, documents, monkeypatch, in_workers, small_batches):
    """In many blocks and slices, with the sizes set in the workers too."""
    in_workers(lm_score)
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(lm_score, "SLICE_TOKENS", 300)
    cut = []
    bucketed = lm_score.bucketed
    monkeypatch.setattr(lm_score, "bucketed", lambda *a: cut.append(bucketed(*a)) or cut[-1])
    some = [r for r in documents if r[0] % 3 == 0 or r[0] > 10_000]
    got = lm_score.score_texts(docs.where("doc_id % 3 = 0 or doc_id > 10000"), "crc32(cast(doc_id AS string)) % 10 = 0").collect()
    assert cut[0].count() > 8
    same(got, *brute(some))


def test_held_out_texts_do_not_choose_the_priors(spark):
    """Repeated pairs make a small prior likely, but only in texts that are held out."""
    rows = [(i, f"w{i} x{i * i} y{i**3}") for i in range(40)] + [(100 + i, "a b c d e f") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    low, high = (lm_score.score_texts(table, c).select("word_prior", "pair_prior").distinct().collect() for c in ("false", "doc_id >= 100"))
    assert len(low) == len(high) == 1 and low[0] < high[0]


def test_held_out_texts_score_better_than_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm_score.score_texts(docs, "crc32(cast(doc_id AS string)) % 10 = 0").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.6 * sum(r["base_score"] for r in rows)


def test_repeated_rows_count_as_often_as_they_occur(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b d"), (20, "a b c")]
    got = lm_score.score_texts(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, bid int"), "doc_id = 20").collect()
    of = sorted((r["doc_id"], r["score"]) for r in got)
    assert [i for i, _ in of] == [1, 1, 2, 20] and of[0] == of[1] and of[0][1] == of[3][1] > of[2][1]
    assert {r["train_tokens"] for r in got} == {12}


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string, train string")
    assert lm_score.score_texts(none, "false").count() == 0
    only = spark.createDataFrame([(1, "a b", "x"), (2, None, None)], "doc_id long, text string, train string")
    assert [r["score"] for r in lm_score.score_texts(only, "true").collect()] == [0.0, 0.0]
