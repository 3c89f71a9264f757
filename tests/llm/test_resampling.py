import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from helmwatch.llm import resampling as r

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, run):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, run, share, min_words, seed, buckets):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(of, features(text, run)[1]))
    for text in target:
        t.update(map(of, features(text, run)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, text in rows:
        n, found = features(text, run)
        weight = sum(gain[of(f)] for f in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, n])
    able = sorted((x for x in out if x[0] is not None and x[5] >= min_words), key=lambda x: (-x[3], x[0], x[2], x[1]))
    for k, x in enumerate(able[: len(able) * share[0] // share[1]]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


ODD = [(-1, "one"), (None, "no id " * 30), (20_001, "Same Words " * 15), (20_002, "same words " * 15), (20_003, "Same Words " * 15), (20_004, "Same Words " * 15), (20_004, "Same Words " * 15), (20_005, "世界 café naïve a1b2 " * 10), (20_006, "x" * 5000), (20_007, "---!!!\x7f\x00")]


@pytest.mark.parametrize(("run", "buckets", "min_words", "share"), [(1, 10_000, 20, (10, 100)), (2, 50, 1, (1, 2)), (3, 997, 0, (1, 1))])
def test_matches_brute_force(spark, documents, run, buckets, min_words, share):
    rows = [*documents, *ODD]
    target = [t["text"] for t in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [None, ""]
    # Extra columns with the names that the operator works with.
    docs = spark.createDataFrame([(i, t, 1, "d", True, 9, 2) for i, t in rows], "doc_id long, text string, weight int, digest string, copies boolean, score int, _id int").repartition(3)
    aims = spark.createDataFrame([(t, "x") for t in target], "text string, digest string")
    got = r.resample(docs, aims, share, min_words, 5, buckets, run)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, target, run, share, min_words, 5, buckets)


@pytest.mark.parametrize("run", [1, 2, 4])
def test_long_texts_in_parts(run):
    text = "Ab1 été, x-y  zz " * 300
    n, found = features(text, run)
    want = Counter(zlib.crc32(f.encode()) % 997 for f in found)
    for split in (1, 7, 50, 1 << 20):
        words, which, counts = r.bucket_counts(text.encode(), 997, run, split)
        assert words == n and dict(zip(which.tolist(), counts.tolist(), strict=True)) == want
    assert r.bucket_counts(b"", 10)[0] == 0 and len(r.bucket_counts(b" , ", 10)[1]) == 0


def test_identical_texts_are_read_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the same text again") for i in range(500)] + [(900, "another one")], "doc_id long, text string")
    counted = r._counted(docs.select("text"), 100, 1, "copies").where("digest IS NOT NULL")
    assert counted.count() == 2
    assert r._totals(r._counted(docs.select("text"), 100, 1, "copies"), 100).sum() == 500 * 4 + 2


def test_draw_favours_the_target(spark):
    rows = [(i, ("alpha beta gamma delta " if i % 5 == 0 else "one two three four ") * 8 + f"w{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aims = spark.createDataFrame([("alpha beta gamma delta",)] * 50, "text string")
    drawn = [x["doc_id"] for x in r.resample(docs, aims).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 40 and sum(i % 5 == 0 for i in drawn) >= 36


def test_query_matches_sql(spark):
    got = sorted((tuple(x) for x in r.op12_resampling(spark, "/root/testdata/sf0.001").collect()), key=str)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    assert got == sorted(con.execute(r.OP12_SQL).fetchall(), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert r.resample(none, some).count() == 0 and r.resample(none, none).count() == 0
    assert r.resample(some, none).count() == 1
