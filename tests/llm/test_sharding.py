import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helmwatch.llm import sharding as s
from helmwatch.llm.numbering import numbered

MASK = (1 << 32) - 1


def loop_permute(x, n, seed):
    """The network with Python's integers, one number at a time."""
    h, keys = s.half_bits(n), s.round_keys(seed)
    while True:
        left, right = x >> h, x & ((1 << h) - 1)
        for k in keys:
            m = (right + k) & MASK
            for _ in range(2):
                m = (m ^ m >> 16) * 73244475 & MASK
            left, right = right, left ^ ((m ^ m >> 16) & ((1 << h) - 1))
        x = left << h | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 1000, 4097])
def test_permutation_is_one_to_one_and_inverts(n):
    got = s.permute(np.arange(n), n, 7)
    assert sorted(got.tolist()) == list(range(n))
    assert got.tolist() == [loop_permute(i, n, 7) for i in range(n)]
    assert s.permute(got, n, 7, back=True).tolist() == list(range(n))


def test_large_ranges_and_bounds():
    n = (1 << 40) + 12_345
    some = np.array([0, 1, n - 1, n // 2])
    got = s.permute(some, n)
    assert got.max() < n and s.permute(got, n, back=True).tolist() == some.tolist()
    assert s.row_at(*s.locate(n - 1, n), n) == n - 1
    with pytest.raises(ValueError):
        s.permute(np.array([5]), 5)
    with pytest.raises(ValueError):
        s.half_bits(1 << 63)


def test_shuffles_and_depends_on_the_seed():
    n = 10_000
    got = s.permute(np.arange(n), n, 1)
    assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.05
    assert (got != s.permute(np.arange(n), n, 2)).mean() > 0.99
    # Neighbours do not stay together: of 40 shards, the next row lies in the same one about every 40th time.
    assert (got[1:] % 40 == got[:-1] % 40).mean() < 0.05


ROWS = [(1, "a"), (2, None), (3, ""), (3, ""), (3, ""), (4, "x" * 100_000), (5, "é世"), (None, "lost"), (None, None), (7, "a"), (7, "b")]
SCHEMA = "doc_id long, text string, shard string, slot boolean, row_number int, _id int, _size string"


def test_assignment_by_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "s", True, 3, 1, "z") for i, t in ROWS], SCHEMA)
    want = []
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())))
    for k, (i, t) in enumerate(order):
        p = loop_permute(k, len(ROWS), 3)
        data = (t or "").encode()
        want.append((i, len(data) + 16, zlib.crc32(data), k, p % 4, p // 4))
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    for parts in (1, 3, 7):
        got = [tuple(r) for r in s.assign_shards(docs.repartition(parts), shards=4, seed=3).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_shards_are_even_and_gapless(spark):
    got = s.assign_shards(spark.range(997).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "max", "min", "nunique"])
    assert len(sizes) == 40 and sizes["count"].max() - sizes["count"].min() == 1
    assert (sizes["max"] == sizes["count"] - 1).all() and (sizes["min"] == 0).all() and (sizes["nunique"] == sizes["count"]).all()
    for r in got.sample(20, random_state=1).itertuples():
        assert s.locate(r.row_number, 997) == (r.shard, r.slot) and s.row_at(r.shard, r.slot, 997) == r.row_number


def test_written_shards_hold_every_row_in_order(spark, docs, tmp_path):
    s.write_shards(docs, str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    want = {(r["shard"], r["slot"]): (r["doc_id"], r["text_crc32"]) for r in s.assign_shards(docs, shards=5).collect()}
    got = {(r["_shard"], r["_slot"]): (r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in back.collect()}
    assert got == want
    with pytest.raises(ValueError):
        s.write_shards(docs.withColumn("_slot", F.lit(1)), str(tmp_path / "no"))


def test_numbers_of_a_hot_key_are_dealt_over_ranges(spark):
    """A key of a third of all rows does not lie in one range."""
    rows = spark.range(3_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"))
    found, n = numbered(rows, "k")
    assert n == 3_000 and [r["row_number"] for r in found.orderBy("row_number").collect()] == list(range(3_000))
    ks = [r["k"] for r in found.orderBy("row_number").collect()]
    assert ks == sorted(ks)


def test_query_matches_sql(spark):
    got = sorted(tuple(r) for r in s.op11_sharding(spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert [r[:-1] for r in got] == sorted(r[:-1] for r in con.execute(s.OP11_SQL).fetchall())


def test_empty_table(spark):
    assert s.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
