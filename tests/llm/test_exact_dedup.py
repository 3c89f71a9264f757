from collections import defaultdict

import duckdb
import pytest

from helmwatch.llm import exact_dedup as e


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    return sorted((i, best(groups[lowered(t)]), len(groups[lowered(t)]), i == best(groups[lowered(t)])) for i, t in rows)


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "Same start " * 9 + "a"), (5, "Same start " * 9 + "b"), (6, "SAME START " * 9 + "A"), (7, "\u00c9cole"), (8, "\u00e9cole"),
    (9, "x" * 300_000), (10, "X" * 300_000), (11, "x" * 299_999 + "y"), (-3, "lone"), (12, "ab"), (13, "AB"), (13, "AB"), (14, "other"), (14, "ab"),
]


@pytest.mark.parametrize(("keep", "best"), [("max", max), ("min", min)])
@pytest.mark.parametrize(("bits", "row_bits"), [(27, 15), (2, 15), (6, 3)])
def test_groups_match_brute_force(spark, monkeypatch, keep, best, bits, row_bits):
    """Small filters take lone texts for members of groups; the result is the same."""
    monkeypatch.setattr(e, "FILTER_BITS", bits)
    monkeypatch.setattr(e, "ROW_BITS", row_bits)
    docs = spark.createDataFrame([(i, t, 0, "k", True, 5, 1) for i, t in ROWS], "doc_id long, text string, _id int, keep_id string, kept boolean, group_size int, _alike int")
    got = sorted(tuple(r) for r in e.duplicate_groups(docs, keep=keep).collect())
    assert got == brute(ROWS, best)
    left = e.drop_duplicates(docs, keep=keep)
    assert left.columns == docs.columns
    stay = {i for i, k, _, kept in got if kept}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _ in ROWS if i in stay)


def test_filter_finds_all_it_holds(spark):
    steps = spark.range(4000).selectExpr("xxhash64(id) AS _step")
    found = e._hit(steps.selectExpr("_step", "true AS held").union(spark.range(4000, 8000).selectExpr("xxhash64(id)", "false")), e._filter(steps))
    hits = {(r["held"], r["_alike"]): r["count"] for r in found.groupBy("held", "_alike").count().collect()}
    assert hits.pop((True, True)) == 4000 and hits.pop((False, False)) > 3990 and set(hits) <= {(False, True)}


def test_query_matches_sql(spark):
    got = sorted(tuple(r) for r in e.op6_exact_dedup(spark, "/root/testdata/sf0.01").collect())
    duckdb.sql("create or replace view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    assert got == sorted(duckdb.sql(e.OP6_SQL).fetchall())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert e.duplicate_groups(none).count() == 0 and e.drop_duplicates(none).count() == 0
