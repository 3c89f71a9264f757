import zlib

import numpy as np
import pytest

from helmwatch.llm import quality


@pytest.fixture(scope="module")
def network(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return quality.fit_on_labels(docs, labels, quality.HELD_OUT)


def naive(net, text):
    """The network's probability, window by window."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return 1 / (1 + np.exp(-net.offset))
    padded = np.concatenate([raw, np.zeros(quality.WIDTH, np.uint8)])
    response = np.array([sum(net.kernel[j, padded[i + j]] for j in range(quality.WIDTH)) for i in range(len(raw))])
    blocks = [response[i : i + quality.BLOCK].max(0) for i in range(0, len(raw), quality.BLOCK)]
    chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:])] or blocks  # noqa: B905
    active = np.maximum(np.array(chunks) + net.bias, 0)
    return 1 / (1 + np.exp(-(np.concatenate([active.mean(0), active.max(0), active.min(0)]) @ net.head + net.offset)))


def test_scores_equal_the_definition(spark, docs, documents, network):
    rows = documents[:40] + documents[-7:]
    table = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["score"] for r in quality.score(table, network).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert abs(got[i] - naive(network, t or "")) < 1e-4


def test_held_out_accuracy(spark, network):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [(truth[r["doc_id"]], r["score"]) for r in quality.score(docs, network).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] in truth]
    right = [(s >= 0.5) == q for q, s in got]
    assert np.mean(right) > 0.93 and np.mean([x for x, (q, _) in zip(right, got, strict=True) if q]) > 0.99


def test_nothing_to_learn_from(spark, docs):
    none = spark.createDataFrame([(None, None), (3, None)], "doc_id long, quality int")
    net = quality.fit_on_labels(docs, none, quality.HELD_OUT)
    assert {r["score"] for r in quality.score(docs, net).collect()} == {0.5}
    assert quality.score(docs.where("false"), net).count() == 0


def test_winners_of_spans_equal_those_of_all_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    kernel = rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32)
    blocks = rng.integers(0, 256, (23, quality.BLOCK + quality.WIDTH - 1), dtype=np.uint8)
    monkeypatch.setattr(quality, "SPAN_BYTES", 5 * quality.BLOCK)
    best, where = quality._winners(kernel, blocks)
    for b in (0, 4, 5, 22):
        dense = np.array([sum(kernel[j, blocks[b, i + j]] for j in range(quality.WIDTH)) for i in range(quality.BLOCK)])
        assert np.allclose(best[b], dense.max(0), atol=1e-5) and (where[b] == dense.argmax(0)).all()


def test_training_reads_whole_texts(spark):
    """What tells the labels apart lies behind 20,000 characters, between the parts that a sample of places would take."""
    filler = "plain words in a row " * 1000
    rows = [(i, filler + ("@@##@@##" if i % 2 else "") + filler) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    net = quality.fit_on_labels(docs, labels, quality.HELD_OUT)
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in quality.score(docs, net).collect())


def test_repeated_rows_train_once(spark, docs):
    """A labelled id with many rows trains by its smallest text; repeated rows are all scored, and alike."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    once = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i}") for i in range(20)], "doc_id long, text string")
    again = once.union(once).union(once.selectExpr("doc_id", "concat('z', text)"))
    a, b = quality.fit_on_labels(once, labels, "false"), quality.fit_on_labels(again, labels.union(labels), "false")
    assert np.array_equal(a.kernel, b.kernel) and a.offset == b.offset
    got = quality.score(once.union(once), a).groupBy("doc_id").agg({"score": "count", "*": "count"}).collect()
    assert len(got) == 20 and {r["count(score)"] for r in got} == {2}
