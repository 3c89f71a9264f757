import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from helmwatch.llm import pii, quality
from tests.llm.test_jaccard import brute as near


def lowered(text):
    return (text or "").encode().lower()


def test_stages_against_brute_force(spark, documents):
    sf_dir = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(i, t, "en", None, 0) for i, t in documents if i > 10_000], source.schema)
    docs = source.union(extra)
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "packing"]

    network = quality.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "false")
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, network).collect()}
    kept = stages["quality classifier"](spark, docs, sf_dir).cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in score.items() if s >= 0.5}

    exact = stages["exact dedup"](spark, docs, sf_dir).cache()
    best = {}
    for i, t in texts.items():
        best[lowered(t)] = max(i, best.get(lowered(t), i))
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(best.values())

    apart = stages["n-gram Jaccard join"](spark, docs, sf_dir).cache()
    assert {r["doc_id"] for r in apart.collect()} == {i for i, (_, c) in near(list(texts.items())).items() if i == c}

    private = stages["PII"](spark, docs, sf_dir)
    for r in private.collect():
        if not pii.base_spans(texts[r["doc_id"]] or "") and "[SECRET]" not in (r["text"] or ""):
            assert r["text"] == texts[r["doc_id"]]
        else:
            assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stages["packing"](spark, apart, sf_dir).collect()
    assert sum(p["length"] for p in pieces) == sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in apart.collect())
    for frame in (kept, exact, apart, private):
        assert frame.columns == docs.columns


def test_run_and_empty_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    none = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0
