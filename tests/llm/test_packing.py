import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helmwatch.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_every_id_lies_in_one_piece(docs, documents, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 20_000)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in documents}
    pieces = packing.pack(docs, RANKS).collect()
    at, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = want[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        at[p["doc_id"]].append((p["start"], p["length"]))
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    assert at.keys() == want.keys()
    for i, spans in at.items():
        assert tuple(np.cumsum([0, *(n for _, n in sorted(spans))])) == (*(s for s, _ in sorted(spans)), len(want[i]))
    sizes = []
    for spans in seqs.values():
        spans.sort()
        ends = np.cumsum([n for _, n in spans])
        assert [s for s, _ in spans] == [0, *ends[:-1]] and ends[-1] <= 1024
        sizes.append(int(ends[-1]))
    assert all(n & (n - 1) == 0 for n in sizes)


def test_special_token_strings_are_read_as_tokenizers_reads_them(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "a <|endoftext|> b  \n\n  c's 12 ²中"
    rows = packing.pack(spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string"), RANKS).collect()
    ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
    assert sum(r["length"] for r in rows) == len(ids)
    assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)


def test_windows_keep_to_the_shares():
    n, shares = [70_000, 20_000, 10_000], [0.7, 0.2, 0.1]
    windows = packing.fill_windows(n, shares, [0.0, 0.0, 0.0])
    assert all(sum(t for _, t in w) == 1024 for w in windows[:-1])
    got = [0, 0, 0]
    for k, w in enumerate(windows[:-1], 1):
        for s, t in w:
            got[s] += t
        assert all(abs(g - p * 1024 * k) <= 256 for g, p in zip(got, shares, strict=True))
    # A deficit carried over is made up for first.
    first = packing.fill_windows(n, shares, [-500.0, 0.0, 500.0])[0]
    assert dict(first)[2] >= 500


def test_empty_table(docs):
    assert packing.pack(docs.where("false"), RANKS).count() == 0


def test_windows_mix_sources_that_lie_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 20_000)
    rows = [(i, "some words of a text " * 20, "abc"[min(i // 300, 2)]) for i in range(1200)]
    # One source after the other, and every partition of one source.
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(4, "doc_id")
    pieces = packing.pack(table, RANKS).collect()
    source, seqs = {i: s for i, _, s in rows}, defaultdict(lambda: defaultdict(int))
    for p in pieces:
        seqs[p["sequence_id"]][source[p["doc_id"]]] += p["length"]
    full = [w for w in seqs.values() if sum(w.values()) == packing.WINDOW]
    assert len(full) > 80
    mixed = [w for w in full if len(w) == 3 and abs(w["a"] - 256) <= 128 and abs(w["c"] - 512) <= 192]
    assert len(mixed) >= 0.6 * len(full)


def test_repeats_of_an_id_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5_000)
    table = spark.createDataFrame([(7, "some words of a text " * 20, "a")] * 400, "doc_id long, text string, source string").coalesce(1)
    pieces = packing.pack(table, RANKS).collect()
    assert sum(p["length"] for p in pieces) == 400 * pieces[0]["doc_tokens"]
    assert len({p["sequence_id"] >> 22 for p in pieces}) > 3


def test_deficits_run_through_all_chains(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHAIN_BLOCKS", 2)
    n = {(b, s): 10 * b + k for b in range(7) for k, s in enumerate("xyz", 1) if (b + k) % 3}
    shares = {"x": 0.5, "y": 0.3, "z": 0.2}
    rows = packing.block_targets(spark.createDataFrame([(b, s, v) for (b, s), v in n.items()], "bid long, source string, n long"), spark.createDataFrame([*shares.items()], "source string, share double")).collect()
    assert {(r["block"], r["source"]) for r in rows} == n.keys()
    for r in rows:
        past = sum(v for (b, _), v in n.items() if b < r["block"])
        served = sum(v for (b, s), v in n.items() if b < r["block"] and s == r["source"])
        assert abs(r["deficit"] - (shares[r["source"]] * past - served)) < 1e-9
