import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from helmwatch.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HARD = ["", None, "  \n\n x  ", "l'été 12²½ don't  'S", "中文字符 дом x y\u001cz", "<|endoftext|>", "a" * 500, "\U0001f600́ é", "x" + " " * 300 + "y", "ﬁ١٢٣\u0085"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x180, exclude_categories=["Cs"]), st.characters(exclude_categories=["Cs"]))))
def test_fast_split_equals_the_pattern(text):
    assert bpe.split(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_ids_and_bytes_equal_the_library(spark, docs, documents, library):
    rows = [*documents, *((20_000 + i, t) for i, t in enumerate(HARD))]
    got = bpe.encode(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int"), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text), text[:60]
        assert bytes(r["decoded"]) == text.encode()


def test_higher_order_fold_equals_the_library(spark, documents, library):
    words = sorted({w for _, t in documents[::10] for w in bpe.split(t or "") if len(w.encode()) <= bpe.LONG_WORD})[::7]
    table = spark.createDataFrame([(w.encode(),) for w in words] + [(None,)], "word binary")
    for r in bpe.encode_words(table, PATH).collect():
        if r["word"] is None:
            assert r["coded"] is None
        else:
            assert r["coded"]["ids"] == library._encode_single_piece(bytes(r["word"])) and r["coded"]["decoded"] == r["word"]


def test_digest(library):
    ids = np.array(library.encode_ordinary("Hello there"), "<u4")
    assert bpe._digest(5, ids.tobytes(), b"Hello there") == (5, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(b"Hello there").hexdigest())


def test_empty_table(docs):
    assert bpe.encode(docs.where("false"), PATH).count() == 0
