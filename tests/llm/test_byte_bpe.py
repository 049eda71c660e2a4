import base64
import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import byte_bpe
from weft.llm.queries import op8_byte_bpe, split_pattern, tokenizer_file


@pytest.fixture(scope="module")
def ranks():
    with open(tokenizer_file(), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("t", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def small(ranks):
    return byte_bpe.TreeCodec(ranks, split_pattern(), leaf=8, window=2)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcS'tre vl 12.!?éß\n\t　\x1c\x85 漢字😀")), max_size=120))
def test_tree_equals_whole(small, library, text):
    ids = small.encode(text)
    assert ids == library.encode_ordinary(text)
    assert small.decode(ids) == text.encode()


def test_long_words_and_runs(small, library):
    for text in ("a" * 3000, " " * 2000 + "x", "ab'" * 700, "word " * 2000, "\n\n  \n" * 300):
        assert small.encode(text) == library.encode_ordinary(text)


def test_query_against_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(byte_bpe.ids_bytes(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_empty_repeats(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "x y", 5), (2, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = byte_bpe.digests(docs, tokenizer_file(), split_pattern()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 0), (2, 0), (2, 0)]
    assert byte_bpe.digests(docs.limit(0), tokenizer_file(), split_pattern()).count() == 0


def test_most_documents_go_up_the_tree(spark, ranks, monkeypatch):
    """At the production leaf size most documents take joins, and every join re-encodes a short window only."""
    tree, joins, windows = byte_bpe.TreeCodec(ranks, split_pattern()), [], []
    whole = tree._join
    monkeypatch.setattr(tree, "_join", lambda text, lo, mid, hi, a, b: (joins.append(text), windows.append(tree._stable_after(text, mid, hi) - tree._stable_before(text, lo, mid)), whole(text, lo, mid, hi, a, b))[2])
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in texts:
        tree.encode(t)
    assert len(set(joins)) > 0.8 * len(set(texts)) and sorted(windows)[len(windows) // 2] <= 2 * byte_bpe.WINDOW


def test_very_long_texts(spark, library):
    rows = [(1, "word, and more. " * 60_000), (2, "x" * 40_000), (3, "\n" * 40_000)]
    got = {r.doc_id: r for r in byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file(), split_pattern()).collect()}
    for k, text in rows:
        assert got[k].ids == library.encode_ordinary(text) and bytes(got[k].decoded) == text.encode()
