import random

import numpy as np
import pytest

from lodestrand.llm import bpe, encode, pretokenize

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ODD = ["", " ", "\n", "  \n", "it's we'll I'd're 'S", "''s 't", "a  b\n\n c \t", "<|endoftext|>", "12½٣ x", "a\x1cb\x85c d​e", "漢字かな", "🙂👩🏽‍🔬", "é" * 70, "a" * 3_000, "ab" * 1_500, " " * 500, "x" + " " * 300 + "'ll"]


@pytest.fixture(scope="module")
def ranks():
    with open(encode.VOCABULARY, "rb") as f:
        return bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_for(seed, n=3_000):
    rng = random.Random(seed)
    alphabet = "aZ's'tredvlm  \n\t\r　\u0085\x1c9½٣!?—é漢🙂​'<|endoftext|>"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_encoder_against_library(ranks, reference):
    texts = texts_for(1)
    got = []
    for ids, sizes in bpe.Encoder(ranks).encode(texts):
        got += np.split(ids, np.cumsum(sizes)[:-1])
    assert [g.tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]


def test_small_chunks_and_full_cache(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    monkeypatch.setattr(bpe, "CACHE_SLICES", 20)
    texts = texts_for(2, 300)
    sizes = np.concatenate(list(bpe.Encoder(ranks).count(texts)))
    assert sizes.tolist() == [len(reference.encode_ordinary(t)) for t in texts]


def test_scan_does_not_depend_on_blocks(monkeypatch):
    texts = texts_for(3, 200)
    _, starts, ends, counts = pretokenize.slices(texts)
    monkeypatch.setattr(pretokenize, "_BLOCK", 3)
    assert all(np.array_equal(a, b) for a, b in zip((starts, ends, counts), pretokenize.slices(texts)[1:], strict=True))


def test_dataframe_round_trip(spark, reference):
    texts = [*texts_for(4, 200), None, "same", "same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    encoded = encode.encode(docs, offsets=True)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == reference.encode_ordinary(t or "")
        assert len(rows[i]["ends"]) == len(rows[i]["ids"]) and (not t or rows[i]["ends"][-1] == len(t.encode()))
    assert {r["doc_id"]: r["text"] for r in encode.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(docs).collect()} == {i: len(r["ids"]) for i, r in rows.items()}
    assert encode.encode(docs.filter("false")).collect() == []
