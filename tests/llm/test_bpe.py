"""Encoding and decoding against the tokenizer library."""

import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from scorelens.llm.bpe import decode, encode, load_ranks  # noqa: E402
from scorelens.llm.bpe_query import VOCABULARY, digest  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})


def test_ids_and_offsets_equal_the_library(spark, library):
    rng = random.Random(3)
    letters = list(" \n\t'strevmld'  abZ019#.é中 　́😀' ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", None, "   ", "'", "''s", " 's", "it's 're'LL  x", "a" * 30000, " " * 3000, "\n\n \n", "\u0000x", "<|endoftext|>"]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x11000, 37) if not 0xD800 <= c < 0xE000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), VOCABULARY).collect()}
    assert len(got) == len(rows)
    token = {rank: raw for raw, rank in load_ranks(VOCABULARY).items()}
    for i, t in rows:
        assert got[i].ids == library.encode_ordinary(t or ""), repr(t)
        raw = (t or "").encode()
        assert all(raw[a : a + len(token[k])] == token[k] for k, a in zip(got[i].ids, got[i].starts))


def test_round_trip_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "Ünïcode text's here", "x", 5), (1, "Ünïcode text's here", "x", 5), (None, None, None, None), (2, "", "ids", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, key int")
    coded = encode(docs, VOCABULARY)
    assert coded.columns == ["doc_id", "ids", "starts"]
    back = decode(coded, VOCABULARY, keep=["doc_id"]).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in back) == [(0, ""), (1, rows[0][1]), (1, rows[0][1]), (2, "")]
    assert digest(docs.limit(0)).collect() == []


def test_digest_columns(spark, library):
    import hashlib

    text = "One row's text, 12 34"
    (row,) = digest(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    ids = library.encode_ordinary(text)
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
