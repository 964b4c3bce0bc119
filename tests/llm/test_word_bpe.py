"""Encoding and decoding by distinct words against the tokenizer library."""

import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from scorelens.llm.word_bpe import decode, encode, encode_and_decode  # noqa: E402
from scorelens.llm.word_bpe_query import VOCABULARY, digest  # noqa: E402

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def texts_to_try():
    rng = random.Random(11)
    letters = list(" \n\t'strevmld'  abZ019#.é中 　́😀' ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", None, "   ", "'", "''s", " 's", "it's 're'LL  x", "a" * 30000, " " * 3000, "ab" * 20000, "\n\n \n", "\u0000x"]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>  ", "<|endoftext", "x  <|endoftext|>\n", "|><|endoftext|>'s"]
    texts += ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x32400, 64)]
    return texts


def test_ids_and_texts_equal_the_library(spark, library):
    rows = list(enumerate(texts_to_try()))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in encode_and_decode(docs, VOCABULARY, block_bytes=50_000).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want, repr(t)
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)


def test_blocks_of_any_size_give_the_same(spark):
    docs = spark.createDataFrame(list(enumerate(texts_to_try()[:600])), SCHEMA).repartition(4)
    small = sorted(map(tuple, digest(docs, block_bytes=1).collect()))
    assert small == sorted(map(tuple, digest(docs).collect()))


def test_decode_of_any_ids(spark, library):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(50257) for _ in range(rng.randint(0, 30))]) for i in range(300)]
    rows += [(300, []), (301, None), (302, [50256, 50256]), (303, [7, 60000, 8])]
    got = dict(map(tuple, decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(3), VOCABULARY, block_bytes=500).collect()))
    assert len(got) == len(rows) and got[301] is None
    for i, ids in rows:
        if ids is not None:
            assert got[i] == library.decode(ids, skip_special_tokens=False)


def test_nulls_repeats_extra_columns_and_empty_tables(spark, library):
    text = "Ünïcode text's here"
    rows = [(1, text, "x", 5, "n"), (1, text, "x", 5, "n"), (None, None, None, None, None), (2, "", "ids", 0, "b"), (None, text, "", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, block int, words string")
    assert encode(docs, VOCABULARY).columns == ["doc_id", "ids"]
    want = library.encode(text, add_special_tokens=False).ids
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in encode_and_decode(docs, VOCABULARY).collect())
    assert got == [(0, [], ""), (0, want, text), (1, want, text), (1, want, text), (2, [], "")]
    assert digest(docs.limit(0)).collect() == []
    assert encode(docs.limit(0), VOCABULARY).collect() == []
    named = docs.withColumnRenamed("doc_id", "key id")
    assert sorted(len(r.ids) for r in encode(named, VOCABULARY, key="key id").collect()) == [0, 0] + [len(want)] * 3


def test_digest_columns(spark, library):
    text = "One row's text, 12 34"
    (row,) = digest(spark.createDataFrame([(7, text)], SCHEMA)).collect()
    ids = library.encode(text, add_special_tokens=False).ids
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
