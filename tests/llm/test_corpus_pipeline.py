"""The pipeline's stages against plain expectations on planted documents."""

import random

from corpus_pipeline import ORACLE_SQL, STAGES, ngram_jaccard_join, run
from scorelens.llm.bpe import load_ranks
from scorelens.llm.bpe_query import VOCABULARY


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinsrh") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def corpus(rng):
    items = [(i, prose(rng, 15) + " " + prose(rng, 10)) for i in range(8)]
    rows = [(i, prose(rng, rng.randint(60, 200)), "en", "src0", 0) for i in range(150)]
    rows += [(200 + i, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "src1", 0) for i in range(20)]
    rows += [(300 + i, rows[i][1] if i % 2 else rows[i][1] + " one more", "en", "src0", 0) for i in range(20)]
    rows += [(400 + i, prose(rng, 60) + " " + items[i][1] + " " + prose(rng, 60), "en", "src2", 0) for i in range(8)]
    rows += [(500, prose(rng, 50) + " call +1 (017) 555-7713 or a.b@mail.example.com now " + prose(rng, 20), "en", "src3", 0), (501, None, None, None, None)]
    rows += [rows[0], (None, prose(rng, 70), None, None, None)]
    return rows, items


def test_each_decision_takes_effect(spark, tmp_path):
    rows, items = corpus(random.Random(3))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs.write.parquet(f"{tmp_path}/stage{k}")
            docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        ids.append(sorted((r.doc_id if r.doc_id is not None else -1) for r in docs.select("doc_id").collect()))
    clean = list(range(150))
    assert ids[0] == sorted([-1, 0] + clean + list(range(300, 320)) + list(range(400, 408)) + [500])
    assert ids[1] == sorted([-1] + clean + list(range(400, 408)) + [500])
    assert ids[2] == ids[3] == ids[4] == sorted([-1] + clean + [500])
    masked = spark.read.parquet(f"{tmp_path}/stage3").filter("doc_id = 500").first()
    assert "[PHONE]" in masked.text and "[EMAIL]" in masked.text and "555" not in masked.text and masked.n_chars == len(masked.text)
    token = {rank: raw for raw, rank in load_ranks(VOCABULARY).items()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/stage3").collect()}
    for r in docs.collect():
        assert b"".join(token[i] for i in r.ids).decode() == text[r.doc_id] and r.n_tokens == len(r.ids)
    assert ORACLE_SQL is None
    whole = run(spark, str(tmp_path))
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in whole.collect()) == sorted((r.doc_id or -1, r.decoded_sha256) for r in docs.collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert run(spark, str(tmp_path)).collect() == []


def test_one_id_with_different_texts(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 70) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "w"), (2, b + " more", "x"), (3, c, "x"), (0, c, "x"), (0, a, "x"), (0, a, "x"),
            (None, a, "x"), (None, a, "x"), (4, "", "x"), (4, None, "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = {(0, a, "x"), (0, c, "x"), (1, b, "w"), (4, "", "x"), (4, None, "x"), (5, "", "x")}
    for _ in range(2):
        got = [tuple(r) for r in ngram_jaccard_join(spark, docs, "").collect()]
        assert sorted(got, key=str) == sorted([*want, (None, a, "x"), (None, a, "x")], key=str)
        docs = docs.repartition(2)
