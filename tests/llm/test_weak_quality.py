"""Weak labels, the scorer, and held-out accuracy."""

import random

import numpy as np

from scorelens.llm.weak_quality import BAD, GOOD, N_FEATURES, estimate_labels, fit_quality, keep_good, score_quality, word_features


def test_expectation_maximisation_finds_the_labellers_accuracies():
    random_ = np.random.RandomState(3)
    n, accuracy = 40000, np.array([0.95, 0.8, 0.7, 0.6])
    truth = random_.random_sample(n) < 0.7
    right = random_.random_sample((n, 4)) < accuracy
    votes = np.where(right == truth[:, None], GOOD, BAD)
    votes[random_.random_sample((n, 4)) < 0.3] = 0
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, found = estimate_labels(patterns, counts.astype(float))
    estimate = found[1, :, GOOD] / (found[1, :, GOOD] + found[1, :, BAD])
    assert np.abs(estimate - accuracy).max() < 0.06
    assert ((good[inverse.ravel()] > 0.5) == truth).mean() > 0.88


def test_features_are_those_of_each_text_alone():
    texts = [b"a b c a b c", b"", b"the&&& THE", "é".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    rows, buckets, size = word_features(data, offsets)
    assert size.tolist() == [6, 0, 2, 1]
    for i, t in enumerate(texts):
        alone = word_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert sorted(buckets[rows == i]) == sorted(alone[1])
    assert buckets.max() < N_FEATURES


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinsrh") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def test_clean_texts_stay_and_junk_goes(spark):
    rng = random.Random(8)
    clean = [(i, prose(rng, rng.randint(20, 300)), "a") for i in range(400)]
    junk = []
    for i in range(80):
        text = prose(rng, 80)
        kind = i % 4
        junk.append((1000 + i, " ".join(w + "$$$" for w in text.split()) if kind == 0 else " | ".join(text.split()) if kind == 1
                     else " ".join(w.upper() + "!!" for w in text.split()) if kind == 2 else ("spam words here " * 60), "a"))
    odd = [(2000, None, None), (2001, "", None), (2002, " \n", None), (None, prose(rng, 100), None)]
    docs = spark.createDataFrame(clean + junk + odd + clean[:5], "doc_id long, text string, _quality_score string").repartition(5)
    model = fit_quality(docs)
    scored = score_quality(docs, model, "score")
    assert scored.columns == ["doc_id", "text", "_quality_score", "score"]
    kept = [r.doc_id for r in scored.filter("score >= 0.2").collect()]
    assert len(kept) == 406 and all(i is None or i < 1000 for i in kept)
    assert keep_good(docs.drop("_quality_score")).columns == ["doc_id", "text"]
    assert keep_good(docs.limit(0)).collect() == []
