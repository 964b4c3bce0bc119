"""Jaccard join against brute force over all pairs."""

import random
import re

import pytest

from scorelens.llm.ngram_join import meeting_keys, similar_components


def brute(rows, n=4, num=85, den=100):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def corpus(seed, sizes, copies, edits):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(30)]
    texts = []
    for size in sizes:
        base = [rng.choice(vocab) for _ in range(size)]
        if rng.random() < 0.4:
            base = passage + base
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(words))
                what = rng.random()
                if what < 0.5:
                    words[k] = rng.choice(vocab)
                elif what < 0.75:
                    del words[k]
                    words = words or ["x"]
                else:
                    words.insert(k, rng.choice(vocab))
            texts.append(" ".join(words) if rng.random() < 0.8 else "\n".join(words).upper())
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,sizes,copies,edits", [
    (1, [1, 2, 3, 4, 5, 8, 12, 20, 30, 38, 40, 45, 60, 90, 150, 400], 8, 3),
    (2, [41, 42, 53, 74, 75, 104, 105, 300], 12, 4),
    (3, [120], 120, 5),
])
def test_components_equal_brute_force(spark, seed, sizes, copies, edits):
    texts = corpus(seed, sizes, copies, edits)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [(100000, None), (100001, ""), (100002, " \n\t"), (100003, "one two"), (100004, "ONE  two"), (2, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in similar_components(docs).collect())
    assert got == brute(rows)


def test_repeats_nulls_clashing_columns_and_no_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", None), (None, None, None), (5, "q r s t u v", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(docs).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, 1), (None, 0, None), (5, 3, 5)], key=str)
    assert similar_components(docs.limit(0)).collect() == []


def test_unrelated_documents_with_one_long_passage_are_not_paired(spark, monkeypatch):
    from scorelens.llm import ngram_join

    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(120))
    texts = [f"{passage} " + " ".join(f"d{i}x{rng.randrange(10**6)}" for _ in range(90)) for i in range(3000)]
    linked = [(i, texts[i].rsplit(" ", 3)[0]) for i in range(0, 3000, 50)]
    rows = list(enumerate(texts)) + [(10_000 + i, t) for i, t in linked]
    met = []
    postings = ngram_join.rarest_postings
    monkeypatch.setattr(ngram_join, "rarest_postings", lambda *a: met.append(postings(*a)) or met[-1])
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {**{i: i for i in range(3000)}, **{10_000 + i: i for i, _ in linked}}


def test_copies_just_below_the_threshold_are_not_compared_pairwise(spark, monkeypatch):
    from scorelens.llm import ngram_join

    rng = random.Random(4)
    original = [f"w{k}" for k in range(800)]
    texts = [original]
    for i in range(200):
        words = list(original)
        for k in rng.sample(range(4, 795, 5), 17):  # 729 of 865 shingles stay
            words[k] = f"e{i}x{k}"
        texts.append(words)
    texts += [[*words[:-1], "end"] for words in texts[1:21]]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    compared, similar_pairs = [], ngram_join.similar_pairs
    monkeypatch.setattr(ngram_join, "similar_pairs", lambda pairs, *a: compared.append(pairs.count()) or similar_pairs(pairs, *a))
    got = sorted(tuple(r) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == brute(rows)
    assert sum(compared) < 10 * len(rows)


@pytest.mark.parametrize("seed,n,num", [(1, 4, 85), (2, 5, 80)])
def test_links_between_copies_that_are_far_from_the_original(spark, seed, n, num):
    rng = random.Random(seed)
    original = [f"w{k}" for k in range(150)]
    edits = [(k, rng.choice(["", f"e{k}", f"e{k} f{k}"])) for k in range(4, 145, 10)]
    texts = [" ".join(original)]
    for _ in range(150):
        words = list(original)
        for k, word in rng.sample(edits, rng.randint(2, 8)):
            words[k] = word
        words = words[: rng.choice([150, 150, 140, 125])]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = [(i + 1, t) for i, t in enumerate(texts[1:])]
    # a text that only a row without an id has links nothing
    docs = spark.createDataFrame([*rows, (None, texts[0])], "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in similar_components(docs, n=n, similarity=num / 100).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute(rows, n, num)
    assert [r for r in got if r[0] is None] == [(None, 150 - n + 1, None)]


@pytest.mark.parametrize("size", [200, 2000, 20_000])
def test_similar_pairs_meet_and_a_widespread_passage_makes_no_large_groups(size):
    import numpy as np

    rng = np.random.default_rng(size)
    share = ngram_join_share()

    def chosen(sets):
        """Keys that each set keeps, by the number of sets that have a key."""
        made = [meeting_keys(np.sort(s), share) for s in sets]
        count = {}
        for keys, _ in made:
            for k in keys.tolist():
                count[k] = count.get(k, 0) + 1
        kept = []
        for keys, spares in made:
            spare = dict(spares)
            mine = set()
            for level in {k & 127 for k in keys.tolist()}:
                ordered = sorted((k for k in keys.tolist() if k & 127 == level), key=lambda k: (count[k], k))
                mine.update(ordered[: len(ordered) - spare.get(level, 0)])
            kept.append(mine)
        return kept

    def grams(n):
        return rng.integers(0, 2**64 - 1, n, dtype=np.uint64)

    common = grams(size * 6 // 10)
    originals = [np.concatenate([common, grams(size - len(common))]) for _ in range(12)]
    # just similar enough: 85 of 100 in the union
    copies = [np.concatenate([o[: -(-len(o) * 925 // 1000)], grams(len(o) * 8 // 100)]) for o in originals]
    kept = chosen(originals + copies)
    for i, (o, c) in enumerate(zip(originals, copies)):
        both = len(np.intersect1d(o, c))
        assert 100 * both >= 85 * len(np.union1d(o, c))
        assert kept[i] & kept[12 + i]
    # the segments that the passage fills in all sets are left out
    frequent = {}
    for k in (k for mine in kept for k in mine):
        frequent[k] = frequent.get(k, 0) + 1
    assert max(frequent.values()) <= 6


def ngram_join_share():
    from fractions import Fraction

    return Fraction(85, 100)
