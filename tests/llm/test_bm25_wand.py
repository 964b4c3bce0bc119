"""Block-max WAND against full scoring, and planted test items."""

import random

import numpy as np
import pytest

from scorelens.llm import bm25_wand
from scorelens.llm.bm25_wand import THRESHOLD, Index, drop_leaks, find_leaks, question_and_answer


def vocabulary(rng, n):
    return ["".join(rng.choice("etaoinsrh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def test_search_retrieves_all_above_the_threshold():
    rng = random.Random(1)
    vocab = vocabulary(rng, 120)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 30))), "x y") for i in range(150)]
    index = Index(items)
    found = 0
    for trial in range(200):
        query = rng.sample(range(len(index.terms)), rng.randint(1, 60))
        if trial % 2:
            query = sorted(set(query) | {t for t, its in enumerate(index.items) if trial in its})
        threshold = rng.choice([0.2, 0.4, THRESHOLD, 0.9])
        full = np.zeros(len(items))
        for t in query:
            full[index.items[t]] += index.impacts[t]
        got = dict(index.search(list(query), threshold))
        want = {i: s for i, s in enumerate(full) if s >= threshold}
        assert set(want) <= set(got) and all(abs(got[i] - full[i]) < 1e-9 and full[i] >= threshold - 1e-4 for i in got)
        found += len(got)
    assert found > 100


def test_bounds_never_lose_a_passage():
    rng = random.Random(7)
    vocab = vocabulary(rng, 60)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(20)), "") for i in range(40)]
    index = Index(items)
    for _ in range(40):
        k = rng.randrange(40)
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 300))) + " " + items[k][1] + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 300)))
        raw = text.encode()
        assert k in {h.item for h in index.hits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))}


def test_question_and_answer():
    assert question_and_answer("One two. Three? Four five.") == ("One two. Three? ", "Four five.")
    assert question_and_answer("a b c d e f") == ("a b c d", "e f")
    assert question_and_answer("") == ("", "")


def test_planted_items_are_found_and_clean_rows_stay(spark):
    rng = random.Random(2)
    vocab = vocabulary(rng, 3000)

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    items = [(i, f"{prose(14)}. {prose(9)}?\n{prose(7)}.") for i in range(30)] + [(30, None), (31, ""), (0, "same " * 3), (33, "...")]
    rows = [(i, prose(rng.randint(1, 400)), "z") for i in range(200)]
    for i in range(60):
        item = items[i % 30][1]
        if i % 3 == 1:
            item = "\n".join(item.upper().split())
        elif i % 3 == 2:
            parts = item.split()
            parts[3] = "changed"
            item = " ".join(parts)
        rows.append((1000 + i, f"{prose(rng.randint(0, 300))} {item} {prose(rng.randint(0, 300))}", "z"))
    rows += [(2000, items[0][1].split("?")[0], "z"), (2001, None, None), (2002, "", None), (2003, prose(40000) + " " + items[1][1], "z"), (None, items[2][1], None)]
    rows += rows[200:202]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect()]
    want = [(1000 + i, i % 30) for i in range(60)] + [(2003, 1), (None, 2), (1000, 0), (1001, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = drop_leaks(docs, benchmark)
    assert left.columns == docs.columns and left.count() == len(rows) - len(want)
    assert find_leaks(docs, benchmark.limit(0)).collect() == []
    assert find_leaks(docs.limit(0), benchmark).collect() == []
    assert drop_leaks(docs, benchmark.filter("text is null")).count() == len(rows)
    two = benchmark.select("item_id", "text").filter("item_id = 5").selectExpr("item_id", "text as question", "cast(null as string) as answer")
    assert {r.doc_id for r in find_leaks(docs, two).collect()} == {1005, 1035}


def test_scores_do_not_depend_on_the_number_of_parts(spark, monkeypatch):
    rng = random.Random(3)
    vocab = vocabulary(rng, 400)

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    items = [(i, f"{prose(rng.randint(16, 30))}. {prose(rng.randint(8, 14))}.") for i in range(40)] + [(40, None), (41, "..."), (3, "again and again")]
    rows = [(i, prose(200)) for i in range(60)]
    for i in range(40):
        kept = items[i][1].split()
        for _ in range(i % 4):  # scores around the threshold
            kept[rng.randrange(len(kept))] = rng.choice(vocab)
        rows.append((100 + i, f"{prose(40)} {' '.join(kept)} {prose(90)}"))
    rows += [(100, rows[60][1]), (None, rows[61][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    size, results, left = sum(len(t or "") for _, t in items), [], []
    for parts in (1, 2, 20):
        monkeypatch.setattr(bm25_wand, "INDEX_BYTES", -(-size // parts))
        indexes = list(bm25_wand.index_parts(benchmark))
        assert len(indexes) > parts // 2 and len({index.window for index in indexes}) == 1
        found = find_leaks(docs, benchmark).collect()
        results.append(sorted(((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in found), key=str))
        left.append(sorted((tuple(r) for r in drop_leaks(docs, benchmark).collect()), key=str))
    assert len(results[0]) > 20 and results[0] == results[1] == results[2]
    assert left[0] == left[1] == left[2] and len(left[0]) < len(rows) - 15
    assert all(0.6 <= score <= 1 + 1e-9 or score == pytest.approx(0.6, abs=1e-4) for _, _, score, _, _ in results[0])
