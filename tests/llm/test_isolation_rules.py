"""Counts against brute force, and the forest on planted anomalies."""

import random
import re
from collections import Counter

import numpy as np

from scorelens.llm.isolation_rules import IsolationForest, average_path, quality_rules
from scorelens.llm.rule_statistics import COUNTS, rule_statistics

SPACE = "[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    bits = ["a", "b", "é", "𝄞x", "##", "|", "\n", "\n\n", " ", "\t", "\r\n", "<b>", "A B\n", "a b c ", "\x0b", " ", "\u0085"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += [None, "", "\n", "x", "x\nx", "x\n", "\nx\nx\n", "w " * 30000, "q" * 60000, "line\n" * 3000]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in rule_statistics(spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(4)).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}


def test_forest_isolates_what_is_far_away():
    random_ = np.random.RandomState(1)
    usual = random_.normal(size=(4000, 3))
    forest = IsolationForest(np.concatenate([usual, [[9.0, 9, 9]] * 4]))
    scores = forest.scores(np.array([[0.0, 0, 0], [9, 9, 9]]))
    assert scores[0] < 0.45 < 0.65 < scores[1]
    assert abs(float(average_path(np.array([256]))[0]) - 10.24) < 0.1
    assert IsolationForest(np.zeros((0, 3))).scores(usual[:2]).shape == (2,)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinsrh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_verdicts_nulls_repeats_and_no_rows(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.randint(60, 200)), "x") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rng, 80).split()), "x") for i in range(30)]
    short = [(2000, "few words", None), (2001, None, None), (2002, "", None), (2003, "same three words " * 40, None), (None, prose(rng, 90), None)]
    frame = spark.createDataFrame(docs + junk + short + docs[:3], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(0, 1), (1001, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality_rules(frame, labels).collect()
    assert len(got) == 338
    for r in got:
        if r.doc_id is None or r.doc_id < 1000:
            assert r.kept and not r.base_failed
        else:
            assert not r.kept and r.base_failed == (r.doc_id >= 2000)
    assert quality_rules(frame.limit(0), labels.limit(0)).collect() == []
    assert quality_rules(frame, labels.limit(0)).filter("kept").count() >= 280
