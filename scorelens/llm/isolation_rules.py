"""Quality rules with an isolation forest on rule statistics.

Every whole text gives counts (words, symbols, repeated lines and windows, ...) and shares of them. Random splits on the
shares isolate anomalous documents after fewer steps than usual ones; the mean path length over many trees gives a
score from 0 to 1. The limit is calibrated on all labelled rows: the score that rejects at most ``FALSE_REJECTS`` of
the good ones.

The forest is fitted on at most ``SAMPLE_ROWS`` rows, those of lowest id hash; every row is scored, and the calibration
histogram counts every labelled row. Without labels the limit is the score that ``ANOMALOUS_SHARE`` of the rows exceed.

Empty and null texts fail the base rules. Repeated rows are judged alike; a null id is kept. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.rule_statistics import COUNTS, MORE_COUNTS, rates, rule_statistics
from scorelens.storage import materialize

SAMPLE_ROWS = 8192
TREES = 100
TREE_ROWS = 256
FALSE_REJECTS = 0.005
ANOMALOUS_SHARE = 0.05
#: Bins of the calibration histogram.
SCORE_BINS = 2000
LEAST_WORDS = 50
#: Shares up to which prose is not unusual.
USUAL_UPPER, USUAL_REPEATS, USUAL_DUP_LINES = 0.1, 0.3, 0.4


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.maximum(np.asarray(n, dtype=float), 1)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def features(counts: np.ndarray) -> np.ndarray:
    """Shares that don't depend on a text's language or length; of upper case and repeats, what exceeds usual prose."""
    symbols, pipes, upper, marks, _, dup_lines, repeats, _, _ = rates(counts).T

    def excess(share: np.ndarray, usual: float) -> np.ndarray:
        return np.maximum(0, share - usual)

    return np.stack([
        symbols, symbols + marks, marks, symbols + marks + pipes, excess(upper, USUAL_UPPER), excess(repeats, USUAL_REPEATS),
        excess(dup_lines, USUAL_DUP_LINES),
    ], axis=1)


class IsolationForest:
    """Trees as arrays: per tree and node a feature, a limit, the first child, and the path length ending there."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        random = np.random.RandomState(seed)
        self.depth = int(np.ceil(np.log2(max(2, min(tree_rows, max(len(rows), 2))))))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, size), dtype=np.int32)
        self.limit = np.full((trees, size), np.inf)
        self.path = np.zeros((trees, size))
        self.usual = float(average_path(np.array([min(tree_rows, max(len(rows), 2))]))[0])
        for tree in range(trees):
            chosen = rows[random.permutation(len(rows))[:tree_rows]] if len(rows) else rows
            self._grow(tree, 0, 0, chosen, random)

    def _grow(self, tree: int, node: int, depth: int, rows: np.ndarray, random: np.random.RandomState) -> None:
        spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else np.zeros(0, int)
        if depth == self.depth or len(spread) == 0:
            # a leaf above the last level sends everything down its left side
            length = depth + float(average_path(np.array([len(rows)]))[0])
            while depth < self.depth:
                node, depth = 2 * node + 1, depth + 1
            self.path[tree, node] = length
            return
        feature = spread[random.randint(len(spread))]
        low, high = rows[:, feature].min(), rows[:, feature].max()
        limit = random.uniform(low, high)
        limit = limit if limit > low else high
        self.feature[tree, node], self.limit[tree, node] = feature, limit
        right = rows[:, feature] >= limit
        self._grow(tree, 2 * node + 1, depth + 1, rows[~right], random)
        self._grow(tree, 2 * node + 2, depth + 1, rows[right], random)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that are isolated sooner."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, limit, path in zip(self.feature, self.limit, self.path):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[at, feature[node]] >= limit[node])
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(self.usual, 1e-9))


def _base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _limit(scored: DataFrame, labels: DataFrame | None) -> float:
    """Score from which rows are rejected, from a histogram of at most ``2 * SCORE_BINS`` cells."""
    binned = scored.filter("not base_failed").withColumn("bin", F.floor(F.col("score") * SCORE_BINS).cast("int"))
    cells = []
    if labels is not None:
        good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
        cells = binned.join(good, "doc_id", "left_semi").groupBy("bin").count().collect()
    share = FALSE_REJECTS
    if not cells:
        cells, share = binned.groupBy("bin").count().collect(), ANOMALOUS_SHARE
    total, above = sum(c["count"] for c in cells), 0
    for cell in sorted(cells, key=lambda c: -c["bin"]):
        above += cell["count"]
        if above > share * total:
            return (cell["bin"] + 1) / SCORE_BINS
    return 1.0


def quality_rules(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept) of docs (doc_id, text); labels: (doc_id, quality 0/1)."""
    stats = materialize(rule_statistics(docs), "statistics")
    names = COUNTS + MORE_COUNTS
    sample = stats.orderBy(F.xxhash64("doc_id"), *names).limit(SAMPLE_ROWS).select(*names).toPandas()
    forest = IsolationForest(features(sample.to_numpy(dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.scores(features(counts)))], names=["doc_id", *names, "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", score double")
    scored = materialize(scored.withColumn("base_failed", _base_failed()), "scored")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < _limit(scored, labels)))
