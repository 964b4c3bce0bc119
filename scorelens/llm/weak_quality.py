"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote good, bad or abstain on the rule statistics of every document.
2. Expectation-maximisation over the counts of vote patterns estimates how each labeller votes on good and on bad
   documents, and so the posterior label of every pattern. The counts cover all documents; there are at most
   3 ** labellers patterns, whatever the input.
3. The posterior labels train a hashed linear scorer (logistic, by gradient steps) on at most ``SAMPLE_ROWS`` documents,
   those of lowest id hash.
4. The scorer runs over every whole text; below ``KEEP_SCORE`` a document is rejected, so one that is in doubt stays.

Documents without a word (null, empty, white space) score 0. Repeated rows score alike; rows with a null id are scored
as all others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.rule_statistics import _later, _repeated, rule_statistics
from scorelens.llm.textscan import gram_hashes, mix, text_slices, word_hashes, words
from scorelens.storage import materialize

SAMPLE_ROWS = 4096
SUFFIX_BUCKETS = 1 << 14
KEEP_SCORE = 0.2
ROUNDS = 100  # of expectation-maximisation
STEPS = 300  # of gradient descent
PENALTY = 1e-4

ABSTAIN, BAD, GOOD = 0, 1, 2


def labellers() -> dict[str, Column]:
    """Votes on rule statistics."""
    chars, n = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))

    def bad(condition: Column) -> Column:
        return F.when(condition, BAD).otherwise(ABSTAIN)

    def good(condition: Column) -> Column:
        return F.when(condition, GOOD).otherwise(ABSTAIN)

    symbols, marks, upper = F.col("n_symbols") / chars, F.col("n_marks") / chars, F.col("n_upper") / chars
    repeats, distinct = F.col("n_repeat_words") / n, F.col("n_distinct") / n
    return {
        "symbols": bad(symbols > 0.05),
        "shouting": bad((upper > 0.3) & (n >= 10)),
        "marks": bad(marks > 0.05),
        "repeats": bad(repeats > 0.5),
        "few_distinct": bad((distinct < 0.5) & (n >= 50) & (n < 2000)),
        "same_lines": bad(F.col("n_dup_lines") > 0.5 * F.greatest(F.col("n_lines"), F.lit(1))),
        "plain": good((symbols < 0.01) & (marks < 0.02) & (upper < 0.2)),
        "varied": good((repeats < 0.3) & (distinct > 0.5) & (F.col("n_dup_lines") <= 0.4 * F.col("n_lines"))),
    }


@dataclass
class WeakLabels:
    """Posterior probability of good for each vote pattern, and the votes' probabilities by class (bad, good)."""

    posterior: dict[str, float]
    votes: np.ndarray


def estimate_labels(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good per pattern and P(vote | class), from pattern counts by expectation-maximisation."""
    n_bad, n_good = (patterns == BAD).sum(axis=1), (patterns == GOOD).sum(axis=1)
    good = np.where(n_bad > 0, 0.1, np.where(n_good > 0, 0.9, 0.5))
    one_hot = np.stack([patterns == v for v in (ABSTAIN, BAD, GOOD)], axis=2).astype(float)
    votes = np.zeros((2, patterns.shape[1], 3))
    for _ in range(ROUNDS):
        weight = np.stack([(1 - good) * counts, good * counts])
        votes = np.einsum("cp,plv->clv", weight, one_hot) + 0.5
        votes /= votes.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        log = np.log(prior)[:, None] + np.einsum("plv,clv->cp", one_hot, np.log(votes))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return good, votes


def weak_labels(voted: DataFrame) -> WeakLabels:
    """From (pattern) of all documents; the driver sees one row for each pattern."""
    cells = voted.groupBy("pattern").count().orderBy("pattern").collect()
    if not cells:
        return WeakLabels({}, np.zeros((2, 0, 3)))
    patterns = np.array([[int(v) for v in c["pattern"]] for c in cells])
    good, votes = estimate_labels(patterns, np.array([c["count"] for c in cells], dtype=float))
    return WeakLabels({c["pattern"]: float(g) for c, g in zip(cells, good)}, votes)


_KIND = np.full(256, 5, dtype=np.int64)  # of a byte: lower, upper, digit, symbol, mark, other
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[list(b"#*$%&|<>")] = 3
_KIND[list(b"!?.,;:")] = 4
N_SHAPES = 6**3
N_FEATURES = SUFFIX_BUCKETS + N_SHAPES + 3


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of every word, and the words per row.

    Buckets: hashed last three bytes, kinds of the first two and the last byte, word seen before, word in a repeated
    window, word in a text with words.
    """
    n_rows = len(offsets) - 1
    starts, ends, rows = words(data, offsets)
    size = np.bincount(rows, minlength=n_rows)
    if len(starts) == 0:
        return rows, rows, size
    hashes = word_hashes(data, starts, ends)
    salt = mix(np.arange(n_rows, dtype=np.uint64) + np.uint64(1))
    suffix = np.zeros(len(starts), dtype=np.uint64)
    for k in range(1, 4):
        at = ends - k
        suffix = (suffix << np.uint64(8)) | np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint64)
    bucket = (mix(suffix) & np.uint64(SUFFIX_BUCKETS - 1)).astype(np.int64)
    second = np.minimum(starts + 1, ends - 1)
    shape = SUFFIX_BUCKETS + 36 * _KIND[data[starts]] + 6 * _KIND[data[second]] + _KIND[data[ends - 1]]
    again = rows[_later(mix(hashes + salt[rows]))]
    grams, first = gram_hashes(hashes, rows, 3)
    twice = first[_repeated(mix(grams + salt[rows[first]]))]
    covered = np.zeros(len(starts) + 2, dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    repeated = rows[covered[: len(starts)]]
    flag = SUFFIX_BUCKETS + N_SHAPES
    return (
        np.concatenate([rows, rows, again, repeated, rows]),
        np.concatenate([bucket, shape, np.full(len(again), flag), np.full(len(repeated), flag + 1), np.full(len(rows), flag + 2)]),
        size,
    )


def fit_scorer(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer on sparse rows, by gradient steps with per-weight rates."""
    weights, squares = np.zeros(N_FEATURES), np.full(N_FEATURES, 1e-8)
    # rare classes count as much as common ones
    mass = np.array([max((1 - target).sum(), 1e-9), max(target.sum(), 1e-9)])
    balance = len(target) / 2 * ((1 - target) / mass[0] + target / mass[1])
    for _ in range(STEPS):
        guess = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights[buckets] * values, len(target)), -50, 50)))
        slope = np.bincount(buckets, ((guess - target) * balance)[rows] * values, N_FEATURES) / max(len(target), 1) + PENALTY * weights
        squares += slope * slope
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


@dataclass
class QualityModel:
    weights: np.ndarray
    labels: WeakLabels


def fit_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Estimate the weak labels on all documents and train the scorer on a bounded sample of them."""
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    voted = rule_statistics(plain).select(
        "doc_id", "n_words", F.concat(*[v.cast("string") for v in labellers().values()]).alias("pattern")
    )
    voted = materialize(voted, "votes")
    labels = weak_labels(voted)
    total = voted.count()
    if total == 0:
        return QualityModel(np.zeros(N_FEATURES), labels)
    # hashes up to a bound that gives the sample and a little more; then the exact number
    bound = min(2**63 - 1, int(1.2 * SAMPLE_ROWS / total * 2**63))
    rank = F.shiftrightunsigned(F.xxhash64("doc_id", F.hash("text")), 1)
    chosen = plain.withColumn("rank", rank).filter(F.col("rank") <= bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                rows, buckets, size = word_features(data, offsets)
                cell, count = np.unique(rows * N_FEATURES + buckets, return_counts=True)
                at = np.searchsorted(cell, np.arange(len(size) + 1) * N_FEATURES).astype(np.int32)
                share = count / np.maximum(size, 1)[cell // N_FEATURES]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(size)), batch.column(2).slice(row, len(size)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array((cell % N_FEATURES).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(share.astype(np.float32))),
                ], names=["doc_id", "rank", "buckets", "shares"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    sample = chosen.select("doc_id", "text", "rank").mapInArrow(run, f"doc_id {kind}, rank long, buckets array<int>, shares array<float>")
    target = voted.filter("n_words > 0").groupBy("doc_id").agg(F.max("pattern").alias("pattern"))
    found = sample.join(target, "doc_id").orderBy("rank", "doc_id").limit(SAMPLE_ROWS).collect()
    if not found:
        return QualityModel(np.zeros(N_FEATURES), labels)
    rows = np.repeat(np.arange(len(found)), [len(r["buckets"]) for r in found])
    buckets = np.concatenate([np.array(r["buckets"], dtype=np.int64) for r in found])
    values = np.concatenate([np.array(r["shares"]) for r in found])
    goodness = np.array([labels.posterior[r["pattern"]] for r in found])
    return QualityModel(fit_scorer(rows, buckets, values, goodness), labels)


def score_quality(docs: DataFrame, model: QualityModel, score: str = "quality_score", text: str = "text") -> DataFrame:
    """Add the probability of good to every row of ``docs``; a column named ``score`` is replaced."""
    weights = model.weights

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        scores = np.zeros(len(texts))
        for row, data, offsets in text_slices(texts):
            rows, buckets, size = word_features(data, offsets)
            total = np.bincount(rows, weights[buckets], len(size)) / np.maximum(size, 1)
            scores[row : row + len(size)] = np.where(size > 0, 1 / (1 + np.exp(-np.clip(total, -50, 50))), 0.0)
        return pa.array(scores)

    return docs.drop(score).withColumn(score, scored(F.col(text).cast("string")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that the classifier keeps, with their columns."""
    scored = score_quality(docs, fit_quality(docs), "_quality_score")
    return scored.filter(F.col("_quality_score") >= KEEP_SCORE).drop("_quality_score")
