"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a step are a hashed embedding of the word (lower case, outer punctuation removed) and the mean of hashed
embeddings of its byte trigrams. A window of ``WINDOW`` words passes a recurrent layer in both directions; attention
weighs the states of all words, and their weighted sum gives the window's logit. Every text is scored in overlapping
windows from its first to its last word; the largest logit counts.

Training: doc labels only, so a positive text teaches through its window of largest logit, a negative one through all.
It uses at most ``TRAIN_POSITIVE`` and ``TRAIN_NEGATIVE`` labelled rows of lowest id hash with at most ``TRAIN_CHARS``
characters, on the driver. Then all texts are scored, and a histogram over all training labels shifts the logits so
that the best separating value becomes ``DECISION``.

Held out are the rows whose crc32 of the id, as text, leaves 1 when divided by 3: their labels are never read. Ids,
languages and sources are no inputs. Texts without words score 0. Rows with a null id are scored; repeated rows score
alike. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.textscan import mix, text_slices, trim_punctuation, word_hashes, words
from scorelens.storage import materialize

TRAIN_POSITIVE, TRAIN_NEGATIVE, TRAIN_CHARS = 1500, 3000, 3000
WINDOW, STRIDE = 32, 24
WORD_BUCKETS, GRAM_BUCKETS = 1 << 13, 1 << 12
WORD_DIM, GRAM_DIM, HIDDEN = 8, 8, 8
BATCH, RATE = 32, 0.01
#: Passes over the training rows: as many as give ``LEAST_STEPS`` steps, within these bounds.
LEAST_EPOCHS, MOST_EPOCHS, LEAST_STEPS = 8, 24, 1000
#: Training drops the word embedding of this share of steps, so that trigrams learn as well.
WORD_DROP = 0.3
#: Training texts that a word bucket must occur in to have an embedding.
LEAST_TEXTS = 5
DECISION = 0.7
LOGIT_BINS = 400

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Words:
    """Distinct words of a slice: word bucket, trigram buckets, and the windows of texts over them."""

    bucket: np.ndarray
    grams: np.ndarray
    gram_start: np.ndarray
    windows: np.ndarray  # rows of WINDOW indices; the number of words stands for padding
    window_row: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, rows = words(data, offsets)
    starts, ends = trim_punctuation(data, starts, ends)
    hashes = word_hashes(data, starts, ends, lower=True)
    distinct, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    size = ends - starts
    gram_start = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(starts - gram_start[:-1], size) + np.arange(gram_start[-1])
    low, high = np.repeat(starts, size), np.repeat(ends, size)
    small = _LOWER[data]
    code = small[at].astype(np.uint64) << np.uint64(8)
    code |= np.where(at > low, small[np.maximum(at - 1, 0)], 0).astype(np.uint64) << np.uint64(16)
    code |= np.where(at + 1 < high, small[np.minimum(at + 1, max(len(data) - 1, 0))], 0).astype(np.uint64)
    grams = (mix(code + np.uint64(77)) & np.uint64(GRAM_BUCKETS - 1)).astype(np.int64)
    # windows: every STRIDE words, the last one ends with the text
    n_rows = len(offsets) - 1
    count = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    n_windows = np.where(count == 0, 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)))
    window_row = np.repeat(np.arange(n_rows), n_windows)
    order = np.arange(len(window_row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    place = np.minimum(order * STRIDE, np.maximum(count[window_row] - WINDOW, 0))
    spot = place[:, None] + np.arange(WINDOW)
    there = spot < count[window_row][:, None]
    flat = np.append(index.reshape(-1), len(distinct))
    windows = flat[np.where(there, begin[window_row][:, None] + spot, len(flat) - 1)]
    return Words((distinct & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), grams, gram_start, windows, window_row)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    def __init__(self, seed: int = 11):
        random = np.random.RandomState(seed)

        def init(*shape: int, scale: float) -> np.ndarray:
            return (random.normal(size=shape) * scale).astype(np.float32)

        width = WORD_DIM + GRAM_DIM
        self.p = {"word": init(WORD_BUCKETS, WORD_DIM, scale=0.1), "gram": init(GRAM_BUCKETS, GRAM_DIM, scale=0.1)}
        for side in "fb":
            self.p[f"in_{side}"] = init(width, 3 * HIDDEN, scale=width**-0.5)
            self.p[f"bias_{side}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
            self.p[f"re_{side}"] = init(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            self.p[f"look_{side}"] = init(HIDDEN, scale=0.1)
            self.p[f"out_{side}"] = init(HIDDEN, scale=0.3)
        self.p["out_bias"] = np.zeros(1, dtype=np.float32)

    def inputs(self, w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of the distinct words, and the trigram counts."""
        size = np.maximum(np.diff(w.gram_start), 1)
        grams = np.zeros((len(w.bucket), GRAM_DIM), dtype=np.float32)
        if len(w.bucket):
            grams = np.add.reduceat(self.p["gram"][w.grams], w.gram_start[:-1], axis=0) / size[:, None].astype(np.float32)
        word = self.p["word"][w.bucket]
        return np.concatenate([word if keep is None else word * keep, grams], axis=1), size

    def projected(self, x: np.ndarray, side: str) -> np.ndarray:
        """Gate inputs of every distinct word, and of padding, which keeps the state."""
        pad = np.zeros((1, 3 * HIDDEN), dtype=np.float32)
        pad[0, :HIDDEN] = 30
        return np.concatenate([x @ self.p[f"in_{side}"] + self.p[f"bias_{side}"], pad])

    def _run(self, gates: np.ndarray, windows: np.ndarray, side: str, tape: list | None) -> tuple[np.ndarray, np.ndarray]:
        """Attention and output terms of every step, steps by windows."""
        re, heads = self.p[f"re_{side}"], np.stack([self.p[f"look_{side}"], self.p[f"out_{side}"]], axis=1)
        n = len(windows)
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        terms = np.empty((WINDOW, n, 2), dtype=np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x = gates[windows[:, t]]
            back = h @ re
            zr = _sigmoid(x[:, : 2 * HIDDEN] + back[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * back[:, 2 * HIDDEN :])
            if tape is not None:
                tape.append((t, h, z, r, new, back[:, 2 * HIDDEN :]))
            h = new + z * (h - new)
            terms[t] = h @ heads
        return terms[:, :, 0], terms[:, :, 1]

    def logits(self, w: Words) -> np.ndarray:
        x, _ = self.inputs(w)
        total = self._pooled(w, x, None)
        return total[0]

    def _pooled(self, w: Words, x: np.ndarray, tapes: dict | None):
        look, out = 0.0, 0.0
        for side in "fb":
            tape = None if tapes is None else tapes.setdefault(side, [])
            a, b = self._run(self.projected(x, side), w.windows, side, tape)
            look, out = look + a, out + b
        look = np.where(w.windows.T == len(w.bucket), -1e9, look)
        weight = np.exp(look - look.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight * out).sum(axis=0)
        return pooled + self.p["out_bias"][0], weight, out, pooled

    def gradients(self, w: Words, slope, keep: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a loss; ``slope`` maps the windows' logits to the loss's derivative by them."""
        x, size = self.inputs(w, keep)
        tapes: dict[str, list] = {}
        logit, weight, out, pooled = self._pooled(w, x, tapes)
        d = slope(logit).astype(np.float32)
        d_out = weight * d
        d_look = weight * (out - pooled) * d
        g = {"out_bias": np.array([d.sum()], dtype=np.float32)}
        dx = np.zeros_like(x)
        for side in "fb":
            re, look_w, out_w = self.p[f"re_{side}"], self.p[f"look_{side}"], self.p[f"out_{side}"]
            d_re, d_gates = np.zeros_like(re), np.zeros((len(w.bucket) + 1, 3 * HIDDEN), dtype=np.float32)
            g[f"look_{side}"], g[f"out_{side}"] = np.zeros_like(look_w), np.zeros_like(out_w)
            dh = np.zeros((len(w.windows), HIDDEN), dtype=np.float32)
            for t, h, z, r, new, back in reversed(tapes[side]):
                after = new + z * (h - new)
                dh = dh + d_look[t][:, None] * look_w + d_out[t][:, None] * out_w
                g[f"look_{side}"] += d_look[t] @ after
                g[f"out_{side}"] += d_out[t] @ after
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * back * r * (1 - r)
                d_back = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_re += h.T @ d_back
                np.add.at(d_gates, w.windows[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
                dh = dh * z + d_back @ re.T
            d_gates = d_gates[:-1]
            g[f"re_{side}"], g[f"in_{side}"], g[f"bias_{side}"] = d_re, x.T @ d_gates, d_gates.sum(axis=0)
            dx += d_gates @ self.p[f"in_{side}"].T
        g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(g["word"], w.bucket, dx[:, :WORD_DIM] * keep)
        np.add.at(g["gram"], w.grams, np.repeat(dx[:, WORD_DIM:] / size[:, None].astype(np.float32), np.diff(w.gram_start), axis=0))
        return g


@dataclass
class Adam:
    rate: float = RATE
    step: int = 0
    mean: dict = field(default_factory=dict)
    square: dict = field(default_factory=dict)

    def apply(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.step += 1
        for name, slope in g.items():
            m = self.mean[name] = 0.9 * self.mean.get(name, 0) + 0.1 * slope
            s = self.square[name] = 0.999 * self.square.get(name, 0) + 0.001 * slope * slope
            fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            p[name] -= (self.rate * fix * m / (np.sqrt(s) + 1e-8)).astype(np.float32)


def train(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Network:
    """Fit on short labelled texts."""
    network, adam, random = Network(), Adam(), np.random.RandomState(seed)
    seen = np.zeros(WORD_BUCKETS, dtype=int)
    for text in texts:
        raw = text.encode()
        np.add.at(seen, np.unique(read_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).bucket), 1)
    # words that are too rare to learn from have no embedding of their own, only their trigrams
    network.p["word"][seen < LEAST_TEXTS] = 0
    common = (seen >= LEAST_TEXTS).astype(np.float32)[:, None]
    epochs = min(MOST_EPOCHS, max(LEAST_EPOCHS, -(-LEAST_STEPS * BATCH // max(len(texts), 1))))
    for epoch in range(epochs):
        order = random.permutation(len(texts))
        adam.rate = RATE * (1 - epoch / epochs)
        for first in range(0, len(order), BATCH):
            chosen = order[first : first + BATCH]
            raw = [texts[i].encode() for i in chosen]
            w = read_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
            if not len(w.windows):
                continue
            truth = toxic[chosen].astype(float)[w.window_row]

            def slope(logit: np.ndarray) -> np.ndarray:
                best = np.full(len(chosen), -np.inf)
                np.maximum.at(best, w.window_row, logit)
                teaches = (truth == 0) | (logit == best[w.window_row])
                # a text counts once, however many windows it has
                share = teaches / np.bincount(w.window_row, teaches, len(chosen))[w.window_row]
                return (_sigmoid(logit) - truth) * share / len(chosen)

            keep = (random.random_sample((len(w.bucket), 1)) >= WORD_DROP).astype(np.float32)
            found = network.gradients(w, slope, keep)
            found["word"] *= common
            adam.apply(network.p, found)
    return network


def _training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id", F.lit(1))
    ids = known.filter("toxic = 1").orderBy(rank, "doc_id").limit(TRAIN_POSITIVE).union(
        known.filter("toxic = 0").orderBy(rank, "doc_id").limit(TRAIN_NEGATIVE))
    ids = materialize(ids, "train_ids")
    # at most TRAIN_POSITIVE + TRAIN_NEGATIVE ids
    short = docs.filter(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(ids), "doc_id")
    rows = short.select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows], dtype=int)


def window_scores(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, logit): the largest logit over all windows of each whole text; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                w = read_words(data, offsets)
                best = np.full(len(offsets) - 1, -np.inf)
                if len(w.windows):
                    np.maximum.at(best, w.window_row, network.logits(w).astype(float))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(best)), pa.array(best, mask=np.isinf(best))], names=["doc_id", "logit"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, logit double")


def _shift(scored: DataFrame, labels: DataFrame) -> float:
    """Logit that separates the training labels best, from a histogram of at most 2 * LOGIT_BINS cells."""
    known = labels.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bin_ = F.greatest(F.least(F.floor(F.col("logit") * 10), F.lit(LOGIT_BINS // 2 - 1)), F.lit(-(LOGIT_BINS // 2))).cast("int")
    cells = scored.filter("logit is not null").join(known, "doc_id").groupBy(bin_.alias("bin"), "toxic").count().collect()
    counts = np.zeros((2, LOGIT_BINS))
    for c in cells:
        counts[c["toxic"], c["bin"] + LOGIT_BINS // 2] += c["count"]
    if not counts[1].any() or not counts[0].any():
        return 0.0
    # right answers when all bins from k on are called toxic; both labels weigh alike
    right = np.cumsum(np.append(0, counts[0])) / counts[0].sum() + (counts[1].sum() - np.cumsum(np.append(0, counts[1]))) / counts[1].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return (best.mean() - LOGIT_BINS // 2) / 10


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for docs (doc_id, text) and labels (doc_id, toxic)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts, toxic = _training_rows(docs, labels)
    network = train(texts, toxic) if len(set(toxic.tolist())) == 2 else Network()
    scored = materialize(window_scores(docs, network), "logits")
    offset = float(np.log(DECISION / (1 - DECISION))) - _shift(scored, labels)
    score = F.coalesce(1 / (1 + F.exp(-(F.col("logit") + F.lit(offset)))), F.lit(0.0))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= DECISION).cast("int").alias("predicted")
    )
