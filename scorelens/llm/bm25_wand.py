"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

An inverted index of the test items is searched with every passage of every document. Passages are windows of twice the
longest item's words, half a window apart, so each place an item can stand in lies whole in one passage. A posting's
impact is its BM25 weight divided by the item's weight for its own text: a passage that holds the whole item scores 1.

A passage is a query of its distinct words. Bounds come first, vectorised: its words' greatest impacts within some range
of items must reach the threshold together. What is left is searched document-at-a-time: cursors move to the pivot, the first item at which
the bounds of the lists before it reach the threshold; the greatest impacts within the item's block decide whether it is
scored or its block skipped. All items above the threshold are retrieved. A hit counts if the passage and half a window
around it hold ``OVERLAP`` of the word n-grams of both the question and the answer.

Items are indexed in parts of about ``INDEX_BYTES`` of text. Document frequencies, mean length and window are those of all
items, so scores don't depend on the number of parts. Each part makes one pass over the documents, whose hits are written
before its index is withdrawn from the executors and the next one is sent: a worker holds one part at a time.

Words are split at ASCII white space, lower-cased from A to Z, and lose outer punctuation. Null or empty texts match
nothing, items without words are never matched. Repeated rows match alike; rows with a null id are searched too. If an
item has no columns ``question`` and ``answer``, its last sentence is the answer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.textscan import gram_hashes, text_slices, trim_punctuation, word_hashes, words
from scorelens.storage import materialize

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.7
#: Items a block of the postings.
BLOCK = 16
#: Bytes of item text in one part of the index.
INDEX_BYTES = 8 << 20
#: Ranges of items for which passages are bounded before the search, and passages bounded at once.
SUPERBLOCKS, CHUNK = 64, 256
LEAST_WINDOW = 64
GRAM = 3
_SLACK = 1e-5


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    starts, ends, rows = words(data, offsets)
    starts, ends = trim_punctuation(data, starts, ends)
    return word_hashes(data, starts, ends, lower=True), rows


def _text_tokens(text: str) -> np.ndarray:
    raw = text.encode()
    return tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def _grams(hashes: np.ndarray) -> np.ndarray:
    n = min(GRAM, len(hashes))
    return np.unique(gram_hashes(hashes, np.zeros(len(hashes), int), n)[0]) if n else hashes[:0]


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last one; a single sentence is cut behind two thirds of its words."""
    breaks = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text)]
    if breaks:
        return text[: breaks[-1]], text[breaks[-1] :]
    parts = text.split()
    cut = max(1, 2 * len(parts) // 3)
    return " ".join(parts[:cut]), " ".join(parts[cut:])


@dataclass
class Hit:
    row: int
    item: int
    score: float
    question: float
    answer: float


@dataclass
class Corpus:
    """Statistics of all items: their number, words, longest one, and in how many of them each term stands."""

    items: int
    words: int
    longest: int
    terms: np.ndarray
    frequency: np.ndarray


class Index:
    """Postings of items, by term and in item order, with the greatest impact of each list and of its blocks.

    ``corpus`` has the statistics of all items, and at least the terms of these; without it these items are all.
    """

    def __init__(self, items: list[tuple[int, str, str]], corpus: Corpus | None = None):
        self.ids = [i for i, _, _ in items]
        item_words = [_text_tokens(q + "\n" + a) for _, q, a in items]
        self.questions = [_grams(_text_tokens(q)) for _, q, _ in items]
        self.answers = [_grams(_text_tokens(a)) for _, _, a in items]
        length = np.array([len(w) for w in item_words], dtype=np.int64)
        total, n_words, longest = len(items), int(length.sum()), int(length.max(initial=0))
        if corpus:
            total, n_words, longest = corpus.items, corpus.words, corpus.longest
        mean = max(n_words / max(total, 1), 1e-9)
        self.window = max(LEAST_WINDOW, 2 * longest)
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *item_words]))
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item, found in enumerate(item_words):
            term, count = np.unique(found, return_counts=True)
            weight = count * (K1 + 1) / (count + K1 * (1 - B + B * length[item] / mean))
            for t, w in zip(np.searchsorted(self.terms, term).tolist(), weight.tolist()):
                lists[t].append((item, w))
        own = np.zeros(len(items))
        frequency = np.array([len(p) for p in lists], dtype=np.int64)
        if corpus:
            frequency = corpus.frequency[np.searchsorted(corpus.terms, self.terms)]
        idf = np.log(1 + (total - frequency + 0.5) / (frequency + 0.5))
        for t, postings in enumerate(lists):
            for item, w in postings:
                own[item] += idf[t] * w
        self.items = [[item for item, _ in p] for p in lists]
        self.impacts = [[float(idf[t] * w / own[item]) for item, w in p] for t, p in enumerate(lists)]
        self.bound = np.array([max(p) for p in self.impacts], dtype=float)
        self.block_bound: list[dict[int, float]] = []
        for its, imps in zip(self.items, self.impacts):
            blocks: dict[int, float] = {}
            for item, impact in zip(its, imps):
                blocks[item // BLOCK] = max(blocks.get(item // BLOCK, 0.0), impact)
            self.block_bound.append(blocks)
        # the same over SUPERBLOCKS wide ranges of items, as a matrix
        self.wide_bound = np.zeros((len(self.terms), SUPERBLOCKS), dtype=np.float32)
        width = -(-max(len(items), 1) // SUPERBLOCKS)
        for t, (its, imps) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.wide_bound[t], np.array(its) // width, np.array(imps, dtype=np.float32))

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (item, score) of at least ``threshold`` for a query of distinct terms: block-max WAND."""
        least = threshold - _SLACK
        end = len(self.ids)
        items, impacts, bounds, blocks = self.items, self.impacts, self.bound, self.block_bound
        place = dict.fromkeys(terms, 0)
        order = sorted(terms, key=lambda t: items[t][0])
        out = []

        def current(t: int) -> int:
            return items[t][place[t]] if place[t] < len(items[t]) else end

        while True:
            reached, pivot = 0.0, -1
            for k, t in enumerate(order):
                reached += bounds[t]
                if reached >= least:
                    pivot = k
                    break
            if pivot < 0 or (item := current(order[pivot])) == end:
                return out
            while pivot + 1 < len(order) and current(order[pivot + 1]) == item:
                pivot += 1
            block = item // BLOCK
            if sum(blocks[t].get(block, 0.0) for t in order[: pivot + 1]) >= least:
                score = 0.0
                for t in order[: pivot + 1]:
                    at = place[t] = bisect_left(items[t], item, place[t])
                    if at < len(items[t]) and items[t][at] == item:
                        score += impacts[t][at]
                        place[t] = at + 1
                if score >= least:
                    out.append((item, score))
            else:
                following = (block + 1) * BLOCK
                if pivot + 1 < len(order):
                    following = min(following, current(order[pivot + 1]))
                for t in order[: pivot + 1]:
                    place[t] = bisect_left(items[t], following, place[t])
            order.sort(key=current)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[Hit]:
        """The best hit of every (row, item) whose question and answer overlap with a passage of the row."""
        hashes, rows = tokens(data, offsets)
        if not len(hashes) or not len(self.terms):
            return []
        term = np.searchsorted(self.terms, hashes)
        known = self.terms.take(term, mode="clip") == hashes
        term = np.where(known, term, 0)
        worth = np.where(known, self.bound[term], 0.0)
        # windows of all rows
        n_rows = len(offsets) - 1
        count = np.bincount(rows, minlength=n_rows)
        begin = np.concatenate(([0], np.cumsum(count)))
        stride = self.window // 2
        n_windows = np.where(count == 0, 0, 1 + np.maximum(0, -(-(count - self.window) // stride)))
        row = np.repeat(np.arange(n_rows), n_windows)
        order = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        start = begin[row] + order * stride
        stop = np.minimum(start + self.window, begin[row + 1])
        sums = np.concatenate(([0.0], np.cumsum(worth)))
        left = np.flatnonzero(sums[stop] - sums[start] >= THRESHOLD - _SLACK)
        left = left[self._reachable(np.where(known, term, -1), start[left], stop[left])]
        best: dict[tuple[int, int], Hit] = {}
        for a, b, r in zip(start[left].tolist(), stop[left].tolist(), row[left].tolist()):
            query = np.unique(term[a:b][known[a:b]])
            for item, score in self.search(query.tolist()):
                low, high = max(begin[r], a - stride), min(begin[r + 1], b + stride)
                question = self._overlap(self.questions[item], hashes[low:high])
                answer = self._overlap(self.answers[item], hashes[low:high])
                if question >= OVERLAP and answer >= OVERLAP:
                    hit = Hit(r, item, score, question, answer)
                    if (r, item) not in best or score > best[r, item].score:
                        best[r, item] = hit
        return list(best.values())

    def _reachable(self, term: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which passages have a range of items whose greatest impacts reach the threshold together."""
        out = np.zeros(len(start), dtype=bool)
        padded = np.append(term, np.full(self.window, -1))
        for first in range(0, len(start), CHUNK):
            a, b = start[first : first + CHUNK], stop[first : first + CHUNK]
            spot = a[:, None] + np.arange(self.window)
            held = np.where(spot < b[:, None], padded[spot], -1)
            present = np.unique(held)
            present = present[present >= 0]
            column = np.zeros(len(self.terms) + 1, dtype=np.int64)
            column[present] = np.arange(len(present))
            column[-1] = len(present)  # words that no item has
            holds = np.zeros((len(a), len(present) + 1), dtype=np.float32)
            holds[np.arange(len(a))[:, None], column[held]] = 1
            bound = holds[:, :-1] @ self.wide_bound[present]
            out[first : first + CHUNK] = bound.max(axis=1, initial=0) >= THRESHOLD - 1e-3
        return out

    @staticmethod
    def _overlap(wanted: np.ndarray, hashes: np.ndarray) -> float:
        """Share of an item's n-grams in a passage; an empty part is there."""
        if not len(wanted):
            return 1.0
        there = [gram_hashes(hashes, np.zeros(len(hashes), int), n)[0] for n in range(1, GRAM + 1)]
        return float(np.isin(wanted, np.concatenate(there)).mean())


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, item, term, words) for every distinct term of the texts of (part, text), and one without a term for the item."""
    for batch in batches:
        for row, data, offsets in text_slices(batch.column(1)):
            hashes, rows = tokens(data, offsets)
            n_words = np.bincount(rows, minlength=len(offsets) - 1)
            pairs = np.unique(np.stack([rows.astype(np.uint64), hashes]), axis=1) if len(hashes) else np.zeros((2, 0), np.uint64)
            part = batch.column(0).slice(row, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([
                part.take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64)), pa.nulls(pairs.shape[1], pa.int64())], names=["part", "term", "words"])
            yield pa.RecordBatch.from_arrays([part, pa.nulls(len(part), pa.int64()), pa.array(n_words, pa.int64())], names=["part", "term", "words"])


def index_parts(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of benchmark (item_id, text or question and answer), of about ``INDEX_BYTES`` of text each."""
    if {"question", "answer"} <= set(benchmark.columns):
        items = benchmark.select("item_id", F.coalesce("question", F.lit("")).alias("q"), F.coalesce("answer", F.lit("")).alias("a"))
    else:
        items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("q"), F.lit(None).cast("string").alias("a"))
    size = items.agg(F.sum(F.length("q") + F.coalesce(F.length("a"), F.lit(0))).alias("n")).first()["n"] or 0
    parts = -(-size // INDEX_BYTES)
    items = items.distinct().withColumn("part", F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(max(parts, 1))).cast("int"))
    total = spread = None
    if parts > 1:
        items = materialize(items, "items")
        found = items.select("part", F.concat_ws("\n", "q", "a").alias("text")).mapInArrow(_item_terms, "part int, term long, words long")
        found = materialize(found, "terms")
        total = found.filter("term is null").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.max("words").alias("longest")).first()
        counts = found.filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))
        own = found.filter("term is not null").select("part", "term").distinct()
        spread = materialize(own.join(counts, "term"), "frequencies")
    for part in range(parts):
        mine = items.filter(F.col("part") == part).orderBy("item_id", "q", "a").select("item_id", "q", "a").collect()
        if not mine:
            continue
        corpus = None
        if spread is not None:
            known = spread.filter(F.col("part") == part).select("term", "n").toArrow()
            terms = known["term"].to_numpy().view(np.uint64)
            order = np.argsort(terms)
            corpus = Corpus(total["n"], total["words"], total["longest"], terms[order], known["n"].to_numpy()[order])
        yield Index([(r["item_id"], *(question_and_answer(r["q"]) if r["a"] is None else (r["q"], r["a"]))) for r in mine], corpus)


def _hits(source: DataFrame, shared: Broadcast, carried: list[str], item_kind: tuple[str, pa.DataType]) -> DataFrame:
    """The columns ``carried`` of ``source`` and the item, for each row of ``source`` and item of one part that its text holds."""
    kinds = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carried]
    names = [*carried, "item_id", "score", "question_overlap", "answer_overlap"]
    schema = ", ".join([*kinds, f"item_id {item_kind[0]}", "score double", "question_overlap double", "answer_overlap double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(0)):
                hits = index.hits(data, offsets)
                if hits:
                    rows = pa.array([row + h.row for h in hits])
                    yield pa.RecordBatch.from_arrays([
                        *[batch.column(k + 1).take(rows) for k in range(len(carried))], pa.array([index.ids[h.item] for h in hits], item_kind[1]),
                        pa.array([h.score for h in hits]), pa.array([h.question for h in hits]), pa.array([h.answer for h in hits]),
                    ], names=names)

    return source.select("text", *carried).mapInArrow(run, schema)


def _hits_by_part(source: DataFrame, benchmark: DataFrame, carried: list[str], parts: Iterable[Index]) -> DataFrame | None:
    """The hits of all parts; those of each are written before the next index goes out. None without items."""
    kind = benchmark.schema["item_id"].dataType.simpleString(), benchmark.select("item_id").limit(0).toArrow().schema.field("item_id").type
    written = []
    for index in parts:
        shared = source.sparkSession.sparkContext.broadcast(index)
        written.append(materialize(_hits(source, shared, carried, kind), "leaks"))
        shared.destroy()
    return reduce(DataFrame.union, written) if written else None


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row for each document row and item it holds."""
    found = _hits_by_part(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, ["doc_id"], index_parts(benchmark))
    if found is None:
        kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
        schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
        found = docs.sparkSession.createDataFrame([], schema)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns.

    One part of the index is a filter on the texts. With more, the digests of texts with hits are written part by part,
    and the rows of these texts go by a join; equal texts hold equal items.
    """
    parts = index_parts(benchmark)
    first = next(parts, None)
    if first is None:
        return docs
    second = next(parts, None)
    if second is None:
        return docs.filter(_holds_none(docs.sparkSession.sparkContext.broadcast(first), F.col(text).cast("string")))
    digest = F.sha2(F.col(text).cast("string"), 256)
    source = docs.select(F.col(text).cast("string").alias("text"), digest.alias("_digest"))
    found = _hits_by_part(source, benchmark, ["_digest"], chain([first, second], parts))
    leaked = materialize(found.select(F.col("_digest").alias("_leaked")).distinct(), "leaked")
    return docs.join(leaked, digest == F.col("_leaked"), "left_anti")


def _holds_none(shared: Broadcast, text: Column) -> Column:
    @F.arrow_udf("boolean")
    def holds_none(texts: pa.Array) -> pa.Array:
        clean = np.ones(len(texts), dtype=bool)
        for row, data, offsets in text_slices(texts):
            for hit in shared.value.hits(data, offsets):
                clean[row + hit.row] = False
        return pa.array(clean)

    return holds_none(text)
