"""Rule statistics of whole texts, vectorised over Arrow batches.

Words are maximal runs without space and tab to carriage return; equal lines and windows are found by 64-bit hashes.
Null and empty texts have no words, lines or symbols: all statistics are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.textscan import gram_hashes, mix, text_slices, word_hashes, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_COUNTS = ["n_lines", "n_distinct", "n_upper", "n_marks", "n_digits", "n_pipes"]

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, dtype=np.int64)
_MARK[list(b"!?")] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_PIPE = np.zeros(256, dtype=np.int64)
_PIPE[ord("|")] = 1
_SPACE = list(b" \t\n\x0b\x0c\r")
_WORD_START = np.zeros(256, dtype=np.int64)  # bytes of words that begin a code point
_WORD_START[:] = [(b & 0xC0) != 0x80 and b not in _SPACE for b in range(256)]
_NOT_SPACE = np.ones(256, dtype=np.int64)
_NOT_SPACE[_SPACE] = 0


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    flag = np.zeros(len(key), dtype=bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def _later(key: np.ndarray) -> np.ndarray:
    """Which values have occurred before."""
    order = np.argsort(key, kind="stable")
    flag = np.zeros(len(key), dtype=bool)
    flag[order[1:][key[order][1:] == key[order][:-1]]] = True
    return flag


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of ``COUNTS`` and ``MORE_COUNTS`` for the texts of a slice."""
    n_rows = len(offsets) - 1
    out = np.zeros((n_rows, len(COUNTS) + len(MORE_COUNTS)), dtype=np.int64)
    if len(data) == 0:
        return out
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    salt = mix(np.arange(n_rows, dtype=np.uint64) + np.uint64(1))
    out[:, 0] = np.bincount(rows, minlength=n_rows)
    out[:, 1] = _per_row(_WORD_START[data], offsets)
    out[:, 2] = _per_row(_SYMBOL[data], offsets)
    # lines: after each line feed, and at each text's start
    feeds = np.flatnonzero(data == 10)
    full = offsets[:-1][np.diff(offsets) > 0]
    line_start = np.union1d(feeds + 1, full)
    line_start = line_start[line_start < len(data)]
    # a line feed at the end of a text begins an empty line, which has no word: it may stand for the next text's start
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[line_end - 1] == 10)
    seen = np.concatenate(([0], np.cumsum(_NOT_SPACE[data])))
    there = seen[line_end] > seen[line_start]
    line_start, line_end = line_start[there], line_end[there]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    line_key = mix(word_hashes(data, line_start, line_end) + salt[line_row])
    out[:, 3] = np.bincount(line_row[_later(line_key)], minlength=n_rows)
    grams, first = gram_hashes(hashes, rows, 3)
    twice = first[_repeated(mix(grams + salt[rows[first]]))]
    covered = np.zeros(len(starts) + 2, dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    out[:, 4] = np.bincount(rows[covered[: len(starts)]], minlength=n_rows)
    out[:, 5] = np.bincount(line_row, minlength=n_rows)
    out[:, 6] = out[:, 0] - np.bincount(rows[_later(mix(hashes + salt[rows]))], minlength=n_rows)
    for k, table in enumerate((_UPPER, _MARK, _DIGIT, _PIPE)):
        out[:, 7 + k] = _per_row(table[data], offsets)
    return out


def rule_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts of ``COUNTS`` and ``MORE_COUNTS``) of every row; extra columns are dropped."""
    names = COUNTS + MORE_COUNTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                counts = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(counts)), *(pa.array(counts[:, i]) for i in range(len(names)))], names=["key", *names]
                )

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("key", key)


def rates(counts: np.ndarray) -> np.ndarray:
    """Shares that the counts give, rows by features."""
    n_words, chars, symbols, dup, repeat, lines, distinct, upper, marks, digits, pipes = (counts[:, i].astype(float) for i in range(11))
    chars1, words1, lines1 = np.maximum(chars, 1), np.maximum(n_words, 1), np.maximum(lines, 1)
    return np.stack([
        symbols / chars1, pipes / words1, upper / chars1, marks / chars1, digits / chars1, dup / lines1, repeat / words1,
        distinct / words1, chars / words1,
    ], axis=1)


RATES = ["symbols", "pipes", "upper", "marks", "digits", "dup_lines", "repeats", "distinct", "word_length"]
