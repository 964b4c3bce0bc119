"""Byte-level BPE encoding and decoding.

Texts are cut into pieces without a regular expression. Every code point has a class (letter, number, white space,
other); with one look-ahead each becomes a symbol of a small automaton. The symbols are transition functions, and
functions compose associatively, so the automaton's state before every code point comes from a blocked scan over
compositions in numpy. Pieces then pass through a cache of pair merges.

Nulls and empty texts give no ids. Repeated rows are encoded alike. Of extra columns nothing is kept: the results hold
the key column and the columns named in each docstring.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.textscan import text_slices

LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, SPACES, LAST_SPACE, JOIN_SPACE = range(8)
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_JOIN, IN_SPACES, ONE_LEFT, TWO_LEFT = range(8)
#: The White_Space property of Unicode.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces whose merges a worker remembers.
CACHE_PIECES = 1 << 17
#: Longer pieces are merged one by one, with a heap.
LONG_PIECE = 64
_BLOCK = 256


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space (``SPACES``) or other."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[WHITE_SPACE] = SPACES
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at the symbol."""
    if symbol == LETTER:
        if state == ONE_LEFT:
            return BEGIN, False
        if state == TWO_LEFT:
            return ONE_LEFT, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_JOIN)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_JOIN)
    if symbol in (OTHER, QUOTE_1, QUOTE_2):
        if state in (IN_OTHERS, AFTER_JOIN):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, QUOTE_1: ONE_LEFT, QUOTE_2: TWO_LEFT}[symbol], True
    if symbol == SPACES:
        return IN_SPACES, state != IN_SPACES
    return (AFTER_JOIN if symbol == JOIN_SPACE else BEGIN), True


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol (+ 8: first of a text), composition table, state reached by a function, piece starts."""
    states = range(8)
    functions = [tuple(_step(s, symbol)[0] for s in states) for symbol in range(8)]
    functions += [(f[BEGIN],) * 8 for f in functions]
    known = {tuple(states): 0}
    order = [tuple(states)]
    pending = list(functions)
    while pending:
        f = pending.pop()
        if f not in known:
            known[f] = len(order)
            order.append(f)
            pending += [tuple(g[f[s]] for s in states) for g in functions]
    reached = np.array(order, dtype=np.uint8)
    size = len(order)
    compose = np.array([[known[tuple(g[f[s]] for s in states)] for g in order] for f in order], dtype=np.uint16)
    begins = np.array([[_step(s, symbol)[1] for symbol in range(8)] for s in states])
    begins = np.concatenate([begins, np.ones((8, 8), dtype=bool)], axis=1)
    return np.array([known[f] for f in functions], np.uint16), compose.reshape(size * size), reached, begins


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """State before every symbol, by a blocked scan over composed transition functions."""
    function, compose, reached, _ = _automaton()
    size, n = len(reached), len(symbols)
    rows = -(-n // _BLOCK)
    padded = np.zeros(rows * _BLOCK, dtype=np.uint16)
    padded[:n] = function[symbols]
    scan = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
    for k in range(1, _BLOCK):
        scan[k] = compose.take(scan[k - 1].astype(np.int32) * size + scan[k])
    entry = np.zeros(rows, dtype=np.uint8)
    step = reached.tolist()
    state = BEGIN
    for row, total in enumerate(scan[-1].tolist()):
        entry[row] = state
        state = step[total][state]
    states = np.empty((_BLOCK, rows), dtype=np.uint8)
    states[0] = entry
    states[1:] = reached.reshape(-1).take(scan[:-1].astype(np.int32) * 8 + entry)
    return states.T.reshape(-1)[:n]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which pieces begin in the texts ``data[offsets[i]:offsets[i + 1]]``."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        lead, place = code[wide], at[wide]
        length = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & np.where(length == 2, 0x1F, np.where(length == 3, 0x0F, 0x07))
        for k in range(1, 4):
            more = length > k
            value[more] = (value[more] << 6) | (data[place[more] + k] & 0x3F)
        code[wide] = value
    kind = _classes()[code]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    first = first[at]
    n = len(code)
    last = np.ones(n, dtype=bool)
    last[:-1] = first[1:]
    following = np.full(n, SPACES, dtype=np.uint8)
    following[:-1] = kind[1:]
    following[last] = SPACES
    symbols = kind.copy()
    single = (kind == SPACES) & (following != SPACES)
    symbols[single] = LAST_SPACE
    symbols[single & (code == 0x20)] = JOIN_SPACE
    quotes = np.flatnonzero((code == 0x27) & ~last)
    if len(quotes):
        one = code[quotes + 1]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        symbols[quotes[short]] = QUOTE_1
        long = quotes[~last[quotes + 1] & (quotes + 2 < n)]
        one, two = code[long + 1], code[np.minimum(long + 2, n - 1)]
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        symbols[long[pair]] = QUOTE_2
    symbols[first] += 8
    _, _, _, begins = _automaton()
    return at[begins.reshape(-1).take(_states_before(symbols).astype(np.int32) * 16 + symbols)]


class Merger:
    """Ids of pieces by lowest-rank pair merging, remembered per piece.

    Unknown pieces of a slice are merged together, one merge of each at a time, on arrays of token ids.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[bytes, bytes] = {}  # piece to its ids as int32
        self.width = max(ranks.values(), default=0) + 1
        joined = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    joined[left * self.width + right] = rank
        self.keys = np.array(sorted(joined), dtype=np.int64)
        self.merged = np.array([joined[k] for k in self.keys.tolist()] + [self.width], dtype=np.int64)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)

    def ids(self, pieces: list[bytes]) -> np.ndarray:
        """The ids of all pieces, one after another."""
        distinct = set(pieces)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known = {p: self.known[p] for p in distinct.intersection(self.known)}
        known, ranks = self.known, self.ranks
        by_length: dict[int, list[bytes]] = {}
        for piece in new:
            rank = ranks.get(piece)
            if rank is not None:
                known[piece] = rank.to_bytes(4, sys.byteorder)
            elif len(piece) > LONG_PIECE:
                known[piece] = np.array(self._merge_long(piece), dtype=np.int32).tobytes()
            else:
                by_length.setdefault(len(piece), []).append(piece)
        for length, group in by_length.items():
            known.update(zip(group, self._merge_group(group, length)))
        return np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype=np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two adjacent ones give; ``width`` if none."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys.take(at, mode="clip") == key, self.merged[at], self.width)

    def _merge_group(self, group: list[bytes], length: int) -> list[bytes]:
        token = self.byte_ids[np.frombuffer(b"".join(group), np.uint8)].reshape(len(group), length)
        pair = self._pairs(token[:, :-1], token[:, 1:])
        order = np.arange(len(group))
        out = [b""] * len(group)

        def put(order: np.ndarray, token: np.ndarray) -> None:
            raw, size = token.astype(np.int32).tobytes(), 4 * token.shape[1]
            for k, i in enumerate(order.tolist()):
                out[i] = raw[k * size : (k + 1) * size]

        while True:
            best = pair.argmin(axis=1)
            rows = np.arange(len(best))
            rank = pair[rows, best]
            over = rank == self.width
            if over.any():
                put(order[over], token[over])
                token, pair, best, rank, order = token[~over], pair[~over], best[~over], rank[~over], order[~over]
                rows = rows[: len(order)]
            if not len(order):
                return out
            token[rows, best] = rank
            count = token.shape[1] - 1
            if count == 1:
                put(order, token[:, :1])
                return out
            # close the gap behind the merged token, then renew the pairs on both sides of it
            after = np.arange(count) > best[:, None]
            token = np.where(after, token[:, 1:], token[:, :-1])
            pair = np.where(after[:, :-1] if count > 1 else after, pair[:, 1:], pair[:, :-1])
            has_right = np.flatnonzero(best < count - 1)
            at = best[has_right]
            pair[has_right, at] = self._pairs(token[has_right, at], token[has_right, at + 1])
            has_left = np.flatnonzero(best > 0)
            at = best[has_left]
            pair[has_left, at - 1] = self._pairs(token[has_left, at - 1], token[has_left, at])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank, the leftmost of equals, until none is left; n log n in the length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here
        previous = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= n or end[middle] != stop:
                continue
            alive[middle] = False
            end[i] = stop
            if stop < n:
                previous[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := previous[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)


_RANKS: dict[str, dict[bytes, int]] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file; read once per worker."""
    if path not in _RANKS:
        with open(path, "rb") as lines:
            _RANKS[path] = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return _RANKS[path]


_MERGERS: dict[str, Merger] = {}


def _merger(path: str) -> Merger:
    """One for each worker, so that pieces stay known from task to task."""
    if path not in _MERGERS:
        _MERGERS[path] = Merger(load_ranks(path))
    return _MERGERS[path]


def _encoder(vocabulary: str, key: str):
    """From batches (key, text) to batches (key, ids, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(vocabulary)
        merger = _merger(vocabulary)
        lengths = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int32)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                begins = piece_starts(data, offsets)
                raw = data.tobytes()
                stops = np.append(begins[1:], len(raw)).tolist()
                ids = merger.ids([raw[a:b] for a, b in zip(begins.tolist(), stops)])
                size = lengths[ids]
                at = np.cumsum(size, dtype=np.int64) - size
                bounds = np.searchsorted(at, offsets).astype(np.int32)
                bounds[-1] = len(ids)
                places = (at - np.repeat(offsets[:-1], np.diff(bounds))).astype(np.int32)
                rows = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, rows),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(places)),
                    ],
                    names=[key, "ids", "starts"],
                )

    return run


def _decoder(vocabulary: str, keep: list[str], ids: str):
    """From batches with a column of ids to batches (columns of ``keep``, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(vocabulary)
        size = max(ranks.values(), default=-1) + 1
        table: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            table[rank] = token
        token = table.__getitem__
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index(ids))
            for first in range(0, batch.num_rows, 256):
                part = column.slice(first, 256)
                values = list(map(token, part.flatten().to_pylist()))
                ends = np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)).tolist()
                there = part.is_valid().to_pylist()
                out = [b"".join(values[a:b]) if valid else None for a, b, valid in zip([0, *ends], ends, there)]
                kept = [batch.column(names.index(c)).slice(first, len(out)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return run


def _texts(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    source = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return source, source.schema[key].dataType.simpleString()


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text: (key, ids array<int>, starts array<int>).

    ``vocabulary`` is the path of a rank file that every worker has. ``starts`` holds the byte offset of each token
    in the UTF-8 text, so any id can be traced to its place. Null texts: no ids.
    """
    source, kind = _texts(df, key, text)
    return source.mapInArrow(_encoder(vocabulary, key), f"`{key}` {kind}, ids array<int>, starts array<int>")


def decode(df: DataFrame, vocabulary: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Bytes that the ids stand for: (columns of ``keep``, decoded binary). Null ids: null; no ids: no bytes.

    An id outside the vocabulary is an error.
    """
    source = df.select(*dict.fromkeys([*keep, ids]))
    fields = ", ".join(f"`{name}` {source.schema[name].dataType.simpleString()}" for name in keep)
    return source.mapInArrow(_decoder(vocabulary, keep, ids), f"{fields}, decoded binary")


def encode_and_decode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` and then ``decode`` in the same workers: (key, ids, decoded)."""
    source, kind = _texts(df, key, text)
    encoder, decoder = _encoder(vocabulary, key), _decoder(vocabulary, [key, "ids"], "ids")
    return source.mapInArrow(lambda batches: decoder(encoder(batches)), f"`{key}` {kind}, ids array<int>, decoded binary")
