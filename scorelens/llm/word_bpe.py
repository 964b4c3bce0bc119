"""Byte-level BPE by a distinct-word table.

Encoding: Spark splits every text into words. Documents are gathered in blocks of about ``BLOCK_BYTES`` bytes of text;
a block is stored as the list of its distinct words and, for every place in its documents, the position of the word in
that list, packed in pages. The lists of all blocks give one table of distinct words, and each distinct word is encoded once. Ids come
back to (block, position) by a join on the word, and the documents pick them up by position.

Decoding: the distinct ids of a block are joined with the table of ids and pieces, and the documents' ids pick their
pieces up.

Only the words of a block's list are shuffled, not their occurrences. A word that stands in every block has one row a
block; words of ``HOT_BLOCKS`` blocks or more are few and are joined as a table of their own. A block is one
row, so what a task holds follows the block's distinct words, its packed positions and the longest text.

Rules: null and empty texts have no ids and decode to an empty string. Repeated rows and rows with a null key are coded
like others. Extra columns are dropped. A special token of the vocabulary file that stands in a text is its special id,
and the text before and after it is split apart, as the tokenizer library does by default.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.operators.ranks import join_hot_values
from scorelens.storage import Scratch, materialize

#: Bytes of text a block.
BLOCK_BYTES = 32 << 20
#: Bytes of text a page: what is unpacked at once.
PAGE_BYTES = 2 << 20
#: Words of so many blocks are joined apart.
HOT_BLOCKS = 100_000
#: Level of the compression of packed numbers.
PACK_LEVEL = 9
#: Options of the tables that lie beside large shuffles.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(PACK_LEVEL)}
#: Longer words are merged with a heap.
LONG_WORD = 64
_ID_BITS = 24
_ID_MASK = (1 << _ID_BITS) - 1
_NO_MERGE = 1 << 62
#: The first code point of those that NEW_LETTERS and NEW_NUMBERS list.
_FIRST_NEW = "870"

# Letters and numbers that Unicode 14 to 16 added. The classes of the Java in use may be older.
NEW_LETTERS = """
870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3
A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC
105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075
1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10
11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB
1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0
1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF
"""
NEW_NUMBERS = """
10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9
1E5F1-1E5FA
"""
#: The White_Space property of Unicode.
WHITE_SPACE = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _class(known: str, listed: str) -> str:
    """A class and newer code points; these are only looked up from the first of them on."""
    ranges = "".join("-".join(rf"\x{{{end}}}" for end in item.split("-")) for item in listed.split())
    return rf"{known}[\x{{{_FIRST_NEW}}}-\x{{10FFFF}}&&[{ranges}]]"


@lru_cache(maxsize=2)
def word_pattern(newer: bool) -> str:
    """The splitting rule of the vocabulary with its classes written out: short forms, letters, numbers, others, spaces."""
    letters, numbers = (_class(r"\p{L}", NEW_LETTERS), _class(r"\p{N}", NEW_NUMBERS)) if newer else (r"\p{L}", r"\p{N}")
    short = "'(?:s|t|re|ve|m|ll|d)"
    runs = f" ?+[{letters}]++| ?+[{numbers}]++| ?+[^{letters}{numbers}{WHITE_SPACE}]++"
    return f"{short}|{runs}|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]++"


def _quoted(token: str) -> str:
    return r"\Q" + token.replace(r"\E", r"\E\\E\Q") + r"\E"


def split_words(text: Column, special: list[str]) -> Column:
    """Words of a text in order; special tokens are words of their own."""

    def words(part: Column, newer: bool = True) -> Column:
        return F.regexp_extract_all(part, F.lit(word_pattern(newer)), F.lit(0))

    # texts without code points that could be new are split by the shorter classes
    plain = F.when(text.rlike(rf"[\x{{{_FIRST_NEW}}}-\x{{10FFFF}}]"), words(text)).otherwise(words(text, False))
    if not special:
        return plain
    either = "|".join(_quoted(s) for s in special)
    found = F.regexp_extract_all(text, F.lit(f"({either})"), F.lit(0))
    nothing = F.array().cast("array<string>")
    apart = F.flatten(F.zip_with(
        F.split(text, either, -1), found,
        lambda part, token: F.concat(words(part), F.when(token.isNotNull(), F.array(token)).otherwise(nothing)),
    ))
    holds = F.lit(False)
    for token in special:
        holds = holds | F.contains(text, F.lit(token))
    return F.when(holds, apart).otherwise(plain)


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        # bytes that print as themselves keep their character, the others follow from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        char = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
        byte = {c: b for b, c in char.items()}
        ids = model["vocab"]
        self.byte_ids = [ids[char[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.pieces = {i: bytes(byte[c] for c in piece) for piece, i in ids.items()}
        self.pieces |= {i: token.encode() for token, i in self.special.items()}
        #: how an id is packed
        self.packed = np.dtype("<u2") if max(self.pieces, default=0) < 1 << 16 else np.dtype("<u4")
        #: by left and right id: rank and merged id
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left] << _ID_BITS | ids[right]] = rank << _ID_BITS | ids[left + right]

    def word_ids(self, word: str) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
        if word in self.special:
            return [self.special[word]]
        token = [self.byte_ids[b] for b in word.encode()]
        if len(token) > LONG_WORD:
            return self._merge_long(token)
        look = self.merges.get
        ranks = [look(a << _ID_BITS | b, _NO_MERGE) for a, b in zip(token, token[1:])]
        while ranks and (best := min(ranks)) != _NO_MERGE:
            i = ranks.index(best)
            token[i] = best & _ID_MASK
            del token[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = look(token[i] << _ID_BITS | token[i + 1], _NO_MERGE)
            if i:
                ranks[i - 1] = look(token[i - 1] << _ID_BITS | token[i], _NO_MERGE)
        return token

    def _merge_long(self, token: list[int]) -> list[int]:
        """The same with a heap; n log n in the length."""
        n, look = len(token), self.merges.get
        heap = [(m, i, token[i], token[i + 1]) for i in range(n - 1) if (m := look(token[i] << _ID_BITS | token[i + 1])) is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue
            token[i], token[j] = best & _ID_MASK, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := look(token[i] << _ID_BITS | token[k])) is not None:
                    heapq.heappush(heap, (m, i, token[i], token[k]))
            if (p := before[i]) >= 0 and (m := look(token[p] << _ID_BITS | token[i])) is not None:
                heapq.heappush(heap, (m, p, token[p], token[i]))
        return [t for t in token if t >= 0]


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> Vocabulary:
    """Read once per worker."""
    return Vocabulary(path)


def _squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=PACK_LEVEL).compress(data, asbytes=True)


def _pack(numbers: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes; the lowest bytes of numbers below 256 lie apart, as they are spread otherwise."""
    values = numbers.astype("<i4")
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T)
    small = values < 256
    return len(values).to_bytes(8, "little") + _squeeze(planes[1:].tobytes() + planes[0][small].tobytes() + planes[0][~small].tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    data = np.frombuffer(pa.decompress(packed[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    planes = np.empty((4, n), np.uint8)
    planes[1:] = data[: 3 * n].reshape(3, n)
    small = ~planes[1:].any(axis=0)
    count = int(small.sum())
    planes[0][small], planes[0][~small] = data[3 * n : 3 * n + count], data[3 * n + count :]
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


class _Block:
    """Documents of a block as they come: distinct items in order of appearance, so that frequent ones have small positions."""

    def __init__(self, number: int):
        self.number, self.position, self.held = number, {}, 0
        self.keys, self.sizes, self.rows, self.pages = [], [], [], []

    def add(self, keys: pa.Array, lists: pa.Array) -> None:
        """One page."""
        coded = lists.flatten().dictionary_encode()
        position = self.position
        known = np.array([position.setdefault(item, len(position)) for item in coded.dictionary.to_pylist()], np.int32)
        places = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else known
        self.keys.append(keys)
        self.sizes.append(pc.fill_null(pc.list_value_length(lists), -1).cast(pa.int32()))
        self.rows.append(len(keys))
        self.pages.append(_pack(places))

    def row(self, item_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.concat_arrays(self.keys), pa.concat_arrays(self.sizes), pa.array(self.rows, pa.int32()),
                   pa.array(self.pages, pa.binary()), pa.array(list(self.position), item_type)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), *lists], names=["block", "keys", "sizes", "rows", "pages", "items"])


def _weights(lists: pa.Array) -> np.ndarray:
    """Bytes of the items of every row, summed up to the row."""
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    items = lists.flatten()
    if pa.types.is_integer(items.type):
        return np.cumsum(length * 4)
    through = np.concatenate([[0], np.cumsum(pc.binary_length(items).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return through[np.cumsum(length)]


def _into_blocks(limit: int, item_type: pa.DataType):
    """From batches (key, list of items) to one row a block; an item weighs its bytes."""
    page = min(limit, PAGE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            through = _weights(batch.column(1))
            first = before = 0
            while first < batch.num_rows:
                # whole rows up to a page, at least one
                stop = max(first + 1, int(np.searchsorted(through, before + page, side="right")))
                block.add(batch.column(0).slice(first, stop - first), batch.column(1).slice(first, stop - first))
                block.held += int(through[stop - 1]) - before
                first, before = stop, int(through[stop - 1])
                if block.held >= limit:
                    yield block.row(item_type)
                    block = _Block(block.number + 1)
        if block.rows:
            yield block.row(item_type)

    return run


def _blocks(source: DataFrame, key: str, items: str, item_type: str, limit: int) -> DataFrame:
    kind = source.schema[key].dataType.simpleString()
    fields = f"block long, keys array<{kind}>, sizes array<int>, rows array<int>, pages array<binary>, items array<{item_type}>"
    arrow = pa.string() if item_type == "string" else pa.int32()
    return materialize(source.select(key, items).mapInArrow(_into_blocks(limit, arrow), fields), "blocks", **PACKED)


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n) with the packed ids of every word: (word, n, ids binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary_of(vocabulary)
        for batch in batches:
            ids = [np.array(known.word_ids(w), known.packed).tobytes() for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, ids binary")


def _by_position(entries: DataFrame, vocabulary: str) -> DataFrame:
    """(block, pos, ids) to one row a block: the ids of its words by position, end to end, and their numbers, both packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = vocabulary_of(vocabulary).packed
        for batch in batches:
            for row in range(batch.num_rows):
                ids = _pack(np.frombuffer(batch.column(1)[row].as_py(), kind))
                lengths = _pack(_values(batch, "word_sizes", row).to_numpy(zero_copy_only=False) // kind.itemsize)
                columns = [batch.column(0).slice(row, 1), pa.array([ids], pa.binary()), pa.array([lengths], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "word_ids", "word_sizes"])

    ordered = entries.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("_words"))
    joined = ordered.select(
        "block",
        F.array_join(F.transform("_words", lambda e: e["ids"].cast("string")), "").cast("binary").alias("word_ids"),
        F.transform("_words", lambda e: F.octet_length(e["ids"])).alias("word_sizes"),
    )
    return joined.mapInArrow(run, "block long, word_ids binary, word_sizes binary")


def _used(word_ids: DataFrame) -> DataFrame:
    """(block, id): the distinct ids of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.unique(_unpack(packed.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block, np.int64)), pa.array(ids)], names=["block", "id"])

    return word_ids.select("block", "word_ids").mapInArrow(run, "block long, id int")


def _pieces(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(id, piece); as large as the vocabulary."""
    rows = pa.table({"id": pa.array(list(vocabulary_of(vocabulary).pieces), pa.int32()),
                     "piece": pa.array(list(vocabulary_of(vocabulary).pieces.values()), pa.binary())})
    return materialize(spark.createDataFrame(rows), "pieces")


def _piece_lists(ids: DataFrame, vocabulary: str) -> DataFrame:
    """(block, id), distinct, joined with the pieces: one row a block with ``used`` (ids) and ``pieces``."""
    joined = ids.join(_pieces(ids.sparkSession, vocabulary), "id")
    pairs = F.sort_array(F.collect_list(F.struct("id", "piece")))
    return joined.groupBy("block").agg(pairs.alias("_pairs")).select(
        "block", F.transform("_pairs", lambda p: p["id"]).alias("used"), F.transform("_pairs", lambda p: p["piece"]).alias("pieces")
    )


class _Decoder:
    """Texts of ids by the pieces of a block; ids without a piece stand for nothing, invalid UTF-8 becomes replacement signs."""

    def __init__(self, used: pa.Array, pieces: pa.Array):
        known = used.to_numpy(zero_copy_only=False)
        self.limit = int(known[-1]) + 1 if len(known) else 0
        self.slot = np.full(self.limit + 1, len(known), np.int64)
        self.slot[known] = np.arange(len(known))
        self.length = np.append(pc.binary_length(pieces).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(pieces.to_pylist()), np.uint8)

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        at = self.slot[np.where((ids < 0) | (ids > self.limit), self.limit, ids)]
        size = self.length[at]
        through = np.concatenate([[0], np.cumsum(size)])
        raw = self.data[np.repeat(self.first[at] - through[:-1], size) + np.arange(through[-1])].tobytes()
        stops = through[ends].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops], stops)]


def _values(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    """The list in one row; an empty one for null."""
    column = batch.column(batch.schema.names.index(name))
    return column.slice(row, 1).flatten()


def _pages(batch: pa.RecordBatch, row: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, sizes (-1: null) and places of the documents of each page of a block."""
    keys, sizes = _values(batch, "keys", row), _values(batch, "sizes", row).to_numpy(zero_copy_only=False)
    first = 0
    for count, packed in zip(_values(batch, "rows", row).to_pylist(), _values(batch, "pages", row)):
        yield keys.slice(first, count), sizes[first : first + count], _unpack(packed.as_py())
        first += count


def _pick_ids(key: str, decoded: bool):
    """From blocks with the ids of their words to documents (key, ids[, decoded])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                # null: a block without words
                word_ids, sizes = (batch.column(batch.schema.names.index(c))[row].as_py() for c in ("word_ids", "word_sizes"))
                length = _unpack(sizes or _pack(np.array([], np.int32))).astype(np.int64)
                bounds = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                lists = pa.ListArray.from_arrays(bounds, pa.array(_unpack(word_ids or _pack(np.array([], np.int32)))))
                decoder = _Decoder(_values(batch, "used", row), _values(batch, "pieces", row)) if decoded else None
                for keys, sizes, places in _pages(batch, row):
                    ids = lists.take(pa.array(places)).flatten() if len(places) else pa.array([], pa.int32())
                    through = np.concatenate([[0], np.cumsum(length[places])])
                    ends = through[np.cumsum(sizes)]
                    bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
                    columns = [keys, pa.ListArray.from_arrays(bounds, ids)]
                    if decoder:
                        columns.append(pa.array(decoder.texts(ids.to_numpy(zero_copy_only=False), ends), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "decoded"][: len(columns)])

    return run


def _encoded_blocks(df: DataFrame, vocabulary: str, key: str, text: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Blocks without their words, and the ids of these by position."""
    special = list(vocabulary_of(vocabulary).special)
    words = split_words(F.coalesce(F.col(text).cast("string"), F.lit("")), special)
    with Scratch(df.sparkSession) as scratch:
        blocks = _blocks(df.select(key, words.alias("_words")), key, "_words", "string", limit)
        entries = blocks.select("block", F.posexplode("items").alias("pos", "word"))
        # every table goes as soon as the next one is written, and so do the shuffle files of each join
        with Scratch(df.sparkSession) as inner:
            # sorted words compress better
            counted = entries.groupBy("word").agg(F.count("*").alias("n")).sortWithinPartitions("word")
            distinct = materialize(encode_words(counted, vocabulary), "words", **PACKED)
            joined = join_hot_values(entries, distinct, ["word"], "ids", HOT_BLOCKS).select("block", "pos", "ids")
            joined = inner.keep(joined, "joined", **PACKED)
        word_ids = scratch.keep(_by_position(joined, vocabulary), "word_ids", compression="zstd")
        return scratch.keep(blocks.drop("items"), "pages", compression="zstd"), word_ids


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token ids of every text: (key, ids array<int>). ``vocabulary`` is the path of a file that every worker has."""
    blocks, word_ids = _encoded_blocks(df, vocabulary, key, text, block_bytes)
    kind = df.schema[key].dataType.simpleString()
    return blocks.join(word_ids, "block", "left").mapInArrow(_pick_ids(key, False), f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids", *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts that ids stand for: (key, decoded). Null ids: null. An id that is not in the vocabulary stands for nothing."""
    source = df.select(F.col(key), F.col(ids).cast("array<int>").alias("_ids"))
    blocks = _blocks(source, key, "_ids", "int", block_bytes)
    lists = materialize(_piece_lists(blocks.select("block", F.explode("items").alias("id")), vocabulary), "piece_lists")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                items = _values(batch, "items", row).to_numpy(zero_copy_only=False)
                decoder = _Decoder(_values(batch, "used", row), _values(batch, "pieces", row))
                for keys, sizes, places in _pages(batch, row):
                    ends = np.cumsum(np.maximum(sizes, 0))
                    texts = [None if n < 0 else t for n, t in zip(sizes.tolist(), decoder.texts(items[places], ends))]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(texts, pa.string())], names=[key, "decoded"])

    return blocks.join(lists, "block", "left").mapInArrow(run, f"`{key}` {kind}, decoded string")


def encode_and_decode(
    df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", *, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``encode``, then ``decode`` of the ids block by block: (key, ids, decoded)."""
    blocks, word_ids = _encoded_blocks(df, vocabulary, key, text, block_bytes)
    lists = materialize(_piece_lists(_used(word_ids), vocabulary), "piece_lists")
    kind = df.schema[key].dataType.simpleString()
    joined = blocks.join(word_ids, "block", "left").join(lists, "block", "left")
    return joined.mapInArrow(_pick_ids(key, True), f"`{key}` {kind}, ids array<int>, decoded string")
