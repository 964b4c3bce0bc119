"""Curve geometry, equal runs, and places read back from files."""

import zlib
from itertools import product

import numpy as np
import pytest

from scorelens.llm.hilbert_shards import curve_index
from scorelens.llm.hilbert_shards_query import placement


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_and_moves_one_step(dims, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dims))).T
    index = curve_index(cells, bits)
    assert sorted(index.tolist()) == list(range(1 << (bits * dims)))
    path = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def check(rows, n_shards, got):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = [r.curve_index for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_runs_are_equal_and_in_curve_order(spark):
    rows = [(i, "wörd " * (i % 37) if i % 9 else None, ["en", "de", None][i % 3], f"src{i % 7 if i % 3 else 0}", i) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    check(rows, 40, placement(docs).collect())


def test_repeated_rows_nulls_clashing_columns_few_rows_and_none(spark):
    rows = [(7, "same", "en", "a", 1)] * 23 + [(None, None, None, None, None), (8, "", "", "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard long")
    check(rows, 4, placement(docs, 4).collect())
    check(rows[:2], 4, placement(docs.limit(2), 4).collect())
    assert placement(docs.filter("false"), 4).collect() == []
