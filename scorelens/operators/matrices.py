"""Symmetric matrices over many columns from blocked Gram products.

Each task multiplies its row batches block against block and keeps one small square of sums per pair of blocks; the
squares are summed per pair of columns. Plans have a few expressions whatever the number of columns, no pairs of rows
are formed, and a task holds seven squares of ``BLOCK`` columns at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.storage import Scratch, materialize

#: Columns of one side of a product; more columns take one scan for each pair of blocks.
BLOCK = 512
#: A variance below this share of the second moment is rounding of a constant.
_CONSTANT = 1e-12

_SUMS = ["n", "bad", "x", "y", "xx", "yy", "xy"]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums over the rows where both sides are present, for every column of ``a`` against every one of ``b``.

    A side is (present, bad, value) by row and column, with zeros for values that are missing or not finite.
    """
    (here, bad, x), (there, worse, y) = a, b
    return np.stack([
        here.T @ there, bad.T @ there + here.T @ worse, x.T @ there, here.T @ y,
        (x * x).T @ there, here.T @ (y * y), x.T @ y,
    ])


def _block_sums(rows: DataFrame, left: range, right: range, shift: np.ndarray) -> DataFrame:
    """Partial sums of one pair of blocks, one row per task and pair of columns (i <= j)."""
    own = left == right
    wanted = list(left) if own else [*left, *right]
    centre, split = shift[wanted], len(left)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            value = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            finite = there & np.isfinite(value)
            value = np.where(finite, value, centre) - centre
            sides = [(there[:, s].astype(float), (there & ~finite)[:, s].astype(float), value[:, s])
                     for s in (slice(0, split), slice(0 if own else split, None))]
            sums = _products(*sides)
            total = sums if total is None else total + sums
        if total is None:
            return
        i, j = np.triu_indices(split) if own else (k.ravel() for k in np.indices(total.shape[1:]))
        picked = total[:, i, j]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i + left.start, pa.int32()), pa.array(j + right.start, pa.int32()), *map(pa.array, picked)],
            names=["a", "b", *_SUMS])

    schema = "a int, b int, " + ", ".join(f"{s} double" for s in _SUMS)
    chosen = F.col("row") if len(wanted) == len(shift) else F.array(*[F.col("row")[k] for k in wanted])
    return rows.select(chosen.alias("row")).mapInArrow(multiply, schema)


def pairwise(wide: DataFrame, names: list[str], measure: Column, value: str, *, centred: bool = False) -> DataFrame:
    """(i, j, ``value``) for all ordered pairs of the columns ``names``.

    ``measure`` is an expression over the pairwise-complete sums n, x, y, xx, yy, xy. With ``centred`` these are of
    values less their column's mean, which keeps small variances of large values. A pair with a NaN or an infinite
    value gives NaN, one without common rows NULL.
    """
    spark, count = wide.sparkSession, len(names)
    if not count:
        return spark.createDataFrame([], f"i string, j string, {value} double")
    with Scratch(spark) as scratch:
        rows = materialize(wide.select(F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("row")), "rows")
        shift = np.zeros(count)
        if centred:
            finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
            means = rows.select(F.posexplode("row").alias("k", "v")).groupBy("k").agg(F.avg(finite).alias("mean"))
            for k, mean in means.collect():
                shift[k] = mean if mean is not None and np.isfinite(mean) else 0.0
        blocks = [range(k, min(k + BLOCK, count)) for k in range(0, count, BLOCK)]
        parts = [_block_sums(rows, p, q, shift) for k, p in enumerate(blocks) for q in blocks[k:]]
        sums = reduce(DataFrame.union, parts).groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in _SUMS])
        # a name for each index; the names are given by the caller
        label = F.array(*[F.lit(c) for c in names])
        cells = spark.range(count * count).select((F.col("id") / count).cast("int").alias("p"), (F.col("id") % count).cast("int").alias("q"))
        cells = cells.withColumns({"a": F.least("p", "q"), "b": F.greatest("p", "q")})
        found = F.when(F.col("bad") > 0, F.lit(float("nan"))).when(F.col("n") > 0, measure)
        result = cells.join(sums, ["a", "b"], "left").select(label[F.col("p")].alias("i"), label[F.col("q")].alias("j"), found.alias(value))
        kept = scratch.keep(result, "matrix")
    return kept


def _variance(total: str, squares: str) -> Column:
    spread = F.col(squares) - F.col(total) * F.col(total) / F.col("n")
    return F.when(spread > _CONSTANT * F.col(squares), spread)


def pearson() -> Column:
    """Of centred sums; NULL when either side has no variance."""
    joint = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    return joint / (F.sqrt(_variance("x", "xx")) * F.sqrt(_variance("y", "yy")))


def cosine() -> Column:
    """Of plain sums; NULL when either side is zero."""
    return F.try_divide(F.col("xy"), F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0)))
