"""Pair joins, exact-size splits and batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.functions.text import text_variants
from scorelens.operators.ranks import ordered_index
from scorelens.storage import join_on, materialize


def pair(left: DataFrame, right: DataFrame, key: str = "sample_id", *, how: str = "inner") -> DataFrame:
    """Pair two corpora on an explicit key; samples on one side only are dropped by the inner form."""
    return left.join(right, key, how)


def pair_counts(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """How many keys are on both sides or on one only."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.agg(
        F.count(F.when((F.col("l") == 1) & (F.col("r") == 1), 1)).alias("paired"),
        F.count(F.when(F.col("r") == 0, 1)).alias("left_only"),
        F.count(F.when(F.col("l") == 0, 1)).alias("right_only"),
    )


def compose_variants(pairs: DataFrame, *, key: str = "sample_id", sep: str = " ") -> DataFrame:
    """Five (sample, variant, text) rows per pair."""
    variants = text_variants(F.col("prompt"), F.col("original_output"), F.col("detoxified_output"), sep=sep)
    return pairs.select(key, F.inline(variants))


BOUNDARY_ROWS = 10_000


def _bucket_counts(df: DataFrame, bucket: Column, *extra: Column) -> DataFrame:
    """Rows per bucket; a bucket has at most 65 536 values."""
    return df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), *extra)


def _bucket_of(counts: DataFrame, rows: int):
    """Bucket that holds row number ``rows``, its size, and the row's number inside it.

    Buckets must not decrease along the order of the rows.
    """
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.withColumn("through", F.sum("n").over(w))
        .where(F.col("through") >= rows)
        .orderBy("b")
        .limit(1)
        .withColumn("inside", F.lit(rows) - F.col("through") + F.col("n"))
        .first()
    )


def _edge(df: DataFrame, order: list[Column], rows: int) -> list:
    """Order values of row number ``rows`` of a small table."""
    names = [f"o{i}" for i in range(len(order))]
    ordered = df.select(*[c.alias(n) for c, n in zip(order, names)]).orderBy(*names).limit(rows)
    edge = ordered.agg(F.max(F.struct(*names)).alias("edge")).first()["edge"]
    return [edge[n] for n in names]


def _through(order: list[Column], edge: list) -> Column:
    """True for rows up to and including the edge in lexicographic order."""
    result = order[-1] <= F.lit(edge[-1])
    for column, value in reversed(list(zip(order[:-1], edge[:-1]))):
        result = (column < F.lit(value)) | ((column == F.lit(value)) & result)
    return result


def _label(df: DataFrame, first: Column, names: tuple[str, str]) -> DataFrame:
    return df.withColumn("split", F.when(first, F.lit(names[0])).otherwise(F.lit(names[1])))


def split_by_hash(
    df: DataFrame, key: str, ratio: float = 0.8, *, seed: int = 42, names: tuple[str, str] = ("train", "test"),
    unique: bool = False,
) -> DataFrame:
    """Seeded random split with exactly floor(ratio * n) of the n distinct keys in the first part.

    All rows of a key are on one side. ``unique`` says that no key repeats, which saves making keys distinct.
    Keys are ordered by the md5 of the seed and key. Counts per hash prefix find the prefix of the row that ends
    the first part, and longer prefixes follow until few rows are left; the split is then a comparison per row,
    without a sort or shuffle of the table. Only scalars reach the driver.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    length = 4
    keys = df.select(key) if unique else df.select(key).distinct()
    counts = materialize(_bucket_counts(keys, F.substring(digest, 1, length)), "buckets")
    rows = math.floor(ratio * (counts.agg(F.sum("n")).first()[0] or 0))
    if rows == 0:
        return _label(df, F.lit(False), names)
    hit = _bucket_of(counts, rows)
    while True:
        part, rows = keys.where(F.substring(digest, 1, length) == hit["b"]), hit["inside"]
        if hit["n"] <= BOUNDARY_ROWS or length == 32:
            break
        length += 4
        hit = _bucket_of(_bucket_counts(part, F.substring(digest, 1, length)), rows)
    order = [digest, F.col(key)]
    return _label(df, _through(order, _edge(part, order, rows)), names)


def split_by_order(
    df: DataFrame, key: str, ratio: float = 0.8, *, names: tuple[str, str] = ("train", "test")
) -> DataFrame:
    """First floor(ratio * n) rows in the order of a unique key.

    A numeric key needs counting passes over ever narrower ranges; other keys are ordered with ``ordered_index``.
    """
    k = F.col(key)
    total, low, high = df.agg(F.count("*"), F.min(key), F.max(key)).first()
    rows = math.floor(ratio * total)
    if rows == 0:
        return _label(df, F.lit(False), names)
    if not isinstance(df.schema[key].dataType, T.NumericType):
        placed = ordered_index(df, [], [key], "_position")
        return _label(placed, F.col("_position") <= rows, names).drop("_position")
    part = df
    while low != high:
        share = (k - F.lit(low)).cast("double") / F.lit(float(high - low))
        bucket = F.least(F.floor(share * 65536), F.lit(65535))
        hit = _bucket_of(_bucket_counts(part, bucket, F.min(key).alias("low"), F.max(key).alias("high")), rows)
        low, high, rows = hit["low"], hit["high"], hit["inside"]
        part = df.where(k.between(F.lit(low), F.lit(high)))
        if hit["n"] <= BOUNDARY_ROWS:
            low = high = _edge(part, [k], rows)[0]
    return _label(df, k <= F.lit(high), names)


def split_by_threshold(
    df: DataFrame, key: str, ratio: float = 0.8, *, seed: int = 42, names: tuple[str, str] = ("train", "test")
) -> DataFrame:
    """Approximate-size random split by hash threshold; needs no pass over the table."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)
    return df.withColumn("split", F.when(unit < ratio, F.lit(names[0])).otherwise(F.lit(names[1])))


def identical_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose outputs are equal, and their percent."""
    same = F.col("original_output") == F.col("detoxified_output")
    return pairs.agg(
        F.count(F.when(same, 1)).alias("identical"),
        F.count("*").alias("pairs"),
        F.coalesce(F.try_divide(100.0 * F.count(F.when(same, 1)), F.count("*")), F.lit(0.0)).alias("percent"),
    )


def with_experiment(results: DataFrame, experiments: DataFrame, key: str = "experiment") -> DataFrame:
    """Add experiment settings; the dimension is written first and broadcast when its measured size allows."""
    return join_on(results, materialize(experiments, "experiments"), [key])


def complete_pairs(paired: DataFrame, *columns: str) -> DataFrame:
    """Rows where all the listed scores are present and not NaN."""
    return paired.dropna(subset=list(columns))


def shuffled_batches(pairs: DataFrame, key: str, batch_size: int, *, seed: int = 42) -> DataFrame:
    """Seeded permutation cut into consecutive batches; a pair stays one row, so its sides stay aligned."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    placed = ordered_index(pairs.withColumn("_digest", digest), [], ["_digest", key], "_position")
    return placed.withColumn("batch_id", F.floor((F.col("_position") - 1) / batch_size)).drop("_digest", "_position")


def assign_index(df: DataFrame, order_by: list[str], name: str = "sample_index") -> DataFrame:
    """0-based row index in the given order."""
    return ordered_index(df, [], order_by, name).withColumn(name, F.col(name) - 1)


def split(df: DataFrame, key: str, ratio: float = 0.8, *, by: str = "hash", seed: int = 42, **options) -> DataFrame:
    """Exact split ``by`` hash or order, or the pass-free ``threshold`` form."""
    if by == "order":
        return split_by_order(df, key, ratio, **options)
    return {"hash": split_by_hash, "threshold": split_by_threshold}[by](df, key, ratio, seed=seed, **options)
