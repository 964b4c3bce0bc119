"""Exact positions, running totals and fractional ranks for groups of any size.

No step puts a whole group into one task: rows are range partitioned by (group, order), numbered inside their
partition, and shifted by the sizes of the earlier partitions of the same group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.storage import join_on, materialize


def _columns(order):
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ordered_index(df: DataFrame, by: list[str], order: list, name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in its group under ``order``.

    ``order`` should end with a unique key: it fixes the result and lets the range partitioner split a value
    that holds a large share of the rows.
    """
    placed = materialize(
        df.orderBy(*by, *_columns(order))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id()),
        "ordered",
    )
    groups = by or ["_all"]
    if not by:
        placed = placed.withColumn("_all", F.lit(0))
    # at most (groups + partitions) rows
    starts = placed.groupBy(*groups, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *groups, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    starts = materialize(starts, "starts")
    return (
        join_on(placed, starts, [*groups, "_part"])
        .withColumn(name, F.col("_seq") + F.col("_shift"))
        .drop("_part", "_seq", "_shift", "_all")
    )


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; NULL equals NULL and NaN equals NaN."""
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([a != b for a, b in zip(values, values[1:])], dtype=bool)
    left, right = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.fill_null(pc.not_equal(left, right), True)
    both = pc.and_(pc.is_null(left, nan_is_null=True), pc.is_null(right, nan_is_null=True))
    return pc.and_(differ, pc.invert(both)).to_numpy(zero_copy_only=False)


def _prefix_sums(by: list[str], sums: dict[str, str]):
    """Running sums of each group within a sorted partition.

    Added columns: the sums, ``_part``, ``_head`` (the row belongs to the partition's first group) and ``_edge`` (1 for the
    first row of the partition, 2 for the last, 3 for both).
    """

    def summed(batch: pa.RecordBatch, begins: np.ndarray, carry: dict) -> dict[str, np.ndarray]:
        start = np.flatnonzero(begins)
        segment = np.cumsum(begins) - 1
        out = {}
        for name, source in sums.items():
            column = pc.fill_null(batch.column(batch.schema.names.index(source)), 0)
            kind = np.float64 if pa.types.is_floating(column.type) else np.int64
            values = column.to_numpy(zero_copy_only=False).astype(kind)
            total = np.cumsum(values)
            # what was added up before the segment; the first one may go on from the last batch
            before = np.concatenate([[-carry[name] if not begins[0] else kind(0)], total[start[start > 0] - 1]]).astype(kind)
            out[name] = total - before[segment if begins[0] else segment + 1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carry, head, held = None, {}, True, None
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            keys = [batch.column(batch.schema.names.index(c)) for c in by]
            begins = np.zeros(rows, dtype=bool)
            begins[0] = last is None
            for k, column in enumerate(keys):
                begins[1:] |= _changes(column)
                if last is not None:
                    begins[0] |= bool(_changes(pa.concat_arrays([last[k], column.slice(0, 1)]))[0])
            totals = summed(batch, begins, carry)
            fresh = begins.copy()
            fresh[0] &= last is not None
            heads = (np.cumsum(fresh) == 0) & head
            edge = np.zeros(rows, dtype=np.int8)
            edge[0] = last is None
            if held is not None:
                yield held
            head = bool(heads[-1])
            last = [column.slice(rows - 1) for column in keys]
            carry = {name: values[-1] for name, values in totals.items()}
            held = pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(v) for v in totals.values()], pa.array(np.full(rows, part, np.int32)), pa.array(heads), pa.array(edge)],
                names=[*batch.schema.names, *[f"_local_{name}" for name in totals], "_part", "_head", "_edge"],
            )
        if held is not None:
            edge = held.column(held.num_columns - 1).to_numpy(zero_copy_only=False).copy()
            edge[-1] += 2
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(edge)], names=held.schema.names)

    return run


def running_totals(df: DataFrame, by: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """Add inclusive running sums ``{output: input}`` in ``order`` within each group; NULL adds nothing.

    ``order`` must be unique inside a group. The rows are range partitioned and sorted once, summed up where they lie and
    written. Only a group that goes on from one partition to the next needs what came before: at most one number for each
    partition, which is joined by partition, so no row is shuffled again.
    """
    inputs = {c: df.schema[c].dataType for c in sums.values()}
    kinds = {o: "double" if isinstance(inputs[c], (T.DoubleType, T.FloatType)) else "long" for o, c in sums.items()}
    fields = [T.StructField(f.name, f.dataType) for f in df.schema]
    schema = T.StructType(fields + [T.StructField(f"_local_{o}", T.DoubleType() if k == "double" else T.LongType()) for o, k in kinds.items()]
                          + [T.StructField("_part", T.IntegerType()), T.StructField("_head", T.BooleanType()), T.StructField("_edge", T.ByteType())])
    placed = materialize(df.orderBy(*by, *_columns(order)).mapInArrow(_prefix_sums(by, sums), schema), "summed")
    edges = materialize(placed.where("_edge > 0").select(*by, "_part", "_edge", *[f"_local_{o}" for o in sums]), "edges")
    # of each partition the group that ends it, with its sum, and the group that begins it
    last = F.col("_edge") >= 2
    marks = edges.groupBy(*by, "_part").agg(
        F.max(F.col("_edge") % 2).alias("_begins"), *[F.max(F.when(last, F.col(f"_local_{o}"))).alias(f"_sum_{o}") for o in sums]
    )
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marks.select(
        "_part", "_begins", *[F.coalesce(F.sum(f"_sum_{o}").over(earlier), F.lit(0)).cast(kinds[o]).alias(f"_before_{o}") for o in sums]
    )
    starts = materialize(starts.where("_begins = 1").drop("_begins").withColumnRenamed("_part", "_from"), "starts")
    joined = placed.join(starts, F.col("_head") & (F.col("_part") == F.col("_from")), "left")
    return joined.select(
        *df.columns, *[(F.col(f"_local_{o}") + F.coalesce(f"_before_{o}", F.lit(0))).alias(o) for o in sums]
    )


#: Bits of a digit of ``ordered_crossings``: a row of k bits is sorted k / DIGIT_BITS times and meets 2^DIGIT_BITS sums.
DIGIT_BITS = 6
#: Rows that are counted at once, and rows of segments that are counted all together.
CROSSING_ROWS, SHORT_SEGMENT = 512, 16


class _Segment:
    """Rows of one (group, level, higher digits) as they come: weights by digit, and what crossed among them."""

    def __init__(self):
        self.sums, self.crossed = np.zeros(1 << DIGIT_BITS), 0.0

    def add(self, digit: np.ndarray, weight: np.ndarray) -> _Segment:
        for first in range(0, len(digit), CROSSING_ROWS):
            d, w = digit[first : first + CROSSING_ROWS], weight[first : first + CROSSING_ROWS]
            placed = np.zeros((len(d) + 1, len(self.sums)))
            placed[0] = self.sums
            placed[np.arange(1, len(d) + 1), d] = w
            through = np.cumsum(placed, axis=0)
            # of what came before, the weight above each digit
            above = through[:-1].sum(axis=1) - np.cumsum(through[:-1], axis=1)[np.arange(len(d)), d]
            self.crossed += float((w * above).sum())
            self.sums = through[-1]
        return self


def _crossings(groups: int):
    """From sorted rows (groups..., digit, weight) to (groups..., _part, _crossed, _sums): what crossed within a partition
    and, for its first and last segment, the weights by digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, key, leads = None, [], True

        def rows(keys: list, crossed: np.ndarray, sums: list) -> pa.RecordBatch:
            columns = [*keys, pa.array(np.full(len(crossed), part, np.int32)), pa.array(crossed), pa.array(sums, pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "_part", "_crossed", "_sums"])

        names: list[str] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = batch.schema.names[:groups]
            keys = batch.columns[:groups]
            digit, weight = (batch.column(groups + i).to_numpy(zero_copy_only=False) for i in range(2))
            weight = weight.astype(np.float64)
            begins = np.zeros(batch.num_rows, dtype=bool)
            begins[0] = held is None or any(_changes(pa.concat_arrays([k, c.slice(0, 1)]))[0] for k, c in zip(key, keys))
            for column in keys:
                begins[1:] |= _changes(column)
            starts = np.flatnonzero(begins)
            stops = np.append(starts[1:], batch.num_rows)
            goes_on = starts[0] if len(starts) else batch.num_rows
            if goes_on:
                held.add(digit[:goes_on], weight[:goes_on])
            if len(starts) == 0:
                continue
            if held is not None:
                yield rows(key, np.array([held.crossed]), [held.sums.tolist() if leads else None])
                leads = False
            # segments that lie in the batch, but for one that leads the partition; the last one may go on
            whole = np.arange(int(leads and len(starts) > 1), len(starts) - 1)
            if leads and len(starts) > 1:
                first = _Segment().add(digit[: stops[0]], weight[: stops[0]])
                yield rows([c.slice(0, 1) for c in keys], np.array([first.crossed]), [first.sums.tolist()])
                leads = False
            if len(whole):
                crossed = np.zeros(batch.num_rows)
                segment = np.cumsum(begins)
                length = (stops - starts)[whole]
                for lag in range(1, min(SHORT_SEGMENT, int(length.max()))):
                    later = np.flatnonzero((segment[lag:] == segment[:-lag]) & (digit[:-lag] > digit[lag:])) + lag
                    crossed[later] += weight[later] * weight[later - lag]
                total = np.add.reduceat(crossed, starts)[whole]
                for i in np.flatnonzero(length > SHORT_SEGMENT):
                    a, b = starts[whole[i]], stops[whole[i]]
                    total[i] = _Segment().add(digit[a:b], weight[a:b]).crossed
                found = np.flatnonzero(total)
                at = pa.array(starts[whole[found]])
                yield rows([c.take(at) for c in keys], total[found], [None] * len(found))
            held = _Segment().add(digit[starts[-1] :], weight[starts[-1] :])
            key = [c.slice(int(starts[-1]), 1) for c in keys]
        if held is not None:
            yield rows(key, np.array([held.crossed]), [held.sums.tolist()])

    return run


def ordered_crossings(df: DataFrame, by: list[str], order: list, rank: str, weight: str, top: int) -> DataFrame:
    """(by, crossings): per group the sum of the weights' products over pairs whose earlier row in ``order`` has the greater
    ``rank``, a whole number from 0 to ``top``. A group may be missing if it has none.

    Two ranks differ first in one digit, below equal higher ones. So each row is sorted once for every digit, by (group,
    digit's level, higher digits, order), and meets the weights of greater digits before it. These are added up
    where the rows lie; a segment that goes on from one partition to the next needs its earlier weights by digit only.
    ``order`` must be unique inside a group.
    """
    levels = max(-(-int(top).bit_length() // DIGIT_BITS), 1)
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level"))
    high = F.expr(f"shiftright(cast(`{rank}` as bigint), (_level + 1) * {DIGIT_BITS})")
    digit = F.expr(f"cast(shiftright(cast(`{rank}` as bigint), _level * {DIGIT_BITS}) & {(1 << DIGIT_BITS) - 1} as int)")
    rows = rows.withColumn("_high", high).withColumn("_digit", digit)
    groups = [*by, "_level", "_high"]
    placed = rows.orderBy(*groups, *_columns(order)).select(*groups, "_digit", weight)
    schema = T.StructType([*[placed.schema[c] for c in groups], T.StructField("_part", T.IntegerType()),
                           T.StructField("_crossed", T.DoubleType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))])
    found = materialize(placed.mapInArrow(_crossings(len(groups)), schema), "crossings")
    # at most two segments a partition go on to another one
    sums = found.where("_sums is not null").select(*groups, "_part", F.posexplode("_sums").alias("_digit", "_sum"))
    earlier = Window.partitionBy(*groups, "_digit").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy(*groups, "_part").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_before", F.sum("_sum").over(earlier)).withColumn("_below", F.sum("_sum").over(smaller))
    both = found.select(*by, "_crossed").unionByName(carried.select(*by, (F.col("_before") * F.col("_below")).alias("_crossed")))
    return both.groupBy(*by).agg(F.coalesce(F.sum("_crossed"), F.lit(0.0)).alias("crossings"))


def value_ranks(df: DataFrame, by: list[str], value: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """One row per (group, distinct value): ``n``, extra ``counts`` and the average rank ``avg_rank``.

    Ties collapse in a map-side combined aggregate before anything is sorted, so a value that fills a third of
    the table is one row. ``n_through`` is the number of rows up to and including the value, and each extra
    count ``c`` gets ``c_through``.
    """
    counts = counts or {}
    distinct = (
        df.where(F.col(value).isNotNull())
        .withColumn(value, F.col(value) + F.lit(0))
        .groupBy(*by, value)
        .agg(F.count("*").alias("n"), *[F.sum(c).cast("bigint").alias(k) for k, c in counts.items()])
    )
    totals = running_totals(distinct, by, [value], {f"{c}_through": c for c in ["n", *counts]})
    return totals.withColumn("avg_rank", F.col("n_through") - (F.col("n") - 1) / F.lit(2.0))


def avg_rank(df: DataFrame, by: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Add the fractional rank of ``value`` to every row; NULL values get NULL."""
    ranks = materialize(
        value_ranks(df, by, value).select(*by, value, "n", F.col("avg_rank").alias(name)), "ranks"
    )
    return join_hot_values(df, ranks, [*by, value], name)


HOT_ROWS = 1_000_000


def join_hot_values(df: DataFrame, ranks: DataFrame, keys: list[str], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join with a per-value table whose ``n`` says how many rows carry the value.

    Values with ``hot_rows`` rows or more number at most rows / ``hot_rows``; they are written as a table of
    their own, which Spark broadcasts after checking its size, so they are never shuffled to one task. The
    other values go through a shuffle join.
    """
    hot = materialize(ranks.where(F.col("n") >= hot_rows).drop("n").withColumnRenamed(name, "_hot"), "hot")
    if hot.isEmpty():
        return join_on(df, ranks.drop("n"), keys, "left")
    cold = ranks.where(F.col("n") < hot_rows).drop("n").withColumnRenamed(name, "_cold")
    marked = join_on(df, hot, keys, "left")
    settled = marked.where(F.col("_hot").isNotNull()).select(*df.columns, F.col("_hot").alias(name))
    rest = marked.where(F.col("_hot").isNull()).drop("_hot")
    return settled.unionByName(
        join_on(rest, cold, keys, "left").select(*df.columns, F.col("_cold").alias(name))
    )
