"""Shards as runs of a Hilbert curve over document metadata.

Several dimensions (text size, id, language, source) are quantised at their quantiles, the cell of every document gives
its index on the curve, rows are sorted by that index, and the sorted sequence is cut into runs of equal row counts.
Neighbours on the curve are close in all dimensions, so each run covers a small box of metadata and a reader can skip
shards, files and row groups by their minima and maxima.

The cuts need exact positions. They come from the narrow key columns only; the texts move once, to their range.

Law: ``rows``; shard sizes are at most one row apart. Equal keys (repeated rows) are told apart by a copy number, so a
run of repeated rows may be cut as well. Null texts have no bytes and checksum 0, other nulls sort first. An empty
table gives no files and no rows. Columns of the input are written as they are; the added ones begin with ``_``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorelens.operators.ranks import ordered_index
from scorelens.storage import materialize

#: Bits a dimension; 2 ** BITS cells each.
BITS = 5
_KEY = ["_curve", "_bytes", "_crc", "_id"]


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points: ``cells`` has a row for each dimension, values below 2 ** bits."""
    x = cells.astype(np.int64).copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations from the coarsest level down
        low = level - 1
        for i in range(dims):
            far = (x[i] & level) != 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(far, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        carry = np.where(x[-1] & level, carry ^ (level - 1), carry)
        level >>= 1
    x ^= carry
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def _text_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def text_crc(text: str = "text") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))


def _leading(column: str) -> Column:
    """The first seven bytes of a string as a number, in string order; null: -1."""
    digits = F.rpad(F.substring(F.hex(F.encode(F.col(column).cast("string"), "UTF-8")), 1, 14), 14, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(-1).cast("long"))


def with_curve(docs: DataFrame) -> DataFrame:
    """Add the sort key: curve index, text bytes, text checksum, id."""
    columns = {"_bytes": _text_bytes(), "_crc": text_crc(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))}
    dimensions = [columns["_bytes"], columns["_id"], _leading("lang"), _leading("source")]
    shares = [i / 2**BITS for i in range(1, 2**BITS)]
    found = docs.agg(*[F.percentile_approx(d, shares, 10000).alias(f"d{i}") for i, d in enumerate(dimensions)]).first()
    edges = [np.unique(np.array(found[i] if found[i] is not None else [], dtype=np.int64)) for i in range(len(dimensions))]

    @F.pandas_udf("long")
    def index(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        cells = np.array([np.searchsorted(e, v.to_numpy(), side="left") for e, v in zip(edges, (a, b, c, d))])
        return pd.Series(curve_index(cells, BITS))

    return docs.withColumns(columns).withColumn("_curve", index(*dimensions))


def write_shards(docs: DataFrame, path: str, n_shards: int) -> StructType:
    """Write ``docs`` (doc_id, text, lang, source, ...) below ``path`` as Parquet, one folder a shard, in curve order.

    Returns the schema of the files.
    """
    spark = docs.sparkSession
    keyed = with_curve(docs)
    copies = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.lit(0)))
    narrow = materialize(keyed.select(*_KEY), "keys").withColumn("_copy", copies)
    placed = ordered_index(narrow, [], [*_KEY, "_copy"])
    total = narrow.count()
    # first row of every shard but the first; at most n_shards rows
    starts = [-(-i * total // n_shards) + 1 for i in range(1, n_shards) if -(-i * total // n_shards) < total]
    cuts = placed.filter(F.col("position").isin(starts)).orderBy("position").collect() if starts else []
    first_of: dict[int, int] = {r["position"]: k for k, r in enumerate(cuts)}
    shard = F.lit(0)
    row_key = F.struct(*[F.col(c).cast("long").alias(c) for c in [*_KEY, "_copy"]])
    for i in range(1, n_shards):
        at = first_of.get(-(-i * total // n_shards) + 1)
        if at is not None:
            cut = F.struct(*[F.lit(int(cuts[at][c])).cast("long").alias(c) for c in [*_KEY, "_copy"]])
            shard = shard + F.when(row_key >= cut, 1).otherwise(0)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards)
    # the window keeps to the range partitioning and its order
    ranged = keyed.repartitionByRange(tasks, *_KEY).sortWithinPartitions(*_KEY).withColumn("_copy", copies)
    ranged = ranged.withColumn("_shard", shard.cast("int")).sortWithinPartitions("_shard", *_KEY, "_copy")
    ranged = ranged.drop("_bytes", "_crc", "_id", "_copy")
    ranged.write.partitionBy("_shard").parquet(path)
    return ranged.schema


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of written shards with ``_shard`` and ``_slot``, the position in the shard from 0."""
    rows = spark.read.schema(schema).parquet(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    files = rows.groupBy("_shard", "_file").agg(F.count("*").alias("_rows"))
    number = F.regexp_extract("_file", r"part-(\d+)-", 1).cast("long")
    earlier = Window.partitionBy("_shard").orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(files, "_file").withColumn("_slot", F.col("_before") + F.col("_row")).drop("_before", "_row", "_file")
