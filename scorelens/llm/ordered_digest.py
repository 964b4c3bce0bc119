"""SHA-256 of the ordered lines of every group, without a group in memory.

Lines are range partitioned by (group, place), joined to pieces of about ``PIECE_BYTES`` where they lie, and only the
pieces of a group meet in one task, which streams them through the hash. The digest of a group is one sequential
computation, so its bytes pass one task; its rows don't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20


def ordered_sha256(df: DataFrame, by: list[str], place: str, line: str, separator: str, name: str) -> DataFrame:
    """(by, name): lowercase hex of ``line`` of the group in order of the long ``place``, joined by ``separator``.

    Null lines are left out; a group without any other gets no row. Nulls in ``by`` are a group. Equal places have no order.
    """
    glue = separator.encode()
    kept = df.where(F.col(line).isNotNull()).select(*by, F.col(place).cast("long").alias("_place"), F.col(line).alias("_line"))
    width = len(by)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, bytes]]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            lines = batch.column(width + 1).cast(pa.binary()).to_pylist()
            yield from zip(zip(*columns[:width]), columns[width], lines)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        group, first, held, size = None, 0, [], 0
        for batch in batches:
            schema = batch.schema
            done = []
            for key, at, raw in runs([batch]):
                if held and (key != group or size > PIECE_BYTES):
                    done.append((group, first, glue.join(held)))
                    held, size = [], 0
                if not held:
                    group, first = key, at
                held.append(raw)
                size += len(raw)
            if done:
                yield batch_of(done, schema)
        if held:
            yield batch_of([(group, first, glue.join(held))], schema)

    def batch_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        keys = [pa.array([r[0][i] for r in rows], schema.field(i).type) for i in range(width)]
        rest = [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays([*keys, *rest], names=[*by, "_place", "_line"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, group, running = None, None, None
        for batch in batches:
            schema = batch.schema
            done = []
            for key, _, raw in runs([batch]):
                if running is not None and key == group:
                    running.update(glue)
                else:
                    if running is not None:
                        done.append((group, running.hexdigest()))
                    group, running = key, hashlib.sha256()
                running.update(raw)
            if done:
                yield hex_of(done, schema)
        if running is not None:
            yield hex_of([(group, running.hexdigest())], schema)

    def hex_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        keys = [pa.array([r[0][i] for r in rows], schema.field(i).type) for i in range(width)]
        return pa.RecordBatch.from_arrays([*keys, pa.array([r[1] for r in rows], pa.string())], names=[*by, name])

    joined = kept.repartitionByRange(*by, "_place").sortWithinPartitions(*by, "_place").mapInArrow(
        pieces, ", ".join([*fields, "_place long", "_line binary"])
    )
    return joined.repartition(*by).sortWithinPartitions(*by, "_place").mapInArrow(digests, ", ".join([*fields, f"`{name}` string"]))
