"""Shared-folder tables that cut lineage, and joins that respect NULL keys."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is created only for a local master without that setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="scorelens-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str, default: str):
    """Within, a setting of the session has another value."""
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _shuffle_files_removed(spark: SparkSession):
    """Within, Spark removes the shuffle files of a query when it has ended: what is written needs them no longer."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true", "false")


def hashed_groups(spark: SparkSession, groups: int):
    """Within, a task keeps the buffers of up to ``groups`` groups of an aggregate of objects; with more it sorts its rows."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name, "128")
    return _setting(spark, name, str(max(groups, int(before))), before)


_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``options`` are those of the Parquet writer.

    Later plans see fixed rows, exact file sizes (so Spark's own size check decides about broadcasting)
    and survive the loss of executors. Inside a ``Scratch`` the table belongs to it and goes with it.
    """
    path = scratch_path(df.sparkSession, name)
    with _shuffle_files_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    owners = _OWNERS.get()
    (owners[-1].paths if owners else _WRITTEN).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Owns the tables that are written with ``materialize`` inside its ``with`` block and deletes them at its end.

    Nothing that leaves the block may still read them: write it with ``keep`` before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        _OWNERS.set((*_OWNERS.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _OWNERS.set(tuple(owner for owner in _OWNERS.get() if owner is not self))
        _delete(self.spark, self.paths)

    def keep(self, df: DataFrame, name: str = "table", **options) -> DataFrame:
        """Write a table that outlives this block."""
        owners = _OWNERS.get()
        outer = _OWNERS.set(owners[: owners.index(self)])
        try:
            return materialize(df, name, **options)
        finally:
            _OWNERS.reset(outer)


#: The open blocks of this thread, from the outermost on.
_OWNERS: ContextVar[tuple[Scratch, ...]] = ContextVar("owners", default=())


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables this process has written with ``materialize`` outside of a ``Scratch``, once no result needs them."""
    _delete(spark, _WRITTEN)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that keeps one copy of the keys and matches NULL with NULL."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_right_{key}"])
    return left.join(renamed, condition, how).drop(*[f"_right_{key}" for key in keys])


def attach_stats(df: DataFrame, by: list[str], *aggregates) -> DataFrame:
    """Add per-group aggregates to every row without a window over whole groups.

    The aggregate combines map-side and is written once; it has one row per group, so the join broadcasts it
    when its measured size allows and is a shuffle join with AQE skew handling otherwise.
    """
    if not by:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    stats = materialize(df.groupBy(*by).agg(*aggregates), "stats")
    return join_on(df, stats, by).drop("_all")
