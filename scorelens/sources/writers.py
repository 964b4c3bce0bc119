"""Sinks for result frames, pairs, metrics and per-epoch generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.operators.metrics import flat_metrics


def maps_as_text(df: DataFrame) -> DataFrame:
    """Map, array and struct columns as JSON text, for formats without nested types."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    )


def write_csv(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    """CSV with header; text with quotes and line breaks survives, maps become JSON text."""
    writer = maps_as_text(df).write.option("header", True).option("quote", '"').option("escape", '"')
    # an empty string and NULL stay different
    writer = writer.option("emptyValue", '""').option("nullValue", "")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_records(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    """JSON records, one per line."""
    writer = df.write.option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def metric_tree(df: DataFrame, keys: list[str], name: str = "tree") -> DataFrame:
    """Keys and one JSON text with all other columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias(name))


def write_pairs(pairs: DataFrame, path: str, *, fmt: str = "csv") -> None:
    """Scored pairs as CSV columns or JSON records."""
    (write_csv if fmt == "csv" else write_records)(pairs, path)


def write_flat_metrics(rows: DataFrame, path: str, key: list[str], splits: list[str], metrics: list[str]) -> None:
    """One row per key with a column per split and metric."""
    write_csv(flat_metrics(rows, key, splits, metrics), path)


def write_generations(df: DataFrame, path: str) -> None:
    """Query, response and toxicity records in one folder per epoch."""
    write_records(df.select("epoch", "query", "response", "toxicity"), path, partition_by=["epoch"])


def write_experiment_results(path: str, tables: dict[str, DataFrame]) -> None:
    """One folder per result family, split by experiment and split where the family has them."""
    for name, df in tables.items():
        keys = [c for c in ("experiment", "split") if c in df.columns]
        write_records(df, f"{path.rstrip('/')}/{name}", partition_by=keys or None)


def write_frames(df: DataFrame, path: str, by: list[str]) -> None:
    """Add rows to a table with one folder per value of ``by``, e.g. per model or epoch.

    Frames may be added one after another and need not have the same columns; ``readers.read_frames`` reads them all.
    """
    df.write.mode("append").partitionBy(*by).parquet(path)
