"""Schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scorelens.operators.prompts import ATTRIBUTES

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


PROMPTS = _table(
    ("prompt_id", _L),
    ("prompt", _table(("text", _S), *[(a, _D) for a in ATTRIBUTES])),
    ("continuation", _table(("text", _S))),
)
GENERATIONS = _table(("prompt_id", _L), ("model", _S), ("prompt", _S), ("output", _S))
DATASET_RECORDS = _table(
    ("sample_id", _L), ("prompt", _S), ("output", _S), ("model_name", _S), ("temperature", _D), ("top_p", _D),
    ("generation_timestamp", T.TimestampType()),
)
CLASSIFICATIONS = _table(
    ("prompt_id", _L), ("model", _S), ("text_type", _S), ("classifier", _S), ("labels", T.MapType(_S, _D))
)
SCORES = _table(
    ("prompt_id", _L), ("model", _S), ("text_type", _S), ("classifier", _S), ("label", _S), ("score", _D)
)
PAIRS = _table(("sample_id", _L), ("prompt", _S), ("original_output", _S), ("detoxified_output", _S))
REWARDS = _table(
    ("sample_id", _L), ("side", _S), ("variant", _S), ("model_id", _S), ("epoch", _I), ("reward", _D)
)
EXPERIMENTS = _table(
    ("experiment", _S), ("model_size", _S), ("size_order", _I), ("toxicity_threshold", _D), ("input_type", _S),
    ("reward_model_id", _S), ("original_dataset_id", _S), ("detoxified_dataset_id", _S),
)
PROMPT_TRACKING = _table(("epoch", _S), ("prompt_idx", _L), ("raw_toxicity", _D), ("softmax_toxicity", _D))
REWARD_EVENTS = _table(("epoch", _I), ("ts", T.TimestampType()), ("model", _S), ("reward", _D))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df
