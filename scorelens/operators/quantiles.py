"""Exact percentiles of huge groups without a full shuffle or a task that holds a group.

A coarse quantile sketch encloses each percentile of a group in a bracket of values. The brackets cut the value
line into ordered segments; counting rows per segment shows where the wanted order statistics lie. While a bracket may
hold more than ``keep_rows`` values between its ends, a pass counts its rows exactly, sketches the values between its ends
and narrows it to a few of ``grid`` parts of equal depth. So every pass leaves the same share of the rows, whatever
the values, and repeated values end up as ends of brackets. Then only the distinct values inside the brackets are kept
and placed within their segment. Every pass is an aggregate that combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.storage import hashed_groups, join_on, materialize

ACCURACY = 1_000
GRID = 256
KEEP_ROWS = 1_000_000
#: Groups whose sketches a task holds side by side, each of up to 50,000 values (about 1 MB).
SKETCHES = 256


def _segment(count: int) -> tuple[Column, Column]:
    """Ordered segment number of a value and whether it lies inside a bracket.

    Both ends of the brackets do not decrease, so the first bracket that ends at or after the value is the only
    one that can be the first to hold it.
    """
    v = F.col("_v")
    passed = sum((F.when(F.col(f"_hi{i}") < v, 1).otherwise(0) for i in range(count)), F.lit(0))
    inside = F.coalesce(
        *[F.when(F.col(f"_hi{i}") >= v, F.col(f"_lo{i}") <= v) for i in range(count)], F.lit(False)
    )
    return 2 * passed + inside.cast("int"), inside


def _targets(fractions: list[float]) -> list[tuple[Column, Column]]:
    """0-based positions of the two order statistics around each percentile."""
    last = F.col("_n") - 1
    lower = [F.floor(F.lit(f) * last) for f in fractions]
    return [(k, F.least(k + 1, last)) for k in lower]


def _at(position: Column, value: str, condition: Column | None = None) -> Column:
    hit = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_c"))
    return F.max(F.when(hit if condition is None else hit & condition, F.col(value)))


def _narrow(rows: DataFrame, brackets: DataFrame, groups: list[str], fractions: list[float], grid: int, accuracy: int) -> DataFrame:
    """Brackets around the same order statistics, narrower by ``_share``, with the rows between the old ends."""
    joined = join_on(rows, brackets, groups)
    v = F.col("_v")
    depths = [i / grid for i in range(grid + 1)]
    measures = []
    for i in range(len(fractions)):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        between = (low < v) & (v < high)
        measures += [
            F.max(low).alias(f"_lo{i}"), F.max(high).alias(f"_hi{i}"), F.count_if(v <= low).alias(f"_through{i}"),
            F.count_if(between).alias(f"_rows{i}"), F.percentile_approx(F.when(between, v), depths, accuracy).alias(f"_cut{i}"),
        ]
    measured = joined.groupBy(*groups).agg(F.max("_n").alias("_n"), *measures)
    ends = []
    error = 2.0 / accuracy  # of the sketch, with some room
    for i, (k, after) in enumerate(_targets(fractions)):
        low, high, inside, cut = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_rows{i}"), F.col(f"_cut{i}")
        first, last = k - F.col(f"_through{i}"), after - F.col(f"_through{i}")  # places between the ends
        below = F.floor((first / inside - error) * grid).cast("int")
        above = F.ceil(((last + 1) / inside + error) * grid).cast("int")
        ends += [
            F.when((inside == 0) | (first < 0) | (below < 0), F.when((first >= inside) & (first >= 0), high).otherwise(low))
            .when(first >= inside, high).otherwise(F.get(cut, below)).alias(f"_lo{i}"),
            F.when((inside == 0) | (last >= inside) | (above > grid), F.when(last < 0, low).otherwise(high))
            .when(last < 0, low).otherwise(F.get(cut, above)).alias(f"_hi{i}"),
        ]
    return measured.select(*groups, "_n", *[f"_rows{i}" for i in range(len(fractions))], *ends)


def _share(grid: int, accuracy: int) -> float:
    """Most of the rows between a bracket's ends that a pass leaves between the new ones."""
    return 6.0 / accuracy + 3.0 / grid


def profile(
    df: DataFrame,
    by: list[str],
    value: str,
    aggregates: list[Column],
    percentiles: dict[str, float],
    *,
    accuracy: int = ACCURACY,
    keep_rows: int = KEEP_ROWS,
    grid: int = GRID,
) -> DataFrame:
    """Per-group ``aggregates`` plus exact linear-interpolated ``percentiles`` ``{name: fraction}`` of ``value``.

    NULL and NaN values do not count. The table is read twice; groups of more than about ``keep_rows * accuracy / 8``
    rows take one more pass for each factor of ``1 / _share``. At least ``4 * grid`` and ``accuracy`` values are kept.
    """
    if not percentiles:
        return df.groupBy(*by).agg(*aggregates)
    groups = by
    if not by:
        df, groups = df.withColumn("_all", F.lit(0)), ["_all"]
    fractions = sorted(set(percentiles.values()))
    count = len(fractions)
    margin = 4.0 / accuracy
    ends = [max(f - margin, 0.0) for f in fractions] + [min(f + margin, 1.0) for f in fractions]
    clean = F.when(~F.isnan(value), F.col(value).cast("double"))
    sketched = df.groupBy(*groups).agg(
        *aggregates,
        F.count(clean).alias("_n"),
        F.min(clean).alias("_min"),
        F.max(clean).alias("_max"),
        F.percentile_approx(clean, ends, accuracy).alias("_cut"),
    )
    with hashed_groups(df.sparkSession, SKETCHES):
        sketch = materialize(sketched, "sketch")
    # a small group keeps all its values
    small = F.col("_n") <= accuracy
    lows = [
        F.when(small if f > margin else F.lit(True), F.col("_min")).otherwise(F.col("_cut")[i]).alias(f"_lo{i}")
        for i, f in enumerate(fractions)
    ]
    highs = [
        F.when(small if f + margin < 1 else F.lit(True), F.col("_max")).otherwise(F.col("_cut")[count + i]).alias(f"_hi{i}")
        for i, f in enumerate(fractions)
    ]
    brackets = sketch.where("_n > 0").select(*groups, "_n", *lows, *highs)
    rows = df.select(*groups, clean.alias("_v")).where(F.col("_v").isNotNull())

    largest = sketch.agg(F.max("_n")).first()[0] or 0
    keep_rows = max(keep_rows, 4 * grid, accuracy)
    held = largest if largest <= accuracy else largest * 2 * margin
    while held > keep_rows:
        narrowed = materialize(_narrow(rows, brackets, groups, fractions, grid, accuracy), "brackets")
        between = max(narrowed.agg(*[F.max(f"_rows{i}") for i in range(count)]).first())
        brackets = narrowed.drop(*[f"_rows{i}" for i in range(count)])
        # a share of what was counted, and one more for rounding
        held = between * _share(grid, accuracy) + 1

    joined = join_on(rows, brackets, groups)
    segment, inside = _segment(count)
    # written, as what lies before is counted from it as well
    counted = materialize(
        joined.select(*groups, "_n", segment.alias("_segment"), F.when(inside, F.col("_v")).alias("_rep"))
        .groupBy(*groups, "_segment", "_rep")
        .agg(F.count("*").alias("_c"), F.max("_n").alias("_n")),
        "counted",
    )
    # what lies in earlier segments, and before a value inside its own
    whole = counted.groupBy(*groups).agg(
        *[F.coalesce(F.sum(F.when(F.col("_segment") < s, F.col("_c"))), F.lit(0)).alias(f"_base{s}") for s in range(2 * count + 1)]
    )
    earlier = Window.partitionBy(*groups, "_segment").orderBy("_rep").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_on(counted.withColumn("_within", F.coalesce(F.sum("_c").over(earlier), F.lit(0))), whole, groups)
    base = F.element_at(F.array(*[f"_base{s}" for s in range(2 * count + 1)]), F.col("_segment") + 1)
    placed = placed.withColumn("_before", base + F.col("_within"))
    picks = []
    for i, (k, after) in enumerate(_targets(fractions)):
        picks += [_at(k, "_rep").alias(f"_a{i}"), _at(after, "_rep").alias(f"_b{i}")]
    picked = placed.groupBy(*groups).agg(F.max("_n").alias("_n"), *picks)
    outputs = []
    for name, f in percentiles.items():
        i = fractions.index(f)
        low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
        rest = F.lit(f) * (F.col("_n") - 1) - F.floor(F.lit(f) * (F.col("_n") - 1))
        outputs.append(
            F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("percentile outside its bracket")))
            .otherwise(low + (high - low) * rest)
            .cast("double")
            .alias(name)
        )
    found = picked.select(*groups, *outputs)
    return join_on(sketch.drop("_n", "_min", "_max", "_cut"), found, groups, "left").drop("_all")


def exact_percentiles(df: DataFrame, by: list[str], value: str, percentiles: dict[str, float], **options) -> DataFrame:
    """Exact percentiles only."""
    return profile(df, by, value, [], percentiles, **options)
