"""Tables behind the plots: histograms, boxes, scatters, curves and density."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.numeric import count_if
from scorelens.operators.quantiles import profile
from scorelens.storage import attach_stats, join_on, materialize


def histogram(df: DataFrame, by: list[str], value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins per group with edges and counts, empty bins included; the maximum is in the last bin.

    A constant group spans one unit around its value.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    flat = F.min(v) == F.max(v)
    edges = materialize(
        rows.groupBy(*by).agg(
            F.when(flat, F.min(v) - 0.5).otherwise(F.min(v)).cast("double").alias("_lo"),
            F.when(flat, F.max(v) + 0.5).otherwise(F.max(v)).cast("double").alias("_hi"),
        ),
        "edges",
    )
    placed = join_on(rows.select(*by, v.cast("double").alias("_v")), edges, by)
    position = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    counts = placed.select(*by, F.least(position, F.lit(bins - 1)).cast("int").alias("bin")).groupBy(*by, "bin").agg(
        F.count("*").alias("count")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return join_on(grid, counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_low"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def box_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, fences at 1.5 interquartile ranges, whiskers inside the fences and the outlier count."""
    quartiles = profile(df, by, value, [F.count(value).alias("n")], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    boxes = materialize(
        quartiles.withColumn("low_fence", F.col("q1") - 1.5 * spread).withColumn(
            "high_fence", F.col("q3") + 1.5 * spread
        ),
        "boxes",
    )
    v = F.col(value)
    rows = join_on(df.select(*by, value), boxes.select(*by, "low_fence", "high_fence"), by)
    inside = (v >= F.col("low_fence")) & (v <= F.col("high_fence"))
    ends = rows.groupBy(*by).agg(
        F.min(F.when(inside, v)).alias("low_whisker"),
        F.max(F.when(inside, v)).alias("high_whisker"),
        count_if(~inside).alias("outliers"),
    )
    return join_on(boxes, ends, by)


def scatter(paired: DataFrame, by: list[str], *, key: str = "prompt_id") -> DataFrame:
    """Baseline against model score per sample with the group's mean improvement."""
    rows = paired.select(*by, key, F.col("base_value").alias("x"), F.col("score").alias("y"))
    return attach_stats(rows, by, F.avg(F.col("x") - F.col("y")).alias("mean_improvement"))


def axis_limits(paired: DataFrame, by: list[str], *, x: str = "base_value", y: str = "score") -> DataFrame:
    """Least and greatest value over both columns."""
    return paired.groupBy(*by).agg(
        F.least(F.min(x), F.min(y)).alias("low"), F.greatest(F.max(x), F.max(y)).alias("high")
    )


def mean_progression(points: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Mean score per epoch."""
    return points.where(F.col("epoch").isNotNull()).groupBy(*by, "epoch").agg(
        F.avg(value).alias("mean"), F.count(value).alias("n")
    )


def density(df: DataFrame, by: list[str], value: str, *, points: int = 100, bins: int = 512) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth, evaluated on a grid over the fine histogram.

    Each group has at most ``bins`` non-empty cells, so the smoothing is ``bins`` x ``points`` rows per group
    whatever the number of values.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    stats = materialize(
        rows.groupBy(*by).agg(
            F.count("*").alias("_n"),
            F.stddev_samp("_v").alias("_std"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
        ),
        "density",
    )
    stats = stats.where(F.col("_std") > 0).withColumn("_h", F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    stats = stats.withColumn("_width", (F.col("_max") - F.col("_min")) / bins)
    placed = join_on(rows, stats, by)
    cell = F.least(F.floor((F.col("_v") - F.col("_min")) / F.col("_width")), F.lit(bins - 1))
    cells = placed.groupBy(*by, cell.alias("_cell")).agg(F.count("*").alias("_c"))
    cells = join_on(cells, stats, by)
    step = (F.col("_max") - F.col("_min") + 6 * F.col("_h")) / (points - 1)
    grid = cells.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("_min") - 3 * F.col("_h") + F.col("point") * step
    )
    centre = F.col("_min") + (F.col("_cell") + 0.5) * F.col("_width")
    z = (F.col("x") - centre) / F.col("_h")
    kernel = F.col("_c") * F.exp(-0.5 * z * z) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return grid.groupBy(*by, "point").agg(F.max("x").alias("x"), F.sum(kernel).alias("density"))


def dashboard(paired: DataFrame, by: list[str], *, threshold: float = 0.05) -> DataFrame:
    """Means, improvement and counts per model and classifier."""
    d = F.col("base_value") - F.col("score")
    return paired.groupBy(*by).agg(
        F.avg("base_value").alias("base_mean"),
        F.avg("score").alias("model_mean"),
        F.avg(d).alias("improvement"),
        count_if(d > threshold).alias("improvements"),
        count_if(d < -threshold).alias("regressions"),
    )


def delta_triples(
    deltas: DataFrame, x: str, y: str, z: str | None = None, *, keys: list[str] = ["prompt_id", "model"]
) -> DataFrame:
    """Deltas of two classifiers per sample and a third value: another classifier or their sum."""
    names = [x, y] + ([z] if z else [])
    wide = deltas.where(F.col("classifier").isin(*names)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("classifier") == c, F.col("delta"))).alias(f"_{i}") for i, c in enumerate(names)]
    )
    wide = wide.dropna(subset=[f"_{i}" for i in range(len(names))])
    third = F.col("_2") if z else F.col("_0") + F.col("_1")
    return wide.select(*keys, F.col("_0").alias("x"), F.col("_1").alias("y"), third.alias("z"))
