"""Column builders for scores, logits and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """True for a present number that is neither NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def is_bad(x: Column) -> Column:
    """True for NaN and infinities; NULL is not bad."""
    return x.isNotNull() & (F.isnan(x) | (F.abs(x) == float("inf")))


def sanitize(x: Column, fill: float | None = 0.0) -> Column:
    """Replace NaN and infinities. Count them first with ``is_bad``."""
    return F.when(is_bad(x), F.lit(fill).cast("double")).otherwise(x)


def sigmoid(x: Column) -> Column:
    """Logistic function that cannot overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logits_score(logits: Column, *, as_reward: bool = False) -> Column:
    """A single logit is the score; of several, the first is taken, raw as a reward and squashed otherwise."""
    first = F.get(logits, F.lit(0))
    return F.when((F.size(logits) == 1) | F.lit(as_reward), first).otherwise(sigmoid(first))


def toxicity_of_reward(reward: Column, *, invert: bool = True) -> Column:
    return -reward if invert else reward


def relative_change(original: Column, modified: Column) -> Column:
    """Change relative to the size of the original; 0 when the original is 0."""
    return F.when(original == 0, F.lit(0.0)).otherwise(F.try_divide(modified - original, F.abs(original)))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def at_least(x: Column, threshold: Column | float, *, inclusive: bool = True) -> Column:
    return (x >= threshold) if inclusive else (x > threshold)


def binary_prediction(score: Column, threshold: float = 0.5) -> Column:
    return (score >= threshold).cast("int")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def value_head(pooled: Column, weights: list[float]) -> Column:
    """Linear head over a pooled vector."""
    return dot(pooled, F.array(*[F.lit(float(w)) for w in weights]))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set; divides by at least 1."""
    width = F.size(F.get(vectors, F.lit(0)))
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    total = F.aggregate(
        kept,
        F.array_repeat(F.lit(0.0), width),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
    )
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double")), F.lit(1.0))
    return F.transform(total, lambda x: x / count)


def safe_corr(x, y) -> Column:
    """Pearson correlation of paired values; NULL when either side has no variance."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(px, py), F.nullif(F.stddev_pop(px) * F.stddev_pop(py), F.lit(0.0)))


def biased_skewness(x: Column, *, min_rows: int = 1) -> Column:
    """Third standardized moment; 0 for constant values or fewer than ``min_rows`` rows."""
    return F.when(F.count(x) < min_rows, F.lit(0.0)).otherwise(F.coalesce(F.skewness(x), F.lit(0.0)))


def rate(condition: Column, over: Column | None = None) -> Column:
    """Share of rows where ``condition`` holds, of those where ``over`` is present."""
    flag = condition.cast("double")
    return F.avg(F.when(over.isNotNull(), flag) if over is not None else flag)


def count_if(condition: Column) -> Column:
    """Rows where ``condition`` holds; 0 rather than NULL for none."""
    return F.count(F.when(condition, F.lit(1)))
