"""Pairwise reward losses as per-pair Column builders; average them for the metric."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelens.functions.numeric import is_bad, softplus


def _nan_is_zero(loss: Column) -> Column:
    return F.when(F.isnan(loss), F.lit(0.0)).otherwise(loss)


def max_margin(original: Column, detoxified: Column, *, margin: float = 0.1) -> Column:
    return _nan_is_zero(F.greatest(F.lit(margin) - (detoxified - original), F.lit(0.0)))


def asymmetric_margin(original: Column, detoxified: Column, *, right: float = 1.0, wrong: float = 2.0) -> Column:
    """Wrong-way differences cost ``wrong`` per unit, right-way ones earn ``right``; may be negative."""
    x = detoxified - original
    return _nan_is_zero(F.when(x > 0, -right * x).otherwise(-wrong * x))


def confidence_margin(
    original: Column, detoxified: Column, *, margin: float = 0.1, confidence: float = 0.5
) -> Column:
    """Margin that grows with the size of the difference."""
    x = detoxified - original
    return _nan_is_zero(F.greatest(F.lit(margin) + F.lit(confidence) * F.abs(x) - x, F.lit(0.0)))


def max_entropy(original: Column, detoxified: Column, *, temperature: float = 0.1) -> Column:
    """Negative log of the softmax share of the detoxified side, in overflow-free form."""
    return softplus((original - detoxified) / F.lit(temperature))


METHODS: dict[str, Callable[..., Column]] = {
    "max_margin": max_margin,
    "asymmetric_margin": asymmetric_margin,
    "confidence_margin": confidence_margin,
    "max_entropy": max_entropy,
}


def pair_loss(method: str, original: Column, detoxified: Column, **params) -> Column:
    """Loss by name; an unknown name means ``max_margin``."""
    return METHODS.get(method, max_margin)(original, detoxified, **params)


def mean_loss(method: str, original: Column, detoxified: Column, **params) -> Column:
    """Aggregate loss of many pairs; a max-entropy mean that is not finite is 1."""
    mean = F.avg(pair_loss(method, original, detoxified, **params))
    if method == "max_entropy":
        return F.when(is_bad(mean), F.lit(1.0)).otherwise(mean)
    return mean
