"""Fit of a linear reward head on frozen embeddings, as a distributed convex problem.

The loss of a pair depends on the reward difference w.x of its vectors only, so gradient and Hessian are sums over pairs.
Every step adds them up where the pairs lie, one array a task, and solves one linear system of the size of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.storage import materialize

#: Weight of the squared length of w; gives separable pairs an optimum.
RIDGE = 1e-6
TOLERANCE = 1e-8
#: Shares of the margin over which the corner of the hinge is rounded, so that it has a curvature; each fit starts the next.
ROUNDED = (1.0, 0.5, 0.25, 0.12, 0.05)


@dataclass(frozen=True)
class Fit:
    """Weights, and how the fit ended: steps taken, norm of the gradient, objective, and whether the norm fell below the tolerance."""

    weights: list[float]
    steps: int
    gradient_norm: float
    objective: float
    converged: bool


def _pair_losses(kind: str, margin: float, temperature: float, rounded: float, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of every reward difference, its slope and its curvature."""
    if kind == "max_entropy":
        scaled = z / temperature
        loss = np.logaddexp(0.0, -scaled)
        behind = np.exp(-np.logaddexp(0.0, scaled))
        return loss, -behind / temperature, behind * (1 - behind) / temperature**2
    width = rounded * margin
    short = np.clip((margin - z) / width, 0.0, 1.0)
    loss = np.where(z < margin - width, margin - z - width / 2, short**2 * width / 2)
    return loss, -short, ((short > 0) & (short < 1)) / width


def _sums(pairs: DataFrame, weights: np.ndarray, loss: tuple) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Number of pairs, and the sums of loss, gradient and Hessian at ``weights``."""
    size = len(weights)
    kind, margin, temperature, rounded = loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gradient, hessian = 0, 0.0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            value, slope, curve = _pair_losses(kind, margin, temperature, rounded, x @ weights)
            n += len(x)
            total += value.sum()
            gradient += x.T @ slope
            hessian += (x * curve[:, None]).T @ x
        numbers = np.concatenate([[n, total], gradient, hessian.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int32()), pa.array(numbers)], names=["i", "v"])

    # one number a place and task, added up map-side
    rows = pairs.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(2 + size + size * size)
    for row in rows:
        sums[row["i"]] = row["v"]
    return int(sums[0]), sums[1], sums[2 : 2 + size], sums[2 + size :].reshape(size, size)


def fit_head(
    pairs: DataFrame,
    vec_original: str,
    vec_detoxified: str,
    loss: str = "max_entropy",
    *,
    temperature: float = 0.1,
    margin: float = 0.1,
    ridge: float = RIDGE,
    max_iter: int = 100,
    tolerance: float = TOLERANCE,
) -> Fit:
    """Minimum of the mean pair loss of the rewards w.v plus ``ridge / 2`` times the squared length of w, by Newton steps.

    ``max_entropy`` is the logistic loss of the difference over the temperature; ``max_margin`` is the hinge at the margin with
    its corner rounded, which changes it by at most a fortieth of the margin. A step that doesn't lower the objective is halved. Pairs with a
    missing or shorter vector, or a NULL in one, take no part. Without pairs there are no weights.
    """
    if loss not in ("max_entropy", "max_margin"):
        raise ValueError(f"unknown loss {loss}")
    x = F.zip_with(vec_detoxified, vec_original, lambda d, o: d.cast("double") - o.cast("double"))
    rows = pairs.select(x.alias("x")).where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = materialize(rows, "differences")
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return Fit([], 0, 0.0, 0.0, True)
    rows = rows.where(F.size("x") == size)

    weights, steps = np.zeros(size), 0
    for rounded in ROUNDED if loss == "max_margin" else (0.0,):

        def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            n, total, gradient, hessian = _sums(rows, weights, (loss, margin, temperature, rounded))
            return total / n + ridge / 2 * weights @ weights, gradient / n + ridge * weights, hessian / n + ridge * np.eye(size)

        value, gradient, hessian = at(weights)
        while (norm := float(np.linalg.norm(gradient))) > tolerance and steps < max_iter:
            step, length = np.linalg.solve(hessian, gradient), 1.0
            while (found := at(weights - length * step))[0] > value and length > 1e-6:
                length /= 2
            steps += 1
            if found[0] > value:
                break
            weights, (value, gradient, hessian) = weights - length * step, found
    return Fit([float(w) for w in weights], steps, norm, float(value), norm <= tolerance)


def fit_reward_head(
    pairs: DataFrame, vec_original: str, vec_detoxified: str, loss: str = "max_entropy", *,
    temperature: float = 0.1, margin: float = 0.1, max_iter: int = 100,
) -> list[float]:
    """The weights of ``fit_head``."""
    return fit_head(pairs, vec_original, vec_detoxified, loss, temperature=temperature, margin=margin, max_iter=max_iter).weights
