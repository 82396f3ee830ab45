"""Clipping vectors and adding calibrated noise."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmill.functions import vectors as vx
from veilmill.functions.rng import laplace, normal
from veilmill.session import cut_lineage

# Encoder scale, clip range in scales, delta.
SIGMA = 0.2
NUM_SIGMAS = 0.5
DELTA = 1e-5
CLIP_LOW = -SIGMA
CLIP_HIGH = NUM_SIGMAS * SIGMA
FEW_SCALES = 1 << 20  #: rows of the table of scales that are broadcast, 24 MB
METHODS = ("laplace", "gaussian", "analytic_gaussian")


def vector_sensitivity(k: int, method: str, width: float = 2 * SIGMA * NUM_SIGMAS) -> float:
    """L1 (Laplace) or L2 (Gaussian) distance of two vectors of ``k`` components in a range
    of ``width``.  The default is the published width; the clip range itself is wider by half."""
    return width * (k if method == "laplace" else math.sqrt(k))


def _log_upper_tail(x: float) -> float:
    """Logarithm of the standard normal upper tail, also far out where the tail underflows."""
    if x < 30:
        return math.log(0.5 * math.erfc(x / math.sqrt(2)))
    series = 1 - 1 / x**2 + 3 / x**4 - 15 / x**6 + 105 / x**8
    return -x * x / 2 - math.log(x * math.sqrt(2 * math.pi)) + math.log(series)


def gaussian_delta(scale: float, epsilon: float, sensitivity: float) -> float:
    """The exact delta of Gaussian noise (Balle and Wang, 2018)."""
    half, shift = sensitivity / (2 * scale), epsilon * scale / sensitivity
    return math.exp(_log_upper_tail(shift - half)) - math.exp(
        epsilon + _log_upper_tail(shift + half)
    )


def analytic_scale(epsilon: float, delta: float, sensitivity: float) -> float:
    """The smallest Gaussian scale that reaches ``delta``, by bisection."""
    low = high = sensitivity
    while gaussian_delta(high, epsilon, sensitivity) > delta:
        high *= 2
    while gaussian_delta(low, epsilon, sensitivity) <= delta:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if gaussian_delta(middle, epsilon, sensitivity) > delta:
            low = middle
        else:
            high = middle
    return high


def noise_scale(
    epsilon: float, k: int, method: str, delta: float = DELTA, width: float | None = None
) -> float:
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, not {method!r}")
    width = 2 * SIGMA * NUM_SIGMAS if width is None else width
    sensitivity = vector_sensitivity(k, method, width)
    if method == "laplace":
        return sensitivity / epsilon
    if method == "gaussian":
        return sensitivity / epsilon * math.sqrt(2 * math.log(1.25 / delta))
    return analytic_scale(epsilon, delta, sensitivity)


def noise_scales(
    budgets: DataFrame, method: str, delta: float = DELTA, width: float | None = None
) -> DataFrame:
    """``(epsilon, k, scale)`` for the distinct ``(epsilon, k)`` of ``budgets``."""

    @F.pandas_udf("double")
    def solve(epsilon: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(
            [noise_scale(e, int(n), method, delta, width) for e, n in zip(epsilon, k)],
            dtype="float64",
        )

    distinct = budgets.select("epsilon", "k").distinct()
    return distinct.withColumn("scale", solve("epsilon", "k"))


def clip_vectors(vecs: DataFrame, low: float = CLIP_LOW, high: float = CLIP_HIGH) -> DataFrame:
    return vecs.withColumn("vec", vx.clip(F.col("vec"), low, high))


def add_noise(
    vecs: DataFrame,
    epsilon: float | str,
    method: str,
    seed,
    delta: float = DELTA,
    width: float | None = None,
    noise_per: str = "row",
    dim: int | None = None,
) -> DataFrame:
    """Add noise to ``vec`` of ``(doc_id, pos, vec)``; ``seed`` must be secret and fresh for each release.

    ``epsilon`` is a number (with ``dim``, the vector length) or a column name; a column is
    calibrated once per distinct value.  ``noise_per="doc"`` repeats one noise vector over
    all rows of a document, ``"row"`` draws for every row.
    """
    if noise_per not in ("row", "doc"):
        raise ValueError("noise_per must be 'row' or 'doc'")
    keys = [F.col("doc_id")] + ([F.col("pos")] if noise_per == "row" else [])
    if isinstance(epsilon, str):
        sized = vecs.withColumn("_k", F.size("vec"))
        scales = noise_scales(
            sized.select(F.col(epsilon).alias("epsilon"), F.col("_k").alias("k")),
            method, delta, width,
        )
        scales = scales.select(
            F.col("epsilon").alias(epsilon), F.col("k").alias("_k"), F.col("scale").alias("_scale")
        )
        # A budget a row at most, and few in practice: vectors meet them where they lie, not by budget.
        scales = cut_lineage(scales, "scales")
        if scales.count() <= FEW_SCALES:
            scales = F.broadcast(scales)
        vecs = sized.join(scales, [epsilon, "_k"]).drop("_k")
        scale: Column = F.col("_scale")
    else:
        if dim is None:
            raise ValueError("a fixed epsilon needs dim, the vector length")
        scale = F.lit(noise_scale(epsilon, dim, method, delta, width))
    draw = laplace if method == "laplace" else normal
    noisy = F.transform(
        vx.as_double(F.col("vec")), lambda x, i: x + draw(scale, seed, *keys, i)
    )
    return vecs.withColumn("vec", noisy).drop("_scale")


def privatize_vectors(
    vecs: DataFrame,
    epsilon: float | str,
    method: str,
    seed,
    delta: float = DELTA,
    low: float = CLIP_LOW,
    high: float = CLIP_HIGH,
    compat: bool = False,
    noise_per: str = "row",
    dim: int | None = None,
) -> DataFrame:
    """Clip, then add noise.  The sensitivity follows from the clip range; ``compat`` uses the
    published width instead, which understates the range by a third."""
    width = None if compat else high - low
    return add_noise(
        clip_vectors(vecs, low, high), epsilon, method, seed, delta, width, noise_per, dim
    )
