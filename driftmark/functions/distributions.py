"""Probability densities and kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.geodesy import angle


def normal(x: Column, mean: float | Column = 0.0, std: float = 1.0) -> Column:
    """The normal density that the workflow uses: its scale is the square of ``std``."""
    scale = std * std
    return F.exp(-F.pow((x - mean) / scale, 2) / 2) / (scale * math.sqrt(2 * math.pi))


def covariance(value: float | list | tuple | np.ndarray, axes: tuple[str, str] = ("x", "y")) -> dict[tuple[str, str], float]:
    """A 2 x 2 covariance by axes, from one variance, two, or a matrix."""
    v = np.asarray(value, dtype=float)
    m = np.eye(2) * v if v.ndim == 0 else np.diag(v) if v.ndim == 1 else v
    if m.shape != (2, 2):
        raise ValueError("a covariance is one number, two, or a 2 x 2 matrix")
    return {(a, b): float(m[i, j]) for i, a in enumerate(axes) for j, b in enumerate(axes)}


def planar_normal(x: Column, y: Column, at: tuple[float, float], cov: dict[tuple[str, str], float], axes: tuple[str, str] = ("x", "y")) -> Column:
    """The bivariate normal density about ``at``; ``axes`` says which entries of ``cov`` belong to x and y."""
    a, b, c = cov[axes[0], axes[0]], cov[axes[0], axes[1]], cov[axes[1], axes[1]]
    det = a * c - b * b
    if det <= 0:
        raise ValueError("the covariance is not positive definite")
    dx, dy = x - at[0], y - at[1]
    return F.exp(-(c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (2 * det)) / (2 * math.pi * math.sqrt(det))


def spherical_normal(lat: Column, lon: Column, at: tuple[Column | float | None, Column | float | None], sigma: float) -> Column:
    """A Gaussian of the angle to a place, up to a factor; NULL where the place is missing."""
    if at[0] is None or at[1] is None:
        return F.lit(None).cast("double")
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.exp(-F.pow(angle(lat, lon, lit(at[0]), lit(at[1])) / sigma, 2) / 2)


def normalise(df: DataFrame, column: str, by: list[str], out: str | None = None) -> DataFrame:
    """Each value over the sum of its group; NULL where that is 0 or nothing is there."""
    return df.withColumn(out or column, F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy(*by))))


def _scaled_bessel(x: np.ndarray, t: float) -> np.ndarray:
    """exp(-t) I_n(t) for whole n >= 0, by Miller's downward recurrence normalised with I_0 + 2 (I_1 + ...) = exp(t)."""
    if t == 0:
        return (x == 0).astype(float)
    top = int(max(x.max(), t)) + int(20 + 6 * math.sqrt(max(x.max(), t) + 1)) + 20
    v = np.zeros(top + 2)
    v[top] = 1e-300
    for n in range(top, 0, -1):
        v[n - 1] = v[n + 1] + 2 * n / t * v[n]
        if v[n - 1] > 1e250:
            v /= 1e250
    return (v / (v[0] + 2 * v[1:].sum()))[x]


def gaussian_line(sigma: float, truncate: float = 4.0, kind: str = "continuous") -> np.ndarray:
    """A Gaussian on whole numbers to int(truncate * sigma + 0.5) either way, summing to 1."""
    half = int(truncate * sigma + 0.5)
    x = np.arange(-half, half + 1)
    if kind == "continuous":
        k = np.exp(-(x**2) / (2 * sigma * sigma)) if sigma > 0 else (x == 0).astype(float)
    elif kind == "discrete":
        k = _scaled_bessel(np.abs(x), sigma * sigma)
    else:
        raise ValueError(f"unknown kernel type: {kind}")
    return k / k.sum()


def gaussian_kernel(sigma: float | tuple[float, float], truncate: float = 4.0, kind: str = "continuous") -> np.ndarray:
    """The outer product of two lines, summing to 1."""
    sx, sy = (sigma, sigma) if np.ndim(sigma) == 0 else sigma
    k = np.outer(gaussian_line(float(sx), truncate, kind), gaussian_line(float(sy), truncate, kind))
    return k / k.sum()
