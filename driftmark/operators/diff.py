"""Differences between a tag's temperatures and a model's profiles.

A profile is an array of (depth, temp), a bin's observations an array of (pressure, temperature); both are in the row,
so the difference is row-local and needs no shuffle beyond the join that brought them together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def nearest_levels(depth: np.ndarray, pressure: np.ndarray) -> np.ndarray:
    """For each pressure the index of the nearest depth, the first of equally near ones: a binary search over sorted depths."""
    order = np.argsort(depth, kind="stable")
    first = np.ones(len(order), dtype=bool)
    first[1:] = depth[order[1:]] != depth[order[:-1]]
    order = order[first]
    held = depth[order]
    right = np.minimum(np.searchsorted(held, pressure), len(held) - 1)
    left = np.maximum(right - 1, 0)
    below, above = np.abs(held[left] - pressure), np.abs(held[right] - pressure)
    return np.where((below < above) | ((below == above) & (order[left] < order[right])), order[left], order[right])


def mean_differences(depth: list, temp: list, pressure: list, temperature: list) -> list[float | None]:
    """Row by row the mean over observations of what they differ by from the nearest level; None without any.

    Rows of one profile are searched together.  Summed as whole billionths, so the order of observations doesn't show.
    """
    out: list[float | None] = [None] * len(depth)
    by: dict[tuple[bytes, bytes], list[int]] = {}
    for k, lists in enumerate(zip(depth, temp, pressure, temperature, strict=True)):
        if all(v is not None and len(v) for v in lists):
            by.setdefault((lists[0].tobytes(), lists[1].tobytes()), []).append(k)
    for (d, t), rows in by.items():
        d, t = np.frombuffer(d), np.frombuffer(t)
        good = ~(np.isnan(d) | np.isnan(t))
        if not good.any():
            continue
        d, t = np.abs(d[good]), np.abs(t[good])
        at = np.repeat(np.arange(len(rows)), [len(pressure[k]) for k in rows])
        p, seen = np.concatenate([pressure[k] for k in rows]), np.concatenate([temperature[k] for k in rows])
        held = ~(np.isnan(p) | np.isnan(seen))
        p, seen, at = p[held], seen[held], at[held]
        each = seen - t[nearest_levels(d, p)]
        total, n = np.zeros(len(rows), dtype=np.int64), np.bincount(at, minlength=len(rows))
        np.add.at(total, at, (np.sign(each) * np.floor(np.abs(each) * 1e9 + 0.5)).astype(np.int64))
        for k, s, c in zip(rows, total.tolist(), n.tolist(), strict=True):
            if c:
                out[k] = s / 1e9 / c
    return out


@F.pandas_udf(DoubleType())
def _mean_differences(depth: pd.Series, temp: pd.Series, pressure: pd.Series, temperature: pd.Series) -> pd.Series:
    lists = [[None if v is None else np.asarray(v, dtype=float) for v in s] for s in (depth, temp, pressure, temperature)]
    return pd.Series(mean_differences(*lists), dtype="Float64")


def profile_difference(profile: Column, obs: Column, bottom: Column, threshold: float = 0.0) -> Column:
    """Mean difference between observed temperatures and those of the nearest level.

    NULL where the bottom is shallower than threshold times the deepest observation, where no level has both depth and
    temperature, or where no observation has both.  The first of equally near levels counts.  Levels are sorted once a
    row and searched in Arrow batches, so a row costs observations times the logarithm of levels.
    """
    part = lambda of, name: F.transform(of, lambda p: p[name].cast("double"))
    mean = _mean_differences(part(profile, "depth"), part(profile, "temp"), part(obs, "pressure"), part(obs, "temperature"))
    if not threshold:
        return mean
    shallow = bottom < F.array_max(F.transform(obs, lambda o: o["pressure"])) * threshold
    return F.when(F.coalesce(shallow, F.lit(False)), None).otherwise(mean)


def compute_diff(model: DataFrame, binned: DataFrame, threshold: float = 0.8, on: str = "time", place: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """(tag_id, time, place, diff, H0, XE, ocean_mask) of each bin at each of the model's places at that time.

    binned is (tag_id, time, obs); model (time, place, H0, XE, profile, dynamic_bathymetry).  The join is on time; a
    model without times holds for all of them.
    """
    joined = model.join(binned, on) if on in model.columns else model.crossJoin(binned)
    return joined.select("tag_id", on, *place, profile_difference(F.col("profile"), F.col("obs"), F.col("dynamic_bathymetry"), threshold).alias("diff"), "H0", "XE", F.col("H0").isNotNull().alias("ocean_mask"))


def counts_per_time(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rows and non-missing values of each group; a group with none of them is what the checks look for."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count(value).alias("n_values"))


def empty_times(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Groups in which the value is always missing."""
    return counts_per_time(df, value, by).filter("n_values = 0").select(*by)


def require_no_empty_times(df: DataFrame, value: str, by: list[str]) -> None:
    """An error if some group has no value at all."""
    n = empty_times(df, value, by).count()
    if n:
        raise ValueError(f"{n} time steps have no {value}")


def require_below(fits: DataFrame, limit: float, tolerance: float = 1e-9) -> None:
    """An error if some fit (tag_id, sigma) lies on its upper bound, within what the search can tell."""
    on = fits.filter(F.col("sigma") >= limit - tolerance).select("tag_id").limit(20).collect()
    if on:
        raise ValueError(f"the fitted sigma is the largest one allowed for {sorted(str(r[0]) for r in on)}; the bounds are too narrow")
