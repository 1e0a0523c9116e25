"""Places on the sphere and the ellipsoid as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from driftmark.functions.units import EARTH_RADIUS_M

#: WGS 84.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
ITERATIONS = 8


def wrap_longitude(lon: Column, center: float = 0) -> Column:
    """Into -180..180 about 0, or else into 0..360."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0 if center == 0 else F.pmod(lon - 180.0, F.lit(360.0)) + 180.0


def colatitude(lat: Column, lon: Column, rot_lat: float = 0.0, rot_lon: float = 0.0) -> tuple[Column, Column]:
    """(theta, phi) in degrees of a place, after a rotation of the grid."""
    return 90.0 - lat - rot_lat, -lon + rot_lon


def cartesian(theta: Column, phi: Column) -> Column:
    """A unit vector (x, y, z) of angles in degrees."""
    t, p = F.radians(theta), F.radians(phi)
    return F.struct((F.sin(t) * F.cos(p)).alias("x"), (F.sin(t) * F.sin(p)).alias("y"), F.cos(t).alias("z"))


def angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle angle in radians (haversine, which keeps small angles exact)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    return angle(lat1, lon1, lat2, lon2) * radius


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def vincenty_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Distance on WGS 84 by Vincenty's inverse formula, a fixed number of iterations; 0 between equal places, nan for missing ones.

    Nearly antipodal places, for which the iteration doesn't settle, get what it has come to.
    """
    f = WGS84_F
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(v))) for v in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    whole = lam = np.radians(lon2 - lon1)

    def about(lam: np.ndarray) -> tuple[np.ndarray, ...]:
        sin = np.sqrt((c2 * np.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * np.cos(lam)) ** 2)
        cos = s1 * s2 + c1 * c2 * np.cos(lam)
        alpha = np.where(sin != 0, c1 * c2 * np.sin(lam) / sin, 0.0)
        square = 1 - alpha * alpha
        # on the equator the middle of the line has no latitude of its own
        middle = np.where(square > 1e-15, cos - 2 * s1 * s2 / square, 0.0)
        return sin, cos, np.arctan2(sin, cos), alpha, square, middle

    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(ITERATIONS):
            sin, cos, sigma, alpha, square, middle = about(lam)
            c = f / 16 * square * (4 + f * (4 - 3 * square))
            lam = whole + (1 - c) * f * alpha * (sigma + c * sin * (middle + c * cos * (2 * middle * middle - 1)))
        sin, cos, sigma, alpha, square, middle = about(lam)
        k = square * ((WGS84_A**2 - WGS84_B**2) / WGS84_B**2)
        a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        twice = middle * middle
        last = b / 6 * middle * (4 * sin * sin - 3) * (4 * twice - 3)
        out = WGS84_B * a * (sigma - b * sin * (middle + b / 4 * (cos * (2 * twice - 1) - last))) / 1000
    return np.where((lat1 == lat2) & (lon1 == lon2), 0.0, out)


@F.pandas_udf(DoubleType())
def _geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    km = vincenty_km(*(v.to_numpy(dtype=float, na_value=np.nan) for v in (lat1, lon1, lat2, lon2)))
    return pd.Series(km).astype("Float64").where(~np.isnan(km), pd.NA)


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """``vincenty_km`` of columns, NULL where a place is missing: Arrow batches, as the iteration is too long an expression to compile."""
    return _geodesic(*(v.cast("double") for v in (lat1, lon1, lat2, lon2)))


def box_degrees(radius_m: float, lat: Column) -> tuple[Column, Column]:
    """Half height and half width in degrees of a box that holds the circle about a place at ``lat``."""
    r = radius_m / EARTH_RADIUS_M
    high = math.degrees(r) * (1 + 1e-9) + 1e-12
    ratio = F.try_divide(F.lit(math.sin(min(r, math.pi / 2))), F.cos(F.radians(lat)))
    return F.lit(high), F.when(F.abs(lat) + high >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9) + 1e-12)
