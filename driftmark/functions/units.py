"""Quantities with units, and the largest movement a step allows."""

from __future__ import annotations

import re

EARTH_RADIUS_M = 6_371_000.0
#: SI factors of the units that parameters use.
FACTORS = {"m": 1.0, "km": 1000.0, "s": 1.0, "min": 60.0, "h": 3600.0, "hour": 3600.0, "d": 86_400.0, "day": 86_400.0}


def quantity(value: str | float | int | dict) -> float:
    """A number as it is, or text like ``60 km / day`` or ``{"magnitude": 60, "units": "km / day"}`` in SI units."""
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, dict):
        value = f"{value['magnitude']} {value['units']}"
    m = re.fullmatch(r"\s*([-+0-9.eE]+)\s*([a-z]+)?\s*(?:/\s*([a-z]+))?\s*", value)
    if not m or not set(filter(None, m.groups()[1:])) <= FACTORS.keys():
        raise ValueError(f"unknown quantity: {value}")
    return float(m[1]) * FACTORS.get(m[2], 1.0) / FACTORS.get(m[3], 1.0)


def max_sigma(speed: str | float, seconds: float, adjustment: float = 5.0, resolution: float | None = None, truncate: float | None = None, radius: float = EARTH_RADIUS_M) -> float:
    """The largest diffusion of a step: in radians, or in pixels of ``resolution`` radians; over ``truncate`` where given."""
    reach = quantity(speed) * seconds * adjustment / radius
    return reach / (resolution or 1.0) / (truncate or 1.0)
