"""HEALPix, the equal-area grid of the sphere (Gorski et al. 2005), as column expressions and as numpy twins.

Angles are radians: theta from the north pole, phi eastwards.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions.geodesy import let

#: Of the twelve base faces, ring and longitude offsets of their lowest corner.
FACE_RING = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_PHI = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
#: Shifts and masks that part or join the bits of a number.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _step(move, shift: int, mask: int):
    return lambda v: v.bitwiseOR(move(v, shift)).bitwiseAND(F.lit(mask))


def _spread(v: Column) -> Column:
    for shift, mask in SPREAD:
        v = let(v, _step(F.shiftleft, shift, mask))
    return v


def _squeeze(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(SPREAD[-1][1]))
    for (shift, _), mask in zip(reversed(SPREAD), [m for _, m in SPREAD[-2::-1]] + [0x00000000FFFFFFFF], strict=True):
        v = let(v, _step(F.shiftright, shift, mask))
    return v


def angles_to_cell(level: int, theta: Column, phi: Column) -> Column:
    """The nested cell that holds a direction."""
    turn = F.pmod(phi, F.lit(2 * math.pi)) / (math.pi / 2)
    at = let(F.struct(theta.alias("theta"), F.cos(theta).alias("z"), turn.alias("tt")), lambda d: _face_place(level, d))
    return let(at, lambda f: (f["face"] * 4**level + _spread(f["x"]) + 2 * _spread(f["y"])).cast("long"))


def _face_place(level: int, d: Column) -> Column:
    """(face, x, y) of a direction (theta, z = cos theta, tt = phi in right angles)."""
    n = 1 << level
    theta, z, za = d["theta"], d["z"], F.abs(d["z"])
    tt = F.when(d["tt"] >= 4, 0.0).otherwise(d["tt"])
    # between the caps
    jp, jm = F.floor(n * (0.5 + tt) - n * z * 0.75), F.floor(n * (0.5 + tt) + n * z * 0.75)
    ip, im = F.shiftright(jp, level), F.shiftright(jm, level)
    face_e = F.when(ip == im, ip.bitwiseOR(F.lit(4).cast("long"))).when(ip < im, ip).otherwise(im + 8)
    x_e, y_e = jm.bitwiseAND(F.lit(n - 1).cast("long")), n - jp.bitwiseAND(F.lit(n - 1).cast("long")) - 1
    # the caps; 1 - |z| is exact near a pole only from theta itself
    near = F.when(z > 0, F.sin(theta / 2)).otherwise(F.cos(theta / 2))
    ntt = F.least(F.floor(tt), F.lit(3).cast("long"))
    reach = n * math.sqrt(6.0) * near
    cp, cm = F.least(F.floor((tt - ntt) * reach), F.lit(n - 1).cast("long")), F.least(F.floor((1 - (tt - ntt)) * reach), F.lit(n - 1).cast("long"))
    north = z >= 0
    face_p = F.when(north, ntt).otherwise(ntt + 8)
    x_p, y_p = F.when(north, n - cm - 1).otherwise(cp), F.when(north, n - cp - 1).otherwise(cm)
    belt = za <= 2 / 3
    face, x, y = F.when(belt, face_e).otherwise(face_p), F.when(belt, x_e).otherwise(x_p), F.when(belt, y_e).otherwise(y_p)
    return F.struct(face.cast("long").alias("face"), x.cast("long").alias("x"), y.cast("long").alias("y"))


def cell_to_face(level: int, cell: Column) -> tuple[Column, Column, Column]:
    """(face, x, y) of a nested cell."""
    inside = cell.bitwiseAND(F.lit((1 << 2 * level) - 1).cast("long"))
    return F.shiftright(cell, 2 * level), _squeeze(inside), _squeeze(F.shiftright(inside, 1))


def cell_to_angles(level: int, cell: Column) -> tuple[Column, Column]:
    """(theta, phi) of a nested cell's centre."""
    n = 1 << level
    face, x, y = cell_to_face(level, cell)
    whole = let(F.struct(face.alias("face"), x.alias("x"), y.alias("y")), lambda f: _centre(n, f["face"], f["x"], f["y"]))
    return whole["theta"], whole["phi"]


def _centre(n: int, face: Column, x: Column, y: Column) -> Column:
    ring = F.element_at(F.array(*[F.lit(v) for v in FACE_RING]), (face + 1).cast("int")) * n - x - y - 1
    nr = F.when(ring < n, ring).when(ring > 3 * n, 4 * n - ring).otherwise(F.lit(n).cast("long"))
    z = F.when(ring < n, 1 - nr * nr / F.lit(3.0 * n * n)).when(ring > 3 * n, nr * nr / F.lit(3.0 * n * n) - 1).otherwise((2 * n - ring) * F.lit(2 / (3 * n)))
    k = F.element_at(F.array(*[F.lit(v) for v in FACE_PHI]), (face + 1).cast("int")) * nr + x - y
    return F.struct(F.acos(z).alias("theta"), (F.lit(math.pi / 4) * F.when(k < 0, k + 8 * nr).otherwise(k) / nr).alias("phi"))


def place_to_cell(level: int, lat: Column, lon: Column) -> Column:
    return angles_to_cell(level, F.radians(90.0 - lat), F.radians(lon))


def cell_to_place(level: int, cell: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of a nested cell's centre, lon in -180..180."""
    theta, phi = cell_to_angles(level, cell)
    lon = F.degrees(phi)
    return 90.0 - F.degrees(theta), F.when(lon > 180, lon - 360).otherwise(lon)


def ring_to_angles(level: int, cell: Column) -> tuple[Column, Column]:
    """(theta, phi) of a cell in the ring numbering."""
    n = 1 << level
    cap, total = 2 * n * (n - 1), 12 * n * n
    a = F.floor((1 + F.sqrt(1 + 2.0 * cell)) / 2)
    low = total - cell
    c = F.floor((1 + F.sqrt(2.0 * low - 1)) / 2)
    ip = cell - cap
    i = F.floor(ip / F.lit(4.0 * n)) + n
    odd = F.when((i + n) % 2 == 1, 1.0).otherwise(0.5)
    z = F.when(cell < cap, 1 - a * a / F.lit(3.0 * n * n)).when(cell < total - cap, (2 * n - i) * F.lit(2 / (3 * n))).otherwise(c * c / F.lit(3.0 * n * n) - 1)
    phi = F.when(cell < cap, (cell + 1 - 2 * a * (a - 1) - 0.5) * math.pi / (2 * a)).when(cell < total - cap, (ip % (4 * n) + 1 - odd) * math.pi / (2 * n)).otherwise((4 * c + 1 - (low - 2 * c * (c - 1)) - 0.5) * math.pi / (2 * c))
    return F.acos(z), phi


def centres(level: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lon) in degrees of nested cells, by numpy."""
    n, cells = 1 << level, np.asarray(cells, dtype=np.int64)
    face, inside = cells >> 2 * level, cells & (n * n - 1)
    x, y = sum((inside >> 2 * k & 1) << k for k in range(max(1, level))), sum((inside >> 2 * k + 1 & 1) << k for k in range(max(1, level)))
    ring = np.array(FACE_RING)[face] * n - x - y - 1
    nr = np.where(ring < n, ring, np.where(ring > 3 * n, 4 * n - ring, n))
    z = np.where(ring < n, 1 - nr * nr / (3 * n * n), np.where(ring > 3 * n, nr * nr / (3 * n * n) - 1, (2 * n - ring) * 2 / (3 * n)))
    k = np.array(FACE_PHI)[face] * nr + x - y
    lon = np.degrees(math.pi / 4 * np.where(k < 0, k + 8 * nr, k) / nr)
    return 90 - np.degrees(np.arccos(z)), np.where(lon > 180, lon - 360, lon)


def resolution(level: int) -> float:
    """The side in radians of a square as large as a cell."""
    return math.sqrt(4 * math.pi / (12 * 4**level))


#: The level at which cells about a box are looked for on the driver: 49,152 cells at most, whatever the grid's level.
COARSE = 6


def cells_in_box(spark: SparkSession, level: int, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """(cell_id, lat, lon) of every cell whose centre lies in the box, ends included; lon[0] > lon[1] spans the date line.

    Coarse cells near the box are found first; their parts are made and tested in tasks.
    """
    top = min(level, COARSE)
    at_lat, at_lon = centres(top, np.arange(12 * 4**top))
    margin = 2 * math.degrees(resolution(top))
    wide = np.where(np.abs(at_lat) + margin >= 89, 360.0, margin / np.maximum(np.cos(np.radians(at_lat)), 1e-3))
    width = (lon[1] - lon[0]) % 360 if lon[0] > lon[1] or lon[1] - lon[0] < 360 else 360.0
    past = (at_lon - lon[0] + wide) % 360
    near = (at_lat >= lat[0] - margin) & (at_lat <= lat[1] + margin) & ((past <= width + 2 * wide) | (wide >= 180))
    parts = 4 ** (level - top)
    coarse = spark.createDataFrame([(int(c),) for c in np.flatnonzero(near)], "coarse long")
    inside = F.explode(F.sequence(F.col("coarse") * parts, F.col("coarse") * parts + (parts - 1))).alias("cell_id")
    cells = coarse.repartition(max(1, int(near.sum()) * parts // 200_000 + 1)).select(inside)
    y, x = cell_to_place(level, F.col("cell_id"))
    if width >= 360:
        across = F.lit(True)
    elif lon[0] > lon[1]:
        across = (F.col("lon") >= lon[0]) | (F.col("lon") <= lon[1])
    else:
        across = (F.col("lon") >= lon[0]) & (F.col("lon") <= lon[1])
    return cells.select("cell_id", y.alias("lat"), x.alias("lon")).filter((F.col("lat") >= lat[0]) & (F.col("lat") <= lat[1]) & across)


def snapped(level: int, lat: Column, lon: Column) -> tuple[Column, Column]:
    """The centre of the cell that holds a place."""
    return cell_to_place(level, place_to_cell(level, lat, lon))
