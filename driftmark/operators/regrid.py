"""Regridding by sparse weights, and stencils over planar grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bilinear_weights(targets: DataFrame, lat0: float, lon0: float, step: float) -> DataFrame:
    """(cell_id, i, j, weight): the four nodes of a regular grid around each target (cell_id, lat, lon)."""
    y, x = (F.col("lat") - lat0) / step, (F.col("lon") - lon0) / step
    i, j = F.floor(y), F.floor(x)
    four = F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j"), (((y - i) if a else (1 - (y - i))) * ((x - j) if b else (1 - (x - j)))).alias("weight")) for a in (0, 1) for b in (0, 1)])
    return targets.select("cell_id", F.explode(four).alias("n")).select("cell_id", "n.*")


def regrid(source: DataFrame, weights: DataFrame, values: list[str], extra: list[str], min_vertices: int = 1) -> DataFrame:
    """(extra, cell_id, values) by source (extra, i, j, values) and weights (cell_id, i, j, weight).

    Missing nodes drop out and the rest are weighed anew; a target with fewer than min_vertices of them is missing, and
    one without any has no row.
    """
    joined = source.join(weights.filter("weight > 0"), ["i", "j"])
    aggs = []
    for v in values:
        w = F.when(F.col(v).isNotNull(), F.col("weight"))
        n = F.count(F.col(v))
        aggs.append(F.when(n >= min_vertices, F.try_divide(F.sum(F.col(v) * F.col("weight")), F.sum(w))).alias(v))
    out = joined.groupBy(*extra, "cell_id").agg(*aggs, *[F.count(v).alias(f"n_{v}") for v in values])
    return out.filter(" or ".join(f"n_{v} > 0" for v in values)).drop(*[f"n_{v}" for v in values])


def apply_sparse(field: DataFrame, weights: DataFrame, value: str, extra: list[str]) -> DataFrame:
    """A sparse matrix (dst, src, w) applied to field (extra, cell_id, value): a join and a map-side combined sum."""
    return field.withColumnRenamed("cell_id", "src").join(weights, "src").groupBy(*extra, "dst").agg(F.sum(F.col("w") * F.col(value)).alias(value)).withColumnRenamed("dst", "cell_id")


def drop_empty(df: DataFrame, value: str, axis: str) -> DataFrame:
    """Rows of an axis (a row or column of a grid) on which some value is there."""
    held = df.filter(F.col(value).isNotNull()).select(axis).distinct()
    return df.join(held, axis, "left_semi")


def delta_at(grid: DataFrame, at: tuple[float, float], method: str = "nearest", names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """grid with ``p``, 1 at the cell nearest to a point (the first in order of equally near ones), else 0."""
    if method != "nearest":
        raise NotImplementedError(f"method {method!r} is not implemented")
    d = F.pow(F.col(names[0]) - at[0], 2) + F.pow(F.col(names[1]) - at[1], 2)
    best = grid.agg(F.min(F.struct(d.alias("d"), F.col(names[0]).alias("bx"), F.col(names[1]).alias("by"))).alias("b")).select("b.bx", "b.by")
    return grid.crossJoin(F.broadcast(best)).withColumn("p", ((F.col(names[0]) == F.col("bx")) & (F.col(names[1]) == F.col("by"))).cast("double")).drop("bx", "by")


def kernel_table(spark: SparkSession, kernel: np.ndarray) -> DataFrame:
    """(dx, dy, w) of a 2-D kernel, whose size is the caller's and small."""
    hx, hy = kernel.shape[0] // 2, kernel.shape[1] // 2
    return spark.createDataFrame([(i - hx, j - hy, float(kernel[i, j])) for i in range(kernel.shape[0]) for j in range(kernel.shape[1])], "dx int, dy int, w double")


def blur(df: DataFrame, value: str, method: str = "gaussian", size: int = 3, kernel: np.ndarray | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """A planar field (extra, x, y, value) filtered by a stencil, with edges reflected.

    gaussian: the kernel given; uniform, minimum, maximum: over size x size cells.
    """
    spark = df.sparkSession
    if method == "gaussian":
        if kernel is None:
            raise ValueError("a gaussian filter needs a kernel")
    elif method in ("uniform", "minimum", "maximum"):
        kernel = np.full((size, size), 1.0 / (size * size))
    else:
        raise ValueError(f"unknown method: {method}")
    w = Window.partitionBy(*extra) if extra else None
    ends = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    if w is None:
        held = df.crossJoin(F.broadcast(df.agg(*ends)))
    else:
        held = df.join(df.groupBy(*extra).agg(*ends), list(extra))
    # every cell asks for its neighbours; places beyond an edge are mirrored on it
    mirror = lambda p, lo, hi: F.when(p < lo, 2 * lo - 1 - p).when(p > hi, 2 * hi + 1 - p).otherwise(p)
    asked = held.select(*extra, "x", "y", "x0", "x1", "y0", "y1").crossJoin(F.broadcast(kernel_table(spark, kernel)))
    asked = asked.select(*extra, "x", "y", "w", mirror(F.col("x") + F.col("dx"), F.col("x0"), F.col("x1")).alias("nx"), mirror(F.col("y") + F.col("dy"), F.col("y0"), F.col("y1")).alias("ny"))
    values = df.select(*extra, F.col("x").alias("nx"), F.col("y").alias("ny"), F.col(value).alias("v"))
    agg = {"minimum": F.min("v"), "maximum": F.max("v")}.get(method, F.sum(F.col("v") * F.col("w")))
    return asked.join(values, [*extra, "nx", "ny"]).groupBy(*extra, "x", "y").agg(agg.alias(value))
