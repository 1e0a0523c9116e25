"""How likely a depth is in a cell, from the depths of its terrain points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins kept above the surface, bins a point is spread over either way, and the least chance.
BUFFER, SPREAD, LEAST = 10, 2, 1e-14


def depth_histogram(points: DataFrame, size: float, bins: int, offset: float = 0.0, by: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """(by, depth_bin, exceedance) for bins 0..bins-1: the chance that a cell's bottom is deeper than the bin.

    points is (by, elevation, stdev).  Each is spread over five bins by a Gaussian of its own deviation (1 where
    missing, 0.5 at least); depths beyond the bins count in the outermost.  Cells without points have no rows.
    """
    top = bins - 0.01
    raw = (-F.col("elevation") - offset) / size
    idx = F.least(F.greatest(raw, F.lit(float(-BUFFER))), F.lit(top)).cast("long") + BUFFER  # a cast cuts towards zero
    st = F.greatest(F.coalesce("stdev", F.lit(1.0)), F.lit(0.5))
    weight = lambda j: F.exp(-F.lit(float(j * j)) / (2 * st * st))
    total = sum((weight(j) for j in range(-SPREAD, SPREAD + 1)), F.lit(0.0))
    spread = F.explode(F.array(*[F.struct(F.least(F.greatest(idx + j, F.lit(0)), F.lit(bins + BUFFER - 1)).alias("bin"), (weight(j) / total).cast("decimal(20,12)").alias("w")) for j in range(-SPREAD, SPREAD + 1)]))
    counted = points.filter("elevation is not null").select(*by, spread.alias("s")).groupBy(*by, "s.bin").agg(F.sum("s.w").alias("w"))
    whole = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "w"))).alias("m"), F.sum("w").alias("total"))
    dense = whole.select(*by, "m", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("depth_bin"))
    each = dense.select(*by, "depth_bin", "total", F.coalesce(F.element_at("m", F.col("depth_bin").cast("long")), F.lit(0).cast("decimal(30,12)")).alias("w"))
    running = F.sum("w").over(Window.partitionBy(*by).orderBy("depth_bin").rowsBetween(Window.unboundedPreceding, 0))
    return each.select(*by, "depth_bin", (1 - running.cast("double") / F.col("total").cast("double")).alias("exceedance"))


def deepest(obs: Column, xe: Column) -> Column:
    """The greatest pressure of a bin over the surface height, shifted by the buffer; NULL where either is missing."""
    known = F.filter(obs, lambda o: o["pressure"].isNotNull())
    return F.when((F.size(known) > 0) & xe.isNotNull(), F.array_max(F.transform(obs, lambda o: F.coalesce(o["pressure"], F.lit(LEAST)) - xe + BUFFER)))


def bathymetry_pdf(binned: DataFrame, reference: DataFrame, histogram: DataFrame, size: float, bins: int) -> DataFrame:
    """(tag_id, time, cell_id, pdf_bathy): the histogram at the deepest observation of each bin and cell.

    reference is (time, cell_id, XE).  Only cells with a histogram stay.  The shift of 10 is in metres as the
    workflow has it, so it agrees with the histogram's own buffer of bins only for bins of one metre.
    """
    cells = reference.join(histogram.select("cell_id").distinct(), "cell_id", "left_semi").join(binned, "time")
    value = deepest(F.col("obs"), F.col("XE"))
    keyed = cells.select("tag_id", "time", "cell_id", value.alias("v")).withColumn("depth_bin", F.least(F.greatest((F.col("v") / size).cast("long"), F.lit(0).cast("long")), F.lit(bins - 1).cast("long")).cast("int"))
    found = keyed.join(histogram.select("cell_id", "depth_bin", "exceedance"), ["cell_id", "depth_bin"], "left")
    chance = F.when(F.col("exceedance") > 0, F.col("exceedance")).otherwise(F.lit(LEAST))
    return found.select("tag_id", "time", "cell_id", F.when(F.col("v").isNotNull(), chance).alias("pdf_bathy"))


def half_width(size: float) -> float:
    return math.fabs(size) / 2
