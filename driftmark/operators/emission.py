"""Emission densities, their combination and normalisation.

An emission table is (tag_id, time, cell_id, pdf); a layer is another column beside pdf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.distributions import normal, normalise, planar_normal, spherical_normal
from driftmark.functions.healpix import snapped
from driftmark.operators.align import by_place


def temperature_pdf(diff: DataFrame, std: float) -> DataFrame:
    """diff with ``pdf``, the normal density of the difference."""
    return diff.withColumn("pdf", normal(F.col("diff"), 0.0, std))


def position_pdf(grid: DataFrame, events: DataFrame, event: str, std: float, spherical: bool = True, names: tuple[str, str] = ("lat", "lon"), level: int | None = None, digits: int | None = None) -> DataFrame:
    """(tag_id, cell_id, p): for each tag, a Gaussian about the place of its event, normalised over ``grid``.

    On a HEALPix grid of a ``level`` the place is its cell's centre, so a deviation far below a cell's size still leaves
    that cell.  Tags whose event has no place have no rows.  A density is worked out once for all cells and tags of the
    same two places; sums are taken first, so pairs of cells and tags are neither shuffled nor sorted.  With ``digits`` it
    is rounded, once as well.  Events are a row a tag and are broadcast while Spark's threshold allows; the grid is never
    collected.
    """
    at = events.filter(F.col("event_name") == event).filter("latitude is not null and longitude is not null").select("tag_id", "latitude", "longitude")
    if level is not None:
        y, x = snapped(level, F.col("latitude"), F.col("longitude"))
        at = at.select("tag_id", y.alias("latitude"), x.alias("longitude"))
    cells = by_place(grid.select("cell_id", F.col(names[0]).alias("y"), F.col(names[1]).alias("x")), "cell_id", ["y", "x"])
    y, x, lat, lon = (F.col(c) for c in ("y", "x", "latitude", "longitude"))
    if spherical:
        p = spherical_normal(y, x, (lat, lon), std)
    else:
        cov = {("x", "x"): std * std, ("x", "y"): 0.0, ("y", "x"): 0.0, ("y", "y"): std * std}
        p = planar_normal(x - lon, y - lat, (0.0, 0.0), cov)
    sums = cells.crossJoin(at.select("latitude", "longitude").distinct()).groupBy("latitude", "longitude").agg(F.sum(p * F.size("ids")).alias("total"))
    whole = at.join(sums, ["latitude", "longitude"]).withColumn("total", F.sum("total").over(Window.partitionBy("tag_id")))
    places = by_place(whole, "tag_id", ["latitude", "longitude", "total"], 8).withColumnRenamed("ids", "tags")
    share = F.try_divide(p, F.col("total"))
    pairs = cells.crossJoin(places).select("tags", "ids", (share if digits is None else F.round(share, digits)).alias("p"))
    return pairs.select(F.inline("tags"), "ids", "p").select("tag_id", F.inline("ids"), "p")


def compute_emission_pdf(diff: DataFrame, grid: DataFrame, events: DataFrame, differences_std: float = 0.75, initial_std: float = 1e-5, recapture_std: float | None = None, spherical: bool = True, level: int | None = None, digits: int | None = None) -> dict[str, DataFrame]:
    """The tables ``emission`` (with pdf), ``initial``, ``final`` (without rows where no recapture place is known) and ``mask``."""
    known = events.filter("latitude is not null and longitude is not null").select("tag_id", "event_name", "latitude", "longitude")
    death = known.filter(F.col("event_name") == "fish_death")
    other = known.filter(F.col("event_name") == "recapture").join(death.select("tag_id").distinct(), "tag_id", "left_anti")
    ends = death.unionByName(other).withColumn("event_name", F.lit("final"))
    return {
        "emission": temperature_pdf(diff, differences_std),
        "initial": position_pdf(grid, events, "release", initial_std, spherical, level=level, digits=digits),
        "final": position_pdf(grid, ends, "final", recapture_std or initial_std, spherical, level=level, digits=digits),
        "mask": diff.groupBy("cell_id").agg(F.bool_or("ocean_mask").alias("mask")) if "ocean_mask" in diff.columns else grid.select("cell_id", F.lit(True).alias("mask")),
    }


def product(columns: list[str]) -> Column:
    """The product of layers; missing in one is missing in all."""
    return reduce(lambda a, b: a * b, [F.col(c) for c in columns])


def combine(layers: DataFrame, columns: list[str], final: DataFrame | None = None, by: tuple[str, ...] = ("tag_id", "time")) -> DataFrame:
    """(by, cell_id, pdf): the product of all layers, at a tag's last time also with ``final`` (tag_id, cell_id, p), normalised."""
    out = layers.select(*by, "cell_id", product(columns).alias("pdf"))
    if final is not None:
        tags = final.select("tag_id").distinct().withColumn("has", F.lit(True))
        last = out.groupBy("tag_id").agg(F.max("time").alias("last"))
        out = out.join(last, "tag_id").join(tags, "tag_id", "left").join(final.select("tag_id", "cell_id", "p"), ["tag_id", "cell_id"], "left")
        out = out.select(*by, "cell_id", F.when((F.col("time") == F.col("last")) & F.coalesce("has", F.lit(False)), F.col("pdf") * F.col("p")).otherwise(F.col("pdf")).alias("pdf"))
    return normalise(out, "pdf", list(by))


def combine_with_acoustic(emission: DataFrame, acoustic: DataFrame, by: tuple[str, ...] = ("tag_id", "time")) -> DataFrame:
    """(by, cell_id, pdf, acoustic, replaced): where at a time every cell has no pdf or no acoustic chance, pdf is the acoustic one.

    ``replaced`` marks those times, for the caller to count and warn of.
    """
    both = emission.select(*by, "cell_id", "pdf").join(acoustic.select(*by, "cell_id", "acoustic"), [*by, "cell_id"], "full_outer")
    none = F.min((F.col("pdf").isNull() | (F.coalesce("acoustic", F.lit(0.0)) == 0)).cast("int")).over(Window.partitionBy(*by)) == 1
    some = F.max(F.col("acoustic").isNotNull().cast("int")).over(Window.partitionBy(*by)) == 1
    return both.withColumn("replaced", none & some).withColumn("pdf", F.when(F.col("replaced"), F.col("acoustic")).otherwise(F.col("pdf")))


def without_acoustic(layers: DataFrame, acoustic: DataFrame) -> DataFrame:
    """layers with ``acoustic`` 1 for tags that have no acoustic table at all.

    For the others a missing chance stays missing: a cell that a silent receiver covers is no place to be in.
    """
    tags = acoustic.select("tag_id").distinct().withColumn("heard", F.lit(True))
    return layers.join(tags, "tag_id", "left").withColumn("acoustic", F.when(F.col("heard").isNull(), 1.0).otherwise(F.col("acoustic"))).drop("heard")


def normalise_pdf(emission: DataFrame, columns: list[str], final: DataFrame | None = None, by: tuple[str, ...] = ("tag_id", "time")) -> DataFrame:
    return combine(emission, columns, final, by)
