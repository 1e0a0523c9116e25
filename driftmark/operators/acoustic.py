"""Emission from acoustic detections."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.distributions import normalise
from driftmark.functions.geodesy import box_degrees, great_circle_m
from driftmark.functions.units import quantity
from driftmark.operators.align import bin_start, tasks


def unknown_receivers(acoustic: DataFrame, stations: DataFrame) -> DataFrame:
    """Receivers with detections that the station table lacks."""
    return acoustic.select("deployment_id").distinct().join(stations.select("deployment_id"), "deployment_id", "left_anti")


def require_known_receivers(acoustic: DataFrame, stations: DataFrame) -> None:
    lacking = sorted(r[0] for r in unknown_receivers(acoustic, stations).limit(20).collect())
    if lacking:
        raise ValueError(f"there are stations in the acoustic table that are not in the station table: {lacking}")


def count_detections(detections: DataFrame, bins: DataFrame, step: timedelta, origin: datetime, closed: str = "right") -> DataFrame:
    """(tag_id, deployment_id, time, count): dense over a tag's receivers and bins, 0 where nothing was heard.

    bins is (tag_id, time), time being the start of a regular bin.  Partial counts are combined before the shuffle.
    """
    counted = _counted(detections, step, origin, closed)
    dense = detections.select("tag_id", "deployment_id").distinct().join(bins.select("tag_id", "time"), "tag_id")
    return dense.join(counted, ["tag_id", "deployment_id", "time"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def _counted(detections: DataFrame, step: timedelta, origin: datetime, closed: str = "right") -> DataFrame:
    """(tag_id, deployment_id, time, count) where something was heard."""
    keyed = detections.select("tag_id", "deployment_id", bin_start(F.col("time"), step, origin, closed).alias("time"))
    return keyed.groupBy("tag_id", "deployment_id", "time").agg(F.count("*").alias("count"))


def reception_masks(stations: DataFrame, grid: DataFrame, buffer_size: float | str, cell: float = 1.0) -> DataFrame:
    """(deployment_id, cell_id): cells whose centre is within the buffer of a station.

    Stations are spread over the tiles of ``cell`` degrees that their box touches, cells have one tile; tiles make the
    join an equi-join, and the exact distance decides.  A box over the date line or a pole takes in all tiles it needs.
    """
    radius = quantity(buffer_size)
    places = stations.select("deployment_id", F.col("deploy_latitude").alias("slat"), F.col("deploy_longitude").alias("slon")).filter("slat is not null and slon is not null")
    high, wide = box_degrees(radius, F.col("slat"))
    tiles = places.withColumn("ti", F.explode(F.sequence(F.floor((F.col("slat") - high) / cell), F.floor((F.col("slat") + high) / cell))))
    turns = int(round(360 / cell))
    tiles = tiles.withColumn("tj", F.explode(F.array_distinct(F.transform(F.sequence(F.floor((F.col("slon") + 180 - wide) / cell), F.floor((F.col("slon") + 180 + wide) / cell)), lambda j: F.pmod(j, F.lit(turns))))))
    cells = grid.select("cell_id", "lat", "lon", F.floor(F.col("lat") / cell).alias("ti"), F.pmod(F.floor((F.col("lon") + 180) / cell), F.lit(turns)).alias("tj"))
    near = cells.join(tiles, ["ti", "tj"]).filter(great_circle_m(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")) <= radius)
    return near.select("deployment_id", "cell_id")


def active_receivers(stations: DataFrame, bins: DataFrame) -> DataFrame:
    """(deployment_id, tag_id, time): receivers that were out for the whole of a bin (tag_id, time, bin_start, bin_end)."""
    deployed = stations.select("deployment_id", "deploy_time", "recover_time")
    return bins.join(deployed, (F.col("bin_start") >= F.col("deploy_time")) & (F.col("bin_end") <= F.col("recover_time"))).select("deployment_id", "tag_id", "time")


def fill_map(stations: DataFrame, grid: DataFrame, masks: DataFrame, bins: DataFrame, nondetections: str = "mask", normalised: bool = True) -> DataFrame:
    """(tag_id, time, cell_id, fill): the density of a bin in which nothing was heard, normalised over the grid unless told otherwise.

    ``ignore``: uniform.  ``mask``: uniform over the cells that no active receiver covers, missing elsewhere.
    """
    every = bins.select("tag_id", "time").crossJoin(grid.select("cell_id"))
    if nondetections == "ignore":
        flat = every.withColumn("fill", F.lit(1.0))
        return normalise(flat, "fill", ["tag_id", "time"]) if normalised else flat
    if nondetections != "mask":
        raise ValueError("invalid nondetections treatment, choose 'ignore' or 'mask'")
    covered = active_receivers(stations, bins).distinct().join(masks, "deployment_id").select("tag_id", "time", "cell_id").distinct().withColumn("covered", F.lit(True))
    free = every.join(covered, ["tag_id", "time", "cell_id"], "left").withColumn("fill", F.when(F.col("covered").isNull(), 1.0)).drop("covered")
    return normalise(free, "fill", ["tag_id", "time"]) if normalised else free


def acoustic_pdf(detections: DataFrame, stations: DataFrame, grid: DataFrame, bins: DataFrame, step: timedelta, origin: datetime, buffer_size: float | str = 1000.0, nondetections: str = "mask", digits: int | None = None) -> DataFrame:
    """(tag_id, time, cell_id, acoustic) for each bin and cell.

    Where something was heard: the counts of the receivers that reach a cell; else the fill map.  Normalised over all
    cells and then NULL outside the grid's mask, so a time may add up to less than 1.  Without detections the table has
    no rows.  Receivers and cells that share a place are taken together until the last step, and rounded (``digits``) once.
    """
    inside = F.coalesce("mask", F.lit(True)) if "mask" in grid.columns else F.lit(True)
    sites = _by_place(stations.select("deployment_id", "deploy_latitude", "deploy_longitude", "deploy_time", "recover_time"), "deployment_id", "deploy_latitude", "deploy_longitude")
    spots = _by_place(grid.select("cell_id", "lat", "lon", inside.alias("mask")), "cell_id", "lat", "lon")
    site, spot = (t.select(F.col("place").alias(name), *at).dropDuplicates([name]) for t, name, at in ((sites, "deployment_id", ("deploy_latitude", "deploy_longitude")), (spots, "cell_id", ("lat", "lon"))))
    masks = reception_masks(site, spot, buffer_size)
    counts = _counted(detections, step, origin).join(bins.select("tag_id", "time"), ["tag_id", "time"], "left_semi")
    placed = counts.join(sites.select("deployment_id", "place"), "deployment_id").groupBy("tag_id", "time", F.col("place").alias("deployment_id")).agg(F.sum("count").alias("count"))
    heard = placed.join(masks, "deployment_id").groupBy("tag_id", "time", "cell_id").agg(F.sum("count").cast("double").alias("raw"))
    times = counts.groupBy("tag_id", "time").agg(F.lit(True).alias("heard"))
    tags = detections.select("tag_id").distinct()
    out = sites.select(F.col("place").alias("deployment_id"), "deploy_time", "recover_time").distinct()
    fill = fill_map(out, spot, masks, bins.join(tags, "tag_id", "left_semi"), nondetections, normalised=False)
    full = fill.join(times, ["tag_id", "time"], "left").join(heard, ["tag_id", "time", "cell_id"], "left")
    chosen = full.withColumn("acoustic", F.when(F.col("heard"), F.coalesce("raw", F.lit(0.0))).otherwise(F.col("fill")))
    size = spots.groupBy(F.col("place").alias("cell_id")).agg(F.count("*").alias("n"))
    total = F.sum(F.col("acoustic") * F.col("n")).over(Window.partitionBy("tag_id", "time"))
    normal = chosen.join(size, "cell_id").select("tag_id", "time", F.col("cell_id").alias("place"), F.try_divide("acoustic", total).alias("acoustic"))
    if digits is not None:
        normal = normal.withColumn("acoustic", F.round("acoustic", digits))
    n, lists = tasks(grid.sparkSession), spots.groupBy("place", "part").agg(F.collect_list(F.struct("cell_id", "mask")).alias("ids")).drop("part")
    # dealt over a number of tasks, as the lists are far smaller than the rows that are made of them
    dealt = normal.repartition(n, "place").join(lists.repartition(n, "place"), "place").select("tag_id", "time", "acoustic", F.inline("ids"))
    return dealt.select("tag_id", "time", "cell_id", F.when(F.col("mask"), F.col("acoustic")).alias("acoustic"))


def _by_place(df: DataFrame, row_id: str, lat: str, lon: str) -> DataFrame:
    """df with ``place``, the least id at its place, and ``part``, which parts a place's rows by the thousand."""
    w = Window.partitionBy(lat, lon)
    return df.withColumns({"place": F.min(row_id).over(w), "part": F.floor((F.row_number().over(w.orderBy(row_id)) - 1) / 1000)})


def strongest_receiver(counts: DataFrame) -> DataFrame:
    """(tag_id, time, deployment_id): the receiver with most detections, the smallest id of equals."""
    w = Window.partitionBy("tag_id", "time").orderBy(F.desc("count"), "deployment_id")
    return counts.withColumn("n", F.row_number().over(w)).filter("n = 1 and count > 0").select("tag_id", "time", "deployment_id")
