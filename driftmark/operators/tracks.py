"""Tracks decoded from states, and their quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.geodesy import geodesic_km

QUANTITIES = ("speed", "distance")


def mean_track(states: DataFrame, grid: DataFrame, by: tuple[str, ...] = ("tag_id", "time")) -> DataFrame:
    """(by, latitude, longitude): the centre of mass of each time's states."""
    joined = states.join(grid.select("cell_id", "lat", "lon"), "cell_id").filter("states is not null")
    total = F.sum("states")
    return joined.groupBy(*by).agg(F.try_divide(F.sum(F.col("lat") * F.col("states")), total).alias("latitude"), F.try_divide(F.sum(F.col("lon") * F.col("states")), total).alias("longitude"))


def modal_track(states: DataFrame, grid: DataFrame, by: tuple[str, ...] = ("tag_id", "time")) -> DataFrame:
    """(by, cell_id, latitude, longitude): each time's likeliest cell, the first of equals."""
    best = states.filter("states is not null").groupBy(*by).agg(F.max_by("cell_id", F.struct("states", -F.col("cell_id"))).alias("cell_id"))
    return best.join(grid.select("cell_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), "cell_id").select(*by, "cell_id", "latitude", "longitude")


def to_trajectory(track: DataFrame, name: str) -> DataFrame:
    return track.withColumn("traj_id", F.lit(name))


def additional_quantities(track: DataFrame, quantities: tuple[str, ...] = QUANTITIES, by: tuple[str, ...] = ("tag_id",)) -> DataFrame:
    """track with speed (km/h) and distance (km) from the place before; the first distance is 0, the first speed the second's."""
    for q in quantities:
        if q not in QUANTITIES:
            raise ValueError(f"unknown quantity: {q}")
    w = Window.partitionBy(*by).orderBy("time")
    d = geodesic_km(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    hours = (F.unix_micros("time") - F.unix_micros(F.lag("time").over(w))) / F.lit(3.6e9)
    out = track.withColumn("_d", d).withColumn("_h", hours)
    if "speed" in quantities:
        speed = F.try_divide(F.col("_d"), F.col("_h"))
        out = out.withColumn("_s", speed).withColumn("speed", F.coalesce("_s", F.lead("_s").over(w))).drop("_s")
    if "distance" in quantities:
        out = out.withColumn("distance", F.coalesce("_d", F.lit(0.0)))
    return out.drop("_d", "_h")


def to_dataframe(track: DataFrame, *others: str) -> DataFrame:
    """Other columns first, then longitude and latitude, as tracks are written."""
    return track.select(*others, "longitude", "latitude")


def frames(states: DataFrame, emission: DataFrame, grid: DataFrame, step: int = 1, by: tuple[str, ...] = ("tag_id",)) -> DataFrame:
    """What a movie of the distributions shows: (by, frame, time, cell_id, lat, lon, states, pdf), visited cells only."""
    from driftmark.operators.align import subsample, visited_cells

    held = subsample(visited_cells(states, list(by)), step, list(by))
    both = held.join(emission.select(*by, "time", "cell_id", "pdf"), [*by, "time", "cell_id"], "left").join(grid.select("cell_id", "lat", "lon"), "cell_id")
    return both.withColumn("frame", F.dense_rank().over(Window.partitionBy(*by).orderBy("time")) - 1).select(*by, "frame", "time", "cell_id", "lat", "lon", "states", "pdf")
