"""Selecting and aligning observations, fields and times."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.schema import require


def axes(first: DataFrame, second: DataFrame) -> DataFrame:
    """All places of two axes, as a field over them has."""
    return first.crossJoin(second)


def by_place(df: DataFrame, row_id: str, place: list[str], most: int = 16) -> DataFrame:
    """(place, ids): the rows of each place as lists of up to ``most`` structs of their id, for what hangs on the place alone.

    Dealt over as many tasks as a shuffle has, as what is made of a list may be far larger than it.  A task holds all that
    is made of one row in memory at once, so lists are short.
    """
    part = F.floor((F.row_number().over(Window.partitionBy(*place).orderBy(row_id)) - 1) / most)
    lists = df.select(*place, row_id).withColumn("part", part).groupBy(*place, "part").agg(F.collect_list(F.struct(row_id)).alias("ids"))
    return lists.repartition(tasks(df.sparkSession)).drop("part")


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def time_slice(events: DataFrame, order: list[str], by: str = "tag_id", time: str = "time") -> DataFrame:
    """(by, start, stop): the first and second event that has a time, in the order given, not by name."""
    known = require(events, by, time).filter(F.col(time).isNotNull())
    ranked = known.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter("n <= 2").groupBy(by).agg(F.max(F.when(F.col("n") == 1, F.col(time))).alias("start"), F.max(F.when(F.col("n") == 2, F.col(time))).alias("stop"))


def adapt_model_time(start: Column, stop: Column) -> tuple[Column, Column]:
    """A slice widened to the hourly fields around it: half an hour before an early minute, half an hour after a late one."""
    half = F.expr("INTERVAL 30 MINUTES")
    return F.when(F.minute(start) < 30, start - half).otherwise(start), F.when(F.minute(stop) > 30, stop + half).otherwise(stop)


def within(column: Column, low, high) -> Column:
    """Both ends belong; a missing end is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (column >= low)
    if high is not None:
        out = out & (column <= high)
    return out


def select_box(df: DataFrame, lat: tuple | None = None, lon: tuple | None = None, names: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """Rows in the box, ends included; plain comparisons, so they reach the scan."""
    for name, ends in zip(names, (lat, lon), strict=True):
        if ends is not None:
            df = df.filter(within(F.col(name), *ends))
    return df


def slice_observations(observations: DataFrame, slices: DataFrame, by: str = "tag_id") -> DataFrame:
    """Observations in their tag's slice, ends included.  Slices are one row a tag; a missing end is open."""
    s = slices.select(by, "start", "stop")
    joined = observations.join(s, by)
    return joined.filter((F.col("start").isNull() | (F.col("time") >= F.col("start"))) & (F.col("stop").isNull() | (F.col("time") <= F.col("stop")))).drop("start", "stop")


def bin_start(time: Column, step: timedelta, origin: datetime, closed: str = "left") -> Column:
    """The start of the regular bin of ``step`` from ``origin`` that holds a time, by arithmetic rather than a range join."""
    micros = step // timedelta(microseconds=1)
    base = (origin - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    off = F.unix_micros(time) - base
    k = F.floor(off / F.lit(micros)) if closed == "left" else F.ceil(off / F.lit(micros)) - 1
    # division is of doubles; put right what it may have rounded
    k = F.when(off < k * micros, k - 1).when(off >= (k + 1) * micros, k + 1).otherwise(k) if closed == "left" else F.when(off <= k * micros, k - 1).when(off > (k + 1) * micros, k + 1).otherwise(k)
    return F.timestamp_micros(k * micros + base)


def bin_observations(observations: DataFrame, step: timedelta, origin: datetime, closed: str = "left", by: str = "tag_id", values: tuple[str, ...] = ("temperature", "pressure")) -> DataFrame:
    """(by, time, obs): each bin's observations as an array of structs in time order; no padding is needed."""
    keyed = observations.withColumn("bin", bin_start(F.col("time"), step, origin, closed))
    return keyed.groupBy(by, "bin").agg(F.array_sort(F.collect_list(F.struct("time", *values))).alias("obs")).withColumnRenamed("bin", "time")


def midpoint_bounds(times: DataFrame, by: list[str], time: str = "time") -> DataFrame:
    """bin_start and bin_end at the midpoints of neighbouring times; ends reach as far out as in."""
    w = Window.partitionBy(*by).orderBy(time)
    t = F.unix_micros(time)
    before, after = F.lag(t).over(w), F.lead(t).over(w)
    left = F.coalesce(t - before, after - t, F.lit(0))
    right = F.coalesce(after - t, t - before, F.lit(0))
    return times.withColumns({"bin_start": F.timestamp_micros(t - F.floor(left / 2)), "bin_end": F.timestamp_micros(t + F.floor(right / 2))})


def time_resolution(times: DataFrame, by: list[str], time: str = "time") -> DataFrame:
    """(by, seconds, regular): the step between a group's times, and whether all steps are equal."""
    step = (F.unix_micros(time) - F.lag(F.unix_micros(time)).over(Window.partitionBy(*by).orderBy(time))) / F.lit(1_000_000)
    return times.withColumn("step", step).groupBy(*by).agg(F.min("step").alias("seconds"), (F.min("step") == F.max("step")).alias("regular"))


def prune_depth(model: DataFrame, max_depth: float | Column, profile: str = "profile") -> DataFrame:
    """Profiles cut to levels no deeper than max_depth less the lowest surface height of the whole model."""
    low = model.agg(F.min("XE").alias("low_xe"))
    limit = (F.lit(max_depth) if not isinstance(max_depth, Column) else max_depth) - F.col("low_xe")
    return model.crossJoin(F.broadcast(low)).withColumn(profile, F.filter(profile, lambda p: p["depth"] <= limit)).drop("low_xe")


def sigma_depth(s: Column, eta: Column, h: Column, hc: Column, theta: float, b: float) -> Column:
    """Depth above the bottom's datum of a terrain-following level (stretched coordinates)."""
    stretch = (1 - b) * F.sinh(theta * s) / math.sinh(theta) + b * (F.tanh(theta * (s + 0.5)) - math.tanh(0.5 * theta)) / (2 * math.tanh(0.5 * theta))
    return (eta * (1 + s) + hc * s + (h - hc) * stretch).cast("float") + eta


def visited_cells(states: DataFrame, by: list[str], cell: str = "cell_id") -> DataFrame:
    """Rows of cells whose states add up to more than 0."""
    seen = states.groupBy(*by, cell).agg(F.sum("states").alias("total")).filter("total > 0").select(*by, cell)
    return states.join(seen, [*by, cell], "left_semi")


def subsample(df: DataFrame, step: int, by: list[str], time: str = "time") -> DataFrame:
    """Every step-th time of a group from its first, never its last."""
    steps = df.select(*by, time).distinct()
    w = Window.partitionBy(*by)
    numbered = steps.withColumn("k", F.row_number().over(w.orderBy(time)) - 1).withColumn("n", F.count("*").over(w))
    return df.join(numbered.filter((F.col("k") % step == 0) & (F.col("k") < F.col("n") - 1)).select(*by, time), [*by, time], "left_semi")


def jumps(df: DataFrame, value: str, by: list[str], threshold: float = 0.2, time: str = "time") -> DataFrame:
    """Each row with its difference to the one before, and whether that is above the threshold."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(time))
    return df.withColumn("difference", d).withColumn("jump", F.coalesce(d > threshold, F.lit(False)))


def coastal_weight(distance_km: Column, rate: float = 0.01) -> Column:
    """What differences are divided by near a coast: 2 at the coast, 1 far from it."""
    return 1 + F.exp(-distance_km * distance_km * rate)


def mark_coastal(diff: DataFrame, distances: DataFrame, step: float, names: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """diff over its coastal weight, with distance interpolated linearly from a grid of ``step`` degrees.

    Each place meets its four corners by their grid numbers, an equi-join; corners without a distance leave it out.
    """
    lat, lon = names
    grid = distances.select(F.round(F.col(lat) / step).cast("long").alias("gi"), F.round(F.col(lon) / step).cast("long").alias("gj"), "distance")
    i, j = F.floor(F.col(lat) / step), F.floor(F.col(lon) / step)
    fi, fj = F.col(lat) / step - i, F.col(lon) / step - j
    corner = lambda di, dj: F.struct((i + di).alias("gi"), (j + dj).alias("gj"), ((fi if di else 1 - fi) * (fj if dj else 1 - fj)).alias("w"))
    keys = [c for c in diff.columns if c != "diff"]
    four = diff.withColumn("corner", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)]))).select(*keys, "diff", "corner.*")
    joined = four.join(grid, ["gi", "gj"], "left").groupBy(*keys).agg(F.first("diff").alias("diff"), F.try_divide(F.sum(F.col("w") * F.col("distance")), F.sum(F.when(F.col("distance").isNotNull(), F.col("w")))).alias("distance"))
    return joined.withColumn("diff", F.col("diff") / coastal_weight(F.col("distance")))


def month(time: Column) -> Column:
    return F.month(time)
