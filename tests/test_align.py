"""Time slices, bins, places and selections; golden values of the documented cases."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark import schema
from driftmark.functions import geodesy, units
from driftmark.operators import align


def day(h, m=0, s=0):
    return datetime(2022, 7, 1, h, m, s)


@pytest.mark.parametrize("times", [[day(1), day(5), None], [day(1), None, day(5)], [None, day(1), day(5), day(9)]])
def test_time_slice_takes_first_two_known_times_by_position(spark, times):
    e = spark.createDataFrame([("a", k, t) for k, t in enumerate(times)], "tag_id string, row int, time timestamp")
    (r,) = align.time_slice(e, ["row"]).collect()
    assert (r.start, r.stop) == (day(1), day(5))


def test_adapt_model_time(spark):
    df = spark.createDataFrame([(day(1, 29), day(5, 31)), (day(1, 30), day(5, 30))], "a timestamp, b timestamp")
    a, b = align.adapt_model_time(F.col("a"), F.col("b"))
    got = [tuple(r) for r in df.select(a, b).collect()]
    assert got == [(day(0, 59), day(6, 1)), (day(1, 30), day(5, 30))]


def binned(spark, n, first, step, size, origin, closed="left"):
    rows = [("a", first + timedelta(seconds=step * k), float(v), 1.0) for k, v in enumerate(np.linspace(0, 1, n))]
    df = spark.createDataFrame(rows, "tag_id string, time timestamp, temperature double, pressure double")
    out = align.bin_observations(df, timedelta(seconds=size), origin, closed).orderBy("time").collect()
    return [[round(o.temperature * (n - 1)) for o in r.obs] for r in out], [r.time for r in out]


def test_bins_closed_left(spark):
    groups, times = binned(spark, 10, day(12), 60, 300, day(12))
    assert groups == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]] and times == [day(12), day(12, 5)]


def test_bins_of_an_odd_origin(spark):
    groups, _ = binned(spark, 12, day(13, 46, 25), 90, 360, day(13, 46, 20))
    assert groups == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


def test_bins_closed_right_take_their_end(spark):
    groups, times = binned(spark, 10, day(12), 60, 300, day(12), "right")
    assert groups == [[0], [1, 2, 3, 4, 5], [6, 7, 8, 9]] and times[0] == day(11, 55)


@pytest.mark.parametrize("step", [30, 90, 120])
def test_time_resolution(spark, step):
    df = spark.createDataFrame([("a", day(1) + timedelta(seconds=step * k)) for k in range(5)], "tag_id string, time timestamp")
    (r,) = align.time_resolution(df, ["tag_id"]).collect()
    assert (r.seconds, r.regular) == (step, True)


def test_midpoint_bounds(spark):
    df = spark.createDataFrame([("a", day(12, 2, 30)), ("a", day(12, 7, 30))], "tag_id string, time timestamp")
    got = align.midpoint_bounds(df, ["tag_id"]).orderBy("time").collect()
    assert [(r.bin_start, r.bin_end) for r in got] == [(day(12), day(12, 5)), (day(12, 5), day(12, 10))]


def test_longitudes_wrap(spark):
    df = spark.range(401).select((F.col("id") - 20).cast("double").alias("lon"))
    got = df.select(geodesy.wrap_longitude(F.col("lon")).alias("a"), geodesy.wrap_longitude(F.col("lon"), 180).alias("b")).agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    assert got[0] >= -180 and got[1] <= 180 and got[2] >= 0 and got[3] <= 540


def test_dimensions(spark):
    names = lambda *c: spark.createDataFrame([(0,) * len(c)], list(c))
    assert schema.spatial_columns(names("x", "y", "v")) == ("x", "y")
    assert schema.spatial_columns(names("latitude", "longitude")) == ("latitude", "longitude")
    assert schema.temporal_column(names("time", "v")) == "time"
    with pytest.raises(ValueError, match="spatial"):
        schema.spatial_columns(names("a", "b"))
    with pytest.raises(ValueError, match="temporal"):
        schema.temporal_column(names("a", "b"))


def test_quantities():
    assert units.quantity("60 km / day") == pytest.approx(60_000 / 86_400)
    assert units.quantity({"magnitude": 2, "units": "km"}) == 2000 and units.quantity(5) == 5
    assert units.max_sigma("60 km / day", 3600, 5) == pytest.approx(60_000 / 24 * 5 / 6_371_000)
    assert units.max_sigma("60 km / day", 3600, 5, resolution=1e-3, truncate=4) == pytest.approx(60_000 / 24 * 5 / 6_371_000 / 1e-3 / 4)
    with pytest.raises(ValueError):
        units.quantity("3 parsec")


def test_prune_subsample_visited(spark):
    m = spark.createDataFrame([("a", -1.0, [(1.0, 10.0), (9.0, 5.0), (12.0, 4.0)]), ("b", 0.5, [(1.0, 9.0)])], "place string, XE double, profile array<struct<depth:double,temp:double>>")
    assert {r.place: len(r.profile) for r in align.prune_depth(m, 9.0).collect()} == {"a": 2, "b": 1}
    t = spark.createDataFrame([("a", k) for k in range(7)], "tag_id string, time int")
    assert sorted(r.time for r in align.subsample(t, 3, ["tag_id"]).collect()) == [0, 3]
    s = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 0.5), ("a", 2, 0.0)], "tag_id string, cell_id int, states double")
    assert {r.cell_id for r in align.visited_cells(s, ["tag_id"]).collect()} == {1}
