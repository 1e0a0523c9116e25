"""Differences, emission, acoustics, bathymetry, regridding and HEALPix."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.functions import distributions, geodesy, healpix
from driftmark.operators import acoustic, bathymetry, diff, emission, regrid


def difference(spark, levels, obs, bottom, threshold):
    df = spark.createDataFrame([(levels, obs, bottom)], "profile array<struct<depth:double,temp:double>>, obs array<struct<time:int,temperature:double,pressure:double>>, bottom double")
    return df.select(diff.profile_difference(F.col("profile"), F.col("obs"), F.col("bottom"), threshold)).first()[0]


LEVELS = [(0.5, 10.0), (1.0, 15.0), (1.5, 20.0), (2.0, 25.0), (2.5, 30.0)]
OBS = [(0, 14.0, 1.0), (1, 19.0, 1.5), (2, 24.0, 2.0)]


def test_difference_golden(spark):
    assert difference(spark, LEVELS, OBS, 2.0, 0.8) == pytest.approx(-1.0, rel=1e-5)
    assert difference(spark, LEVELS, OBS, 2.5, 0.8) == pytest.approx(-1.0, rel=1e-5)


def test_difference_missing(spark):
    assert difference(spark, LEVELS, OBS, 1.5, 0.8) is None  # bottom too shallow
    assert difference(spark, LEVELS, OBS, 1.5, 0.0) == pytest.approx(-1.0)
    assert difference(spark, [(None, 1.0), (1.0, None)], OBS, 2.0, 0.8) is None
    assert difference(spark, LEVELS, [(0, None, 1.0), (1, 1.0, None)], 2.0, 0.8) is None
    assert difference(spark, [(0.0, 1.0), (2.0, 5.0)], [(0, 9.0, 1.0)], 2.0, 0.0) == pytest.approx(8.0)  # the first of equals


def fields(spark, rows, names="pdf"):
    return spark.createDataFrame(rows, f"tag_id string, time int, cell_id int, {names} double")


def test_combine_with_final(spark):
    f = fields(spark, [("a", t, c, 2.0) for t in range(3) for c in range(2)])
    final = spark.createDataFrame([("a", c, 3.0) for c in range(2)], "tag_id string, cell_id int, p double")
    assert {r.pdf for r in emission.combine(f, ["pdf"], final).collect()} == {0.5}


def test_combine_without_final(spark):
    f = fields(spark, [("a", 0, 0, 3.0), ("a", 0, 1, 1.0), ("a", 1, 0, 2.0), ("a", 1, 1, 2.0)])
    got = {(r.time, r.cell_id): r.pdf for r in emission.combine(f, ["pdf"]).collect()}
    assert got == {(0, 0): 0.75, (0, 1): 0.25, (1, 0): 0.5, (1, 1): 0.5}


def test_normalise(spark):
    x = [[3, 1, 7, 5, 4], [4, 5, 9, 0, 2], [3, 4, 3, 5, 5]]
    f = fields(spark, [("a", t, c, float(v)) for t, row in enumerate(x) for c, v in enumerate(row)])
    got = {(r.time, r.cell_id): r.pdf for r in distributions.normalise(f, "pdf", ["time"]).collect()}
    assert got == {(t, c): pytest.approx(v / 20) for t, row in enumerate(x) for c, v in enumerate(row)}
    empty = fields(spark, [("a", 0, 0, None), ("a", 1, 0, 0.0)])
    assert [r.pdf for r in distributions.normalise(empty, "pdf", ["time"]).collect()] == [None, None]


def test_acoustic_fallback(spark):
    e = fields(spark, [("a", 0, 0, None), ("a", 0, 1, None), ("a", 1, 0, 0.2), ("a", 1, 1, 0.8)])
    h = fields(spark, [("a", t, c, 0.5) for t in range(2) for c in range(2)], "acoustic")
    got = {(r.time, r.cell_id): (r.pdf, r.replaced) for r in emission.combine_with_acoustic(e, h).collect()}
    assert got == {(0, 0): (0.5, True), (0, 1): (0.5, True), (1, 0): (0.2, False), (1, 1): (0.8, False)}


def test_empty_times_and_bounds(spark):
    e = fields(spark, [("a", 0, 0, None), ("a", 1, 0, 0.2)])
    with pytest.raises(ValueError, match="1 time steps"):
        diff.require_no_empty_times(e, "pdf", ["tag_id", "time"])
    fits = spark.createDataFrame([("a", 0.4999), ("b", 0.1)], "tag_id string, sigma double")
    diff.require_below(fits, 0.6, 1e-3)
    with pytest.raises(ValueError, match="'a'"):
        diff.require_below(fits, 0.5, 1e-3)


def test_differences_against_brute_force():
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(60):
        d, p = rng.integers(0, 9, rng.integers(1, 8)).astype(float), rng.integers(0, 20, rng.integers(1, 6)) / 2
        t, x = rng.random(len(d)), rng.random(len(p))
        d[rng.random(len(d)) < 0.1], x[rng.random(len(x)) < 0.1] = np.nan, np.nan
        rows.append((d, t, p, x))
    rows += [(np.array([1.0]), np.array([2.0]), np.array([]), np.array([])), (None, None, np.array([1.0]), np.array([1.0]))] + rows[:3]

    def brute(d, t, p, x):
        if d is None:
            return None
        levels = [(a, b) for a, b in zip(d, t, strict=True) if a == a and b == b]
        each = [v - min(levels, key=lambda level: abs(level[0] - q))[1] for q, v in zip(p, x, strict=True) if v == v] if levels else []
        return sum(each) / len(each) if each else None

    got = diff.mean_differences(*map(list, zip(*rows, strict=True)))
    assert got == [None if w is None else pytest.approx(w, abs=1e-8) for w in (brute(*r) for r in rows)]


def test_silent_receivers_keep_tags_away(spark):
    """Of ten cells the one that an active receiver covers is no place for a tag that it didn't hear."""
    grid = spark.createDataFrame([(c, 40.0 + c, 0.0, True) for c in range(10)], "cell_id long, lat double, lon double, mask boolean")
    st = spark.createDataFrame([(1, 40.0, 0.0, T0, T0 + timedelta(days=9)), (2, 0.0, 0.0, T0, T0 + timedelta(days=9))], "deployment_id long, deploy_latitude double, deploy_longitude double, deploy_time timestamp, recover_time timestamp")
    hour = timedelta(hours=1)
    bins = spark.createDataFrame([("a", T0 + hour, T0 + hour, T0 + 2 * hour)], "tag_id string, time timestamp, bin_start timestamp, bin_end timestamp")
    heard = acoustic.acoustic_pdf(spark.createDataFrame([("a", T0 + timedelta(days=5), 2)], "tag_id string, time timestamp, deployment_id long"), st, grid, bins, hour, T0, 1000.0)
    e = spark.createDataFrame([(tag, T0 + hour, c, 0.1) for tag in "ab" for c in range(10)], "tag_id string, time timestamp, cell_id long, pdf double")
    layers = emission.without_acoustic(emission.combine_with_acoustic(e, heard), heard)
    got = {(r.tag_id, r.cell_id): r.pdf for r in emission.combine(layers, ["pdf", "acoustic"]).collect()}
    assert got["a", 0] is None and all(got["a", c] == pytest.approx(1 / 9) for c in range(1, 10))
    assert all(got["b", c] == pytest.approx(0.1) for c in range(10))


def test_boxes_hold_all_their_cells(spark):
    for level, lat, lon in ((7, (46.0, 51.0), (-8.0, -1.0)), (3, (60.0, 90.0), (-180.0, 180.0)), (8, (-2.0, 3.0), (178.0, -177.0)), (2, (-90.0, -75.0), (0.0, 360.0))):
        every = np.arange(12 * 4**level)
        y, x = healpix.centres(level, every)
        across = (x >= lon[0]) | (x <= lon[1]) if lon[0] > lon[1] else (x >= lon[0]) & (x <= lon[1]) if lon[1] - lon[0] < 360 else x == x
        want = set(every[(y >= lat[0]) & (y <= lat[1]) & across].tolist())
        assert {r.cell_id for r in healpix.cells_in_box(spark, level, lat, lon).collect()} == want and want


def test_places_snap_to_their_cells(spark):
    """The default deviation is far below a cell's size, and still the release's cell has all the probability."""
    grid = healpix.cells_in_box(spark, 6, (46.0, 51.0), (-8.0, -1.0))
    events = spark.createDataFrame([("a", "release", 48.111, -4.222), ("b", "release", None, None)], "tag_id string, event_name string, latitude double, longitude double")
    got = emission.position_pdf(grid, events, "release", 1e-5, level=6).filter("p > 0").collect()
    at = grid.limit(1).select(healpix.place_to_cell(6, F.lit(48.111), F.lit(-4.222)).alias("c")).first().c
    assert [(r.tag_id, r.cell_id, r.p) for r in got] == [("a", at, 1.0)]


def test_position_densities_are_not_shuffled(spark):
    """Cells and tags share places; some tags have none, a tag's death goes before its recapture."""
    rng = np.random.default_rng(21)
    cells = [(c, 40.0 + c % 4, -5.0 + c % 3) for c in range(30)]
    grid = spark.createDataFrame(cells, "cell_id long, lat double, lon double")
    at = {(t, e): (None if t % 5 == 0 else 41.0 + t % 2, float(rng.integers(-5, -2))) for t in range(20) for e in ("release", "fish_death", "recapture") if e == "release" or (t + len(e)) % 3}
    events = spark.createDataFrame([(t, e, *p) for (t, e), p in at.items()], "tag_id int, event_name string, latitude double, longitude double")
    made = emission.compute_emission_pdf(grid.withColumn("diff", F.lit(0.0)), grid, events, initial_std=0.02, recapture_std=0.03)
    ends = {t: next((at[t, e] for e in ("fish_death", "recapture") if at.get((t, e), (None,))[0] is not None), (None,)) for t in range(20)}
    for name, places, sd in (("initial", {t: at[t, "release"] for t in range(20)}, 0.02), ("final", ends, 0.03)):
        want = {}
        for t, (la, *lo) in places.items():
            if la is not None:
                y, x = np.radians([c[1] for c in cells]), np.radians([c[2] for c in cells])
                a, b = np.radians(la), np.radians(lo[0])
                w = np.exp(-((2 * np.arcsin(np.sqrt(np.sin((a - y) / 2) ** 2 + np.cos(y) * np.cos(a) * np.sin((b - x) / 2) ** 2)) / sd) ** 2) / 2)
                want |= {(t, c): pytest.approx(v) for c, v in enumerate(w / w.sum())}
        got = made[name].collect()
        assert {(r.tag_id, r.cell_id): r.p for r in got} == want and len(got) == len(want) > 0
        above = made[name]._jdf.queryExecution().sparkPlan().toString().split("Join")[0].split("CartesianProduct")[0]
        assert not any(w in above for w in ("Exchange", "Window", "Sort"))


T0 = datetime(2022, 1, 1)


def test_acoustic_pdf(spark):
    grid = spark.createDataFrame([(c, 40.0 + c, 0.0, c != 3) for c in range(4)], "cell_id long, lat double, lon double, mask boolean")
    stations = spark.createDataFrame([(7, 40.0, 0.0, T0, T0 + timedelta(days=9)), (8, 42.0, 0.0, T0, T0 + timedelta(days=9))], "deployment_id long, deploy_latitude double, deploy_longitude double, deploy_time timestamp, recover_time timestamp")
    heard = spark.createDataFrame([("a", T0 + timedelta(hours=1), 7)] * 3, "tag_id string, time timestamp, deployment_id long")
    bins = spark.createDataFrame([("a", T0 + timedelta(days=k), T0 + timedelta(days=k), T0 + timedelta(days=k + 1)) for k in (0, 1, 20)], "tag_id string, time timestamp, bin_start timestamp, bin_end timestamp")
    got = {((r.time - T0).days, r.cell_id): r.acoustic for r in acoustic.acoustic_pdf(heard, stations, grid, bins, timedelta(days=1), T0, "1 km").collect()}
    assert [got[0, c] for c in range(4)] == [1.0, 0.0, 0.0, None]
    assert [got[1, c] for c in range(4)] == [None, 0.5, None, None]  # cells 1 and 3 are out of reach; 3 is land
    assert [got[20, c] for c in range(4)] == [0.25, 0.25, 0.25, None]  # no receiver is out
    with pytest.raises(ValueError, match="stations"):
        acoustic.require_known_receivers(heard, stations.filter("deployment_id = 8"))
    assert acoustic.acoustic_pdf(heard.limit(0), stations, grid, bins, timedelta(days=1), T0).count() == 0
    with pytest.raises(ValueError, match="nondetections"):
        acoustic.fill_map(stations, grid, acoustic.reception_masks(stations, grid, 1000), bins, "other")


def test_many_receivers_and_cells_at_one_place(spark, monkeypatch):
    """They are taken together: six million pairs of receivers and cells here are two of places."""
    real, masks = acoustic.reception_masks, []
    monkeypatch.setattr(acoustic, "reception_masks", lambda *a: masks.append(real(*a)) or masks[-1])
    st = spark.range(3001).selectExpr("id as deployment_id", "if(id = 3000, 45d, 40d) as deploy_latitude", "0d as deploy_longitude").withColumns({"deploy_time": F.lit(T0), "recover_time": F.when(F.col("deployment_id") < 3000, F.lit(T0 + timedelta(days=99))).otherwise(F.lit(T0))})
    grid = spark.range(2020).selectExpr("id as cell_id", "case when id < 2000 then 40d when id < 2010 then 45d else 50d end as lat", "0d as lon", "id % 2000 > 0 as mask")
    heard = spark.createDataFrame([("a", T0 + timedelta(hours=1), min(k, 9)) for k in range(12)], "tag_id string, time timestamp, deployment_id long")
    bins = spark.createDataFrame([("a", T0 + timedelta(days=k), T0 + timedelta(days=k), T0 + timedelta(days=k + 1)) for k in range(40)], "tag_id string, time timestamp, bin_start timestamp, bin_end timestamp")
    got = acoustic.acoustic_pdf(heard, st, grid, bins, timedelta(days=1), T0, "1 km").toPandas().round({"acoustic": 9})
    assert masks[0].count() == 2
    assert len(got) == len(got[["time", "cell_id"]].drop_duplicates()) == 40 * 2020
    first, rest = got[got["time"] == T0], got[got["time"] > T0]
    here = lambda t, low, high: t[(t["cell_id"] >= low) & (t["cell_id"] < high) & (t["cell_id"] % 2000 > 0)]["acoustic"]
    assert got[got["cell_id"] % 2000 == 0]["acoustic"].isna().all()
    assert (here(first, 0, 2000) == 0.0005).all() and (here(first, 2000, 2020) == 0).all()
    assert here(rest, 0, 2000).isna().all() and (here(rest, 2000, 2020) == 0.05).all()


def test_reception_over_the_date_line(spark):
    grid = spark.createDataFrame([(0, 10.0, 179.999), (1, 10.0, -179.999), (2, 10.0, 178.0), (3, 89.9999, 20.0)], "cell_id long, lat double, lon double")
    st = spark.createDataFrame([(1, 10.0, 180.0), (2, 89.9999, -160.0)], "deployment_id long, deploy_latitude double, deploy_longitude double")
    assert {tuple(r) for r in acoustic.reception_masks(st, grid, 1000).collect()} == {(1, 0), (1, 1), (2, 3)}


def histogram_by_hand(points, size, bins):
    out = np.zeros(bins + 10)
    for elevation, sd in points:
        i = int(min(max(-elevation / size, -10), bins - 0.01)) + 10
        s = max(1.0 if sd is None else sd, 0.5)
        w = np.array([math.exp(-j * j / (2 * s * s)) for j in range(-2, 3)])
        for j, v in zip(range(-2, 3), w / w.sum(), strict=True):
            out[min(max(i + j, 0), bins + 9)] += v
    return 1 - np.cumsum(out / out.sum())[:bins]


def test_bathymetry(spark):
    pts = [(-5.0, None), (-31.0, 2.0), (3.0, 0.1), (-900.0, 1.0), (-8.5, 0.7)]
    df = spark.createDataFrame([(1, e, s) for e, s in pts] + [(2, None, 1.0)], "cell_id int, elevation double, stdev double")
    h = bathymetry.depth_histogram(df, 4.0, 12)
    rows = h.orderBy("depth_bin").collect()
    assert {r.cell_id for r in rows} == {1} and np.allclose([r.exceedance for r in rows], histogram_by_hand(pts, 4.0, 12), atol=1e-9)
    obs = spark.createDataFrame([("a", 1, [(6.0,), (2.0,)]), ("a", 2, [(None,)])], "tag_id string, time int, obs array<struct<pressure:double>>")
    ref = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (1, 2, 0.5)], "time int, cell_id int, XE double")
    got = {r.time: r.pdf_bathy for r in bathymetry.bathymetry_pdf(obs, ref, h, 4.0, 12).collect()}
    assert got == {1: pytest.approx(rows[3].exceedance), 2: None}


def test_regrid_weights_missing_nodes(spark):
    nodes = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (1, 1, 5.0)], "i long, j long, v double")
    target = spark.createDataFrame([(9, 0.5, 0.5), (8, 5.0, 5.0)], "cell_id int, lat double, lon double")
    w = regrid.bilinear_weights(target, 0.0, 0.0, 1.0)
    assert [tuple(r) for r in regrid.regrid(nodes, w, ["v"], []).collect()] == [(9, 3.0)]
    assert regrid.regrid(nodes, w, ["v"], [], 4).first().v is None


def test_delta_and_blur(spark):
    g = spark.createDataFrame([(x, y, 1.0 if (x, y) == (1, 1) else 0.0) for x in range(3) for y in range(3)], "x int, y int, v double")
    assert [(r.x, r.y) for r in regrid.delta_at(g, (1.4, 0.6)).filter("p = 1").collect()] == [(1, 1)]
    with pytest.raises(NotImplementedError):
        regrid.delta_at(g, (0, 0), "point-in-polygon")
    assert {r.v for r in regrid.blur(g, "v", "maximum").collect()} == {1.0}
    assert sum(r.v for r in regrid.blur(g, "v", "uniform").collect()) == pytest.approx(1.0)
    with pytest.raises(ValueError, match="unknown method"):
        regrid.blur(g, "v", "sobel")


@pytest.mark.parametrize("level", [0, 1, 3, 5])
def test_healpix_round_trip(spark, level):
    n = 12 * 4**level
    df = spark.range(n)
    theta, phi = healpix.cell_to_angles(level, F.col("id"))
    lat, lon = healpix.cell_to_place(level, F.col("id"))
    got = df.select("id", healpix.angles_to_cell(level, theta, phi).alias("back"), lat.alias("lat"), lon.alias("lon")).orderBy("id").toPandas()
    assert (got["id"] == got["back"]).all()
    a, b = healpix.centres(level, np.arange(n))
    assert np.allclose(a, got["lat"]) and np.allclose((b - got["lon"] + 180) % 360 - 180, 0)


def test_healpix_ring_and_nested_have_the_same_centres(spark):
    level, n = 2, 192
    pick = lambda f: {(round(math.cos(r[0]), 9), round(r[1] % (2 * math.pi), 9)) for r in spark.range(n).select(*f(level, F.col("id"))).collect()}
    assert pick(healpix.ring_to_angles) == pick(healpix.cell_to_angles)


@pytest.mark.parametrize("sigma", [0.01, 1.0, 5.0])
def test_spherical_normal_recovers_sigma(spark, sigma):
    lat, lon = healpix.cell_to_place(3, F.col("id"))
    cells = spark.range(128).select(lat.alias("lat"), lon.alias("lon"))
    at = cells.first()
    a = geodesy.angle(F.col("lat"), F.col("lon"), F.lit(at.lat), F.lit(at.lon))
    got = cells.select(a.alias("a"), distributions.spherical_normal(F.col("lat"), F.col("lon"), (at.lat, at.lon), sigma).alias("p")).filter("p > 1e-300").toPandas()
    if len(got) > 3:
        assert np.polyfit(got["a"], np.log(got["p"]), 2)[0] == pytest.approx(-1 / (2 * sigma**2), rel=1e-6)
    assert spark.range(1).select(distributions.spherical_normal(F.lit(1.0), F.lit(1.0), (None, None), sigma)).first()[0] is None


def test_covariances_and_kernels():
    assert distributions.covariance([4.0, 9.0], ("x", "y")) == {("x", "x"): 4.0, ("x", "y"): 0.0, ("y", "x"): 0.0, ("y", "y"): 9.0}
    assert distributions.covariance(2.0)["y", "y"] == 2.0
    with pytest.raises(ValueError):
        distributions.covariance([1.0, 2.0, 3.0])
    for kind in ("continuous", "discrete"):
        k = distributions.gaussian_kernel(1.3, 4.0, kind)
        assert k.shape == (11, 11) and k.sum() == pytest.approx(1.0) and k[5, 5] == k.max()
    # the discrete kernel's variance is sigma squared
    line, x = distributions.gaussian_line(1.3, 8.0, "discrete"), np.arange(-10, 11)
    assert (line * x * x).sum() == pytest.approx(1.69, rel=1e-6)
    with pytest.raises(ValueError):
        distributions.gaussian_line(1.0, kind="other")
