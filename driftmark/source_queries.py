"""Queries of sources and sinks, which write a table in its format and read it back, and of what goes with them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import distributions, healpix, units
from driftmark.operators import align, emission, movement, regrid, tracks
from driftmark.queries import FIELD, HAVERSINE, NODES, OBS, PLACES, RECEIVERS, SMOOTH, UNPACK, SIGMA, _kernel_sql, field, log_track, observations, places, query, receivers, six, square, starts, table
from driftmark.session import shared_folder
from driftmark.sources import model, store, tags


@query("SELECT event_id, ts AS utc, ts - INTERVAL 9 HOUR AS tokyo FROM events")
def tz_times(spark, sf_dir):
    """Times without a zone, and times of a zone that has had no summer time since 1951."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("utc"), F.col("ts").alias("tokyo"))
    return tags.tz_convert(e, {"utc": None, "tokyo": "Asia/Tokyo"})


def tagging_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release at a tag's first time, and a death at its last view, whose place is unknown; tags without a view have no time for it."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("tag_id")).agg(F.min("ts").alias("a"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("b"))
    release = F.struct(F.lit("release").alias("event_name"), F.col("a").cast("timestamp").alias("time"), (40 + (F.col("tag_id") % 50) / 10).alias("latitude"), (-10 + (F.col("tag_id") % 40) / 5).alias("longitude"))
    nowhere = F.lit(None).cast("double")
    death = F.struct(F.lit("fish_death").alias("event_name"), F.col("b").cast("timestamp").alias("time"), nowhere.alias("latitude"), nowhere.alias("longitude"))
    return e.select("tag_id", F.explode(F.array(release, death)).alias("e")).select("tag_id", "e.*")


@query(f"""WITH {OBS}, s AS (SELECT user_id AS tag_id, min(ts) AS a, max(ts) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id),
u AS (SELECT 'dst' AS kind, tag_id, time, temperature AS first, pressure AS second FROM obs JOIN s USING (tag_id) WHERE time >= a AND (b IS NULL OR time <= b)
UNION ALL SELECT 'release', tag_id, a, 40 + (tag_id % 50) / 10, -10 + (tag_id % 40) / 5 FROM s UNION ALL SELECT 'fish_death', tag_id, b, NULL, NULL FROM s
UNION ALL SELECT 'acoustic', tag_id, time, CAST(pressure AS BIGINT), NULL FROM obs)
SELECT kind, CAST(tag_id AS VARCHAR) AS tag_id, time, first, second FROM u""")
def tag_folders(spark, sf_dir):
    """A folder a tag, written and loaded: its log within its slice, its events, its detections."""
    root, log = shared_folder(spark, "tags"), observations(spark, sf_dir)
    for name, t in (("dst", log), ("tagging_events", tagging_events(spark, sf_dir)), ("acoustic", log.select("tag_id", "time", F.col("pressure").cast("long").alias("deployment_id")))):
        tags.save_tag_files(t, root, name)
    loaded, _ = tags.load_tag(spark, root)
    none = F.lit(None).cast("double")
    parts = [
        loaded.dst.select(F.lit("dst").alias("kind"), "tag_id", "time", F.col("temperature").alias("first"), F.col("pressure").alias("second")),
        loaded.events.select(F.col("event_name").alias("kind"), "tag_id", "time", F.col("latitude").alias("first"), F.col("longitude").alias("second")),
        loaded.acoustic.select(F.lit("acoustic").alias("kind"), "tag_id", "time", F.col("deployment_id").cast("double").alias("first"), none.alias("second")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {RECEIVERS} SELECT deployment_id, concat('station ', deployment_id) AS station_name, deploy_time, deploy_longitude, deploy_latitude, recover_time FROM st")
def stations_from_file(spark, sf_dir):
    """A station table read from a file and merged into one that lacks some stations and all names."""
    path, every = f"{shared_folder(spark, 'stations')}/stations.csv", receivers(spark, sf_dir)
    every.withColumn("station_name", F.concat(F.lit("station "), F.col("deployment_id"))).write.option("header", True).csv(path)
    known = every.filter("deployment_id % 3 <> 0").withColumn("station_name", F.lit(None).cast("string"))
    return tags.update_stations_from(spark, known, path).select("deployment_id", "station_name", "deploy_time", "deploy_longitude", "deploy_latitude", "recover_time")


@query("""WITH x AS (SELECT TIMESTAMP '2022-07-01' + to_hours(CAST(p_partkey % 24 AS INTEGER)) AS time, 40 + (p_partkey % 50) / 10 AS lat, -10 + ((p_partkey // 50) % 40) / 5 AS lon,
  CAST(p_size AS DOUBLE) AS depth, p_retailprice / 100 AS temp, (p_partkey % 24 - 12) / 20 AS xe, 20.0 + p_partkey % 50 AS h0 FROM part),
g AS (SELECT time, lat, lon, depth, max(temp) AS temp, xe, h0 FROM x GROUP BY ALL),
f AS (SELECT * FROM g WHERE time BETWEEN '2022-07-01 03:00:00' AND '2022-07-01 20:00:00' AND lat BETWEEN 40.5 AND 44 AND lon BETWEEN -9 AND -3),
s AS (SELECT *, CASE WHEN depth = (SELECT min(depth) FROM f) THEN 0.0 ELSE depth END + xe AS dynamic FROM f)
SELECT time, lat, lon, round(dynamic, 9) + 0.0 AS depth, temp, round(h0 + xe, 9) AS bottom FROM s WHERE dynamic <= 30 - (SELECT min(xe) FROM s)""")
def model_tables(spark, sf_dir):
    """A catalog's three tables assembled, stored, and loaded by time, box and depth with the first level at the surface."""
    k = F.col("p_partkey")
    time = F.timestamp_seconds(F.unix_timestamp(F.lit("2022-07-01").cast("timestamp")) + (k % 24) * 3600)
    x = table(spark, sf_dir, "part").select(time.alias("time"), (40 + (k % 50) / 10).alias("lat"), (-10 + (F.floor(k / 50) % 40) / 5).alias("lon"), F.col("p_size").cast("double").alias("depth"), (F.col("p_retailprice") / 100).alias("TEMP"), ((k % 24 - 12) / 20).alias("XE"), (20.0 + k % 50).alias("H0"))
    temperature = x.groupBy("time", "lat", "lon", "depth").agg(F.max("TEMP").alias("TEMP"))
    path = f"{shared_folder(spark, 'model')}/sea.parquet"
    model.assemble(temperature, x.select("time", "lat", "lon", "XE").distinct(), x.select("lat", "lon", "H0").distinct()).write.parquet(path)
    m = model.load_model(spark, path, (datetime(2022, 7, 1, 3), datetime(2022, 7, 1, 20)), {"lat": (40.5, 44.0), "lon": (-9.0, -3.0)}, 30.0, surface_at_zero=True)
    levels = m.select("time", "lat", "lon", F.round("dynamic_bathymetry", 9).alias("bottom"), F.explode("profile").alias("p"))
    return levels.select("time", "lat", "lon", six("p.depth", 9).alias("depth"), F.col("p.temp").alias("temp"), "bottom")


@query("""WITH x AS (SELECT p_brand AS place, p_size * 10800 AS t1, max(p_retailprice) / 100 AS v1 FROM part GROUP BY ALL),
n AS (SELECT *, lead(t1) OVER w AS t2, lead(v1) OVER w AS v2, coalesce(lag(t1) OVER w, lead(t1, 2) OVER w) AS t3, coalesce(lag(v1) OVER w, lead(v1, 2) OVER w) AS v3 FROM x WINDOW w AS (PARTITION BY place ORDER BY t1)),
e AS (SELECT *, CAST(unnest(CASE WHEN t2 IS NULL THEN [t1] ELSE range(t1, t2, 3600) END) AS DOUBLE) AS t FROM n)
SELECT place, make_timestamp(CAST(t AS BIGINT) * 1000000) AS time, round(CASE WHEN t = t1 THEN v1 WHEN t3 IS NULL THEN v1 + (v2 - v1) * (t - t1) / (t2 - t1)
  ELSE v1 * (t - t2) / (t1 - t2) * (t - t3) / (t1 - t3) + v2 * (t - t1) / (t2 - t1) * (t - t3) / (t2 - t3) + v3 * (t - t1) / (t3 - t1) * (t - t2) / (t3 - t2) END, 6) + 0.0 AS "TEMP" FROM e""")
def interpolated_times(spark, sf_dir):
    x = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("place"), F.timestamp_seconds(F.col("p_size") * 10800).alias("time")).agg((F.max("p_retailprice") / 100).alias("TEMP"))
    return model.interpolate_times(x, 3600, place=("place",)).withColumn("TEMP", six("TEMP"))


@query(f"WITH {FIELD} SELECT tag_id, time, cell_id, round(pdf, 9) AS pdf, CASE WHEN cell_id % 13 <> 5 THEN round(pdf / 2, 9) END AS states FROM e")
def stored_distributions(spark, sf_dir):
    """Emission and states stored by tag and opened together; states are missing outside the mask."""
    root, e = shared_folder(spark, "stored"), field(spark, sf_dir)
    store.save(e, f"{root}/combined")
    store.save(e.filter("cell_id % 13 <> 5").withColumn("states", F.col("pdf") / 2).drop("pdf"), f"{root}/states")
    return store.open_distributions(spark, root).select(F.col("tag_id").cast("int"), "time", "cell_id", F.round("pdf", 9).alias("pdf"), F.round("states", 9).alias("states"))


@query(f"WITH {PLACES} SELECT k, lat, lon, CAST(lat AS DOUBLE) AS yi, lon AS xi FROM (SELECT k, CAST(lat AS DOUBLE) AS lat, lon FROM pl)")
def stored_diff(spark, sf_dir):
    root = shared_folder(spark, "diff")
    store.save(places(spark, sf_dir), f"{root}/diff")
    return store.open_diff(spark, root).select("k", "lat", "lon", "yi", "xi")


@query(f"WITH {OBS} SELECT concat('tag-', tag_id) AS traj_id, time, -10 + temperature / 100 AS longitude, 40 + pressure / 10 AS latitude FROM obs")
def geoparquet_tracks(spark, sf_dir):
    """Tracks named, stored with points, and read as the table that tracks are written as."""
    root, t = shared_folder(spark, "tracks"), log_track(spark, sf_dir)
    named = tracks.to_trajectory(t, "tag-").withColumn("traj_id", F.concat("traj_id", "tag_id"))
    store.save_trajectories(named.repartition("traj_id"), root, "geoparquet")
    return tracks.to_dataframe(store.read_trajectories(spark, root, fmt="geoparquet"), "traj_id", "time")


@query("SELECT CAST(c_custkey AS VARCHAR) AS tag, 'True' AS warm_plume, c_name AS name FROM customer WHERE c_nationkey % 2 = 0")
def flagged_tags(spark, sf_dir):
    path = f"{shared_folder(spark, 'flags')}/flags.csv"
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tag"), F.when(F.col("c_nationkey") % 2 == 0, "True").otherwise("False").alias("warm_plume"), F.col("c_name").alias("name"))
    c.write.option("header", True).option("sep", "\t").csv(path)
    return tags.read_flags(spark, path)


@query(f"WITH {PLACES} SELECT concat('place ', k) AS name, CAST(lat AS DOUBLE) AS lat, lon FROM pl")
def listed_places(spark, sf_dir):
    path = f"{shared_folder(spark, 'places')}/places.csv"
    places(spark, sf_dir).select(F.concat(F.lit("place "), F.col("k")).alias("name"), "lat", "lon").write.option("header", True).option("sep", ";").csv(path)
    return tags.read_places(spark, path)


RINGS = 16


@query(f"""WITH r AS (SELECT i, CASE WHEN i < {RINGS} THEN i WHEN i > {3 * RINGS} THEN {4 * RINGS} - i ELSE {RINGS} END AS q FROM range(1, {4 * RINGS}) t(i)),
s AS (SELECT *, sum(4 * q) OVER (ORDER BY i) - 4 * q AS before, CASE WHEN i < {RINGS} THEN 1 - q * q / {3.0 * RINGS * RINGS} WHEN i > {3 * RINGS} THEN q * q / {3.0 * RINGS * RINGS} - 1 ELSE ({2 * RINGS} - i) / {1.5 * RINGS} END AS z,
  CASE WHEN i BETWEEN {RINGS} AND {3 * RINGS} AND (i - {RINGS}) % 2 = 1 THEN 0.0 ELSE 0.5 END AS shift FROM r),
c AS (SELECT *, unnest(range(4 * q)) AS j FROM s)
SELECT CAST(before + j AS BIGINT) AS cell_id, round(acos(z), 9) + 0.0 AS theta, round((j + shift) * pi() / (2 * q), 9) + 0.0 AS phi FROM c""")
def ring_cells(spark, sf_dir):
    """The centres of all cells of a grid in the ring numbering."""
    theta, phi = healpix.ring_to_angles(RINGS.bit_length() - 1, F.col("id"))
    return spark.range(12 * RINGS * RINGS).select(F.col("id").alias("cell_id"), six(theta, 9).alias("theta"), six(phi, 9).alias("phi"))


STENCIL_LEVEL, STENCIL_SIGMA = 9, 0.004


def _stencil_sql() -> str:
    """The smoother with the stencil's kernel, all of whose cells are within its reach, and no mask."""
    side, s = healpix.resolution(STENCIL_LEVEL), f"({STENCIL_SIGMA!r} * {2**STENCIL_LEVEL} / sqrt(pi()))"
    at = {"a": "(40 + (i // 8) * 0.1)", "b": "(-10 + (i % 8) * 0.1)", "c": "(40 + (j // 8) * 0.1)", "d": "(-10 + (j % 8) * 0.1)"}
    raw = f"list_transform(range(64), lambda i: list_transform(range(64), lambda j: exp(-power({HAVERSINE.format(**at)} / {side!r} / {s}, 2))))"
    kernel = f"k AS (SELECT list_transform(raw, lambda r: list_transform(r, lambda x: x / list_sum(r))) AS m FROM (SELECT {raw} AS raw))"
    open_sea = "CASE WHEN c % 13 <> 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    return SMOOTH.replace(_kernel_sql(SIGMA), kernel).replace(open_sea, "CAST(1 AS DOUBLE)") + UNPACK.format("b")


@query(_stencil_sql())
def hmm_smooth_stencil(spark, sf_dir):
    s = movement.smooth(field(spark, sf_dir), starts(spark, sf_dir), square(spark), movement.Predictor("stencil", {"level": STENCIL_LEVEL}), STENCIL_SIGMA)
    return s.withColumn("states", F.round("states", 6))


@query(f"WITH {PLACES} SELECT lat, lon FROM (SELECT DISTINCT CAST(lat AS DOUBLE) AS lat FROM pl), (SELECT DISTINCT lon FROM pl)")
def field_axes(spark, sf_dir):
    p = places(spark, sf_dir)
    return align.axes(p.select("lat").distinct(), p.select("lon").distinct())


@query(f"WITH {NODES}, a AS (SELECT i, j, CASE WHEN i % 7 > 1 THEN v END AS v FROM nd) SELECT i, j, v FROM a WHERE i IN (SELECT i FROM a WHERE v IS NOT NULL)")
def without_empty_rows(spark, sf_dir):
    p = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select((p % 40).alias("i"), F.floor(p / 40).alias("j"), F.when((p % 9 != 0) & (p % 40 % 7 > 1), F.col("p_size").cast("double")).alias("v"))
    return regrid.drop_empty(nodes, "v", "i")


@query(f"""WITH {RECEIVERS}, g AS (SELECT deployment_id AS cell_id, deploy_latitude AS lat, deploy_longitude AS lon FROM st), u AS (SELECT DISTINCT user_id AS tag_id FROM events),
ev AS (SELECT tag_id, 'initial' AS kind, 0.05 AS sd, 40 + (tag_id % 50) / 10 AS y, -10 + (tag_id % 40) / 5 AS x FROM u
  UNION ALL SELECT tag_id, 'final', 0.1, 41.0, -6 + (tag_id % 10) / 5 FROM u WHERE tag_id % 3 = 0 AND tag_id % 2 = 1
  UNION ALL SELECT tag_id, 'final', 0.1, 43.0, -4 + (tag_id % 10) / 5 FROM u WHERE tag_id % 3 <= 1 AND NOT (tag_id % 3 = 0 AND tag_id % 2 = 1)),
d AS (SELECT kind, tag_id, cell_id, exp(-power({HAVERSINE.format(a='lat', b='lon', c='y', d='x')} / sd, 2) / 2) AS w FROM ev, g)
SELECT kind, tag_id, cell_id, round(w / sum(w) OVER (PARTITION BY kind, tag_id), 9) + 0.0 AS p FROM d""")
def known_positions(spark, sf_dir):
    """Densities about places of release and of death or, where that is unknown, recapture."""
    u, t = table(spark, sf_dir, "events").select(F.col("user_id").alias("tag_id")).distinct(), F.col("tag_id")
    at = lambda name, lat, lon: F.struct(F.lit(name).alias("event_name"), lat.alias("latitude"), lon.alias("longitude"))
    release = at("release", 40 + (t % 50) / 10, -10 + (t % 40) / 5)
    death = F.when(t % 3 == 0, at("fish_death", F.when(t % 2 == 1, F.lit(41.0)), -6 + (t % 10) / 5))
    recapture = F.when(t % 3 <= 1, at("recapture", F.lit(43.0), -4 + (t % 10) / 5))
    events = u.select("tag_id", F.explode(F.array_compact(F.array(release, death, recapture))).alias("e")).select("tag_id", "e.*")
    grid = receivers(spark, sf_dir).select(F.col("deployment_id").alias("cell_id"), F.col("deploy_latitude").alias("lat"), F.col("deploy_longitude").alias("lon"))
    out = emission.compute_emission_pdf(grid.withColumn("diff", F.lit(0.0)), grid, events, initial_std=0.05, recapture_std=0.1, digits=9)
    both = out["initial"].withColumn("kind", F.lit("initial")).unionByName(out["final"].withColumn("kind", F.lit("final")))
    return both.select("kind", "tag_id", "cell_id", (F.col("p") + 0.0).alias("p"))


@query("""WITH t AS (SELECT DISTINCT user_id AS tag_id, ts FROM events), d AS (SELECT tag_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY tag_id ORDER BY ts))) / 1e6 AS s FROM t)
SELECT tag_id, round(60000.0 / 86400 * min(s) * 5 / 6371000, 12) AS radians, round(60000.0 / 86400 * min(s) * 5 / 6371000 / 0.002 / 4, 9) AS pixels FROM d GROUP BY tag_id""")
def sigma_bounds(spark, sf_dir):
    """The widest diffusion of each tag by its shortest step, in radians and in pixels over the kernel's cut."""
    t = align.time_resolution(observations(spark, sf_dir).select("tag_id", "time").distinct(), ["tag_id"])
    s = F.col("seconds")
    return t.select("tag_id", F.round(units.max_sigma("60 km / day", s), 12).alias("radians"), F.round(units.max_sigma("60 km / day", s, resolution=0.002, truncate=4.0), 9).alias("pixels"))


@query("""WITH o AS (SELECT unnest(range(-4, 5)) AS d), l AS (SELECT d, exp(-d * d / (2 * 0.81)) AS w FROM o), a AS (SELECT x.d AS dx, y.d AS dy, x.w * y.w AS w FROM l x, l y)
SELECT dx, dy, round(w / sum(w) OVER (), 9) AS w FROM a""")
def planar_kernel(spark, sf_dir):
    """The planar kernel of a deviation of 0.9 cells, which reaches int(4 * 0.9 + 0.5) = 4 cells."""
    k = distributions.gaussian_kernel(0.9)
    h = k.shape[0] // 2
    rows = [(i - h, j - h, float(k[i, j])) for i in range(k.shape[0]) for j in range(k.shape[1])]
    return spark.createDataFrame(rows, "dx long, dy long, w double").withColumn("w", F.round("w", 9))
