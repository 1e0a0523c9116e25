"""Queries of the engine's operators over the driver's tables, each with the same in DuckDB's SQL.

The tables hold no biologging data, so they are read as such: events are a tag's log (tag = user, temperature = value,
pressure = k), part is an ocean model (place = brand, depth = size), supplier are receivers, lineitem detections,
embeddings fields over 8 x 8 cells (tag = label, time = order of vec_id), orders points of terrain.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark import streaming
from driftmark.functions import distributions, geodesy, healpix
from driftmark.operators import acoustic, align, bathymetry, diff, emission, movement, regrid, tracks
from driftmark.session import shared_folder
from driftmark.sources import store, tags

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORIGIN = datetime(2024, 1, 1)


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return naive(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def naive(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0, as the two engines sum in different orders."""
    return F.round(c, digits) + 0.0


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("tag_id"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("temperature"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("pressure"))


OBS = "obs AS (SELECT user_id AS tag_id, ts AS time, value AS temperature, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS pressure FROM events)"


def day_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.bin_observations(observations(spark, sf_dir), timedelta(days=1), ORIGIN)


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("place"), F.col("p_size").cast("double").alias("depth")).agg((F.max("p_retailprice") / 10).alias("temp"))
    return levels.groupBy("place").agg(F.max("depth").alias("dynamic_bathymetry"), F.max("depth").alias("H0"), F.lit(0.0).alias("XE"), F.array_sort(F.collect_list(F.struct("depth", "temp"))).alias("profile"))


DIFF = f"""{OBS},
m AS (SELECT p_brand AS place, CAST(p_size AS DOUBLE) AS depth, max(p_retailprice) / 10 AS temp FROM part GROUP BY ALL),
b AS (SELECT place, max(depth) AS bottom FROM m GROUP BY place),
n AS (SELECT p.pressure, m.place, arg_min(m.temp, struct_pack(d := abs(m.depth - p.pressure), k := m.depth)) AS temp FROM (SELECT DISTINCT pressure FROM obs) p, m GROUP BY ALL),
d AS (SELECT o.tag_id, date_trunc('day', o.time) AS time, n.place,
  CASE WHEN any_value(b.bottom) < max(o.pressure) * 0.8 THEN NULL ELSE CAST(sum(CAST(o.temperature - n.temp AS DECIMAL(28,9))) AS DOUBLE) / count(*) END AS diff
  FROM obs o JOIN n ON n.pressure = o.pressure JOIN b ON b.place = n.place GROUP BY o.tag_id, date_trunc('day', o.time), n.place)"""


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.compute_diff(model(spark, sf_dir), day_bins(spark, sf_dir), 0.8, place=("place",))


@query(f"""WITH {DIFF}, p AS (SELECT *, exp(-power(diff / 100.0, 2) / 2) / (100.0 * sqrt(2 * pi())) AS pdf FROM d)
SELECT tag_id, time, place, round(diff, 6) + 0.0 AS diff, round(pdf / sum(pdf) OVER (PARTITION BY tag_id, time), 6) + 0.0 AS pdf FROM p""")
def emission_pdf(spark, sf_dir):
    """Log, daily bins, nearest level, density, normalised over places."""
    p = emission.temperature_pdf(differences(spark, sf_dir), 10.0)
    return distributions.normalise(p, "pdf", ["tag_id", "time"]).select("tag_id", "time", "place", six("diff").alias("diff"), six("pdf").alias("pdf"))


@query(f"WITH {DIFF} SELECT tag_id, time, count(*) AS n_rows, count(diff) AS n_values, count(diff) = 0 AS empty FROM d GROUP BY ALL")
def diff_counts(spark, sf_dir):
    return diff.counts_per_time(differences(spark, sf_dir), "diff", ["tag_id", "time"]).withColumn("empty", F.col("n_values") == 0)


@query("""WITH e AS (SELECT user_id AS tag_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'error'),
s AS (SELECT tag_id, max(ts) FILTER (n = 1) AS start, max(ts) FILTER (n = 2) AS stop FROM e WHERE n <= 2 GROUP BY tag_id)
SELECT *, CASE WHEN minute(start) < 30 THEN start - INTERVAL 30 MINUTE ELSE start END AS model_start, CASE WHEN minute(stop) > 30 THEN stop + INTERVAL 30 MINUTE ELSE stop END AS model_stop FROM s""")
def time_slice(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("tag_id"), "event_id", F.when(F.col("event_type") != "error", F.col("ts")).cast("timestamp").alias("time"))
    s = align.time_slice(e, ["event_id"])
    a, b = align.adapt_model_time(F.col("start"), F.col("stop"))
    return s.withColumns({"model_start": a, "model_stop": b})


@query(f"""WITH {OBS}, s AS (SELECT user_id AS tag_id, min(ts) AS start, max(ts) FILTER (event_type = 'view') AS stop FROM events GROUP BY user_id)
SELECT tag_id, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM obs JOIN s USING (tag_id) WHERE time >= start AND (stop IS NULL OR time <= stop) GROUP BY tag_id""")
def slice_observations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy(F.col("user_id").alias("tag_id")).agg(F.min("ts").cast("timestamp").alias("start"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).cast("timestamp").alias("stop"))
    return align.slice_observations(observations(spark, sf_dir), s).groupBy("tag_id").agg(F.count("*").alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query(f"""WITH {OBS}, k AS (SELECT *, epoch_us(time) - epoch_us(TIMESTAMP '2024-01-01') AS off FROM obs),
b AS (SELECT 'left' AS closed, *, off // 3600000000 AS k FROM k UNION ALL SELECT 'right', *, (off + 3600000000 - 1) // 3600000000 - 1 FROM k)
SELECT closed, tag_id, TIMESTAMP '2024-01-01' + to_microseconds(k * 3600000000) AS time, count(*) AS n, CAST(sum(CAST(temperature AS DECIMAL(18,6))) AS DOUBLE) AS total, max(pressure) AS deepest FROM b GROUP BY ALL""")
def bin_observations(spark, sf_dir):
    out = None
    for closed in ("left", "right"):
        b = align.bin_observations(observations(spark, sf_dir), timedelta(hours=1), ORIGIN, closed)
        one = b.select(F.lit(closed).alias("closed"), "tag_id", "time", F.size("obs").cast("long").alias("n"), F.aggregate(F.transform("obs", lambda o: o["temperature"].cast("decimal(18,6)")), F.lit(0).cast("decimal(28,6)"), lambda a, x: (a + x).cast("decimal(28,6)")).cast("double").alias("total"), F.array_max(F.transform("obs", lambda o: o["pressure"])).alias("deepest"))
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {OBS}, t AS (SELECT DISTINCT tag_id, epoch_us(time) AS t FROM obs), w AS (SELECT *, lag(t) OVER (PARTITION BY tag_id ORDER BY t) AS p, lead(t) OVER (PARTITION BY tag_id ORDER BY t) AS n FROM t)
SELECT tag_id, make_timestamp(t) AS time, make_timestamp(t - coalesce(t - p, n - t, 0) // 2) AS bin_start, make_timestamp(t + coalesce(n - t, t - p, 0) // 2) AS bin_end FROM w""")
def midpoint_bounds(spark, sf_dir):
    return align.midpoint_bounds(observations(spark, sf_dir).select("tag_id", "time").distinct(), ["tag_id"])


@query("""WITH t AS (SELECT DISTINCT o_custkey % 20 AS k, o_orderdate AS t FROM orders), d AS (SELECT k, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY k ORDER BY t))) / 1000000 AS s FROM t)
SELECT k, min(s) AS seconds, min(s) = max(s) AS regular FROM d GROUP BY k""")
def time_resolution(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("k"), F.col("o_orderdate").cast("timestamp").alias("time")).distinct()
    return align.time_resolution(t, ["k"])


RECEIVERS = """st AS (SELECT s_suppkey AS deployment_id, 40 + (s_suppkey % 50) / 10 AS deploy_latitude, -10 + ((s_suppkey * 7) % 80) / 10 AS deploy_longitude,
  TIMESTAMP '1998-01-01' + to_days(CAST((s_suppkey % 10) * 100 AS INTEGER)) AS deploy_time, TIMESTAMP '1998-01-01' + to_days(CAST((s_suppkey % 10) * 100 + 500 AS INTEGER)) AS recover_time FROM supplier)"""
CELLS = "g AS (SELECT p_partkey AS cell_id, 40 + (p_partkey % 50) / 10 AS lat, -10 + ((p_partkey // 50) % 40) / 5 AS lon, p_partkey % 11 <> 0 AS mask FROM part)"
HAVERSINE = "2 * asin(sqrt(least(1.0, power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"


def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    start = lambda days: (F.lit("1998-01-01").cast("date") + ((k % 10) * 100 + days).cast("int")).cast("timestamp")
    return table(spark, sf_dir, "supplier").select(k.alias("deployment_id"), (40 + (k % 50) / 10).alias("deploy_latitude"), (-10 + ((k * 7) % 80) / 10).alias("deploy_longitude"), start(0).alias("deploy_time"), start(500).alias("recover_time"))


def sea_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("cell_id"), (40 + (k % 50) / 10).alias("lat"), (-10 + (F.floor(k / 50) % 40) / 5).alias("lon"), (k % 11 != 0).alias("mask"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tag_id"), F.col("l_shipdate").cast("timestamp").alias("time"), F.col("l_suppkey").alias("deployment_id"))


QUARTER = timedelta(days=90)
BINS = "bins AS (SELECT * FROM (SELECT DISTINCT l_returnflag AS tag_id FROM lineitem), (SELECT TIMESTAMP '1998-01-01' + to_days(CAST(90 * unnest(range(20)) AS INTEGER)) AS time))"
DET = "det AS (SELECT l_returnflag AS tag_id, l_shipdate AS time, l_suppkey AS deployment_id FROM lineitem)"
COUNTS = f"""{BINS}, {DET},
cnt AS (SELECT tag_id, deployment_id, TIMESTAMP '1998-01-01' + to_days(CAST(90 * floor((CAST(time AS DATE) - DATE '1998-01-01' - 1) / 90) AS INTEGER)) AS time, count(*) AS c FROM det GROUP BY ALL),
dense AS (SELECT t.tag_id, t.deployment_id, b.time, coalesce(c.c, 0) AS count FROM (SELECT DISTINCT tag_id, deployment_id FROM det) t JOIN bins b USING (tag_id) LEFT JOIN cnt c ON c.tag_id = t.tag_id AND c.deployment_id = t.deployment_id AND c.time = b.time)"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tag_id")).distinct()
    return t.withColumn("time", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: (F.lit("1998-01-01").cast("date") + k * 90).cast("timestamp")))).withColumns({"bin_start": F.col("time"), "bin_end": F.col("time") + F.expr("INTERVAL 90 DAYS")})


@query(f"WITH {COUNTS} SELECT tag_id, deployment_id, time, count FROM dense")
def count_detections(spark, sf_dir):
    return acoustic.count_detections(detections(spark, sf_dir), quarters(spark, sf_dir), QUARTER, datetime(1998, 1, 1))


@query(f"WITH {DET} SELECT DISTINCT deployment_id FROM det WHERE deployment_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def unknown_receivers(spark, sf_dir):
    return acoustic.unknown_receivers(detections(spark, sf_dir), receivers(spark, sf_dir).filter("deployment_id % 2 = 0"))


@query(f"WITH {RECEIVERS}, {BINS} SELECT deployment_id, tag_id, time FROM bins, st WHERE time >= deploy_time AND time + INTERVAL 90 DAY <= recover_time")
def active_receivers(spark, sf_dir):
    return acoustic.active_receivers(receivers(spark, sf_dir), quarters(spark, sf_dir))


MASKS = f"{RECEIVERS}, {CELLS}, masks AS (SELECT deployment_id, cell_id FROM st, g WHERE {HAVERSINE.format(a='lat', b='lon', c='deploy_latitude', d='deploy_longitude')} * 6371000.0 <= 25003)"


@query(f"WITH {MASKS} SELECT * FROM masks")
def reception_mask(spark, sf_dir):
    return acoustic.reception_masks(receivers(spark, sf_dir), sea_cells(spark, sf_dir), "25.003 km")


@query(f"""WITH {COUNTS}, {MASKS},
heard AS (SELECT tag_id, time, cell_id, CAST(sum(count) AS DOUBLE) AS raw FROM dense JOIN masks USING (deployment_id) WHERE count > 0 GROUP BY ALL),
times AS (SELECT DISTINCT tag_id, time FROM dense WHERE count > 0),
active AS (SELECT DISTINCT b.tag_id, b.time, m.cell_id FROM bins b JOIN st ON b.time >= deploy_time AND b.time + INTERVAL 90 DAY <= recover_time JOIN masks m USING (deployment_id)),
f AS (SELECT b.tag_id, b.time, g.cell_id, g.mask, t.time IS NOT NULL AS h, CASE WHEN a.cell_id IS NULL THEN 1.0 END AS fill, coalesce(heard.raw, 0.0) AS raw
  FROM bins b CROSS JOIN g LEFT JOIN times t ON t.tag_id = b.tag_id AND t.time = b.time LEFT JOIN active a ON a.tag_id = b.tag_id AND a.time = b.time AND a.cell_id = g.cell_id
  LEFT JOIN heard ON heard.tag_id = b.tag_id AND heard.time = b.time AND heard.cell_id = g.cell_id WHERE b.tag_id IN (SELECT tag_id FROM times)),
v AS (SELECT *, CASE WHEN h THEN raw ELSE fill END AS x FROM f)
SELECT tag_id, time, cell_id, CASE WHEN mask THEN round(x / nullif(sum(x) OVER (PARTITION BY tag_id, time), 0), 9) + 0.0 END AS acoustic FROM v""")
def acoustic_pdf(spark, sf_dir):
    p = acoustic.acoustic_pdf(detections(spark, sf_dir), receivers(spark, sf_dir), sea_cells(spark, sf_dir), quarters(spark, sf_dir), QUARTER, datetime(1998, 1, 1), "25.003 km", digits=9)
    return p.withColumn("acoustic", F.col("acoustic") + 0.0)


FIELD = """raw AS (SELECT label AS tag_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS time, embedding FROM embeddings),
field AS (SELECT tag_id, time, unnest(embedding) AS v, unnest(range(len(embedding))) AS cell_id FROM raw),
e AS (SELECT tag_id, time, cell_id, exp(CAST(v AS DOUBLE)) AS pdf FROM field)"""


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select(F.col("label").alias("tag_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long").alias("time"), "embedding")
    return t.select("tag_id", "time", F.posexplode("embedding").alias("c", "v")).select("tag_id", "time", F.col("c").cast("long").alias("cell_id"), F.exp(F.col("v").cast("double")).alias("pdf"))


def square(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(64).select(k.alias("cell_id"), F.floor(k / 8).cast("int").alias("x"), (k % 8).cast("int").alias("y"), (40 + F.floor(k / 8) * 0.1).alias("lat"), (-10 + (k % 8) * 0.1).alias("lon"), (k % 13 != 5).alias("mask"))


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial states: 0.5 at two cells that the tag's label gives."""
    t = table(spark, sf_dir, "embeddings").select(F.col("label").alias("tag_id")).distinct()
    return t.select("tag_id", F.explode(F.array((F.col("tag_id") % 5).cast("long"), (F.col("tag_id") % 5 + 8).cast("long"))).alias("cell_id"), F.lit(0.5).alias("p"))


LAST = "l AS (SELECT tag_id, max(time) AS t1 FROM e GROUP BY tag_id)"


@query(f"""WITH {FIELD}, {LAST}, a AS (SELECT *, CASE WHEN cell_id % 8 >= 4 THEN 2.0 ELSE 0.5 END AS acoustic, CASE WHEN time % 5 = 0 THEN NULL ELSE pdf END AS p FROM e),
q AS (SELECT tag_id, time, cell_id, acoustic, min(CASE WHEN p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY tag_id, time) = 1 AS replaced, p FROM a),
r AS (SELECT *, CASE WHEN replaced THEN acoustic ELSE p END * acoustic AS x FROM q),
f AS (SELECT r.*, CASE WHEN time = t1 AND tag_id % 2 = 0 THEN CASE WHEN cell_id < 32 THEN x / 32.0 END ELSE x END AS y FROM r JOIN l USING (tag_id))
SELECT tag_id, time, cell_id, round(y / sum(y) OVER (PARTITION BY tag_id, time), 9) + 0.0 AS pdf FROM f""")
def combine_pdfs(spark, sf_dir):
    e = field(spark, sf_dir).withColumn("pdf", F.when(F.col("time") % 5 != 0, F.col("pdf")))
    heard = e.select("tag_id", "time", "cell_id", F.when(F.col("cell_id") % 8 >= 4, 2.0).otherwise(0.5).alias("acoustic"))
    final = e.select("tag_id", "cell_id").distinct().filter("tag_id % 2 = 0 and cell_id < 32").withColumn("p", F.lit(1 / 32))
    return emission.combine(emission.combine_with_acoustic(e, heard), ["pdf", "acoustic"], final).withColumn("pdf", six("pdf", 9))


SIGMA = 0.9


def _kernel_sql(sigma: float, name: str = "k", log: bool = False) -> str:
    """A CTE with the kernel's rows (by target cell) as one list of lists."""
    half = int(4 * sigma + 0.5)
    line = ", ".join(repr(float(v)) for v in distributions.gaussian_line(sigma))
    w = f"CASE WHEN abs(i // 8 - j // 8) <= {half} AND abs(i % 8 - j % 8) <= {half} THEN line[i // 8 - j // 8 + {half + 1}] * line[i % 8 - j % 8 + {half + 1}] ELSE 0.0 END"
    return f"{name} AS (SELECT list_transform(range(64), lambda i: list_transform(range(64), lambda j: {w})) AS m FROM (SELECT CAST([{line}] AS DOUBLE[]) AS line))"


PACKED = f"""{FIELD}, p AS (SELECT tag_id, time, list(pdf ORDER BY cell_id) AS e FROM e GROUP BY ALL),
i0 AS (SELECT DISTINCT tag_id, list_transform(range(64), lambda c: CASE WHEN c = tag_id % 5 OR c = tag_id % 5 + 8 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS s FROM p),
msk AS (SELECT list_transform(range(64), lambda c: CASE WHEN c % 13 <> 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS mask)"""


def _forward_sql(sigma: float, name: str = "f", kernel: str = "k") -> str:
    return f"""{name}(tag_id, time, pred, s, z) AS (
  SELECT p.tag_id, p.time, i0.s, i0.s, list_dot_product(i0.s, p.e) FROM p JOIN i0 USING (tag_id) WHERE p.time = 1
  UNION ALL
  SELECT tag_id, time, pred, list_transform(u, lambda x: x / list_sum(u)), list_sum(u) FROM (
    SELECT *, list_transform(range(1, 65), lambda c: pred[c] * e[c]) AS u FROM (
      SELECT p.tag_id, p.time, p.e, list_transform(range(1, 65), lambda c: list_dot_product(m[c], {name}.s) * mask[c]) AS pred FROM {name} JOIN p ON p.tag_id = {name}.tag_id AND p.time = {name}.time + 1, {kernel}, msk)))"""


def _score_sql() -> str:
    parts = []
    for n, s in enumerate((0.6, 0.9, 1.3)):
        parts.append((f"{_kernel_sql(s, f'k{n}')}, {_forward_sql(s, f'f{n}', f'k{n}')}", f"SELECT tag_id, {s} AS sigma, -sum(ln(z)) AS score FROM f{n} GROUP BY tag_id"))
    return f"WITH RECURSIVE {PACKED}, {', '.join(a for a, _ in parts)}, u AS ({' UNION ALL '.join(b for _, b in parts)})\n"


@query(_score_sql() + "SELECT tag_id, CAST(sigma AS DOUBLE) AS sigma, round(score, 5) AS score FROM u")
def hmm_score(spark, sf_dir):
    s = movement.score(field(spark, sf_dir), starts(spark, sf_dir), square(spark), movement.Predictor("planar"), [0.6, 0.9, 1.3])
    return s.withColumn("score", F.round("score", 5))


@query(_score_sql() + "SELECT tag_id, CAST(arg_min(sigma, score) AS DOUBLE) AS sigma, round(min(score), 5) AS score FROM u GROUP BY tag_id")
def hmm_grid_search(spark, sf_dir):
    s = movement.score(field(spark, sf_dir), starts(spark, sf_dir), square(spark), movement.Predictor("planar"), [0.6, 0.9, 1.3])
    return movement.grid_search(s).withColumn("score", F.round("score", 5))


@query()
def hmm_bounds_search(spark, sf_dir):
    """Iterative, so without SQL; tests hold it against a dense grid."""
    return movement.fit(field(spark, sf_dir), starts(spark, sf_dir), square(spark), movement.Predictor("planar"), (0.2, 2.0), 1e-4)


FORWARD = f"WITH RECURSIVE {PACKED}, {_kernel_sql(SIGMA)}, {_forward_sql(SIGMA)}"
UNPACK = "SELECT tag_id, time, cell_id, round(states, 6) AS states FROM (SELECT tag_id, time, unnest(range(64)) AS cell_id, unnest(s) AS states FROM {}) WHERE states > 0"


@query(f"{FORWARD} {UNPACK.format('f')}")
def hmm_forward(spark, sf_dir):
    s = movement.smooth(field(spark, sf_dir), starts(spark, sf_dir), square(spark), movement.Predictor("planar"), SIGMA, forward_only=True)
    return s.withColumn("states", F.round("states", 6))


SMOOTH = f"""{FORWARD}, l AS (SELECT tag_id, max(time) AS t1 FROM p GROUP BY tag_id),
b(tag_id, time, s) AS (
  SELECT f.tag_id, f.time, f.s FROM f JOIN l ON l.tag_id = f.tag_id AND l.t1 = f.time
  UNION ALL
  SELECT tag_id, time, list_transform(u, lambda x: x / list_sum(u)) FROM (
    SELECT tag_id, time, list_transform(range(1, 65), lambda c: list_dot_product(m[c], r) * s[c]) AS u FROM (
      SELECT f.tag_id, f.time, f.s, list_transform(range(1, 65), lambda c: b.s[c] / (n.pred[c] + 1e-300)) AS r FROM b JOIN f ON f.tag_id = b.tag_id AND f.time = b.time - 1 JOIN f n ON n.tag_id = b.tag_id AND n.time = b.time), k))"""


@query(f"{SMOOTH} {UNPACK.format('b')}")
def hmm_smooth(spark, sf_dir):
    s = movement.smooth(field(spark, sf_dir), starts(spark, sf_dir), square(spark), movement.Predictor("planar"), SIGMA)
    return s.withColumn("states", F.round("states", 6))


@query(f"{SMOOTH}, st AS (SELECT tag_id, time, unnest(range(64)) AS c, unnest(s) AS w FROM b) SELECT tag_id, time, round(sum((40 + (c // 8) * 0.1) * w) / sum(w), 6) AS latitude, round(sum((-10 + (c % 8) * 0.1) * w) / sum(w), 6) AS longitude FROM st GROUP BY ALL")
def mean_track(spark, sf_dir):
    s = movement.smooth(field(spark, sf_dir), starts(spark, sf_dir), square(spark), movement.Predictor("planar"), SIGMA)
    return tracks.mean_track(s, square(spark)).select("tag_id", "time", six("latitude").alias("latitude"), six("longitude").alias("longitude"))


@query(f"WITH {FIELD} SELECT tag_id, time, arg_max(cell_id, struct_pack(p := pdf, c := -cell_id)) AS cell_id FROM e GROUP BY ALL")
def modal_track(spark, sf_dir):
    return tracks.modal_track(field(spark, sf_dir).withColumnRenamed("pdf", "states"), square(spark)).select("tag_id", "time", "cell_id")


def _viterbi_sql(line: np.ndarray, first: str) -> str:
    """Max-plus steps; ``first`` orders equally good predecessors."""
    half, text = len(line) // 2, ", ".join(repr(float(v)) for v in np.log(line))
    near = f"abs(i // 8 - j // 8) <= {half} AND abs(i % 8 - j % 8) <= {half}"
    return f"""WITH RECURSIVE {PACKED}, kk AS (SELECT list_transform(range(64), lambda i: list_transform(range(64), lambda j: CASE WHEN {near} THEN line[i // 8 - j // 8 + {half + 1}] + line[i % 8 - j % 8 + {half + 1}] ELSE CAST('-inf' AS DOUBLE) END)) AS m FROM (SELECT CAST([{text}] AS DOUBLE[]) AS line)),
v(tag_id, time, s, came) AS (
  SELECT tag_id, CAST(1 AS BIGINT), list_transform(s, lambda x: CASE WHEN x > 0 THEN ln(x) ELSE CAST('-inf' AS DOUBLE) END), list_transform(range(64), lambda c: CAST(0 AS BIGINT)) FROM i0
  UNION ALL
  SELECT tag_id, time, list_transform(range(1, 65), lambda c: CASE WHEN mask[c] = 1 THEN list_max(u[c]) + ln(e[c]) ELSE CAST('-inf' AS DOUBLE) END), list_transform(range(1, 65), lambda c: list_position({first}, list_max({first})) ) FROM (
    SELECT p.tag_id, p.time, p.e, mask, list_transform(range(1, 65), lambda c: list_transform(range(1, 65), lambda j: v.s[j] + m[c][j])) AS u FROM v JOIN p ON p.tag_id = v.tag_id AND p.time = v.time + 1, kk, msk)),
l AS (SELECT tag_id, max(time) AS t1 FROM p GROUP BY tag_id),
b(tag_id, time, c) AS (
  SELECT v.tag_id, v.time, list_position(v.s, list_max(v.s)) FROM v JOIN l ON l.tag_id = v.tag_id AND l.t1 = v.time
  UNION ALL
  SELECT b.tag_id, b.time - 1, v.came[b.c] FROM b JOIN v ON v.tag_id = b.tag_id AND v.time = b.time WHERE b.time > 1)
SELECT tag_id, time, CAST(c - 1 AS BIGINT) AS cell_id FROM b"""


@query(_viterbi_sql(distributions.gaussian_line(SIGMA), "u[c]"))
def viterbi(spark, sf_dir):
    return movement.viterbi(field(spark, sf_dir), starts(spark, sf_dir), square(spark), SIGMA)


@query(_viterbi_sql(distributions.gaussian_line(SIGMA, kind="discrete"), "u[c]"))
def viterbi_discrete(spark, sf_dir):
    return movement.viterbi(field(spark, sf_dir), starts(spark, sf_dir), square(spark), SIGMA, "columns")


def spread(spark: SparkSession, sf_dir: str, name: str) -> movement.Spread:
    """The model for fields larger than a task, with the planar kernel as a table."""
    line = distributions.gaussian_line(SIGMA)
    half = len(line) // 2
    a = square(spark).select(F.col("cell_id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    b = square(spark).select(F.col("cell_id").alias("dst"), "x", "y")
    own = F.array(*[F.lit(float(v)) for v in line])
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    near = a.join(b, (F.abs(dx) <= half) & (F.abs(dy) <= half))
    kernel = near.select("src", "dst", (F.element_at(own, dx + half + 1) * F.element_at(own, dy + half + 1)).alias("w"))
    return movement.Spread(field(spark, sf_dir), starts(spark, sf_dir), kernel, square(spark), shared_folder(spark, name))


@query(f"{FORWARD} {UNPACK.format('f')}")
def hmm_forward_distributed(spark, sf_dir):
    """The variant for fields larger than a task."""
    s = spread(spark, sf_dir, "forward").forward().filter("states > 0")
    return s.select("tag_id", "time", "cell_id", F.round("states", 6).alias("states"))


@query(f"{SMOOTH} {UNPACK.format('b')}")
def hmm_smooth_distributed(spark, sf_dir):
    return spread(spark, sf_dir, "smooth").smooth().withColumn("states", F.round("states", 6))


def _near_kernel_sql(sigma: float) -> str:
    """The spherical kernel of the 64 cells, by all pairs."""
    at = {"a": "40 + (i // 8) * 0.1", "b": "-10 + (i % 8) * 0.1", "c": "40 + (j // 8) * 0.1", "d": "-10 + (j % 8) * 0.1"}
    far = HAVERSINE.format(**{k: f"({v})" for k, v in at.items()})
    raw = f"list_transform(range(64), lambda i: list_transform(range(64), lambda j: CASE WHEN {far} <= {4 * sigma!r} THEN exp(-power({far} / {sigma!r}, 2) / 2) ELSE 0.0 END))"
    return f"k AS (SELECT list_transform(raw, lambda r: list_transform(r, lambda x: x / list_sum(r))) AS m FROM (SELECT {raw} AS raw))"


ANGLE = 0.0031


@query(SMOOTH.replace(_kernel_sql(SIGMA), _near_kernel_sql(ANGLE)) + UNPACK.format("b"))
def hmm_smooth_sphere(spark, sf_dir):
    """The default predictor, by lists of neighbours on the sphere."""
    s = movement.smooth(field(spark, sf_dir), starts(spark, sf_dir), square(spark), movement.Predictor("sphere"), ANGLE)
    return s.withColumn("states", F.round("states", 6))


@query(f"""WITH p AS (SELECT s_suppkey AS k, 40 + (s_suppkey % 50) / 10 AS lat, -10 + ((s_suppkey * 7) % 80) / 10 AS lon FROM supplier),
a AS (SELECT s.k AS src, d.k AS dst, {HAVERSINE.format(a="s.lat", b="s.lon", c="d.lat", d="d.lon")} AS a FROM p s, p d),
r AS (SELECT src, dst, exp(-power(a / 0.011, 2) / 2) AS w FROM a WHERE a <= 0.044)
SELECT src, dst, round(w / sum(w) OVER (PARTITION BY dst), 9) AS w FROM r""")
def sphere_kernel(spark, sf_dir):
    """The spherical kernel as a table, joined by cubes of space."""
    cells = receivers(spark, sf_dir).select(F.col("deployment_id").alias("cell_id"), F.col("deploy_latitude").alias("lat"), F.col("deploy_longitude").alias("lon"))
    return movement.sphere_kernel_table(cells, 0.011, digits=9)


@query(f"""WITH {FIELD}, {LAST} SELECT tag_id, (time - 1) // 3 AS frame, time, cell_id, round(40 + (cell_id // 8) * 0.1, 6) AS lat, round(-10 + (cell_id % 8) * 0.1, 6) AS lon, round(pdf, 9) AS states, round(pdf, 9) AS pdf
FROM e JOIN l USING (tag_id) WHERE (time - 1) % 3 = 0 AND time < t1 AND cell_id % 2 = 0""")
def movie_frames(spark, sf_dir):
    e = field(spark, sf_dir)
    s = e.select("tag_id", "time", "cell_id", F.when(F.col("cell_id") % 2 == 0, F.col("pdf")).otherwise(0.0).alias("states"))
    f = tracks.frames(s, e, square(spark), 3).withColumn("frame", F.col("frame").cast("long"))
    return f.withColumns({c: F.round(c, n) for c, n in (("lat", 6), ("lon", 6), ("states", 9), ("pdf", 9))})


@query(f"""WITH {FIELD}, a AS (SELECT *, pdf * CASE WHEN tag_id % 2 = 1 THEN 1.0 WHEN cell_id % 8 < 4 THEN 0.25 END AS x FROM e)
SELECT tag_id, time, cell_id, round(x / sum(x) OVER (PARTITION BY tag_id, time), 9) + 0.0 AS pdf FROM a""")
def silent_receivers(spark, sf_dir):
    """Cells that a silent receiver covers are missing for tags that have an acoustic table; others have no such layer."""
    e = field(spark, sf_dir)
    heard = e.filter("tag_id % 2 = 0").select("tag_id", "time", "cell_id", F.when(F.col("cell_id") % 8 < 4, 0.25).alias("acoustic"))
    layers = emission.without_acoustic(emission.combine_with_acoustic(e, heard), heard)
    return emission.combine(layers, ["pdf", "acoustic"]).withColumn("pdf", six("pdf", 9))


# the positions of the tag log as a track: lat = 40 + k / 10, lon = -10 + value / 100

def _vincenty_sql(source: str, keep: str) -> str:
    """CTEs v0 … v9 from rows with la1, lo1, la2, lo2; the last has km."""
    f, a, b = geodesy.WGS84_F, geodesy.WGS84_A, geodesy.WGS84_B
    out = [f"v0 AS (SELECT {keep}, la1, lo1, la2, lo2, sin(atan({1 - f!r} * tan(radians(la1)))) AS s1, cos(atan({1 - f!r} * tan(radians(la1)))) AS c1, sin(atan({1 - f!r} * tan(radians(la2)))) AS s2, cos(atan({1 - f!r} * tan(radians(la2)))) AS c2, radians(lo2 - lo1) AS l, radians(lo2 - lo1) AS lam FROM {source})"]
    trig = "sqrt(power(c2 * sin(lam), 2) + power(c1 * s2 - s1 * c2 * cos(lam), 2)) AS sn, s1 * s2 + c1 * c2 * cos(lam) AS cs"
    more = f"atan2(sn, cs) AS sg, coalesce(c1 * c2 * sin(lam) / nullif(sn, 0), 0) AS sa"
    mid = "1 - sa * sa AS c2a, coalesce(cs - 2 * s1 * s2 / CASE WHEN 1 - sa * sa > 1e-15 THEN 1 - sa * sa END, 0) AS cm"
    stack = lambda src: f"(SELECT *, {mid} FROM (SELECT *, {more} FROM (SELECT *, {trig} FROM {src})))"
    cols = f"{keep}, la1, lo1, la2, lo2, s1, c1, s2, c2, l"
    for k in range(geodesy.ITERATIONS):
        c = f"({f!r} / 16 * c2a * (4 + {f!r} * (4 - 3 * c2a)))"
        out.append(f"v{k + 1} AS (SELECT {cols}, l + (1 - {c}) * {f!r} * sa * (sg + {c} * sn * (cm + {c} * cs * (2 * cm * cm - 1))) AS lam FROM {stack(f'v{k}')})")
    u2 = f"(c2a * {(a * a - b * b) / (b * b)!r})"
    big = f"(1 + {u2} / 16384 * (4096 + {u2} * (-768 + {u2} * (320 - 175 * {u2}))))"
    small = f"({u2} / 1024 * (256 + {u2} * (-128 + {u2} * (74 - 47 * {u2}))))"
    delta = f"({small} * sn * (cm + {small} / 4 * (cs * (2 * cm * cm - 1) - {small} / 6 * cm * (4 * sn * sn - 3) * (4 * cm * cm - 3))))"
    out.append(f"vv AS (SELECT {keep}, CASE WHEN la1 = la2 AND lo1 = lo2 THEN 0.0 ELSE {b!r} * {big} * (sg - {delta}) / 1000 END AS km FROM {stack(f'v{geodesy.ITERATIONS}')})")
    return ",\n".join(out)


TRACK = f"{OBS}, t AS (SELECT tag_id, time, 40 + pressure / 10 AS la2, -10 + temperature / 100 AS lo2, lag(40 + pressure / 10) OVER w AS la1, lag(-10 + temperature / 100) OVER w AS lo1, epoch_us(time) - epoch_us(lag(time) OVER w) AS dt FROM obs WINDOW w AS (PARTITION BY tag_id ORDER BY time))"


def log_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("tag_id", "time", (40 + F.col("pressure") / 10).alias("latitude"), (-10 + F.col("temperature") / 100).alias("longitude"))


@query(f"WITH {TRACK}, {_vincenty_sql('t', 'tag_id, time, dt')}, s AS (SELECT *, km / nullif(dt / 3.6e9, 0) AS sp FROM vv) SELECT tag_id, time, round(coalesce(km, 0.0), 5) + 0.0 AS distance, round(coalesce(sp, lead(sp) OVER (PARTITION BY tag_id ORDER BY time)), 3) + 0.0 AS speed FROM s")
def track_quantities(spark, sf_dir):
    return tracks.additional_quantities(log_track(spark, sf_dir)).select("tag_id", "time", six("distance", 5).alias("distance"), six("speed", 3).alias("speed"))


@query(f"WITH {OBS}, j AS (SELECT tag_id, time, temperature - lag(temperature) OVER (PARTITION BY tag_id ORDER BY time) AS d FROM obs) SELECT tag_id, time, month(time) AS month, round(d, 6) + 0.0 AS difference, coalesce(d > 0.2, false) AS jump FROM j")
def temperature_jumps(spark, sf_dir):
    return align.jumps(observations(spark, sf_dir), "temperature", ["tag_id"]).select("tag_id", "time", align.month(F.col("time")).cast("long").alias("month"), six("difference").alias("difference"), "jump")


@query(f"WITH {OBS} SELECT concat('tag-', tag_id) AS traj_id, time, -10 + temperature / 100 AS longitude, 40 + pressure / 10 AS latitude FROM obs")
def trajectories_round_trip(spark, sf_dir):
    root = shared_folder(spark, "tracks")
    t = log_track(spark, sf_dir).withColumn("traj_id", F.concat(F.lit("tag-"), F.col("tag_id")))
    store.save_trajectories(t.repartition("traj_id"), root)
    return store.read_trajectories(spark, root).select("traj_id", "time", "longitude", "latitude")


PLACES = "pl AS (SELECT c_custkey AS k, (c_custkey * 37) % 181 - 90 AS lat, (c_custkey * 101) % 720 / 2 - 180 AS lon FROM customer)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), ((k * 37) % 181 - 90).cast("double").alias("lat"), ((k * 101) % 720 / 2 - 180).alias("lon"))


@query(f"WITH {PLACES} SELECT k, (lon + 180) % 360 - 180 AS about_0, CASE WHEN (lon - 180) % 360 < 0 THEN (lon - 180) % 360 + 360 ELSE (lon - 180) % 360 END + 180 AS about_180, 90.0 - lat - 3 AS theta, -lon + 5 AS phi FROM pl WHERE lat BETWEEN -60 AND 60 AND lon BETWEEN -170 AND 170")
def wrap_and_box(spark, sf_dir):
    p = align.select_box(places(spark, sf_dir), (-60, 60), (-170, 170))
    theta, phi = geodesy.colatitude(F.col("lat"), F.col("lon"), 3.0, 5.0)
    return p.select("k", geodesy.wrap_longitude(F.col("lon")).alias("about_0"), geodesy.wrap_longitude(F.col("lon"), 180).alias("about_180"), theta.alias("theta"), phi.alias("phi"))


LEVEL = 5


def place_cell() -> Column:
    """The cell of a place; its longitude is turned as in the SQL, whose last bit says to which of two cells a place on their edge goes."""
    whole = F.lit(2 * np.pi)
    return healpix.angles_to_cell(LEVEL, F.radians(90.0 - F.col("lat")), (F.radians("lon") % whole + whole) % whole)


def _healpix_sql() -> str:
    n = 1 << LEVEL
    bits = lambda v: f"list_sum(list_transform(range({LEVEL}), lambda b: CAST(((CAST({v} AS BIGINT) >> b) & 1) << (2 * b) AS BIGINT)))"
    return f"""WITH {PLACES}, a AS (SELECT k, radians(90.0 - lat) AS th, cos(radians(90.0 - lat)) AS z, ((radians(lon) % (2 * pi())) + 2 * pi()) % (2 * pi()) / (pi() / 2) AS tt FROM pl),
b AS (SELECT *, CAST(floor({n} * (0.5 + tt) - {n} * z * 0.75) AS BIGINT) AS jp, CAST(floor({n} * (0.5 + tt) + {n} * z * 0.75) AS BIGINT) AS jm, CAST(least(3, floor(tt)) AS BIGINT) AS q,
  {n} * sqrt(6.0) * CASE WHEN z > 0 THEN sin(th / 2) ELSE cos(th / 2) END AS r FROM a),
c AS (SELECT *, least({n - 1}, CAST(floor((tt - q) * r) AS BIGINT)) AS cp, least({n - 1}, CAST(floor((1 - (tt - q)) * r) AS BIGINT)) AS cm FROM b),
d AS (SELECT k, CASE WHEN abs(z) <= 2 / 3 THEN CASE WHEN jp // {n} = jm // {n} THEN (jp // {n}) | 4 WHEN jp // {n} < jm // {n} THEN jp // {n} ELSE jm // {n} + 8 END WHEN z >= 0 THEN q ELSE q + 8 END AS face,
  CASE WHEN abs(z) <= 2 / 3 THEN jm % {n} WHEN z >= 0 THEN {n - 1} - cm ELSE cp END AS x, CASE WHEN abs(z) <= 2 / 3 THEN {n - 1} - jp % {n} WHEN z >= 0 THEN {n - 1} - cp ELSE cm END AS y FROM c)
SELECT k, CAST(face * {n * n} + {bits('x')} + 2 * {bits('y')} AS BIGINT) AS cell_id, face, x, y FROM d"""


def _centre_sql(source: str, level: int, keep: str) -> str:
    """(keep, lat, lon): centres of the nested cells of a table with cell_id."""
    n = 1 << level
    squeeze = lambda v: f"CAST(list_sum(list_transform(range({level}), lambda b: ((({v}) >> (2 * b)) & 1) << b)) AS BIGINT)"
    lists = lambda v: "[" + ", ".join(map(str, v)) + "]"
    return f"""SELECT {keep}, 90 - degrees(acos(z)) AS lat, CASE WHEN l > 180 THEN l - 360 ELSE l END AS lon FROM (
  SELECT *, CASE WHEN ring < {n} THEN 1 - nr * nr / {3.0 * n * n} WHEN ring > {3 * n} THEN nr * nr / {3.0 * n * n} - 1 ELSE ({2 * n} - ring) * {2 / (3 * n)!r} END AS z,
    degrees(pi() / 4 * CASE WHEN o < 0 THEN o + 8 * nr ELSE o END / nr) AS l FROM (
    SELECT *, {lists(healpix.FACE_PHI)}[face + 1] * nr + x - y AS o FROM (
      SELECT *, CASE WHEN ring < {n} THEN ring WHEN ring > {3 * n} THEN {4 * n} - ring ELSE {n} END AS nr FROM (
        SELECT *, {lists(healpix.FACE_RING)}[face + 1] * {n} - x - y - 1 AS ring FROM (
          SELECT *, cell_id // {n * n} AS face, {squeeze(f'cell_id % {n * n}')} AS x, {squeeze(f'(cell_id % {n * n}) >> 1')} AS y FROM {source})))))"""


@query(f"SELECT cell_id, round(lat, 9) + 0.0 AS lat, round(lon, 9) + 0.0 AS lon FROM ({_centre_sql('(SELECT unnest(range(196608)) AS cell_id)', 7, 'cell_id')}) WHERE lat BETWEEN 46 AND 51 AND lon BETWEEN -8 AND -1")
def regrid_cells(spark, sf_dir):
    """All cells of a box, at a level that is finer than the coarse one they are looked for at."""
    return healpix.cells_in_box(spark, 7, (46.0, 51.0), (-8.0, -1.0)).select("cell_id", six("lat", 9).alias("lat"), six("lon", 9).alias("lon"))


@query(f"WITH h AS ({_healpix_sql()}) SELECT k, round(lat, 9) + 0.0 AS lat, round(lon, 9) + 0.0 AS lon FROM ({_centre_sql('h', LEVEL, 'k')})")
def snapped_places(spark, sf_dir):
    lat, lon = healpix.cell_to_place(LEVEL, place_cell())
    return places(spark, sf_dir).select("k", six(lat, 9).alias("lat"), six(lon, 9).alias("lon"))


@query(f"WITH {PLACES}, a AS (SELECT k, radians(90.0 - lat) AS t, radians(-lon) AS p FROM pl) SELECT k, round(sin(t) * cos(p), 9) + 0.0 AS x, round(sin(t) * sin(p), 9) + 0.0 AS y, round(cos(t), 9) + 0.0 AS z FROM a")
def cartesian(spark, sf_dir):
    theta, phi = geodesy.colatitude(F.col("lat"), F.col("lon"))
    return places(spark, sf_dir).withColumn("v", geodesy.cartesian(theta, phi)).select("k", *[six(f"v.{c}", 9).alias(c) for c in "xyz"])


@query(_healpix_sql())
def healpix_cells(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("cell_id", place_cell())
    face, x, y = healpix.cell_to_face(LEVEL, F.col("cell_id"))
    return p.select("k", "cell_id", face.alias("face"), x.alias("x"), y.alias("y"))


@query(f"""WITH {PLACES} SELECT k, round({HAVERSINE.format(a='lat', b='lon', c='45.0', d='-5.0')}, 9) AS angle, round(exp(-power({HAVERSINE.format(a='lat', b='lon', c='45.0', d='-5.0')} / 0.5, 2) / 2), 9) + 0.0 AS spherical,
round(exp(-(0.09 * (lon / 100) * (lon / 100) - 2 * 0.02 * (lon / 100) * (lat / 100) + 0.25 * (lat / 100) * (lat / 100)) / (2 * 0.0221)) / (2 * pi() * sqrt(0.0221)), 9) + 0.0 AS planar, round(exp(-power((lat - 10) / 25.0, 2) / 2) / (25.0 * sqrt(2 * pi())), 9) + 0.0 AS line FROM pl""")
def densities(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    cov = distributions.covariance([[0.25, 0.02], [0.02, 0.09]])
    return places(spark, sf_dir).select("k", F.round(geodesy.angle(lat, lon, F.lit(45.0), F.lit(-5.0)), 9).alias("angle"), six(distributions.spherical_normal(lat, lon, (45.0, -5.0), 0.5), 9).alias("spherical"), six(distributions.planar_normal(lon / 100, lat / 100, (0.0, 0.0), cov), 9).alias("planar"), six(distributions.normal(lat, 10.0, 5.0), 9).alias("line"))


NODES = "nd AS (SELECT p_partkey % 40 AS i, p_partkey // 40 AS j, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS DOUBLE) END AS v FROM part)"


@query(f"""WITH {NODES}, tg AS (SELECT s_suppkey AS cell_id, (s_suppkey * 13 % 380) / 10 AS y, (s_suppkey * 29 % 480) / 10 AS x FROM supplier),
o(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
w AS (SELECT cell_id, CAST(floor(y) AS BIGINT) + a AS i, CAST(floor(x) AS BIGINT) + b AS j, (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM tg, o)
SELECT cell_id, CASE WHEN count(v) >= 2 THEN round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) + 0.0 END AS v FROM w JOIN nd USING (i, j) WHERE w > 0 GROUP BY cell_id HAVING count(v) > 0""")
def regrid_bilinear(spark, sf_dir):
    k = F.col("s_suppkey")
    targets = table(spark, sf_dir, "supplier").select(k.alias("cell_id"), ((k * 13 % 380) / 10).alias("lat"), ((k * 29 % 480) / 10).alias("lon"))
    p = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select((p % 40).alias("i"), F.floor(p / 40).alias("j"), F.when(p % 9 != 0, F.col("p_size").cast("double")).alias("v"))
    return regrid.regrid(nodes, regrid.bilinear_weights(targets, 0.0, 0.0, 1.0), ["v"], [], 2).withColumn("v", six("v"))


def _blur_sql() -> str:
    k = distributions.gaussian_kernel(0.5)
    h = k.shape[0] // 2
    rows = ", ".join(f"({i - h}, {j - h}, CAST({float(k[i, j])!r} AS DOUBLE))" for i in range(k.shape[0]) for j in range(k.shape[1]))
    return f"""WITH {FIELD}, o(dx, dy, w) AS (VALUES {rows}), a AS (SELECT tag_id, time, cell_id // 8 AS x, cell_id % 8 AS y, w, cell_id // 8 + dx AS nx, cell_id % 8 + dy AS ny FROM e, o),
m AS (SELECT tag_id, time, x, y, w, CASE WHEN nx < 0 THEN -1 - nx WHEN nx > 7 THEN 15 - nx ELSE nx END * 8 + CASE WHEN ny < 0 THEN -1 - ny WHEN ny > 7 THEN 15 - ny ELSE ny END AS c FROM a)
SELECT m.tag_id, m.time, x, y, round(sum(e.pdf * w), 6) AS smooth, round(max(e.pdf) FILTER (true), 6) AS top FROM m JOIN e ON e.tag_id = m.tag_id AND e.time = m.time AND e.cell_id = m.c GROUP BY ALL"""


@query(_blur_sql())
def blur_edges(spark, sf_dir):
    f = field(spark, sf_dir).select("tag_id", "time", F.floor(F.col("cell_id") / 8).alias("x"), (F.col("cell_id") % 8).alias("y"), "pdf")
    k = distributions.gaussian_kernel(0.5)
    smooth = regrid.blur(f, "pdf", "gaussian", kernel=k, extra=("tag_id", "time")).select("tag_id", "time", "x", "y", F.round("pdf", 6).alias("smooth"))
    top = regrid.blur(f, "pdf", "maximum", size=k.shape[0], extra=("tag_id", "time")).select("tag_id", "time", "x", "y", F.round("pdf", 6).alias("top"))
    return smooth.join(top, ["tag_id", "time", "x", "y"])


@query(f"WITH {FIELD}, w(dst, src, w) AS (SELECT i, j, 1.0 / (1 + abs(i - j)) FROM range(64) a(i), range(64) b(j) WHERE abs(i - j) <= 2) SELECT tag_id, time, dst AS cell_id, round(sum(w * pdf), 6) AS pdf FROM e JOIN w ON src = cell_id GROUP BY ALL")
def sparse_matmul(spark, sf_dir):
    a, b = spark.range(64).select(F.col("id").alias("dst")), spark.range(64).select(F.col("id").alias("src"))
    w = a.crossJoin(b).filter("abs(dst - src) <= 2").withColumn("w", 1.0 / (1 + F.abs(F.col("dst") - F.col("src"))))
    return regrid.apply_sparse(field(spark, sf_dir), w, "pdf", ["tag_id", "time"]).withColumn("pdf", F.round("pdf", 6))


@query(f"WITH {PLACES} SELECT k, CASE WHEN k = (SELECT arg_min(k, struct_pack(d := power(lon - 3, 2) + power(lat - 4, 2), a := lon, b := lat, k := k)) FROM pl) THEN 1.0 ELSE 0.0 END AS p FROM pl")
def delta(spark, sf_dir):
    """Several customers may stand at one place; the first of them is the cell."""
    at = places(spark, sf_dir).select("k", F.col("lon").alias("x"), F.col("lat").alias("y"))
    cells = at.groupBy("x", "y").agg(F.min("k").alias("k"))
    one = regrid.delta_at(cells, (3.0, 4.0)).filter("p = 1").select("k", "p")
    return at.join(one, "k", "left").select("k", F.coalesce("p", F.lit(0.0)).alias("p"))



SIZE, NB = 16.0, 20
HIST = f"""pt AS (SELECT o_custkey % 50 AS cell_id, o_totalprice / 1000 AS depth, CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 4) / 2 END AS sd FROM orders),
ix AS (SELECT cell_id, CAST(trunc(least(greatest(depth / {SIZE}, -10.0), {NB - 0.01})) AS BIGINT) + 10 AS i, greatest(coalesce(sd, 1.0), 0.5) AS s FROM pt),
sp AS (SELECT cell_id, least(greatest(i + j, 0), {NB + 9}) AS bin, CAST(exp(-CAST(j * j AS DOUBLE) / (2 * s * s)) / (exp(-4 / (2 * s * s)) + exp(-1 / (2 * s * s)) + 1 + exp(-1 / (2 * s * s)) + exp(-4 / (2 * s * s))) AS DECIMAL(20,12)) AS w FROM ix, (SELECT unnest([-2, -1, 0, 1, 2]) AS j)),
tot AS (SELECT cell_id, sum(w) AS total FROM sp GROUP BY cell_id), hb AS (SELECT cell_id, bin, sum(w) AS w FROM sp GROUP BY ALL),
hist AS (SELECT t.cell_id, d.depth_bin, 1 - CAST(coalesce((SELECT sum(w) FROM hb WHERE hb.cell_id = t.cell_id AND hb.bin <= d.depth_bin), 0) AS DOUBLE) / CAST(t.total AS DOUBLE) AS exceedance FROM tot t, (SELECT unnest(range({NB})) AS depth_bin) d)"""


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    pts = table(spark, sf_dir, "orders").select((k % 50).alias("cell_id"), (-F.col("o_totalprice") / 1000).alias("elevation"), F.when(k % 3 != 0, (k % 4) / 2).alias("stdev"))
    return bathymetry.depth_histogram(pts, SIZE, NB)


@query(f"WITH {HIST} SELECT cell_id, CAST(depth_bin AS INTEGER) AS depth_bin, round(exceedance, 9) + 0.0 AS exceedance FROM hist")
def bathymetry_histogram(spark, sf_dir):
    return histogram(spark, sf_dir).withColumn("exceedance", six("exceedance", 9))


@query(f"""WITH {HIST}, {OBS}, d AS (SELECT tag_id, date_trunc('day', time) AS time, max(pressure) AS p FROM obs GROUP BY ALL), c AS (SELECT cell_id, (cell_id % 5) / 10 AS xe FROM tot),
v AS (SELECT tag_id, time, cell_id, least(greatest(CAST(trunc((p - xe + 10) / {SIZE}) AS BIGINT), 0), {NB - 1}) AS b FROM d, c)
SELECT tag_id, time, v.cell_id, round(CASE WHEN exceedance > 0 THEN exceedance ELSE 1e-14 END, 9) + 0.0 AS pdf_bathy FROM v JOIN hist ON hist.cell_id = v.cell_id AND depth_bin = b""")
def bathymetry_pdf(spark, sf_dir):
    binned, h = day_bins(spark, sf_dir), histogram(spark, sf_dir)
    cells = h.select("cell_id").distinct().withColumn("XE", (F.col("cell_id") % 5) / 10)
    reference = binned.select("time").distinct().crossJoin(cells)
    return bathymetry.bathymetry_pdf(binned, reference, h, SIZE, NB).withColumn("pdf_bathy", six("pdf_bathy", 9))


@query("SELECT p_partkey, round(CAST(eta * (1 + s) + 5.0 * s + (h - 5.0) * (0.7 * sinh(6.0 * s) / sinh(6.0) + 0.3 * (tanh(6.0 * (s + 0.5)) - tanh(3.0)) / (2 * tanh(3.0))) AS FLOAT) + eta, 2) + 0.0 AS depth FROM (SELECT p_partkey, -p_size / 50 AS s, (p_partkey % 7) / 10 AS eta, 100.0 + p_partkey % 50 AS h FROM part)")
def sigma_depth(spark, sf_dir):
    k = F.col("p_partkey")
    d = align.sigma_depth(-F.col("p_size") / 50, (k % 7) / 10, 100.0 + k % 50, F.lit(5.0), 6.0, 0.3)
    return table(spark, sf_dir, "part").select("p_partkey", six(d, 2).alias("depth"))


@query("WITH m AS (SELECT DISTINCT p_brand AS place, CAST(p_size AS DOUBLE) AS depth FROM part), x AS (SELECT place, depth, (CAST(regexp_extract(place, '([0-9]+)', 1) AS INTEGER) % 3) / 10 - 0.1 AS xe FROM m) SELECT place, count(*) FILTER (depth <= 30 - (SELECT min(xe) FROM x)) AS levels FROM x GROUP BY place")
def prune_depth(spark, sf_dir):
    m = model(spark, sf_dir).withColumn("XE", (F.regexp_extract("place", "([0-9]+)", 1).cast("int") % 3) / 10 - 0.1)
    return align.prune_depth(m, 30.0).select("place", F.size("profile").cast("long").alias("levels"))


@query("""WITH g AS (SELECT p_partkey % 40 AS gi, p_partkey // 40 AS gj, CAST(p_size AS DOUBLE) AS dist FROM part WHERE p_partkey % 9 <> 0), d AS (SELECT s_suppkey AS k, (s_suppkey * 13 % 380) / 10 AS lat, (s_suppkey * 29 % 480) / 10 AS lon, s_acctbal AS diff FROM supplier),
o(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)), c AS (SELECT d.*, CAST(floor(lat) AS BIGINT) + a AS gi, CAST(floor(lon) AS BIGINT) + b AS gj, (CASE WHEN a = 1 THEN lat - floor(lat) ELSE 1 - (lat - floor(lat)) END) * (CASE WHEN b = 1 THEN lon - floor(lon) ELSE 1 - (lon - floor(lon)) END) AS w FROM d, o),
r AS (SELECT k, lat, lon, any_value(diff) AS diff, sum(w * dist) / nullif(sum(CASE WHEN dist IS NOT NULL THEN w END), 0) AS distance FROM c LEFT JOIN g USING (gi, gj) GROUP BY ALL)
SELECT k, round(distance, 6) + 0.0 AS distance, round(diff / (1 + exp(-distance * distance * 0.01)), 6) + 0.0 AS diff FROM r""")
def coastal_weights(spark, sf_dir):
    p, k = F.col("p_partkey"), F.col("s_suppkey")
    grid = table(spark, sf_dir, "part").filter("p_partkey % 9 <> 0").select((p % 40).cast("double").alias("lat"), F.floor(p / 40).cast("double").alias("lon"), F.col("p_size").cast("double").alias("distance"))
    d = table(spark, sf_dir, "supplier").select(k.alias("k"), ((k * 13 % 380) / 10).alias("lat"), ((k * 29 % 480) / 10).alias("lon"), F.col("s_acctbal").alias("diff"))
    return align.mark_coastal(d, grid, 1.0).select("k", six("distance").alias("distance"), six("diff").alias("diff"))


@query("SELECT s_suppkey AS deployment_id, CASE WHEN s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0 THEN s_name END AS station_name FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 5 < 4")
def merge_stations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a = s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("deployment_id"), F.col("s_name").alias("station_name"))
    b = s.filter("s_suppkey % 5 < 4").select(F.col("s_suppkey").alias("deployment_id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("station_name"))
    return tags.update_stations(a, b)


@query(f"WITH {OBS} SELECT tag_id, date_trunc('hour', time) AS time, count(*) AS n_obs, CAST(sum(CAST(temperature AS DECIMAL(18,6))) AS DOUBLE) AS total_temperature, max(pressure) AS deepest FROM obs GROUP BY ALL")
def stream_bins(spark, sf_dir):
    """Events replayed as a stream of files; every window is written again when it changes, and the last batch is the result."""
    root, kept = shared_folder(spark, "stream"), table(spark, sf_dir, "events")
    source = spark.readStream.schema(kept.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = source.select(F.col("user_id").alias("tag_id"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("temperature"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("pressure"))
    out = streaming.binned_stream(log, "1 hour").writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state")
    out.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{root}/out")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").withColumn("total_temperature", F.col("total_temperature").cast("double"))


@query(f"{FORWARD} {UNPACK.format('f')}")
def stream_forward(spark, sf_dir):
    """The forward filter on a stream of steps, one file of steps a batch."""
    root = shared_folder(spark, "online")
    packed = field(spark, sf_dir).groupBy("tag_id", "time").agg(F.array_sort(F.collect_list(F.struct("cell_id", "pdf"))).alias("c")).select("tag_id", F.timestamp_seconds("time").alias("time"), F.transform("c", lambda x: x["pdf"]).alias("pdf"))
    packed.write.mode("overwrite").parquet(f"{root}/in")
    initial = starts(spark, sf_dir).groupBy("tag_id").agg(F.map_from_entries(F.collect_list(F.struct("cell_id", "p"))).alias("m")).select("tag_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: F.coalesce(F.element_at("m", c.cast("long")), F.lit(0.0))).alias("p"))
    steps = spark.readStream.schema(packed.schema).parquet(f"{root}/in")
    out = streaming.online_forward(steps, initial, square(spark), movement.Predictor("planar"), SIGMA)
    out.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").format("parquet").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("tag_id", F.unix_seconds("time").alias("time"), "cell_id", F.round("states", 6).alias("states"))
