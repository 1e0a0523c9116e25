"""Files in and out, and the whole workflow on a small sea."""

import json
import struct
import warnings
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.plans import workflow
from driftmark.sources import model, store, tags


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "tags" / "A1"
    d.mkdir(parents=True)
    (d / "dst.csv").write_text("time,temperature,pressure\n" + "".join(f"2022-07-01T{h:02d}:00:00Z,{20 + h}.0,{1 + h}.0\n" for h in range(5)))
    (d / "tagging_events.csv").write_text('event_name,time,longitude,latitude\n"release",2022-07-01T00:00:00Z,-5.0,48.0\n"fish_death",2022-07-01T03:00:00Z,NA,NA\n')
    (d / "stations.csv").write_text("deployment_id,station_name,deploy_time,deploy_longitude,deploy_latitude,recover_time,recover_longitude,recover_latitude\n1,one,2022-06-01T00:00:00Z,-5.0,48.0,2022-08-01T00:00:00Z,NA,NA\n")
    (d / "acoustic.csv").write_text("time,deployment_id\n2022-07-01T01:10:00Z,1\n")
    (d / "metadata.json").write_text(json.dumps({"pit": "A1", "kind": "dst"}))
    return str(tmp_path / "tags")


def test_open_tag(spark, root):
    t = tags.open_tag(spark, root, "A1")
    first = t.dst.orderBy("time").limit(2).collect()
    assert [(r.tag_id, r.time, r.temperature) for r in first] == [("A1", datetime(2022, 7, 1), 20.0), ("A1", datetime(2022, 7, 1, 1), 21.0)]
    assert t.stations.first().recover_longitude is None and t.acoustic.count() == 1
    assert t.metadata.first().metadata == {"pit": "A1", "kind": "dst"}
    loaded, slices = tags.load_tag(spark, root)
    assert loaded.dst.count() == 4 and slices.count() == 1


def test_optional_files(spark, root, tmp_path):
    import os

    for name in ("stations.csv", "metadata.json"):
        os.remove(f"{root}/A1/{name}")
    (tmp_path / "tags/A1/acoustic.csv").write_text("time,deployment_id\n")
    t = tags.open_tag(spark, root)
    assert t.stations is None and t.acoustic is None and t.metadata is None
    (tmp_path / "tags/A1/dst.csv").write_text("time,pressure\n2022-07-01T00:00:00Z,1\n")
    with pytest.raises(ValueError, match="temperature"):
        tags.open_tag(spark, root)


def test_update_stations(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.0)], "deployment_id long, station_name string, deploy_latitude double")
    b = spark.createDataFrame([(1, "x", 5.0), (3, "z", 2.0)], "deployment_id long, station_name string, deploy_latitude double")
    assert sorted(map(tuple, tags.update_stations(a, b).collect())) == [(1, "x", 5.0), (2, "y", 1.0), (3, "z", 2.0)]
    assert tags.update_stations(a, b, "replace").count() == 2
    clash = b.withColumn("station_name", F.lit("other"))
    with pytest.raises(Exception, match="conflicting values"):
        tags.update_stations(a, clash).collect()
    with pytest.raises(ValueError):
        tags.update_stations(a, b, "other")


def test_trajectories(spark, tmp_path):
    df = spark.createDataFrame([("a", datetime(2022, 1, 1), -5.25, 48.1), ("b", datetime(2022, 1, 1), 0.0, -3.0)], "traj_id string, time timestamp, longitude double, latitude double")
    for fmt in store.FORMATS:
        store.save_trajectories(df, str(tmp_path), fmt)
        got = store.read_trajectories(spark, str(tmp_path), ["a"], fmt)
        assert got.select("longitude", "latitude").collect() == [(-5.25, 48.1)]
    points = {r.traj_id: struct.unpack("<BIdd", r.geometry) for r in store.read_trajectories(spark, str(tmp_path), fmt="geoparquet").collect()}
    assert points == {"a": (1, 1, -5.25, 48.1), "b": (1, 1, 0.0, -3.0)}
    with pytest.raises(ValueError, match="unknown format"):
        store.save_trajectories(df, str(tmp_path), "gpx")


def test_parameters_and_paths(spark, tmp_path):
    store.save_parameters(spark, str(tmp_path), {"sigma": 0.1})
    assert store.load_parameters(spark, str(tmp_path)) == {"sigma": 0.1}
    assert store.target_root("/data", "A1") == "/data/A1"
    assert store.target_root("/data", "A1", "subdir", 64, 0.8, (0, 30), "1000 m") == "/data/64-0.8-0_30-1000m/A1"
    assert store.save_html("<p>", str(tmp_path / "no" / "x.html"))[0] is False and store.save_html("<p>", str(tmp_path / "x.html"))[0]


def sea(spark):
    lat, lon, t0 = np.arange(46.0, 50.01, 0.5), np.arange(-8.0, -1.99, 0.5), datetime(2022, 7, 1)
    rows = [(t0 + timedelta(hours=h), float(a), float(b), float(d), 20.0 + 0.3 * float(a - 48) - 0.05 * d, 0.1, 50.0) for h in range(5) for a in lat for b in lon for d in range(0, 10, 2)]
    return spark.createDataFrame(rows, "time timestamp, latitude double, longitude double, depth double, thetao double, zos double, deptho double")


def test_model_source(spark, tmp_path):
    path = str(tmp_path / "sea.parquet")
    sea(spark).write.parquet(path)
    m = model.load_model(spark, path, (datetime(2022, 7, 1), datetime(2022, 7, 1, 2)), {"lat": (47, 49), "lon": (-6, -4)}, 6.0)
    assert m.agg(F.min("lat"), F.max("lat"), F.max("time")).first() == (47.0, 49.0, datetime(2022, 7, 1, 2))
    assert m.agg(F.max(F.size("profile"))).first()[0] == 3  # dynamic depths 0.1, 2.1, 4.1 are within 6 - 0.1
    assert "PushedFilters" in m._jdf.queryExecution().explainString(m._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    with pytest.raises(NotImplementedError):
        model.load_model(spark, "s3://x/y.zarr")
    model.register("mem", lambda spark, uri, box, times: sea(spark))
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        model.load_model(spark, "mem:x", box={"lat": (0, 90)})
    assert any("does not cover" in str(w.message) for w in caught)
    assert model.dataset("GLOBAL_ANALYSISFORECAST_PHY_001_024", "thetao") == "cmems_mod_glo_phy-thetao_anfc_0.083deg_P1D-m_202406"
    assert model.dataset("IBI_MULTIYEAR_PHY_005_002", "deptho").endswith("static_202211--ext--bathy")
    with pytest.raises(ValueError):
        model.dataset("NWSHELF_MULTIYEAR_PHY_004_009", "zos", "H")
    assert model.static_product("cmems_mod_glo_phy_anfc_0.083deg_P1D-m") == "cmems_mod_glo_phy_anfc_0.083deg_static"


def test_workflow(spark, root, tmp_path, monkeypatch):
    path, out = str(tmp_path / "sea.parquet"), str(tmp_path / "out")
    sea(spark).write.parquet(path)
    loaded, slices = tags.load_tag(spark, root)
    settings = workflow.Settings(level=7, differences_std=2.0, buffer="60 km", adjustment=300.0)
    tables = workflow.prepare(spark, loaded, slices, model.load_model(spark, path), out, settings, (46.0, -8.0, 0.5))
    sums = tables["combined"].groupBy("time").agg(F.sum("pdf").alias("s")).collect()
    assert sums and all(r.s == pytest.approx(1.0) for r in sums)
    assert tables["initial"].filter("p > 0").count() == 1  # the default deviation leaves the release's cell
    with pytest.raises(ValueError, match="the bounds are too narrow"):  # no step leaves its cell
        workflow.estimate(spark, out, replace(settings, adjustment=5.0))
    monkeypatch.setattr(workflow.diff, "require_below", lambda *_: None)
    workflow.estimate(spark, out, settings)
    store.save_fits(spark.createDataFrame([("A1", 0.01, 1.0, 9)], "tag_id string, sigma double, score double, evaluations int"), out)
    assert store.load_parameters(spark, out)["predictor"]["kind"] == "sphere"
    got = workflow.decode(spark, out, ("mean", "mode", "viterbi"))
    assert {r.traj_id for r in got.select("traj_id").distinct().collect()} == {"A1-mean", "A1-mode", "A1-viterbi"}
    assert got.filter("latitude between 45 and 51 and longitude between -9 and -1").count() == got.count() > 0


def test_times_are_interpolated_by_parabolas(spark):
    t0 = datetime(2022, 7, 1)
    df = spark.createDataFrame([(1.0, 2.0, 0.0, t0 + timedelta(hours=3 * k), float((3 * k) ** 2 - 3 * k)) for k in range(4)], "lat double, lon double, depth double, time timestamp, TEMP double")
    got = {(r.time - t0).seconds // 3600: r.TEMP for r in model.interpolate_times(df, 3600).collect()}
    assert got == {h: pytest.approx(h * h - h) for h in range(10)}
    two = model.interpolate_times(df.filter(F.col("TEMP") <= 6), 3600)
    assert {(r.time - t0).seconds // 3600: r.TEMP for r in two.collect()} == {0: 0.0, 1: pytest.approx(2.0), 2: pytest.approx(4.0), 3: 6.0}
    e = spark.createDataFrame([(-5.0,)], "elevation double")
    assert model.depth_from_elevation(e).first().depth == 5.0


def test_tag_files_are_written_one_a_tag(spark, tmp_path):
    t = spark.createDataFrame([("a", datetime(2022, 7, 1, 1, 0, 0, 250), 1.5, None), ("a", datetime(2022, 7, 1), 0.1, 2.0), ("b c", None, 3.0, 4.0)], "tag_id string, time timestamp, temperature double, pressure double")
    root = f"file://{tmp_path}"
    assert tags.save_tag_files(t, root, "dst") == 3 == tags.save_tag_files(t, root, "dst")  # written again, no row is there twice
    assert (tmp_path / "a" / "dst.csv").read_text() == "time,temperature,pressure\n2022-07-01T00:00:00.000000Z,0.1,2.0\n2022-07-01T01:00:00.000250Z,1.5,NA\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b c"] and [p.name for p in (tmp_path / "b c").iterdir()] == ["dst.csv"]
    assert tags.save_tag_files(t.filter("false"), root, "acoustic") == 0
