"""From tags and an ocean model to tracks, in steps that each write a table for the next.

prepare: diff, emission, acoustic and combined densities.  estimate: each tag's sigma.  decode: states and tracks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions.healpix import cells_in_box, resolution
from driftmark.functions.units import max_sigma
from driftmark.operators import acoustic, diff, emission, movement, tracks
from driftmark.operators.align import adapt_model_time, bin_observations
from driftmark.operators.regrid import bilinear_weights, regrid
from driftmark.sources import store
from driftmark.sources.tags import Tags


@dataclass(frozen=True)
class Settings:
    """What a run is configured with; quantities are text with units or SI numbers."""

    step: timedelta = timedelta(hours=1)
    origin: datetime = datetime(1970, 1, 1)
    threshold: float = 0.8
    differences_std: float = 0.75
    initial_std: float = 1e-5
    recapture_std: float | None = None
    buffer: str = "1000 m"
    nondetections: str = "mask"
    speed: str = "60 km / day"
    adjustment: float = 5.0
    truncate: float = 4.0
    level: int = 12
    tolerance: float = 1e-6
    predictor: movement.Predictor = field(default_factory=movement.Predictor)

    def upper_bound(self) -> float:
        return max_sigma(self.speed, self.step.total_seconds(), self.adjustment, truncate=self.truncate)


def healpix_grid(places: DataFrame, level: int) -> DataFrame:
    """(cell_id, lat, lon) of all cells whose centre is in the box that the places (lat, lon) span, finer than the places or not."""
    box = places.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if box[0] is None:
        raise ValueError("the model has no places")
    return cells_in_box(places.sparkSession, level, (box[0], box[1]), (box[2], box[3]))


def bins_of(slices: DataFrame, settings: Settings) -> DataFrame:
    """(tag_id, time, bin_start, bin_end): all regular bins of each tag's slice, widened to the model's hours."""
    start, stop = adapt_model_time(F.col("start"), F.col("stop"))
    micros = settings.step // timedelta(microseconds=1)
    base = (settings.origin - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    first = F.floor((F.unix_micros(start) - base) / F.lit(micros))
    last = F.floor((F.unix_micros(stop) - base) / F.lit(micros))
    k = slices.select("tag_id", F.explode(F.sequence(first, last)).alias("k"))
    return k.select("tag_id", F.timestamp_micros(F.col("k") * micros + base).alias("time")).withColumns({"bin_start": F.col("time"), "bin_end": F.timestamp_micros(F.unix_micros("time") + micros)})


def prepare(spark: SparkSession, tags: Tags, slices: DataFrame, model: DataFrame, root: str, settings: Settings, source_grid: tuple[float, float, float]) -> dict[str, DataFrame]:
    """Write and return the tables of the model's input; source_grid is the model's first lat, first lon and step."""
    binned = bin_observations(tags.dst, settings.step, settings.origin, "left")
    store.save(diff.compute_diff(model, binned, settings.threshold), f"{root}/diff")
    differences = store.open_table(spark, f"{root}/diff")
    diff.require_no_empty_times(differences, "diff", ["tag_id", "time"])
    lat0, lon0, step = source_grid
    grid = healpix_grid(model.select("lat", "lon").distinct(), settings.level)
    numbered = differences.select("tag_id", "time", "diff", F.col("ocean_mask").cast("double").alias("sea"), F.round((F.col("lat") - lat0) / step).cast("long").alias("i"), F.round((F.col("lon") - lon0) / step).cast("long").alias("j"))
    store.save(regrid(numbered, bilinear_weights(grid, lat0, lon0, step), ["diff", "sea"], ["tag_id", "time"]), f"{root}/diff-regridded")
    regridded = store.open_table(spark, f"{root}/diff-regridded").withColumn("ocean_mask", F.col("sea") > 0)
    made = emission.compute_emission_pdf(regridded, grid, tags.events, settings.differences_std, settings.initial_std, settings.recapture_std, level=settings.level)
    grid = grid.join(made["mask"], "cell_id", "left").withColumn("mask", F.coalesce("mask", F.lit(False)))
    layers, names = made["emission"].select("tag_id", "time", "cell_id", "pdf"), ["pdf"]
    if tags.acoustic is not None and tags.stations is not None:
        acoustic.require_known_receivers(tags.acoustic, tags.stations)
        bins = bins_of(slices, settings)
        heard = acoustic.acoustic_pdf(tags.acoustic, tags.stations.drop("tag_id").dropDuplicates(["deployment_id"]), grid, bins, settings.step, settings.origin, settings.buffer, settings.nondetections)
        store.save(heard, f"{root}/acoustic")
        heard = store.open_table(spark, f"{root}/acoustic")
        layers = emission.without_acoustic(emission.combine_with_acoustic(layers, heard), heard)
        names = ["pdf", "acoustic"]
    combined = emission.combine(layers, names, made["final"])
    for name, table in (("combined", combined), ("initial", made["initial"]), ("grid", grid)):
        store.save(table, f"{root}/{name}")
    return {n: store.open_table(spark, f"{root}/{n}") for n in ("combined", "initial", "grid")}


def estimate(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    """Fit every tag's sigma and write them with the predictor's settings; an error where one lies on its upper bound."""
    tables = [store.open_table(spark, f"{root}/{n}") for n in ("combined", "initial", "grid")]
    bounds = (1e-4 if settings.upper_bound() > 1e-4 else 1e-6, settings.upper_bound())
    store.save_fits(movement.fit(*tables, settings.predictor, bounds, settings.tolerance), root)
    diff.require_below(spark.read.json(f"{root}/fits"), bounds[1], 2 * settings.tolerance)
    store.save_parameters(spark, root, {"predictor": {"kind": settings.predictor.kind, "settings": settings.predictor.settings}, "comment": f"fitted on cells of {resolution(settings.level):.3g} rad"})
    return spark.read.json(f"{root}/fits")


def decode(spark: SparkSession, root: str, modes: tuple[str, ...] = ("mean", "mode"), fmt: str = "parquet") -> DataFrame:
    """Smooth with the fitted sigmas, and write states and tracks of all modes."""
    combined, initial, grid = (store.open_table(spark, f"{root}/{n}") for n in ("combined", "initial", "grid"))
    fits, own = spark.read.json(f"{root}/fits"), store.load_parameters(spark, root)["predictor"]
    store.save(movement.smooth(combined, initial, grid, movement.Predictor(own["kind"], own["settings"]), fitted=fits), f"{root}/states")
    states = store.open_table(spark, f"{root}/states")
    predictor = movement.Predictor(own["kind"], own["settings"])

    def best() -> DataFrame:
        path = movement.viterbi(combined, initial, grid, fitted=fits, predictor=predictor)
        return path.join(grid.select("cell_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), "cell_id").drop("cell_id")

    made = {"mean": lambda: tracks.mean_track(states, grid), "mode": lambda: tracks.modal_track(states, grid).drop("cell_id"), "viterbi": best}
    out = None
    for mode in modes:
        if mode not in made:
            raise ValueError(f"unknown mode: {mode}")
        one = tracks.additional_quantities(made[mode]()).withColumn("traj_id", F.concat_ws("-", F.col("tag_id").cast("string"), F.lit(mode)))
        out = one if out is None else out.unionByName(one)
    store.save_trajectories(out, root, fmt)
    return store.read_trajectories(spark, root, fmt=fmt)
