"""Tables and tracks written by one step and read by the next."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "geoparquet")


def save(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("tag_id",)) -> None:
    """Overwrite a table; a failure is an error."""
    own = [c for c in partition_by if c in df.columns]
    df.write.mode("overwrite").partitionBy(*own).parquet(path) if own else df.write.mode("overwrite").parquet(path)


def open_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def open_diff(spark: SparkSession, root: str) -> DataFrame:
    """The stored differences, with lat and lon as the grid's axes yi and xi beside them."""
    df = spark.read.parquet(f"{root}/diff")
    return df.withColumns({"yi": F.col("lat"), "xi": F.col("lon")})


def open_distributions(spark: SparkSession, root: str) -> DataFrame:
    """(tag_id, time, cell_id, states, pdf): states with the emission they came from; states are NULL outside the mask."""
    states, emission = spark.read.parquet(f"{root}/states"), spark.read.parquet(f"{root}/combined")
    keys = [c for c in ("tag_id", "time", "cell_id") if c in emission.columns and c in states.columns]
    return emission.join(states, keys, "left")


def save_trajectories(tracks: DataFrame, root: str, fmt: str = "parquet") -> None:
    """Tracks (traj_id, time, longitude, latitude, …) partitioned by trajectory; geoparquet adds a well-known-binary point."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    out = tracks
    if fmt == "geoparquet":
        # a little-endian point: byte order, kind 1, then x and y as doubles
        out = tracks.withColumn("geometry", F.unhex(F.concat(F.lit("0101000000"), _double_hex(F.col("longitude")), _double_hex(F.col("latitude")))))
    out.write.mode("overwrite").partitionBy("traj_id").parquet(f"{root}/tracks-{fmt}")


def _double_hex(c):
    """The sixteen hexadecimal digits of a double's little-endian bytes."""
    a = F.abs(c)
    exponent = F.floor(F.log2(a))
    exponent = F.when(F.pow(F.lit(2.0), exponent) > a, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= a, exponent + 1).otherwise(exponent)
    mantissa = ((a / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).otherwise(F.shiftleft((exponent + 1023).cast("long"), 52) + mantissa)
    signed = F.when(c < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)
    text = F.lpad(F.hex(signed), 16, "0")
    return F.concat(*[F.substring(text, 15 - 2 * k, 2) for k in range(8)])


def read_trajectories(spark: SparkSession, root: str, names: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Tracks by name; only their partitions are read."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    df = spark.read.parquet(f"{root}/tracks-{fmt}")
    return df.filter(F.col("traj_id").isin(names)) if names else df


def save_parameters(spark: SparkSession, root: str, parameters: dict) -> None:
    """One JSON object as a text file."""
    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/parameters.json")


def load_parameters(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/parameters.json").first()["value"])


def save_fits(fits: DataFrame, root: str) -> None:
    """(tag_id, sigma, score, …) of all tags as JSON rows."""
    fits.write.mode("overwrite").json(f"{root}/fits")


def save_html(html: str, path: str) -> tuple[bool, str]:
    """(written, message) of a page saved by the driver."""
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write(html)
    except OSError as e:
        return False, str(e)
    return True, f"saved {path}"


def target_root(base: str, tag: str, scheme: str = "default", nside: int | None = None, threshold: float | None = None, rotation: tuple[float, float] | None = None, buffer: str | None = None) -> str:
    """Where a tag's results go: ``default`` by tag, ``subdir`` under a folder named by the parameters."""
    if scheme == "default":
        return str(PurePosixPath(base) / tag) if "://" not in base else f"{base.rstrip('/')}/{tag}"
    if scheme != "subdir":
        raise ValueError(f"unknown scheme: {scheme}")
    rot = f"{rotation[0]:g}_{rotation[1]:g}" if rotation else "0_0"
    return f"{base.rstrip('/')}/{nside}-{threshold:g}-{rot}-{(buffer or '').replace(' ', '')}/{tag}"
