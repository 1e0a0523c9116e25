"""Tag folders: dst.csv, tagging_events.csv, metadata.json and, where they exist, stations.csv and acoustic.csv.

One scan reads a file of all tags: ``root/*/dst.csv``, the tag's name being its folder's.  Times are ISO 8601; without
a zone they are UTC, which is the session's zone.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark import schema
from driftmark.operators.align import slice_observations, time_slice


@dataclass(frozen=True)
class Tags:
    """The tables of one or all tags, each with ``tag_id``; stations and acoustic are None where no tag has them."""

    dst: DataFrame
    events: DataFrame
    metadata: DataFrame | None = None
    stations: DataFrame | None = None
    acoustic: DataFrame | None = None


def tz_convert(df: DataFrame, zones: dict[str, str | None]) -> DataFrame:
    """Times of the columns as UTC; with a zone, naive times are taken to be of that zone."""
    return df.withColumns({c: F.to_utc_timestamp(c, zone) if zone else F.col(c).cast("timestamp") for c, zone in zones.items()})


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _csv(spark: SparkSession, path: str, fields: str, columns: str = "*") -> DataFrame:
    own = spark.read.option("header", True).option("nullValue", "NA").option("enforceSchema", False)
    read = own.csv(path)
    kinds = dict(f.strip().split(" ") for f in fields.split(","))
    schema.require(read, *[c for c in kinds if c not in ("recover_longitude", "recover_latitude")])
    every = [F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in read.columns]
    return schema.null_nan(read.select(*every, F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+\z", 1).alias("tag_id")))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """A station table, without a tag."""
    return _csv(spark, path, schema.STATIONS).drop("tag_id")


def open_tag(spark: SparkSession, root: str, name: str = "*") -> Tags:
    """One tag's tables, or with ``*`` those of all tags under root."""
    base = f"{root}/{name}"
    events = _csv(spark, f"{base}/tagging_events.csv", schema.TAGGING_EVENTS)
    # the order of a file's rows counts: the first and second time are the slice
    events = events.withColumn("row", F.monotonically_increasing_id())
    out = {"dst": _csv(spark, f"{base}/dst.csv", schema.DST), "events": events}
    if _exists(spark, f"{base}/metadata.json"):
        text = spark.read.option("wholetext", True).text(f"{base}/metadata.json")
        out["metadata"] = text.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+\z", 1).alias("tag_id"), F.from_json("value", "map<string,string>").alias("metadata"))
    for key, fields in (("stations", schema.STATIONS), ("acoustic", schema.ACOUSTIC)):
        if _exists(spark, f"{base}/{key}.csv"):
            table = _csv(spark, f"{base}/{key}.csv", fields)
            if not table.isEmpty():
                out[key] = table
    return Tags(**out)


def load_tag(spark: SparkSession, root: str, name: str = "*") -> tuple[Tags, DataFrame]:
    """The tables with dst cut to each tag's time slice, and the slices (tag_id, start, stop)."""
    tags = open_tag(spark, root, name)
    slices = time_slice(tags.events, ["row"])
    return Tags(slice_observations(tags.dst, slices), tags.events, tags.metadata, tags.stations, tags.acoustic), slices


def save_tag_files(table: DataFrame, root: str, name: str) -> int:
    """A table as ``root/<tag_id>/<name>.csv``, a file a tag in time order; the number of rows written.

    Tags are written in tasks of their own.  A file gets its name when it is whole, so a task that runs again does no harm.
    """
    columns = [c for c in table.columns if c != "tag_id"]

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        folder = f"{base}/{key[0]}"
        files.create_dir(folder, recursive=True)
        text = part.sort_values("time", kind="stable")[columns].to_csv(index=False, na_rep="NA", date_format="%Y-%m-%dT%H:%M:%S.%fZ")
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as f:
            f.write(text.encode())
        files.move(draft, f"{folder}/{name}.csv")
        return pd.DataFrame({"n_rows": [len(part)]})

    return table.groupBy("tag_id").applyInPandas(one, "n_rows long").agg(F.sum("n_rows")).first()[0] or 0


def update_stations(stations: DataFrame | None, other: DataFrame, method: str = "merge") -> DataFrame:
    """``replace``: the other table.  ``merge``: both by deployment_id; the rows' values must not contradict each other.

    A contradiction raises when the result is evaluated.
    """
    if method == "replace" or stations is None:
        return other
    if method != "merge":
        raise ValueError(f"unknown method: {method}")
    names = [c for c in dict.fromkeys([*stations.columns, *other.columns]) if c not in ("deployment_id", "tag_id")]
    a, b = stations.alias("a"), other.alias("b")
    joined = a.join(b, F.col("a.deployment_id") == F.col("b.deployment_id"), "full_outer")
    out = [F.coalesce("a.deployment_id", "b.deployment_id").alias("deployment_id")]
    for c in names:
        if c in stations.columns and c in other.columns:
            x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
            clash = x.isNotNull() & y.isNotNull() & (x != y)
            out.append(F.when(clash, F.raise_error(F.concat(F.lit(f"conflicting values of {c} for station "), F.col("a.deployment_id").cast("string"))).cast(stations.schema[c].dataType)).otherwise(F.coalesce(x, y)).alias(c))
        else:
            out.append(F.col(f"{'a' if c in stations.columns else 'b'}.{c}").alias(c))
    return joined.select(*out)


def update_stations_from(spark: SparkSession, stations: DataFrame | None, uri: str, method: str = "merge") -> DataFrame:
    if not uri.endswith(".csv"):
        warnings.warn(f"{uri} may not be a CSV file", RuntimeWarning, stacklevel=2)
    return update_stations(stations, read_stations(spark, uri), method)


def read_flags(spark: SparkSession, path: str, flag: str = "warm_plume", sep: str = "\t") -> DataFrame:
    """A separated list of tags, those for which the flag is true."""
    return spark.read.option("header", True).option("sep", sep).csv(path).filter(F.lower(flag) == "true")


def read_places(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A separated list of named places, such as plants on a coast."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path)
