"""Ocean model fields: (time, lat, lon, H0, XE, profile, dynamic_bathymetry) with profile an array of (depth, temp).

Fields come as Parquet tables or catalog tables.  Formats that need a network or a client of their own (array stores,
the marine service) plug in by ``register``; their reader gets the box and the times, so it can fetch no more than that.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.operators.align import prune_depth, select_box, within
from driftmark.schema import null_nan, require

#: Names in published products and the engine's.
NAMES = {"thetao": "TEMP", "zos": "XE", "deptho": "H0", "latitude": "lat", "longitude": "lon"}
#: Published datasets of ocean products as (product, variable, frequency, dataset); deptho is static.
PRODUCTS = (
    ("GLOBAL_ANALYSISFORECAST_PHY_001_024", "thetao", "H", "cmems_mod_glo_phy-thetao_anfc_0.083deg_PT6H-i_202406"),
    ("GLOBAL_ANALYSISFORECAST_PHY_001_024", "thetao", "D", "cmems_mod_glo_phy-thetao_anfc_0.083deg_P1D-m_202406"),
    ("GLOBAL_ANALYSISFORECAST_PHY_001_024", "zos", "H", "cmems_mod_glo_phy_anfc_0.083deg_PT1H-m_202406"),
    ("GLOBAL_ANALYSISFORECAST_PHY_001_024", "zos", "D", "cmems_mod_glo_phy_anfc_0.083deg_P1D-m_202406"),
    ("GLOBAL_ANALYSISFORECAST_PHY_001_024", "deptho", None, "cmems_mod_glo_phy_anfc_0.083deg_static_202211--ext--bathy"),
    ("GLOBAL_MULTIYEAR_PHY_001_030", "thetao", "NEW", "cmems_mod_glo_phy_myint_0.083deg_P1D-m_202311"),
    ("GLOBAL_MULTIYEAR_PHY_001_030", "thetao", "OLD", "cmems_mod_glo_phy_my_0.083deg_P1D-m_202311"),
    ("GLOBAL_MULTIYEAR_PHY_001_030", "zos", "NEW", "cmems_mod_glo_phy_myint_0.083deg_P1D-m_202311"),
    ("GLOBAL_MULTIYEAR_PHY_001_030", "zos", "OLD", "cmems_mod_glo_phy_anfc_0.083deg_P1D-m_202406"),
    ("GLOBAL_MULTIYEAR_PHY_001_030", "deptho", None, "cmems_mod_glo_phy_anfc_0.083deg_static_202211--ext--bathy"),
    ("IBI_MULTIYEAR_PHY_005_002", "thetao", "H", "cmems_mod_ibi_phy_anfc_0.027deg-3D_PT1H-m_202211"),
    ("IBI_MULTIYEAR_PHY_005_002", "thetao", "D", "cmems_mod_ibi_phy_anfc_0.027deg-3D_P1D-m_202211"),
    ("IBI_MULTIYEAR_PHY_005_002", "zos", "H", "cmems_mod_ibi_phy_anfc_0.027deg-2D_PT1H-m_202211"),
    ("IBI_MULTIYEAR_PHY_005_002", "zos", "D", "cmems_mod_ibi_phy_anfc_0.027deg-3D_P1D-m_202211"),
    ("IBI_MULTIYEAR_PHY_005_002", "deptho", None, "cmems_mod_ibi_phy_anfc_0.027deg-3D_static_202211--ext--bathy"),
    ("IBI_ANALYSISFORECAST_PHY_005_001", "thetao", "D", "cmems_mod_ibi_phy_my_0.083deg-3D_P1D-m_202012"),
    ("IBI_ANALYSISFORECAST_PHY_005_001", "zos", "H", "cmems_mod_ibi_phy_my_0.083deg-2D_PT1H-m_202012"),
    ("IBI_ANALYSISFORECAST_PHY_005_001", "zos", "D", "cmems_mod_ibi_phy_my_0.083deg-3D_P1D-m_202012"),
    ("IBI_ANALYSISFORECAST_PHY_005_001", "deptho", None, "cmems_mod_ibi_phy_my_0.083deg-3D_static_202012--ext--bathy"),
    ("NWSHELF_ANALYSISFORECAST_PHY_004_013", "thetao", "H", "cmems_mod_nws_phy_anfc_0.027deg-3D_PT1H-m_202309"),
    ("NWSHELF_ANALYSISFORECAST_PHY_004_013", "thetao", "D", "cmems_mod_nws_phy_anfc_0.027deg-3D_P1D-m_202309"),
    ("NWSHELF_ANALYSISFORECAST_PHY_004_013", "zos", "H", "cmems_mod_nws_phy_anfc_0.027deg-2D_PT1H-m_202309"),
    ("NWSHELF_ANALYSISFORECAST_PHY_004_013", "zos", "D", "cmems_mod_nws_phy_anfc_0.027deg-3D_P1D-m_202309"),
    ("NWSHELF_ANALYSISFORECAST_PHY_004_013", "deptho", None, "cmems_mod_nws_phy_anfc_0.027deg-3D_static_202309--ext--bathy"),
    ("NWSHELF_MULTIYEAR_PHY_004_009", "thetao", "D", "cmems_mod_nws_phy-t_my_7km-3D_P1D-m_202012"),
    ("NWSHELF_MULTIYEAR_PHY_004_009", "zos", "D", "cmems_mod_nws_phy-ssh_my_7km-2D_P1D-m_202012"),
    ("NWSHELF_MULTIYEAR_PHY_004_009", "deptho", None, "cmems_mod_nws_phy-bottomt_my_7km-2D_P1D-m_202012"),
)
READERS: dict[str, Callable[..., DataFrame]] = {}


def register(scheme: str, reader: Callable[..., DataFrame]) -> None:
    """A reader(spark, uri, box, times) for URIs of a scheme, returning long rows (time, lat, lon, depth, TEMP, XE, H0)."""
    READERS[scheme] = reader


def dataset(product: str, variable: str, frequency: str | None = "D") -> str:
    """The published dataset that holds a product's variable at a frequency."""
    for p, v, f, name in PRODUCTS:
        if (p, v) == (product, variable) and f in (None, frequency):
            return name
    raise ValueError(f"no dataset of {product} has {variable} at {frequency}")


def static_product(name: str) -> str:
    """The name of a product's static fields."""
    return f"{name.rsplit('_', 1)[0]}_static"


def prepare(fields: DataFrame, box: dict[str, tuple[float, float]] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Long rows renamed to the engine's names, with dynamic_depth = depth + XE and dynamic_bathymetry = H0 + XE."""
    renamed = null_nan(fields.withColumnsRenamed({a: b for a, b in (NAMES | (names or {})).items() if a in fields.columns and b not in fields.columns}))
    require(renamed, "time", "lat", "lon", "depth", "TEMP", "XE", "H0")
    if box:
        ends = renamed.agg(*[f(c).alias(f"{c}{k}") for c in ("lat", "lon") for k, f in (("0", F.min), ("1", F.max))]).first()
        for c in ("lat", "lon"):
            if c in box and ends[f"{c}0"] is not None and (box[c][0] < ends[f"{c}0"] or box[c][1] > ends[f"{c}1"]):
                warnings.warn(f"the model does not cover the whole box in {c}", RuntimeWarning, stacklevel=2)
    return renamed.withColumns({"dynamic_depth": F.col("depth") + F.col("XE"), "dynamic_bathymetry": F.col("H0") + F.col("XE")})


def assemble(temperature: DataFrame, surface: DataFrame, bathymetry: DataFrame) -> DataFrame:
    """Long rows from a catalog's tables: (time, lat, lon, depth, TEMP), (time, lat, lon, XE) and (lat, lon, H0)."""
    return prepare(temperature.join(surface, ["time", "lat", "lon"]).join(bathymetry, ["lat", "lon"]))


def profiles(fields: DataFrame) -> DataFrame:
    """One row a time and place, its levels in an array by rising dynamic depth, so differences need no more shuffle."""
    level = F.struct(F.col("dynamic_depth").alias("depth"), F.col("TEMP").alias("temp"))
    return fields.groupBy("time", "lat", "lon").agg(F.first("H0").alias("H0"), F.first("XE").alias("XE"), F.first("dynamic_bathymetry").alias("dynamic_bathymetry"), F.array_sort(F.collect_list(level)).alias("profile"))


def surface_level(fields: DataFrame) -> DataFrame:
    """The uppermost level set to depth 0, as in virtual stores whose first level lies below the surface."""
    low = fields.agg(F.min("depth").alias("low"))
    return fields.crossJoin(F.broadcast(low)).withColumn("depth", F.when(F.col("depth") == F.col("low"), 0.0).otherwise(F.col("depth"))).drop("low")


def depth_from_elevation(fields: DataFrame) -> DataFrame:
    """Fields whose levels are elevations below zero, with ``depth`` as their absolute value."""
    return fields.withColumn("depth", F.abs("elevation")).drop("elevation")


def interpolate_times(fields: DataFrame, step_seconds: int, values: tuple[str, ...] = ("TEMP",), place: tuple[str, ...] = ("lat", "lon", "depth")) -> DataFrame:
    """(place, time, values) every step_seconds between a place's first and last time, by parabolas through three times.

    The parabola of a stretch goes through its ends and the time before it, or after it for the first stretch; with two
    times only it is a line.  A missing value in any of the three makes the stretch's inner values missing.
    """
    t = F.unix_seconds("time")
    known = fields.select(*place, t.alias("t1"), *[F.col(v).alias(f"{v}1") for v in values])
    w = Window.partitionBy(*place).orderBy("t1")
    cols = {}
    for c in ("t", *values):
        cols |= {f"{c}0": F.lag(f"{c}1").over(w), f"{c}2": F.lead(f"{c}1").over(w), f"{c}3": F.lead(f"{c}1", 2).over(w)}
    wide = known.withColumns(cols)
    stops = F.when(F.col("t2").isNull(), F.array("t1")).otherwise(F.filter(F.sequence("t1", "t2", F.lit(step_seconds)), lambda x: x < F.col("t2")))
    each = wide.withColumn("t", F.explode(stops))

    def at(v: str) -> Column:
        third_t, third = F.coalesce("t0", "t3"), F.when(F.col("t0").isNotNull(), F.col(f"{v}0")).otherwise(F.col(f"{v}3"))
        x, a, b, c = F.col("t"), F.col("t1"), F.col("t2"), third_t
        line = F.col(f"{v}1") + (F.col(f"{v}2") - F.col(f"{v}1")) * (x - a) / (b - a)
        slope_ab, slope_bc = (F.col(f"{v}2") - F.col(f"{v}1")) / (b - a), (third - F.col(f"{v}2")) / (c - b)
        bend = (slope_bc - slope_ab) / (c - a) * (x - a) * (x - b)
        return F.when(x == a, F.col(f"{v}1")).when(c.isNull(), line).otherwise(line + bend).alias(v)

    return each.select(*place, F.timestamp_seconds("t").alias("time"), *[at(v) for v in values])


def load_model(spark: SparkSession, uri: str, times: tuple[datetime, datetime] | None = None, box: dict[str, tuple[float, float]] | None = None, max_depth: float | Column | None = None, surface_at_zero: bool = False) -> DataFrame:
    """Profiles from a URI: a registered scheme, a ``.parquet`` or other folder of Parquet, or ``table:name``.

    Time and box are comparisons on the scan's columns and so are pushed down; levels deeper than max_depth less the
    lowest surface height go.
    """
    box = box or {}
    scheme = uri.partition(":")[0] if ":" in uri else ""
    if scheme in READERS:
        long = READERS[scheme](spark, uri, box, times)
    elif scheme == "table":
        long = spark.table(uri.partition(":")[2])
    elif uri.endswith((".zarr", ".yaml", ".yml")) or scheme in ("copernicus", "intake"):
        raise NotImplementedError(f"no reader for {uri}; register one for its scheme, or convert it to Parquet")
    else:
        long = spark.read.parquet(uri)
    long = long.withColumnsRenamed({a: b for a, b in NAMES.items() if a in long.columns and b not in long.columns})
    if times:
        long = long.filter(within(F.col("time"), *times))
    long = select_box(long, box.get("lat"), box.get("lon"))
    out = profiles(prepare(surface_level(long) if surface_at_zero else long, box))
    return prune_depth(out, max_depth) if max_depth is not None else out
