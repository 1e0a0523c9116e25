"""Tables of the engine, and checks when they are loaded.

Missing values are NULL everywhere: NaN becomes NULL when a table is read, as aggregates then skip it and arithmetic
passes it on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATIONS = "deployment_id bigint, station_name string, deploy_time timestamp, deploy_longitude double, deploy_latitude double, recover_time timestamp, recover_longitude double, recover_latitude double"
DST = "time timestamp, temperature double, pressure double"
TAGGING_EVENTS = "event_name string, time timestamp, latitude double, longitude double"
ACOUSTIC = "time timestamp, deployment_id bigint"

#: Names that a spatial or temporal dimension goes by, in order of preference.
SPATIAL = (("Y", "X"), ("latitude", "longitude"), ("lat", "lon"), ("x", "y"), ("cells",), ("cell_id",))
TEMPORAL = ("T", "time")


def spatial_columns(df: DataFrame) -> tuple[str, ...]:
    """The columns that give a row's place."""
    for names in SPATIAL:
        if set(names) <= set(df.columns):
            return names
    raise ValueError("could not determine the spatial dimensions. Try passing them explicitly.")


def temporal_column(df: DataFrame) -> str:
    """The column that gives a row's time."""
    for name in TEMPORAL:
        if name in df.columns:
            return name
    raise ValueError("could not determine the temporal dimension. Try passing it explicitly.")


def require(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if lacking := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def null_nan(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes NULL."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
