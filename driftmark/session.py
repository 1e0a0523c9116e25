"""Spark sessions for the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings every session of the engine needs: UTC times, adaptive plans, skewed joins split at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def create_session(name: str = "driftmark", master: str | None = None, workers: int | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """A session on ``master`` (the environment's own if None); ``workers`` caps executors where the cluster allocates them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | ({"spark.dynamicAllocation.maxExecutors": str(workers)} if workers else {}) | (settings or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` where all executors can write: under spark.checkpoint.dir, or where that is unset and all runs on one machine a local one."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="driftmark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
