"""Shared plumbing: tables written in the cluster's shared folder, and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset and all runs on one machine a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    return _LOCAL["dir"]


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, where: str) -> bool:
    path, fs = _path(spark, where)
    return fs.exists(path)


def remove(spark: SparkSession, where: str) -> None:
    path, fs = _path(spark, where)
    fs.delete(path, True)


class Workspace:
    """Intermediate tables of one operator call, as Parquet under the shared folder.

    A written table cuts lineage as a checkpoint does, survives lost executors, and is compressed and
    column-pruned when read again.  Tables that a returned DataFrame still reads stay until the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        remove(self.spark, self.path(name))

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc.sc().isStopped():
                return
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the JVM may have gone before the driver's Python
            return


def components(ws: Workspace, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of the undirected links (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each is a map-side-combined min per node and one join, so a node
    with very many links is split over tasks.  The rounds grow with the logarithm of the longest chain.  Nothing
    but one checksum per round reaches the driver.
    """
    both = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter("u <> v")
    edges = ws.keep(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen, k = _checksum(edges), 0
    while seen[0]:
        # large star: every larger neighbour of u points at u's smallest neighbour
        two = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        k += 1
        edges = ws.keep(small, f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (r["n"], r["h"])
