"""Near-duplicate embeddings by E8 lattice hashing.

Each of TABLES tables projects unit vectors at random to BLOCKS blocks of eight numbers and decodes every block to the
nearest point of the E8 lattice; the points are the cell.  A vector is stored in its own cell and in the PROBES
neighbouring cells that it is nearest to, and looks for others in the same ones: two vectors meet where any of their
cells is one, most likely the cell of the point half way between them.  As both sides have neighbours, few of them do
what one side alone needs many for.  Every pair found is verified: first against an upper bound of its cosine from
codes of a byte a component, then by its cosine in double precision.

At scale: a vector sends TABLES * (PROBES + 1) keys through one shuffle, drawn anew from the vector where they are
wanted, so no list of cells is stored.  Equal vectors form a class of which one goes on.  In a cell, members are first compared with the cell's
leader alone; those within half the linking angle of one leader are a cluster, whose members link with each other for
certain, so a cluster of n near copies costs n comparisons.  Only pairs from different clusters are compared one by one.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing.  Vectors of different
lengths link with nothing of another length.  Rows that repeat a vec_id are one vector a row, each with a row and a
count of links of its own (the other rows within reach, whatever their id); a component holds all rows of an id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Workspace, components
from driftmark.llm.minhash import mix64
from driftmark.llm.textbatch import small_batches

#: A pair at COSINE meets in one table with probability 0.205 (64 components, by simulation), in none with 0.0026;
#: unrelated vectors meet in one with 5e-6.
COSINE, TABLES, BLOCKS, PROBES, WIDTH, SEED = 0.9, 26, 3, 5, 2.0, 20_240_101


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: all signs of two ones, and halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a in (1, -1):
            for b in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    for k in range(256):
        signs = [(k >> i) & 1 for i in range(8)]
        if sum(signs) % 2 == 0:
            out.append(np.array([-0.5 if s else 0.5 for s in signs]))
    return np.array(out)


ROOTS = roots()


def _d8(y: np.ndarray) -> np.ndarray:
    """The nearest point with integer coordinates of even sum."""
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) % 2)
    if len(odd):
        e = y[odd] - r[odd]
        k = np.abs(e).argmax(axis=1)
        r[odd, k] += np.where(e[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


@dataclass(frozen=True)
class Table:
    """One table's projection from dim numbers, and the multipliers that turn a cell's lattice points into a key."""

    projection: np.ndarray
    factors: np.ndarray
    steps: np.ndarray


def tables(dim: int) -> list[Table]:
    """The same on every machine, and others for every dim."""
    draw, out = np.random.default_rng(SEED + dim), []
    for _ in range(TABLES):
        projection = draw.standard_normal((dim, 8 * BLOCKS)) / WIDTH
        factors = draw.integers(1, 1 << 62, size=(BLOCKS, 8), dtype=np.int64) * 2 + 1
        # doubled coordinates are whole numbers; a step to a neighbour adds the same to the key wherever it starts
        out.append(Table(projection, factors, ((2 * ROOTS).astype(np.int64)[None] * factors[:, None, :]).sum(axis=2)))
    return out


def cells(unit: np.ndarray, drawn: list[Table], probes: int) -> np.ndarray:
    """For rows of unit vectors: own cell by table, and after it so many neighbouring ones, as 64-bit keys."""
    n = len(unit)
    out = np.empty((n, TABLES, 1 + probes), dtype=np.int64)
    for t, table in enumerate(drawn):
        y = (unit @ table.projection).reshape(n * BLOCKS, 8)
        b = decode(y)
        base = ((2 * b).astype(np.int64).reshape(n, BLOCKS, 8) * table.factors).sum(axis=(1, 2))
        out[:, t, 0] = _key(base, t)
        if probes:
            gain = ((y - b) @ ROOTS.T).reshape(n, BLOCKS * len(ROOTS))  # the nearer a neighbour, the greater
            pick = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
            out[:, t, 1:] = _key(base[:, None] + table.steps.reshape(-1)[pick], t)
    return out


def _key(x: np.ndarray, t: int) -> np.ndarray:
    return mix64(x.view(np.uint64) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)


def _unit(v) -> np.ndarray | None:
    if v is None or not len(v):
        return None
    x = np.asarray(v, dtype=np.float64)  # null components become nan
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / math.sqrt(float((x * x).sum()))


def _units(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        u = [_unit(v) for v in part["embedding"]]
        yield pd.DataFrame({"vec_id": part["vec_id"], "unit": [None if x is None else x.tobytes() for x in u]})


def _by_dim(part: pd.DataFrame, drawn: dict[int, list[Table]]) -> Iterator[tuple[pd.DataFrame, np.ndarray, list[Table]]]:
    """Rows of one number of components each, with their vectors and its tables."""
    for size, same in part.groupby(part["unit"].map(len)):
        dim = size // 8
        if dim not in drawn:
            drawn[dim] = tables(dim)
        yield same, np.frombuffer(b"".join(same["unit"]), dtype=np.float64).reshape(-1, dim), drawn[dim]


def _own_cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[int, list[Table]] = {}
    for part in parts:
        for same, unit, drawn in _by_dim(part, known):
            yield pd.DataFrame({"rep": same["rep"].to_numpy(), "own": list(cells(unit, drawn, 0)[:, :, 0]), "code": [code(u) for u in unit]})


def _all_cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[int, list[Table]] = {}
    for part in parts:
        for same, unit, drawn in _by_dim(part, known):
            keys = cells(unit, drawn, PROBES).reshape(len(unit), -1)
            times = keys.shape[1]
            yield pd.DataFrame({"cell": keys.reshape(-1), "rep": np.repeat(same["rep"].to_numpy(), times), "root": np.repeat(same["root"].to_numpy(), times)})


def cosine(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, dtype=np.float64), np.frombuffer(b, dtype=np.float64)
    return float(x @ y) if len(x) == len(y) else -1.0


def code(unit: np.ndarray) -> bytes:
    """A unit vector in a byte a component: scale and error norm as floats, then the components over the scale."""
    scale = float(np.abs(unit).max()) / 127
    q = np.rint(unit / scale).astype(np.int8)
    return np.array([scale, np.sqrt(((unit - scale * q) ** 2).sum()) + 1e-9], dtype=np.float64).tobytes() + q.tobytes()


def most(a: bytes, b: bytes) -> float:
    """The greatest cosine that two codes allow: their product, and what either error can add to it."""
    if len(a) != len(b):
        return -1.0
    (sa, ea), (sb, eb) = np.frombuffer(a, dtype=np.float64, count=2), np.frombuffer(b, dtype=np.float64, count=2)
    x, y = np.frombuffer(a, dtype=np.int8, offset=16).astype(np.int32), np.frombuffer(b, dtype=np.int8, offset=16).astype(np.int32)
    return float(sa * sb * int(x @ y) + ea + eb + ea * eb)


def near_duplicates(embeddings: DataFrame, least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings (vec_id, embedding)."""
    spark = embeddings.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "lattice")
    half = math.cos(math.acos(least) / 2 - 1e-6)
    rows = ws.keep(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(_units, "vec_id long, unit binary"), "units")
    valid = rows.filter("unit is not null and vec_id is not null")
    grouped = valid.groupBy("unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = ws.keep(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")  # settled by the write
    ids = ws.keep(rows.join(classes.select("unit", "rep"), "unit", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("rep")).alias("rep")), "ids")
    hashed = ws.keep(classes.select("rep", "unit").mapInPandas(_own_cells, "rep long, own array<long>, code binary"), "cells")
    own = hashed.select("rep", F.explode("own").alias("cell"))

    def checked(pairs: DataFrame, vectors: DataFrame, value: Callable[[bytes, bytes], float], bound: float) -> DataFrame:
        def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                hit = np.fromiter((value(x, y) >= bound for x, y in zip(part["va"], part["vb"], strict=True)), bool, len(part))
                yield part.loc[hit, ["a", "b"]]

        both = pairs.join(vectors.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")
        return both.select("a", "b", "va", "vb").mapInPandas(check, "a long, b long")

    def verified(pairs: DataFrame, bound: float, name: str) -> DataFrame:
        """Pairs whose cosine reaches the bound; codes, an eighth as long, drop first what can't."""
        left = checked(pairs, hashed.select("rep", F.col("code").alias("v")), most, bound)
        return ws.keep(checked(left, classes.select("rep", F.col("unit").alias("v")), cosine, bound), name)

    lead = own.groupBy("cell").agg(F.min("rep").alias("lead"), F.count("*").alias("c")).filter("c > 1").select("cell", "lead")
    close = verified(own.join(lead, "cell").filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), half, "close")
    # a leader that follows no other leader is a root; others join the smallest root they are close to
    follows = close.select(F.col("a").alias("b")).distinct()
    member = close.join(follows, "b", "left_anti").groupBy("a").agg(F.min("b").alias("root"))
    clusters = ws.keep(classes.select("rep", "size").join(member.withColumnRenamed("a", "rep"), "rep", "left").select("rep", "size", F.coalesce("root", "rep").alias("root")), "clusters")

    rooted = classes.select("rep", "unit").join(clusters.select("rep", "root"), "rep")
    stored = rooted.mapInPandas(_all_cells, "cell long, rep long, root long")
    others = stored.select("cell", F.col("rep").alias("other"), F.col("root").alias("other_root"))
    met = stored.join(others, "cell").filter("rep < other and root <> other_root")
    pairs = met.select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct()
    links = verified(pairs, least, "links")

    sizes = clusters.select("rep", "size")
    whole = clusters.groupBy("root").agg(F.sum("size").alias("whole"))
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = ends.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("size").alias("outside")).withColumnRenamed("a", "rep")
    counts = clusters.join(whole, "root").join(outside, "rep", "left").select("rep", "root", (F.col("whole") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"))
    # classes that share an id are one component
    several = ids.filter("rep is not null").groupBy("vec_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("b < most")
    same_id = ids.join(several.select("vec_id", "b"), "vec_id").filter("rep > b").select(F.col("rep").alias("a"), "b")
    edges = links.unionByName(clusters.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).unionByName(same_id)
    comp = components(ws, edges)
    joined = classes.select("rep", "least").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "least", F.coalesce("component", "rep").alias("component"))
    label = joined.groupBy("component").agg(F.min("least").alias("label"))
    of = joined.select("rep", "component").join(label, "component").join(counts.select("rep", "n_links"), "rep").select("rep", "n_links", "label")
    out = ids.join(of, "rep", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "vec_id").alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
