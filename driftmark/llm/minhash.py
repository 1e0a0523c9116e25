"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit universe make all coordinates of a signature: ``sigma`` scatters a document's shingles
once, and ``pi``, shifted circularly by k, gives coordinate k as the least pi(sigma(s) - k).  Bands of ROWS
coordinates are the bucket keys.  Links are confirmed on full shingle sets (64-bit hashes).

At scale: no text is shuffled.  A first pass makes a row of numbers of each document; rows with one and the same set
form a class, of which one row goes on.  A second pass makes the sets of the classes that share a bucket, found by
their rows' addresses (``slots``), and leaves them on a shelf, from which later steps fetch them slot by slot.  In a
bucket, members are compared with a leader rather than with each other; what a round links becomes one component, and
the next round compares only members of different components with another leader, the one with the smallest share of
shingles that nobody else has.  Pairs that such shingles keep below the threshold are left out, which is exact.  What
is left after ROUNDS rounds is compared pair by pair between different components, so no linked pair is lost, while a
bucket of n copies costs n.  Leaders are written before they are joined, so that a bucket or leader with very many
members is split at run time.

Null or empty texts and texts without words have no shingles and link with nothing.  Rows without doc_id link with
nothing and are kept.  Rows that repeat a doc_id are judged each by its own text; in ``without_near_duplicates`` rows
go, not ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Workspace, components
from driftmark.llm.slots import ROW, SLOT, addressed, fetched, shelve, without
from driftmark.llm.textbatch import small_batches

WORDS, BANDS, ROWS, ROUNDS = 5, 24, 5, 3
#: Bins of a profile, a power of two up to 256.
BINS = 64
#: Links have 100 * intersection >= LEAST * union.
LEAST = 85
_BAND_SEED = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]
_FEATURES = f"doc_id long, {SLOT} long, {ROW} int, n_shingles long, set_a long, set_b long, bands array<long>"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; the whole sequence as one where words are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z lower, only ASCII white space
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(h) < size:
        size = len(h)
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """All BANDS * ROWS coordinates of a non-empty set."""
    x = _permute((mix64(sets) >> np.uint64(32)).astype(np.uint32), 0x21F0AAAD, 0xD35A2D97)  # sigma
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        low = np.minimum(low, _permute(x[None, i : i + 4096] - _SHIFTS, 0x85EBCA6B, 0xC2B2AE35).min(axis=1))  # pi, shifted
    return low


def bands(sets: np.ndarray) -> np.ndarray:
    s = signature(sets).astype(np.uint64).reshape(BANDS, ROWS)
    h = _BAND_SEED.copy()
    for k in range(ROWS):
        h = mix64(h * np.uint64(0xBF58476D1CE4E5B9) + s[:, k])
    return h.view(np.int64)


def _features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for t in part["text"]:
            s = shingles(t)
            if len(s):
                a, b = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                rows.append((len(s), int(a.view(np.int64)), int(b.view(np.int64)), bands(s)))
            else:
                rows.append((0, 0, 0, np.empty(0, np.int64)))
        made = pd.DataFrame(rows, columns=["n_shingles", "set_a", "set_b", "bands"])
        yield pd.concat([part[["doc_id", SLOT, ROW]].astype({"doc_id": "Int64"}).reset_index(drop=True), made], axis=1)


def _sets(own: pa.RecordBatch, there: pa.Table) -> Iterator[pa.RecordBatch]:
    """The sets of rows (text, address) that the shelf names."""
    for i in range(0, own.num_rows, 200):
        part = own.slice(i, 200)
        held = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
        yield pa.record_batch([part.column(SLOT), part.column(ROW), pa.array(held, pa.binary())], names=[SLOT, ROW, "hashes"])


def _with_sets(names: list[str]):
    def make(own: pa.RecordBatch, there: pa.Table) -> Iterator[pa.RecordBatch]:
        held = there.column("hashes").combine_chunks()
        held = held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks)
        yield pa.record_batch([*[own.column(n) for n in names], held.cast(pa.binary())], names=[*names, "hashes"])

    return make


def _with_lists(names: list[str]):
    """As ``_with_sets``, with sets as lists of numbers, which Spark compares without a Python worker."""

    def make(own: pa.RecordBatch, there: pa.Table) -> Iterator[pa.RecordBatch]:
        held = there.column("hashes").to_pylist()
        ends = np.cumsum([0, *(len(x) // 8 for x in held)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(held), dtype=np.int64)))
        yield pa.record_batch([*[own.column(n) for n in names], lists], names=[*names, "hashes"])

    return make


def _exploded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for i in range(0, len(part), 500):
            own = [np.frombuffer(x, dtype=np.int64) for x in part["hashes"].iloc[i : i + 500]]
            nodes = np.repeat(part["node"].iloc[i : i + 500].to_numpy(), [len(x) for x in own])
            yield pd.DataFrame({"node": nodes, "h": np.concatenate(own) if own else np.empty(0, np.int64)})


def _binned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def count(x: bytes) -> np.ndarray:
        return np.bincount(np.frombuffer(x, dtype=np.uint8)[::8] % BINS, minlength=BINS).astype(np.int32)

    for part in parts:
        yield pd.DataFrame({"node": part["node"], "bins": [count(x) for x in part["hashes"]]})


def linked(a: Column, b: Column, least: int) -> Column:
    """Whether two non-empty sets, as arrays of distinct numbers, are linked; sizes first, which rule most out."""
    x, y = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return (100 * F.least(x, y).cast("long") >= least * F.greatest(x, y).cast("long")) & (100 * both.cast("long") >= least * (x + y - both).cast("long"))


def judged(ws: Workspace, rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(address, doc_id, n_shingles, component_id, kept) for each row of addressed rows (doc_id, text)."""
    small_batches(ws.spark)
    docs = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", SLOT, ROW)
    made = docs.mapInPandas(_features, _FEATURES)
    feats = ws.keep(made.withColumn("node", F.monotonically_increasing_id()), "features")
    same = ["set_a", "set_b", "n_shingles"]
    first = F.min(F.struct("doc_id", "node", SLOT, ROW, "bands")).alias("x")
    full = feats.filter("n_shingles > 0 and doc_id is not null")
    classes = ws.keep(full.groupBy(*same).agg(first).select(*same, F.col("x.doc_id").alias("rep"), "x.node", f"x.{SLOT}", f"x.{ROW}", "x.bands"), "classes")
    places = classes.select("node", SLOT, ROW)
    member = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    inside = ws.keep(member.join(ws.keep(shared, "shared"), "bucket"), "inside")
    wanted = shelve(ws, places.join(inside.select("node").distinct(), "node", "left_semi").select(SLOT, ROW), "wanted")
    texts = docs.select("text", SLOT, ROW)
    sets = shelve(ws, fetched(texts, wanted, _sets, f"{SLOT} long, {ROW} int, hashes binary"), "sets", clustered=True)

    def with_sets(df: DataFrame, make: Callable = _with_sets, kind: str = "binary") -> DataFrame:
        """df, which has node, with the node's set."""
        names = df.columns
        kinds = ", ".join(f"{n} {t}" for n, t in df.dtypes)
        near = df.join(places, "node").repartition(SLOT).sortWithinPartitions(SLOT, ROW)
        return fetched(near, sets, make(names), f"{kinds}, hashes {kind}")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The linked ones of pairs (a, b), of which b is the leader, with few different ones and perhaps many pairs each."""
        lists = _with_lists, "array<long>"
        leads = ws.keep(with_sets(pairs.select(F.col("b").alias("node")).distinct(), *lists), f"{name}-leads")
        left = with_sets(pairs.select(F.col("a").alias("node"), "b"), *lists).withColumnsRenamed({"node": "a", "hashes": "ha"})
        both = left.join(leads.withColumnsRenamed({"node": "b", "hashes": "hb"}), "b")
        out = ws.keep(both.filter(linked(F.col("ha"), F.col("hb"), least)).select("a", "b"), name)
        ws.drop(f"{name}-leads")
        return out

    def profiles(members: DataFrame) -> DataFrame:
        """(node, own, bins): how many shingles of each member no other has, and its shingles' counts in BINS bins."""
        held = ws.keep(with_sets(members.select("node").distinct()), "held")
        each = held.mapInPandas(_exploded, "node long, h long").groupBy("h")
        single = each.agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
        own = single.groupBy("node").agg(F.count("*").cast("int").alias("own"))
        out = ws.keep(held.mapInPandas(_binned, "node long, bins array<int>").join(own, "node", "left").na.fill(0, ["own"]), "profiles")
        ws.drop("held")
        return out

    def can_link(most: Column, n: str, other_n: str) -> Column:
        """Whether an intersection of at most ``most`` can link sets of these sizes."""
        return 100 * most >= least * (F.col(n) + F.col(other_n) - most)

    # bounds of an intersection, so neither drops a link: shingles that others have, and bin by bin the smaller count
    shared_most = F.least(F.col("n_shingles") - F.col("own"), F.col("lead_n") - F.col("lead_own"))
    smaller = F.zip_with("bins", "lead_bins", lambda a, b: F.least(a, b))
    binned_most = F.aggregate(smaller, F.lit(0), lambda a, x: a + x)
    as_lead = {"node": "lead", "comp": "lead_comp", "n_shingles": "lead_n", "own": "lead_own", "bins": "lead_bins"}

    links, tried, comp = [], [], None
    inside = inside.withColumns({"own": F.lit(0), "bins": F.array().cast("array<int>")})
    for k in range(ROUNDS + 1):
        at = inside.withColumn("comp", F.col("node"))
        if comp is not None:
            at = inside.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        mixed = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
        mixed = ws.keep(mixed, f"mixed-{k}")
        if k:
            at = ws.keep(at.join(mixed, "bucket"), f"at-{k}")
        if k == 1:
            at = ws.keep(at.drop("own", "bins").join(profiles(at), "node"), "profiled")
            inside = at.drop("comp")
        other = at.select("bucket", *[F.col(a).alias(b) for a, b in as_lead.items()])
        if k < ROUNDS:
            # the leader is the member with the smallest share of shingles of its own, which most others can link with
            share = (F.col("lead_own") / F.col("lead_n")).alias("o")
            turn = F.struct(share, F.xxhash64("lead", F.lit(k)).alias("h"), *as_lead.values())
            if k == 0:
                other = other.join(mixed, "bucket")
            if k >= 2:  # the best leader outside the first one's component
                taken = ws.keep(other.groupBy("bucket").agg(F.min(turn).alias("l")).select("bucket", F.col("l.lead_comp").alias("taken")), f"taken-{k}")
                other = other.join(taken, "bucket").filter("lead_comp <> taken")
            leads = ws.keep(other.groupBy("bucket").agg(F.min(turn).alias("l")).select("bucket", *[f"l.{c}" for c in as_lead.values()]), f"leads-{k}")
            near = can_link(shared_most, "n_shingles", "lead_n")
            if k:
                near = near & can_link(binned_most, "n_shingles", "lead_n")
            pairs = at.join(leads, "bucket").filter((F.col("comp") != F.col("lead_comp")) & near)
        else:
            rest = ws.keep(at.join(classes.select("node", "bands"), "node"), "rest")
            other = rest.select("bucket", F.col("bands").alias("lead_bands"), *[F.col(a).alias(b) for a, b in as_lead.items()])
            # cheap bounds first; a pair that shares several buckets comes up in the first of them alone
            first = F.array_min(F.array_intersect("bands", "lead_bands")) == F.col("bucket")
            near = can_link(shared_most, "n_shingles", "lead_n") & can_link(binned_most, "n_shingles", "lead_n")
            pairs = rest.join(other, "bucket").filter((F.col("comp") < F.col("lead_comp")) & near & first)
        pairs = pairs.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
        if tried:
            both = reduce(DataFrame.union, tried)
            pairs = pairs.join(both.union(both.select("b", "a")), ["a", "b"], "left_anti")
        pairs = ws.keep(pairs, f"pairs-{k}")
        if pairs.isEmpty():
            continue
        tried.append(pairs)
        found = confirmed(pairs, f"links-{k}")
        if found.isEmpty():
            continue
        links.append(found)
        comp = ws.keep(components(ws, reduce(DataFrame.union, links), f"cc-{k}"), f"comp-{k}")
    if comp is not None:
        ids = classes.select("node", "rep").join(comp, "node")
        least_ids = ws.keep(ids.groupBy("component").agg(F.min("rep").alias("least")), "least-ids")
        named = comp.join(least_ids, "component").select("node", "least")
        classes = ws.keep(classes.select(*same, "node", "rep").join(named, "node", "left").select(*same, F.coalesce("least", "rep").alias("rep")), "named")
    for name in ("shared", "inside", "wanted", "sets", "held", "profiles", "profiled", "rest", *[f"{n}-{k}" for k in range(ROUNDS + 1) for n in ("mixed", "at", "taken", "leads", "pairs", "links")]):
        ws.drop(name)
    of = feats.select(SLOT, ROW, "doc_id", *same).join(classes.select(*same, "rep"), same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("component_id")
    return of.select(SLOT, ROW, "doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents (doc_id, text)."""
    ws = Workspace(documents.sparkSession, "minhash")
    return judged(ws, addressed(ws, documents.select("doc_id", "text")), least).drop(SLOT, ROW)


def without_near_duplicates(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """documents with the same columns, without the rows that are not ``kept``; of rows that are alike in id and set, all stay."""
    ws = Workspace(documents.sparkSession, "minhash")
    rows = addressed(ws, documents)
    gone = shelve(ws, judged(ws, rows, least).filter("not kept").select(SLOT, ROW), "gone")
    return without(rows, gone)
