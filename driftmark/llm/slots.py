"""Rows of files by address, so that a later pass over the files looks something up for each row without a shuffle of texts.

A row's address is its slot, a run of SLOT_ROWS rows of one file, and its number in the slot; both come from the
Parquet reader, so they are the same in every pass however the files are split into tasks.  A shelf is a table by slot
in the shared folder.  A task that meets a slot's rows reads that slot's part of the shelf itself: one shelf file at a
time, of which row groups of other slots are skipped.  Files go through ``pyarrow.fs``.  Memory is one slot's part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Workspace

SLOT_ROWS = 16_384
#: The address's columns.
SLOT, ROW = "__slot", "__row"
#: Bytes of a shelf's row groups, so that a slot can be read without the others.
GROUP_BYTES = 4 << 20
_PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _fixed(df: DataFrame) -> bool:
    """Whether df is a deterministic selection and projection of Parquet files, whose rows keep their places."""
    if "_metadata" in df.columns:
        return False
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    rest = [plan]
    while rest:
        node = rest.pop()
        if node.nodeName() not in _PLAIN:
            return False
        children = node.children()
        rest += [children.apply(k) for k in range(children.size())]
    try:
        df.select("_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def addressed(ws: Workspace, df: DataFrame, name: str = "rows") -> DataFrame:
    """df with SLOT and ROW; written first where its rows have no fixed places in files."""
    if not _fixed(df):
        names = df.columns
        df = ws.keep(df.withColumnRenamed("_metadata", "__metadata"), name)
        if "_metadata" in names:
            return _numbered(df).withColumnRenamed("__metadata", "_metadata")
    return _numbered(df)


def _numbered(df: DataFrame) -> DataFrame:
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    slot = F.xxhash64(file, F.floor(at / SLOT_ROWS).cast("long"))
    return df.select("*", slot.alias(SLOT), (at % SLOT_ROWS).cast("int").alias(ROW))


@dataclass
class Shelf:
    """A table by slot, read slot by slot in tasks."""

    root: str
    parts: int
    _last: tuple = field(default=(None, None), repr=False)

    def of(self, slot: int) -> pa.Table | None:
        """The rows of a slot, in order of ROW where they have one; None where there are none."""
        if self._last[0] != slot:
            fs, base = filesystem(self.root)
            at = f"{base}/shelf={slot % self.parts}"
            table = None
            if fs.get_file_info(at).type != pafs.FileType.NotFound:
                table = ds.dataset(at, filesystem=fs, format="parquet").to_table(filter=ds.field(SLOT) == slot)
                if not table.num_rows:
                    table = None
                elif ROW in table.column_names:
                    table = table.take(pc.sort_indices(table, sort_keys=[(ROW, "ascending")]))
            self._last = (slot, table)
        return self._last[1]

    def __getstate__(self) -> dict:
        return {"root": self.root, "parts": self.parts, "_last": (None, None)}


def shelve(ws: Workspace, df: DataFrame, name: str, clustered: bool = False) -> Shelf:
    """Write df, which has SLOT, as a shelf; ``clustered`` says that its tasks hold few slots each, so it needs no shuffle."""
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("shelf", F.pmod(F.col(SLOT), F.lit(parts)))
    if not clustered:
        df = df.repartition(parts, "shelf").sortWithinPartitions("shelf", SLOT)
    df.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("shelf").parquet(ws.path(name))
    return Shelf(ws.path(name), parts)


def runs(slots: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slot, start, stop) of runs of one slot."""
    if len(slots):
        cut = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
        yield from ((int(slots[a]), a, b) for a, b in zip(cut, cut[1:], strict=False))


def _matched(shelf: Shelf, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Table, np.ndarray]]:
    """(rows, the shelf's rows of their slot, for each row its place among them or -1)."""
    for slot, a, b in runs(batch.column(SLOT).to_numpy()):
        own, there = batch.slice(a, b - a), shelf.of(slot)
        rows = own.column(ROW).to_numpy()
        if there is None:
            yield own, None, np.full(len(rows), -1)
            continue
        held = there.column(ROW).to_numpy()
        at = np.searchsorted(held, rows)
        at[at == len(held)] = 0
        yield own, there, np.where(held[at] == rows, at, -1)


def without(df: DataFrame, shelf: Shelf) -> DataFrame:
    """df, which has SLOT and ROW, without the rows whose address is on the shelf, and without the address."""
    out = df.drop(SLOT, ROW)
    names = out.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, _, at in _matched(shelf, batch):
                yield own.filter(pa.array(at < 0)).select(names)

    return df.select(*names, SLOT, ROW).mapInArrow(keep, out.schema)


def fetched(df: DataFrame, shelf: Shelf, make: Callable[[pa.RecordBatch, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``make`` makes of the rows of df that the shelf has, with the shelf's rows for them in the same order."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, there, at in _matched(shelf, batch):
                if there is not None and (at >= 0).any():
                    yield from make(own.filter(pa.array(at >= 0)), there.take(pa.array(at[at >= 0])))

    return df.mapInArrow(get, schema)
