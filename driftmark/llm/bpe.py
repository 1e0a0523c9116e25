"""Byte-level BPE by a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its position; an inner node holds the least rank below it, so the
leftmost least pair is found from the root in logarithmic time.  A merge changes three leaves: the merged pair's own,
the dead neighbour's, and the previous live neighbour's.  Short pieces of text go through many trees at once, held as
the rows of numpy arrays; long ones through one tree of plain lists.  Both follow the same steps.

Texts are split by the tokenizer's pattern; a piece that is itself a token is that token; every other piece is merged
on its own.  Null texts count as empty.  Ids are unsigned 32-bit little-endian numbers.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from driftmark.llm.textbatch import Memo, pieces, small_batches

NONE = np.int64(1) << 40
#: Bytes up to which a piece goes through the row-wise trees, and how many pieces at once.
SHORT, ROWS = 64, 10_000
#: Pieces in each generation of a worker's memo, some 200 bytes each.
PIECES_KNOWN = 100_000
_ENCODERS: dict[str, Encoder] = {}


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """A file of lines 'base64 rank'."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.single = np.full(256, -1, dtype=np.int64)
        self.pairs: dict[int, int] = {}
        for t, i in ranks.items():
            if len(t) == 1:
                self.single[t[0]] = i
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = i
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.memo = Memo(self._learn, PIECES_KNOWN)

    # one tree

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece, by one tree."""
        ids = self.single[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n = len(ids)
        size = 1 << max(1, (n - 1).bit_length())
        none, pairs = int(NONE), self.pairs
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = pairs.get(ids[i] << 20 | ids[i + 1], none)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, rank: int) -> None:
            k = size + at
            tree[k] = rank
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] < none:
            k, low = 1, tree[1]
            while k < size:
                k = 2 * k if tree[2 * k] == low else 2 * k + 1
            at = k - size
            dead, prev = after[at], before[at]
            ids[at] = low
            nxt = after[at] = after[dead]
            ids[dead] = -1
            put(dead, none)
            if nxt < n:
                before[nxt] = at
                put(at, pairs.get(low << 20 | ids[nxt], none))
            else:
                put(at, none)
            if prev >= 0:
                put(prev, pairs.get(ids[prev] << 20 | low, none))
        return [i for i in ids if i >= 0]

    # many trees

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def merge_rows(self, raws: list[bytes], width: int) -> list[bytes]:
        """Packed ids of each piece of at most ``width`` bytes (a power of two), by one tree a row."""
        n = len(raws)
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), dtype=np.uint8).reshape(n, width)
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        ids[:, :width] = np.where(np.arange(width) < lengths[:, None], self.single[flat], -1)
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        tree[:, width:] = self._rank(ids[:, :-1], ids[:, 1:])
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        after = np.minimum(np.arange(1, width + 2), width) + np.zeros((n, 1), dtype=np.int64)
        before = np.maximum(np.arange(-1, width), -1) + np.zeros((n, 1), dtype=np.int64)

        def put(row: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            k = at + width
            tree[row, k] = rank
            while k[0] > 1:
                k = k >> 1
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            low, k = tree[row, 1], np.ones(len(row), dtype=np.int64)
            while k[0] < width:
                k = 2 * k
                k = k + (tree[row, k] != low)
            at = k - width
            dead, prev = after[row, at], before[row, at]
            nxt = after[row, dead]
            ids[row, at] = low
            ids[row, dead] = -1
            after[row, at] = nxt
            before[row, nxt] = at  # position ``width`` is a stop with id -1
            put(row, dead, np.full(len(row), NONE))
            put(row, at, self._rank(low, np.where(nxt < width, ids[row, nxt], -1)))
            has = prev >= 0
            put_row, put_at = row[has], prev[has]
            if len(put_row):
                put(put_row, put_at, self._rank(ids[put_row, put_at], low[has]))
            row = row[tree[row, 1] < NONE]
        live = ids[:, :width] >= 0
        packed, ends = ids[:, :width][live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    # texts

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode("utf-8", "replace")
            own = self.ranks.get(raw)
            if own is not None:
                out[p] = np.array([own], dtype="<u4").tobytes()
            elif len(raw) <= SHORT:
                groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
            else:
                out[p] = np.array(self.merge(raw), dtype="<u4").tobytes()
        for width, group in groups.items():
            for i in range(0, len(group), ROWS):
                part = group[i : i + ROWS]
                out.update(zip([p for p, _ in part], self.merge_rows([r for _, r in part], width), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.pattern.findall(t) for t in texts]
        get = self.memo.known(set().union(*split)).__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, packed: bytes) -> bytes:
        return decode(self.bytes_of, packed)


def decode(bytes_of: dict[int, bytes], packed: bytes) -> bytes:
    """The bytes of packed ids; it needs none of an encoder's tables but this one."""
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def encoder(raw: bytes, pattern: str) -> Encoder:
    """The worker's encoder for this rank file; built once a process."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(parse_ranks(raw), pattern)
    return _ENCODERS[key]


def encode_column(spark: SparkSession, path: str, pattern: str, text: str = "text") -> Column:
    """The packed ids of each whole text.  The rank file (read on the driver, under 1 MB) is broadcast."""
    small_batches(spark)
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast((f.read(), pattern))

    @F.pandas_udf("binary")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(*sent.value)
        for part in parts:
            yield pd.Series([x for _, run in pieces(part) for x in own.encode(run)], dtype=object)

    return encode(F.col(text))


def decode_column(spark: SparkSession, path: str, pattern: str, ids: str = "ids") -> Column:
    """The bytes that packed ids stand for; null ids give null."""
    small_batches(spark)
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = {i: t for t, i in parse_ranks(sent.value).items()}
        for part in parts:
            yield pd.Series([None if x is None else decode(bytes_of, x) for x in part], dtype=object)

    return decoded(F.col(ids))


def round_trip_column(spark: SparkSession, path: str, pattern: str, text: str = "text") -> Column:
    """The packed ids of each whole text and the bytes they stand for, by one Python worker a task where the two columns above take two."""
    small_batches(spark)
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast((f.read(), pattern))

    @F.pandas_udf("ids binary, back binary")
    def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(*sent.value)
        for part in parts:
            ids = [x for _, run in pieces(part) for x in own.encode(run)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "back": pd.Series([own.decode(x) for x in ids], dtype=object)})

    return both(F.col(text))
