"""Cutting Arrow batches of texts into pieces of bounded size, so memory doesn't follow the batch's row count."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import SparkSession

#: Characters a piece holds at most, unless a single text is longer.
PIECE_CHARS = 250_000
#: Rows of an Arrow batch: with texts, Spark's 10,000 would hold too much in a Python worker.
BATCH_ROWS = 500
#: Entries in each of a memo's two generations.
REMEMBERED = 200_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most in this session from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Memo:
    """Results by piece of text, of bounded size: what was not asked for during a whole generation is forgotten."""

    def __init__(self, learn: Callable[[list[str]], dict[str, bytes]], size: int = REMEMBERED):
        self.learn, self.size, self.young, self.old = learn, size, {}, {}

    def known(self, seen: set[str]) -> dict[str, bytes]:
        """A mapping that has every piece of ``seen``."""
        new = seen - self.young.keys()
        if len(self.young) + len(new) > self.size:
            self.old, self.young, new = self.young, {}, seen
        again = new & self.old.keys()
        self.young.update({p: self.old[p] for p in again})
        self.young.update(self.learn(list(new - again)))
        return self.young


def pieces(texts: Sequence[str | None], most: int = PIECE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts with null as empty) of consecutive runs of about ``most`` characters."""
    start, held, total = 0, [], 0
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if held and total + len(t) > most:
            yield start, held
            start, held, total = i, [], 0
        held.append(t)
        total += len(t)
    if held:
        yield start, held
