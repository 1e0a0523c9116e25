"""Benchmark decontamination: a BM25 index of test items, searched by every training passage with block-max WAND.

A passage is a window of words twice as long as the longest item, moved by that length, so every copy of an item lies
whole in some window.  Scores are BM25 with the item as the document, divided by the item's score against itself, so 1
is a passage with all of the item's words.  Every (passage, item) with a score of THRESHOLD or more is retrieved, and
is a leak if COVER of the word 5-shingles of the item's question and of its answer stand in the passage.

Before the search a bound drops what can't reach the threshold: an item's commonest words have at most REST of its
weight together, so a passage without the rest of the threshold among the item's other words is out.  The bound is
exact; nothing above the threshold is lost.

The index is of the test items, not of the corpus.  It is cut into blocks of BLOCK_ITEMS items and BLOCK_CHARS
characters, each broadcast on its own and searched in a pass of its own; document frequencies are of all items.

The question is the item's text up to its last ``?``, or else all sentences but the last; the answer is what is left,
and with a single sentence both are the whole.  Null or empty texts and items hold no words and match nothing.
Rows that repeat a doc_id are searched each on its own, and an item_id that comes twice is two items of that name, so
either may give equal pairs of ids more than once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm.textbatch import small_batches

THRESHOLD, COVER, SHINGLE = 0.6, 0.8, 5
#: Share of an item's weight that its commonest words, which the bound doesn't look up, may have together.
REST = 0.3
BLOCK_ITEMS, BLOCK_CHARS, POSTINGS_BLOCK = 4096, 4_000_000, 16
K1, B = 1.2, 0.75
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    mark = text.rstrip().rstrip("?").rfind("?") if text.rstrip().endswith("?") else text.rfind("?")
    if mark >= 0:
        q, a = words_of(text[: mark + 1]), words_of(text[mark + 1 :])
    else:
        parts = [p for p in map(words_of, re.split(r"[.!\n]+", text)) if p]
        q, a = [w for p in parts[:-1] for w in p], parts[-1] if parts else []
    return (q, a) if q and a else (q + a, q + a)


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Postings by term, sorted by item, in blocks with the greatest weight of each."""

    def __init__(self, items: list[tuple[int, str]], frequency: Counter, total: int, mean: float, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        split = [words_of(t) for _, t in items]
        self.parts = [tuple(map(shingles, question_and_answer(t or ""))) for _, t in items]
        self.span = max([8, *map(len, split)])
        self.terms: dict[str, int] = {}
        rows: list[list[tuple[int, float]]] = []
        essential: list[list[tuple[int, float]]] = []
        self.rest = np.zeros(len(items))
        for k, words in enumerate(split):
            norm = K1 * (1 - B + B * len(words) / mean) if mean else K1
            w = {t: math.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in Counter(words).items()}
            own, low = sum(w.values()), 0.0
            for t, x in sorted(w.items(), key=lambda y: (y[1], y[0])):
                x /= own
                term = self.terms.setdefault(t, len(self.terms))
                if term == len(rows):
                    rows.append([])
                    essential.append([])
                rows[term].append((k, x))
                if low + x < REST:
                    low += x
                else:
                    essential[term].append((k, x))
            self.rest[k] = low
        self.items = [[k for k, _ in r] for r in rows]
        self.weights = [[x for _, x in r] for r in rows]
        self.tops = [max(x) for x in self.weights]
        self.block_tops = [[max(x[i : i + POSTINGS_BLOCK]) for i in range(0, len(x), POSTINGS_BLOCK)] for x in self.weights]
        self.ends = np.cumsum([0, *map(len, essential)])
        self.essential_items = np.array([k for r in essential for k, _ in r], dtype=np.int64)
        self.essential_weights = np.array([x for r in essential for _, x in r])
        self.is_essential = np.array([bool(r) for r in essential], dtype=bool)

    def possible(self, terms: np.ndarray) -> np.ndarray:
        """Items that may reach the threshold with these distinct terms; it never misses one."""
        hit = terms[self.is_essential[terms]]
        if not len(hit):
            return hit
        at = np.concatenate([np.arange(a, b) for a, b in zip(self.ends[hit], self.ends[hit + 1], strict=True)])
        items, where = np.unique(self.essential_items[at], return_inverse=True)
        weight = np.bincount(where, weights=self.essential_weights[at])
        return items[weight + self.rest[items] >= self.threshold - 1e-9]

    def search(self, terms: list[int], first: int, last: int) -> list[tuple[int, float]]:
        """Block-max WAND: all items from first to last whose score reaches the threshold, with it."""
        out, need = [], self.threshold - 1e-9
        cursors = []  # [item, place, term]
        for t in terms:
            at = bisect_left(self.items[t], first)
            if at < len(self.items[t]):
                cursors.append([self.items[t][at], at, t])

        def move(c: list, item: int) -> bool:
            at = bisect_left(self.items[c[2]], item, c[1])
            if at == len(self.items[c[2]]):
                return False
            c[0], c[1] = self.items[c[2]][at], at
            return True

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.tops[c[2]]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0 or cursors[pivot][0] > last:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks that hold the pivot item
            bound, edge = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else last + 1
            for c in cursors[: pivot + 1]:
                own = self.items[c[2]]
                at = bisect_left(own, item, c[1])
                if at < len(own):
                    block = at // POSTINGS_BLOCK
                    bound += self.block_tops[c[2]][block]
                    edge = min(edge, own[min(len(own), (block + 1) * POSTINGS_BLOCK) - 1] + 1)
            if bound < need:
                cursors = [c for k, c in enumerate(cursors) if k > pivot or move(c, max(edge, item + 1))]
                continue
            if cursors[0][0] < item:
                cursors = [c for c in cursors if c[0] >= item or move(c, item)]
                continue
            score = sum(self.weights[c[2]][c[1]] for c in cursors[: pivot + 1])
            if score >= need:
                out.append((item, min(1.0, score)))
            cursors = [c for k, c in enumerate(cursors) if k > pivot or move(c, item + 1)]
        return out

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question_overlap, answer_overlap) of each item that the text holds, by its best passage."""
        words = words_of(text)
        get = self.terms.get
        terms = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = np.unique(terms)
        if not len(self.possible(known[known >= 0])):
            return []
        best: dict[int, tuple[float, float, float]] = {}
        for a in range(0, max(1, len(words) - self.span), self.span):
            window = np.unique(terms[a : a + 2 * self.span])
            window = window[window >= 0]
            items = self.possible(window)
            if not len(items):
                continue
            own = None
            for k, score in self.search(window.tolist(), int(items[0]), int(items[-1])):
                passage = words[a : a + 2 * self.span]
                if own is None:
                    own = {SHINGLE: shingles(passage)}
                q, answer = (self._share(p, passage, own) for p in self.parts[k])
                if q >= COVER and answer >= COVER and (k not in best or score > best[k][0]):
                    best[k] = (score, q, answer)
        return [(self.ids[k], *v) for k, v in sorted(best.items())]

    @staticmethod
    def _share(part: set[tuple[str, ...]], passage: list[str], own: dict[int, set]) -> float:
        if not part:
            return 0.0
        n = len(next(iter(part)))
        if n not in own:
            own[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
        return len(part & own[n]) / len(part)


def blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], Counter, int, float]]:
    """The items with words, a block at a time, with the statistics of all items.  Two passes, one block in memory."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").orderBy("item_id", "text")
    frequency, total, length = Counter(), 0, 0
    for r in items.toLocalIterator():
        words = words_of(r["text"])
        if words:
            frequency.update(set(words))
            total, length = total + 1, length + len(words)
    held, chars = [], 0
    for r in items.toLocalIterator():
        if not words_of(r["text"]):
            continue
        if held and (len(held) >= BLOCK_ITEMS or chars + len(r["text"]) > BLOCK_CHARS):
            yield held, frequency, total, length / total
            held, chars = [], 0
        held.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if held:
        yield held, frequency, total, length / total


_TYPE = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def _searcher(sent):
    @F.pandas_udf(_TYPE)
    def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = sent.value
        for part in parts:
            yield pd.Series([[dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), x, strict=True)) for x in index.leaks(t)] for t in part], dtype=object)

    return leaks


def leaks_column(spark: SparkSession, benchmark: DataFrame, text: str = "text") -> Column:
    """The leaks of each whole text, as an array; one Python pass a block of items."""
    small_batches(spark)
    columns = []
    for items, frequency, total, mean in blocks(benchmark):
        columns.append(_searcher(spark.sparkContext.broadcast(Index(items, frequency, total, mean)))(F.col(text)))
    return reduce(lambda a, b: F.concat(a, b), columns) if columns else F.array().cast(_TYPE)


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each leak; clean documents have no row."""
    found = documents.select("doc_id", leaks_column(documents.sparkSession, benchmark).alias("leaks"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
