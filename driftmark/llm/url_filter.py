"""URL rules by a bit-parallel wildcard automaton.

All glob patterns lie one after another in multiword bit masks.  Bit j of a pattern says that its first j characters
fit what has been read; a step shifts every pattern at once (Shift-And) and lets a star's bit stay.  Whole batches of
URLs are simulated together, one column of bytes at a time, on their canonical form: a dot, the host, a zero byte, the
path.  A star in a host pattern doesn't cross the zero byte.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: what follows, up to
``?``, ``#`` or the end.  Null urls and urls without ``://`` have an empty host and path, fit no rule, and are allowed.
Of the rules that fit, the longest decides; without one, the block patterns do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the query, (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs on host and path that block where no rule decides; a starting list, ``read_globs`` reads longer ones.
BLOCK_GLOBS = (("*casino*", "*"), ("*free-bets*", "*"), ("*poker*", "*"), ("*xxx*", "*"), ("*porn*", "*"), ("*malware*", "*"), ("*phish*", "*"), ("*cheap-pills*", "*"), ("*torrent*", "*"), ("*", "*/phishing/*"), ("*", "*.exe"))
#: Bytes of URLs that are simulated together.
CELLS = 4_000_000
SPLIT = 0


@dataclass(frozen=True)
class Automaton:
    """step: for each byte, the bits it may enter; stay: those where a star holds it; first, last: each pattern's ends."""

    step: np.ndarray
    stay: np.ndarray
    first: np.ndarray
    last: tuple[int, ...]

    def run(self, raws: list[bytes]) -> np.ndarray:
        """A boolean row for each URL with a column for each pattern."""
        out = np.zeros((len(raws), len(self.last)), dtype=bool)
        order = sorted(range(len(raws)), key=lambda i: -len(raws[i]))
        at = 0
        while at < len(order):
            width = max(1, len(raws[order[at]]))
            rows = order[at : at + max(1, CELLS // width)]
            out[rows] = self._batch([raws[i] for i in rows], width)
            at += len(rows)
        return out

    def _batch(self, raws: list[bytes], width: int) -> np.ndarray:
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        grid = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), dtype=np.uint8).reshape(len(raws), width)
        state = np.repeat(self.first[None, :], len(raws), axis=0)
        alive = np.searchsorted(-lengths, -np.arange(width), side="left")  # rows that are longer than k come first
        for k in range(width):
            n = int(alive[k])
            if not n:
                break
            c, d = grid[:n, k], state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (d & self.stay[c])
        bits = np.array(self.last)
        return (state[:, bits // 64] >> (bits % 64).astype(np.uint64)) & np.uint64(1) > 0


def compile_globs(globs: list[tuple[str, str]]) -> Automaton:
    """Globs of (host, path); ``*`` is any run and ``?`` any one byte, in a host neither the end of the host."""
    total = sum(len([c for c in (h + p).encode() if c != ord("*")]) + 2 for h, p in globs)
    words = -(-total // 64)
    step, stay, first = (np.zeros((256, words), dtype=np.uint64), np.zeros((256, words), dtype=np.uint64), np.zeros(words, dtype=np.uint64))
    last, at = [], 0
    for host, path in globs:
        first[at // 64] |= np.uint64(1) << np.uint64(at % 64)
        for part, c in [(0, c) for c in host.encode()] + [(2, SPLIT)] + [(1, c) for c in path.encode()]:
            if part < 2 and c == ord("*"):
                for b in range(256):
                    if part or b != SPLIT:
                        stay[b, at // 64] |= np.uint64(1) << np.uint64(at % 64)
                continue
            at += 1
            for b in [x for x in range(256) if part or x != SPLIT] if part < 2 and c == ord("?") else [c]:
                step[b, at // 64] |= np.uint64(1) << np.uint64(at % 64)
        last.append(at)
        at += 1
    return Automaton(step, stay, first, tuple(last))


def rule_glob(rule: str) -> tuple[str, str]:
    """A rule ``host/path`` fits its host and all subdomains where the path starts with its path."""
    host, _, path = rule.partition("/")
    return f"*.{host}", f"/{path}*"


def read_globs(path: str) -> tuple[tuple[str, str], ...]:
    """Globs of (host, path) from a text file, one a line with white space between; ``#`` starts a comment, no path is any."""
    with open(path, encoding="utf-8") as f:
        parts = [line.split("#")[0].split() for line in f]
    return tuple((p[0], p[1] if len(p) > 1 else "*") for p in parts if p)


def host_column(url: str = "url") -> Column:
    raw = F.coalesce(F.regexp_extract(F.col(url), r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, globs: tuple[tuple[str, str], ...] = BLOCK_GLOBS) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for every row of pages (page_id, url); only those columns are read."""
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    automaton = compile_globs([rule_glob(r) for _, r in ranked] + [(f"*{h}" if not h.startswith("*") else h, p) for h, p in globs])
    names, verdicts = [r for _, r in ranked] + [None] * len(globs), [v for v, _ in ranked] + ["block"] * len(globs)
    patterns = [None] * len(ranked) + [f"{h}/{p}" for h, p in globs]

    @F.pandas_udf("rule string, verdict string, pattern string")
    def verdict(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            fits = automaton.run([b"." + h.encode("utf-8", "replace") + b"\0" + p.encode("utf-8", "replace") for h, p in zip(hosts, paths, strict=True)])
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1).tolist()
            yield pd.DataFrame({"rule": [names[k] if k >= 0 else None for k in best], "verdict": [verdicts[k] if k >= 0 else "allow" for k in best], "pattern": [patterns[k] if k >= 0 else None for k in best]}, dtype=object)

    canonical = pages.select("page_id", host_column().alias("host"), path_column().alias("path"))
    return canonical.withColumn("v", verdict("host", "path")).select("page_id", "host", "path", "v.rule", "v.verdict", "v.pattern")
