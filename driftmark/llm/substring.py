"""Repeated passages by collinear chaining of shared k-mer seeds.

Seeds are all word k-mers.  Of MIN_WORDS words with every fifth substituted some KMER in a row are left, so a copy at
IDENTITY by substitutions shares seeds; one that mixes insertions and deletions as densely may not.  A seed that comes
again within RUN words is told apart by its number in that run, so a repeated line matches along its whole length.
Each place of a seed is matched with the seed's leader, its first place in the order of files and rows, rather than
with all its places: a passage that n documents hold costs n matches.  The leader's own document matches its further
places with the seed's place in the last document that has it.

A document's matches with one leader are chained in order, a Fenwick tree giving for each match the best chain that
ends before it in both texts, less a gap cost for the words skipped in either.  Chains whose seeds cover LEAST_COVER
words (a copy of MIN_WORDS at IDENTITY covers at least 10, however its differences lie) are aligned word by word: ends
are extended, gaps are aligned by their longest common subsequence, and a chain is cut where a gap doesn't align.
What aligns with IDENTITY or more is a fuzzy copy.  A document's copies that touch are merged, and passages of
MIN_WORDS words or more are returned, for the leaders too.

What this loses: a passage whose seeds have several leaders, as an earlier document holds a part of it, comes in pieces.
Up to three words at a joint may stay out, and a piece of under MIN_COPY words that its neighbours don't extend over
is dropped, which can leave less than MIN_WORDS of a passage that two documents do share.

At scale: no text is shuffled.  A first pass packs seeds in blocks by ranges of their hash (48 bits, as differences of
sorted ones), at most two places a seed and block, the first and the last row's, so that a seed of all documents sends
two a block.  Whoever gets a range finds leaders and answers each slot of rows (``slots``) once for each seed that
another row has.  The answers wait on a shelf for the second pass, which chains.  Leaders' words are asked for by
spans on a grid of GRID words, so their number is bounded by the leader's length, not by its followers.

Null and empty texts and texts of fewer than KMER words have no seeds.  Rows without doc_id are left out; rows that
repeat a doc_id are texts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Workspace
from driftmark.llm.minhash import mix64
from driftmark.llm.slots import ROW, SLOT, Shelf, addressed, fetched, shelve
from driftmark.llm.textbatch import small_batches

KMER, MIN_WORDS, IDENTITY = 4, 50, 0.8
#: Copies shorter than this are no part of a passage.
MIN_COPY = 20
#: Words skipped in either text cost GAP_COST each; a chain is cut where more than MAX_GAP are skipped.
GAP_COST, MAX_GAP = 0.1, 40
#: Words that a chain's seeds cover at least.
LEAST_COVER = 8
#: Words beyond a chain's ends that an extension may look at; copies this near are merged.
REACH, TOUCH = 24, 2
#: Equal seeds at most this far apart are one run.
RUN = 24
#: A gap of more words than this must align by half.
LOOSE = 8
#: A leader's spans start and stop on multiples of this.
GRID = 32
#: Seeds of a block at most, over all ranges; bytes of input that one range of hashes stands for.
PIECE_SEEDS, RANGE_BYTES = 400_000, 2 << 20


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all k-mers, a hash with the number of its seed in a run of equal ones."""
    n = len(words) - KMER + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    h = np.full(n, KMER, dtype=np.uint64)
    for k in range(KMER):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k])
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (np.diff(order) > RUN)])
    k = np.arange(n)
    h[order] += mix64((k - np.maximum.accumulate(np.where(new, k, 0))).astype(np.uint64))  # mix64 keeps 0
    return h.view(np.int64), np.arange(n, dtype=np.int32)


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length, byte by byte of their numbers, compressed."""
    head = np.array([len(columns), *[c.dtype.num for c in columns], len(columns[0])], dtype=np.int64).tobytes()
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint16, np.uint32, np.uint64, np.int64)}


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    *kinds, n = np.frombuffer(raw, np.int64, k + 1, 8).tolist()
    at, out = 8 * (k + 2), []
    for kind in kinds:
        size = _KINDS[kind].itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(_KINDS[kind]))
        at += n * size
    return out


def _steps(h: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, in four bytes each where they fit."""
    d = np.diff(h, prepend=np.uint64(0))
    return d.astype(np.uint32) if not len(d) or d.max() < 1 << 32 else d


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _blocks(ranges: int):
    """Makes rows (span, slot, payload) of texts: a slot's seeds by range of their hash, with the first and the last row's place."""

    def flush(slot: int, held: list) -> pd.DataFrame:
        h, row, pos = (np.concatenate([x[k] for x in held]) for k in range(3))
        held.clear()
        order = np.argsort(h, kind="stable")
        h, row, pos = h[order], row[order], pos[order]
        each = _first_of(h, row)  # a row's first place of a seed
        h, row, pos = h[each], row[each], pos[each]
        start = _first_of(h)
        last = np.append(start[1:], len(h)) - 1
        pick = np.unique(np.concatenate([start, last]))
        h, row, pos = h[pick], row[pick], pos[pick]
        bounds = [(k << 48) // ranges for k in range(1, ranges)]
        cut = [0, *np.searchsorted(h, np.array(bounds, dtype=np.uint64)).tolist(), len(h)]
        made = [(k, slot, pack(_steps(h[a:b]), row[a:b], pos[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
        return pd.DataFrame(made, columns=["span", SLOT, "payload"])

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, now = [], 0, None
        for part in parts:
            for slot, row, t in zip(part[SLOT], part[ROW], part["text"], strict=True):
                if held and (slot != now or count >= PIECE_SEEDS):
                    yield flush(now, held)
                    held, count = [], 0
                now = slot
                h, pos = seeds(word_hashes(t))
                if len(h):
                    held.append((h.view(np.uint64) >> np.uint64(16), np.full(len(h), row, np.uint16), pos.astype(np.uint32)))
                    count += len(h)
        if held:
            yield flush(now, held)

    return make


def _leaders(part: pd.DataFrame) -> pd.DataFrame:
    """For a range of hashes: to each slot its seeds that another row has, with their leaders' places.

    To the leader's slot also the place in the last row, for the leader's further places.
    """
    part = part.sort_values(SLOT)
    slots = np.unique(part[SLOT].to_numpy())
    held = []
    for slot, payload in zip(part[SLOT], part["payload"], strict=True):
        steps, row, pos = unpack(payload)
        held.append((np.cumsum(steps, dtype=np.uint64), np.full(len(row), np.searchsorted(slots, slot), np.uint32), row, pos))
    h, own, row, pos = (np.concatenate([x[k] for x in held]) for k in range(4))
    del held
    order = np.lexsort((pos, row, own, h))
    h, own, row, pos = h[order], own[order], row[order], pos[order]
    del order
    start = _first_of(h)
    size = np.diff(np.append(start, len(h)))
    last = start + size - 1
    shared = (own[start] != own[last]) | (row[start] != row[last])
    lead, end = np.repeat(start, size), np.repeat(last, size)
    pick = np.zeros(len(h), dtype=bool)
    pick[_first_of(h, own)] = True
    pick &= np.repeat(shared, size)
    at = np.flatnonzero(pick)
    at = at[np.argsort(own[at], kind="stable")]
    cut = [*_first_of(own[at]).tolist(), len(at)] if len(at) else []
    made = []
    for a, b in zip(cut, cut[1:], strict=False):
        x, y, z = at[a:b], lead[at[a:b]], end[at[a:b]]
        tells = own[y] == own[x]
        other = [np.where(tells, v[z] + np.uint32(1), 0).astype(np.uint32) for v in (own, row.astype(np.uint32), pos)]
        named, index = np.unique(np.concatenate([slots[own[y]], slots[own[z][tells]]]), return_inverse=True)
        lead_slot, last_slot = index[: b - a].astype(np.uint32), np.zeros(b - a, np.uint32)
        last_slot[tells] = index[b - a :] + 1
        payload = pack(_steps(h[x]), lead_slot, row[y], pos[y], last_slot, other[1], other[2])
        made.append((int(slots[own[x[0]]]), pack(named), payload))
    return pd.DataFrame(made, columns=[SLOT, "named", "payload"])


class Answers:
    """A slot's shared seeds in order of their hash: leaders' slots (as places in ``names``), rows and places, and where
    the leader is in the slot itself the same of the last row that has the seed."""

    def __init__(self, table: pa.Table):
        held = [(unpack(a)[0], unpack(b)) for a, b in zip(table.column("named").to_pylist(), table.column("payload").to_pylist(), strict=True)]
        held.sort(key=lambda x: int(x[1][0][0]))  # ranges of hashes follow each other
        self.names = np.unique(np.concatenate([n for n, _ in held]))
        sizes = np.cumsum([0, *(len(c[0]) for _, c in held)])
        n = int(sizes[-1])
        self.h, self.slot, self.row, self.pos = np.empty(n, np.uint64), np.empty(n, np.int32), np.empty(n, np.uint16), np.empty(n, np.uint32)
        far = []
        while held:
            names, (steps, slot, row, pos, last_slot, last_row, last_pos) = held.pop()
            a, b = sizes[len(held)], sizes[len(held) + 1]
            code = np.searchsorted(self.names, names).astype(np.int32)
            self.h[a:b], self.slot[a:b], self.row[a:b], self.pos[a:b] = np.cumsum(steps, dtype=np.uint64), code[slot], row, pos
            told = np.flatnonzero(last_slot)
            far.append((told + a, code[last_slot[told] - 1], last_row[told] - 1, last_pos[told] - 1))
        self.told, self.far_slot, self.far_row, self.far_pos = (np.concatenate([f[k] for f in reversed(far)]) for k in range(4))

    def matches(self, slot: int, row: int, h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        """(leader's slot's place in names, its row, its place, own place) of a row's seeds; not of the leader's own place."""
        k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[k] == h
        k, pos = k[hit], pos[hit].astype(np.int64)
        code = np.searchsorted(self.names, slot)
        own = (self.slot[k] == code) & (self.row[k] == row) if code < len(self.names) and self.names[code] == slot else np.zeros(len(k), bool)
        lead_slot, lead_row, at = self.slot[k].astype(np.int64), self.row[k].astype(np.int64), self.pos[k].astype(np.int64)
        good = ~own
        if own.any():
            other = np.flatnonzero(own & (pos != at))
            t = np.minimum(np.searchsorted(self.told, k[other]), len(self.told) - 1)
            other, t = other[self.told[t] == k[other]], t[self.told[t] == k[other]]
            lead_slot[other], lead_row[other], at[other] = self.far_slot[t], self.far_row[t], self.far_pos[t]
            good[other] = True
        return lead_slot[good], lead_row[good], at[good], pos[good]


def _thinned(lead: np.ndarray, pos: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of a run of seeds on one diagonal every KMER-th and the last: they cover the same words and score the same."""
    order = np.lexsort((pos, at - pos, lead))
    lead, pos, shift = lead[order], pos[order], (at - pos)[order]
    start = np.ones(len(pos), dtype=bool)
    start[1:] = (lead[1:] != lead[:-1]) | (shift[1:] != shift[:-1]) | (pos[1:] != pos[:-1] + 1)
    k = np.arange(len(pos))
    step = k - np.maximum.accumulate(np.where(start, k, 0))
    return np.sort(order[(step % KMER == 0) | np.append(start[1:], True)])


def _cover(a: list[int]) -> int:
    """Words that seeds at rising places cover."""
    return KMER + sum(min(KMER, y - x) for x, y in zip(a, a[1:], strict=False))


def chains(matches: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint chains of (place, leader's place), best first, each rising in both places."""
    matches = sorted(set(matches))
    ranks = {b: k + 1 for k, b in enumerate(sorted({b for _, b in matches}))}
    size = len(ranks)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)  # prefix maxima of score + gap term, with the match
    score, before = [0.0] * len(matches), [-1] * len(matches)
    i = 0
    while i < len(matches):
        j = i
        while j < len(matches) and matches[j][0] == matches[i][0]:  # matches at one place can't follow each other
            a, b = matches[j]
            best, k = (-1e18, -1), ranks[b] - 1
            while k > 0:
                best = max(best, tree[k])
                k -= k & -k
            gain = best[0] - GAP_COST * (a + b)
            if best[1] >= 0 and gain > 0:
                pa, pb = matches[best[1]]
                score[j], before[j] = gain + min(KMER, a - pa, b - pb), best[1]
            else:
                score[j] = KMER
            j += 1
        for m in range(i, j):
            a, b = matches[m]
            value, k = (score[m] + GAP_COST * (a + b), m), ranks[b]
            while k <= size:
                if value > tree[k]:
                    tree[k] = value
                k += k & -k
        i = j
    used, out = [False] * len(matches), []
    for end in sorted(range(len(matches)), key=lambda m: (-score[m], m)):
        chain, k = [], end
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(matches[k])
            k = before[k]
        chain.reverse()
        cut = [0, *[x for x in range(1, len(chain)) if max(chain[x][0] - chain[x - 1][0], chain[x][1] - chain[x - 1][1]) > MAX_GAP + KMER], len(chain)]
        out += [chain[x:y] for x, y in zip(cut, cut[1:], strict=False) if y > x]
    return out


def _chained(shelf: Shelf):
    """Makes the chains of texts, each with its own words and the leader's span on the grid."""

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known = None, None
        for part in parts:
            rows = []
            for slot, row, doc, t in zip(part[SLOT], part[ROW], part["doc"], part["text"], strict=True):
                if slot != now:
                    there, now = shelf.of(slot), slot
                    shelf._last, known = (None, None), None
                    known = None if there is None else Answers(there)
                    there = None
                if known is not None:
                    rows += [(slot, row, doc, *c) for c in _chains_of(slot, row, word_hashes(t), known)]
            yield pd.DataFrame(rows, columns=[SLOT, ROW, "doc", "lead_slot", "lead_row", "a", "b", "a0", "b0", "b1", "words"])

    return make


def _chains_of(slot: int, row: int, words: np.ndarray, known: Answers) -> Iterator[tuple]:
    h, pos = seeds(words)
    lead_slot, lead_row, at, pos = known.matches(slot, row, h.view(np.uint64) >> np.uint64(16), pos)
    if len(pos) < 2:
        return
    order = np.lexsort((pos, lead_row, lead_slot))
    lead_slot, lead_row, at, pos = lead_slot[order], lead_row[order], at[order], pos[order]
    start = _first_of(lead_slot, lead_row)
    lead = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pos))))
    leads = known.names[lead_slot[start]].tolist(), lead_row[start].tolist()
    # no chain covers more words than all seeds with one leader
    step = np.minimum(np.diff(pos, append=pos[-1]), KMER)
    step[np.append(start[1:], len(pos)) - 1] = KMER
    enough = np.add.reduceat(step, start)[lead] >= LEAST_COVER
    lead, at, pos = lead[enough], at[enough], pos[enough]
    if not len(pos):
        return
    pick = _thinned(lead, pos, at)
    lead, at, pos = lead[pick], at[pick], pos[pick]
    order = np.argsort(lead, kind="stable")
    cut = [*_first_of(lead[order]).tolist(), len(order)]
    short = words.astype(np.uint32)
    for x, y in zip(cut, cut[1:], strict=False):
        part = order[x:y]
        if len(part) == 1:
            continue
        for chain in chains(list(zip(pos[part].tolist(), at[part].tolist(), strict=True))):
            a, b = [p for p, _ in chain], [q for _, q in chain]
            if min(_cover(a), _cover(b)) < LEAST_COVER:
                continue
            a0, b0, b1 = max(0, a[0] - REACH), max(0, b[0] - REACH) // GRID * GRID, -(-(b[-1] + KMER + REACH) // GRID) * GRID
            places = [np.array([v[0], *map(int.__sub__, v[1:], v)], dtype=np.int32).tobytes() for v in (a, b)]
            i = int(lead[part[0]])
            yield leads[0][i], leads[1][i], *places, a0, b0, b1, short[a0 : a[-1] + KMER + REACH].tobytes()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for w in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == w)))
    return int(row[-1])


def _extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How far both go on alike from their starts, and how many words agree: +1 a match, -2 another, until 6 are lost."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    total = np.cumsum(np.where(same, 1, -2))
    stop = np.flatnonzero(np.maximum.accumulate(total) - total > 6)
    top = total[: stop[0]] if len(stop) else total
    k = int(top.argmax()) + 1 if len(top) and top.max() > 0 else 0
    return k, int(same[:k].sum())


def align(x: np.ndarray, y: np.ndarray, a: list[int], b: list[int]) -> list[tuple[int, int, int, int, float]]:
    """Pieces (start, stop, other start, other stop, identity) of a chain with places a in x and b in y."""
    pieces, i, j = [], a[0], b[0]
    back, agree = _extend(x[:i][::-1], y[:j][::-1])
    start, other, same = i - back, j - back, agree + KMER
    end, last = i + KMER, j + KMER
    for p, q in zip(a[1:], b[1:], strict=True):
        if p < end or q < last:  # seeds that overlap: on one diagonal they only add words
            step = min(p + KMER - end, q + KMER - last)
            if p - end == q - last and step > 0:
                same, end, last = same + step, end + step, last + step
            continue
        gap_x, gap_y = x[end:p], y[last:q]
        held = int((gap_x == gap_y).sum()) if len(gap_x) == len(gap_y) else 0
        if 2 * held < max(len(gap_x), len(gap_y)):
            held = max(held, _common(gap_x, gap_y))
        if max(len(gap_x), len(gap_y)) > LOOSE and 2 * held < max(len(gap_x), len(gap_y)):
            on, agree = _extend(gap_x, gap_y)
            pieces.append((start, end + on, other, last + on, same + agree))
            back, agree = _extend(gap_x[on:][::-1], gap_y[on:][::-1])
            start, other, same = p - back, q - back, agree + KMER
        else:
            same += held + KMER
        end, last = p + KMER, q + KMER
    on, agree = _extend(x[end:], y[last:])
    pieces.append((start, end + on, other, last + on, same + agree))
    return [(s, e, o, f, n / max(e - s, f - o)) for s, e, o, f, n in pieces]


def _spans(own: pa.RecordBatch, there: pa.Table) -> Iterator[pa.RecordBatch]:
    """The words of the spans that the shelf asks of rows (doc, text, address)."""
    for k in range(own.num_rows):
        words = word_hashes(own.column("text")[k].as_py()).astype(np.uint32)
        asked = there.column("spans")[k].as_py()
        cols = [pa.array([v] * len(asked), pa.int64()) for v in (own.column(SLOT)[k].as_py(), own.column(ROW)[k].as_py(), own.column("doc")[k].as_py())]
        ends = [pa.array([s[n] for s in asked], pa.int32()) for n in ("b0", "b1")]
        cut = pa.array([words[s["b0"] : s["b1"]].tobytes() for s in asked], pa.binary())
        yield pa.record_batch([*cols, *ends, cut], names=["lead_slot", "lead_row", "other", "b0", "b1", "lead_words"])


def _aligned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for r in part.itertuples(index=False):
            x, y = np.frombuffer(r.words, dtype=np.uint32), np.frombuffer(r.lead_words, dtype=np.uint32)
            a, b = (np.cumsum(np.frombuffer(v, dtype=np.int32)) for v in (r.a, r.b))
            for s, e, o, f, share in align(x, y, (a - r.a0).tolist(), (b - r.b0).tolist()):
                if min(e - s, f - o) >= MIN_COPY and share >= IDENTITY:
                    rows.append((r.slot, r.row, r.doc, s + r.a0, e + r.a0, r.lead_slot, r.lead_row, r.other, o + r.b0, f + r.b0, share))
        yield pd.DataFrame(rows, columns=_COPY)


_COPY = ["slot", "row", "doc", "start", "stop", "lead_slot", "lead_row", "other", "other_start", "other_stop", "identity"]


def _merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for doc, copies in zip(part["doc"], part["copies"], strict=True):
            run: list = []
            for c in [*sorted(copies, key=lambda c: (c["start"], c["stop"], c["other"], c["other_start"])), None]:
                if run and (c is None or c["start"] > stop + TOUCH):  # noqa: F821
                    if stop - run[0]["start"] >= MIN_WORDS:  # noqa: F821
                        best = min(run, key=lambda c: (c["start"] - c["stop"], c["other"], c["other_start"]))
                        rows.append((doc, run[0]["start"], stop, stop - run[0]["start"], best["other"], best["other_start"], best["other_stop"], best["identity"]))  # noqa: F821
                    run = []
                if c is not None:
                    stop = max(stop, c["stop"]) if run else c["stop"]  # noqa: F821
                    run.append(c)
        yield pd.DataFrame(rows, columns=["doc_id", "start_word", "end_word", "n_words", "match_doc_id", "match_start", "match_end", "identity"])


def passages(documents: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, match_doc_id, match_start, match_end, identity) of each repeated passage."""
    spark = documents.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "substring")
    named = documents.select(F.col("doc_id").cast("long").alias("doc"), "text").filter("doc_id is not null and text is not null")
    docs = addressed(ws, named)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = max(16, -(-size // RANGE_BYTES))
    packed = docs.select("text", SLOT, ROW).mapInPandas(_blocks(ranges), f"span int, {SLOT} long, payload binary")
    answers = packed.groupBy("span").applyInPandas(_leaders, f"{SLOT} long, named binary, payload binary")
    shelf = shelve(ws, answers, "answers")
    kinds = f"{SLOT} long, {ROW} int, doc long, lead_slot long, lead_row int, a binary, b binary, a0 int, b0 int, b1 int, words binary"
    chained = ws.keep(docs.mapInPandas(_chained(shelf), kinds), "chains")
    ws.drop("answers")

    asked = chained.select(F.col("lead_slot").alias(SLOT), F.col("lead_row").alias(ROW), "b0", "b1").distinct()
    asked = asked.groupBy(SLOT, ROW).agg(F.collect_list(F.struct("b0", "b1")).alias("spans"))
    kinds = "lead_slot long, lead_row long, other long, b0 int, b1 int, lead_words binary"
    spans = ws.keep(fetched(docs, shelve(ws, asked, "asked"), _spans, kinds), "spans")
    both = chained.withColumnsRenamed({SLOT: "slot", ROW: "row"}).join(spans, ["lead_slot", "lead_row", "b0", "b1"])
    kinds = "slot long, row int, doc long, start int, stop int, lead_slot long, lead_row int, other long, other_start int, other_stop int, identity double"
    copies = ws.keep(both.mapInPandas(_aligned, kinds), "copies")
    for name in ("chains", "asked", "spans"):
        ws.drop(name)
    # a leader's span that many copies share comes once, with the smallest of their ids
    turned = F.struct(F.col("doc").alias("other"), F.col("start").alias("other_start"), F.col("stop").alias("other_stop"), "identity")
    lead = [F.col("lead_slot").alias("slot"), F.col("lead_row").alias("row"), F.col("other").alias("doc"), F.col("other_start").alias("start"), F.col("other_stop").alias("stop")]
    back = copies.groupBy(*lead).agg(F.min(turned).alias("x")).select("slot", "row", "doc", "start", "stop", "x.*")
    whole = copies.select(*back.columns).union(back).groupBy("slot", "row", "doc")
    each = whole.agg(F.collect_list(F.struct("start", "stop", "other", "other_start", "other_stop", "identity")).alias("copies"))
    out = "doc_id long, start_word int, end_word int, n_words int, match_doc_id long, match_start int, match_end int, identity double"
    return each.select("doc", "copies").mapInPandas(_merged, out)
