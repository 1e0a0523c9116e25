"""Token-id files with fixed-width bit packing.

A file holds the ids of consecutive documents, each in the least bits that the vocabulary needs, in blocks of BLOCK
ids, every block starting on a byte.  The footer has each document's id and first position and each block's offset, so
a reader unpacks any range with numpy and touches only the blocks that hold it.

Layout, little-endian: magic, blocks, footer (bits, ids, documents and blocks as int64; a byte a document that is 1
where the document has an id; document ids; starts, one more than documents; block offsets, one more than blocks),
the footer's length as int64, magic.

A dataset is one file for each range of document ids.  Files are written under a name of the task's own and then
renamed, so a task that is run again or twice leaves one whole file.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Workspace
from driftmark.llm.slots import filesystem
from driftmark.llm.textbatch import Memo, pieces, small_batches

MAGIC, BLOCK = b"PKIDS001", 1 << 16
#: Words in each generation of a worker's memo, some 200 bytes each.
WORDS_KNOWN = 400_000
#: Characters whose words are looked up at once.
WORD_PIECE = 1_000_000
#: Ids a reader unpacks at once.
READ_IDS = 1 << 22
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: A sign between a letter and white space is a pre-token of its own.
_SIGN = re.compile(r"(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,;:!?])(?=[ \n])")
#: Words of Latin letters, digits and ASCII signs, for which lower case and composition change no class; no ``<`` or apostrophe.
_LATIN = re.compile(r"[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0139-\u0148\u014a-\u017e]+")
_ENCODERS: dict[str, WordEncoder] = {}


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another in ``bits`` bits each, low bits first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=count).astype("<u4")
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class PackedWriter:
    """Writes one file; memory is one block and the index."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.rest, self.starts, self.ids, self.offsets, self.has = out, bits, np.empty(0, "<u4"), [0], [], [len(MAGIC)], bytearray()
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.has.append(doc_id is not None)
        self.ids.append(doc_id or 0)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        while len(self.rest) >= BLOCK:
            self._block(self.rest[:BLOCK])
            self.rest = self.rest[BLOCK:]

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.out.write(raw)
        self.offsets.append(self.offsets[-1] + len(raw))

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        foot = struct.pack("<4q", self.bits, self.starts[-1], len(self.ids), len(self.offsets) - 1) + bytes(self.has)
        foot += b"".join(np.array(x, dtype="<i8").tobytes() for x in (self.ids, self.starts, self.offsets))
        self.out.write(foot + struct.pack("<q", len(foot)) + MAGIC)


class PackedReader:
    """Random access to one file by position or by document."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a packed id file, or one that was not finished")
        (length,) = struct.unpack("<q", tail[:8])
        foot = file.read_at(length, size - 16 - length)
        self.bits, self.count, docs, n = struct.unpack("<4q", foot[:32])
        self.has = np.frombuffer(foot, dtype=np.uint8, count=docs, offset=32)
        at = 32 + docs
        self.doc_ids = np.frombuffer(foot, dtype="<i8", count=docs, offset=at)
        self.starts = np.frombuffer(foot, dtype="<i8", count=docs + 1, offset=at + 8 * docs)
        self.offsets = np.frombuffer(foot, dtype="<i8", count=n + 1, offset=at + 8 * docs + 8 * (docs + 1))

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids at positions start to stop, of which only the blocks that hold them are read."""
        if stop <= start:
            return np.empty(0, "<u4")
        a, b = start // BLOCK, (stop - 1) // BLOCK + 1
        raw = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        out = []
        for k in range(a, b):
            lo, hi = int(self.offsets[k] - self.offsets[a]), int(self.offsets[k + 1] - self.offsets[a])
            out.append(unpack(raw[lo:hi], self.bits, min(BLOCK, self.count - k * BLOCK)))
        return np.concatenate(out)[start - a * BLOCK : stop - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


class WordEncoder:
    """A tokenizer whose pre-tokens never cross white space, applied to each distinct word once.

    New words are encoded as one text, as a call a word costs more than its merges.  The last token of each pre-token
    carries the end-of-word mark, so counting pre-tokens tells the words' ids apart; where the counts disagree, or for
    words beyond Latin letters, each word is a call of its own.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_str(spec), Memo(self._learn, WORDS_KNOWN)
        vocabulary, model = self.tokenizer.get_vocab(with_added_tokens=True), json.loads(spec)
        self.size = max(vocabulary.values()) + 1
        mark = model["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.size, dtype=bool)
        if mark:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.pattern = regex.compile(_splitter(model)["pattern"]["Regex"])
        norm = model.get("normalizer") or {}
        self.lowers = any(n.get("type") == "Lowercase" for n in norm.get("normalizers", [norm]))
        self.parts_signs = self.pattern.findall("a.") == ["a", "."]
        self.special = [t["content"] for t in model.get("added_tokens", [])]

    def _each(self, words: list[str]) -> dict[str, bytes]:
        return dict(zip(words, (np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)), strict=True))

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        plain, odd, out = [], [], {}
        for w in new:
            (plain if _LATIN.fullmatch(w) else odd).append(w)
        for i in range(0, len(plain), 4000):
            words = plain[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids])
            counts = np.cumsum([1 if w.isalpha() else len(self.pattern.findall(w)) for w in words])
            if len(last) != counts[-1] or not len(last):
                odd += words
                continue
            packed, cuts = ids.tobytes(), (4 * (last[counts - 1] + 1)).tolist()
            out.update(zip(words, [packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        return out | (self._each(odd) if odd else {})

    def _words(self, text: str) -> list[str]:
        """Words that encode to the text's ids, as few distinct ones as the tokenizer's own normal form allows."""
        try:
            text.encode("latin-1")  # such text is composed already, and each of its letters has one lower-case letter
        except UnicodeEncodeError:
            return _SPACE.split(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or any(t in text for t in self.special):
            return _SPACE.split(text)
        if self.lowers:
            low = text.lower()
            if any(t in low for t in self.special):  # in other letters it is ordinary text
                return _SPACE.split(text)
            text = low
        return (_SIGN.sub(r" \1", text) if self.parts_signs else text).split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as add_special_tokens=False gives them."""
        split = [self._words(t) for t in texts]
        get = self.memo.known(set().union(*split)).__getitem__
        return [np.frombuffer(b"".join(map(get, s)), dtype="<u4") for s in split]


def _splitter(model: dict) -> dict:
    """The step of a tokenizer's pre-tokenizer that keeps pieces free of white space, or an empty one."""
    pre = model.get("pre_tokenizer") or {}
    return next((s for s in pre.get("pretokenizers", [pre]) if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and "Regex" in s.get("pattern", {})), {})


def word_encoder(spec: str) -> WordEncoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


@dataclass(frozen=True)
class PackedDataset:
    """Files in ascending order of document ids: (path, documents, ids)."""

    files: tuple[tuple[str, int, int], ...]


def write(documents: DataFrame, spec_path: str, end_id: int, folder: str) -> PackedDataset:
    """Encode every whole text of documents (doc_id, text), append end_id, and write files in ascending doc_id order.

    Null texts are empty and so hold end_id alone; rows without doc_id come first; rows that repeat a doc_id are
    ordered by their text.  One shuffle deals whole texts out by ranges of doc_id.  One row a file reaches the driver.
    """
    with open(spec_path, encoding="utf-8") as f:
        spec = f.read()
    if not _splitter(json.loads(spec)):
        raise ValueError("the tokenizer keeps white space; words cannot be encoded one by one")
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(spec)

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, shard = word_encoder(sent.value), TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        draft, final, end = f"{base}/.{shard:08d}-{uuid.uuid4().hex}", f"{base}/{shard:08d}.ids", np.array([end_id], dtype="<u4")
        n = 0
        with fs.open_output_stream(draft) as out:
            writer = PackedWriter(out, bits_for(max(own.size, end_id + 1)))
            for part in parts:
                for first, run in pieces(part["text"], WORD_PIECE):
                    for k, ids in enumerate(own.encode(run)):
                        d = part["doc_id"].iloc[first + k]
                        writer.add(None if pd.isna(d) else int(d), np.concatenate([ids, end]))
                        n += 1
            writer.close()
        if n:
            fs.move(draft, final)
            yield pd.DataFrame({"shard": [shard], "docs": [n], "ids": [writer.starts[-1]]})
        else:
            fs.delete_file(draft)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = sorted(rows.mapInPandas(put, "shard int, docs long, ids long").collect())
    return PackedDataset(tuple((f"{folder}/{r['shard']:08d}.ids", r["docs"], r["ids"]) for r in done))


def read(spark, dataset: PackedDataset) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: one task a file, READ_IDS at a time."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not dataset.files:
        return spark.createDataFrame([], schema)
    bases = np.cumsum([0, *(n for _, _, n in dataset.files)]).tolist()

    def get(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in part["id"]:
                fs, path = filesystem(dataset.files[k][0])
                with fs.open_input_file(path) as file:
                    own = PackedReader(file)
                    a, docs = 0, len(own.doc_ids)
                    while a < docs:
                        b = max(a + 1, int(np.searchsorted(own.starts, own.starts[a] + READ_IDS, side="right")) - 1)
                        ids, at = own.read(int(own.starts[a]), int(own.starts[b])), (own.starts[a : b + 1] - own.starts[a]).tolist()
                        yield pd.DataFrame({
                            "doc_id": pd.array(own.doc_ids[a:b], dtype="Int64").copy() if own.has[a:b].all() else pd.array([int(x) if h else None for x, h in zip(own.doc_ids[a:b], own.has[a:b], strict=True)], dtype="Int64"),
                            "start": own.starts[a:b] + bases[k],
                            "n_tokens": np.diff(own.starts[a : b + 1]),
                            "ids_crc32": [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at, at[1:], strict=False)],
                        })
                        a = b

    n = len(dataset.files)
    return spark.range(0, n, 1, n).mapInPandas(get, schema)


def write_and_read(documents: DataFrame, spec_path: str, end_id: int) -> DataFrame:
    """Write to the cluster's shared folder and read the files back."""
    ws = Workspace(documents.sparkSession, "packed-ids")
    return read(documents.sparkSession, write(documents, spec_path, end_id, ws.path("files")))
