"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Every whole text is compressed in blocks of BLOCK bytes under both dictionaries.  Two normalised differences of
compressed sizes, (good - bad) / (good + bad) and the log of the better size over the raw size, go through a logistic
calibration fitted on labelled rows that were kept out of the dictionaries.

The dictionaries and the calibration are fitted on a bounded sample of labelled rows (``sample_rows`` a class, the
rows with the smallest hash of their id); scoring covers every row.  Null and empty texts score as the calibration's
value for two zero differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm.textbatch import small_batches

BLOCK = 2048
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Labelled rows a class that a fit may use at most, and bytes of text a class that enter a dictionary's training.
SAMPLE_ROWS = 3000
#: Bytes of that sample's texts a class, in whole texts in the order of their id's hash, that a dictionary is trained on.
TRAIN_BYTES = 8_000_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        good, bad = _compressor(self.good), _compressor(self.bad)

        def score(text: str | None) -> float:
            z = sum(w * x for w, x in zip(self.weights, _inputs(*sizes(text, good, bad)), strict=True))
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        return score


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def sizes(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[int, int, int]:
    """Compressed bytes under either dictionary and raw bytes, over all blocks of the text."""
    raw = (text or "").encode("utf-8", "replace")
    cut = blocks(raw)
    return sum(len(good.compress(b)) for b in cut), sum(len(bad.compress(b)) for b in cut), len(raw)


def _inputs(g: int, b: int, n: int) -> tuple[float, float, float, float]:
    """Calibration inputs; the square bends the second difference, as both well and hardly compressible texts are rare."""
    if not n:
        return (1.0, 0.0, 0.0, 0.0)
    ratio = math.log(min(g, b) / n)
    return (1.0, 10 * (g - b) / (g + b), ratio, min(0.0, ratio + 1.5) ** 2)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 200) -> np.ndarray:
    """Weights of the least penalised logistic loss.

    Newton's full step can overshoot and run away where classes nearly part, so a step is halved until the loss, which
    is convex, falls enough; inputs are brought to one scale first.
    """
    scale = np.maximum(np.abs(x).max(axis=0), 1e-12)
    u, w = x / scale, np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = u @ v
        return float(np.logaddexp(0.0, z).sum() - y @ z + ridge / 2 * v @ v)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -500, 500)))
        slope = u.T @ (p - y) + ridge * w
        step = np.linalg.solve((u * (p * (1 - p))[:, None]).T @ u + ridge * np.eye(len(w)), -slope)
        rate = 1.0
        while rate > 1e-10 and not loss(w + rate * step) <= now + 1e-4 * rate * float(slope @ step):
            rate /= 2
        if rate <= 1e-10:
            break
        w = w + rate * step
        before, now = now, loss(w)
        if before - now < 1e-10 * (1 + abs(now)):
            break
    return w / scale


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of DICTIONARY_BYTES from about TRAIN_BYTES of the sample; of a sample too small to train on, the start of its text."""
    parts, total = [], 0
    for cut in map(blocks, texts):
        parts += cut
        total += sum(map(len, cut))
        if total >= TRAIN_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their text itself is the dictionary
        return b"".join(parts)[:DICTIONARY_BYTES]


def sample(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, text, label) of at most ``sample_rows`` rows a class, of those that are not held out.

    The rows are drawn by the hash of their id from ``labels`` (doc_id, quality) alone; their texts come by one scan of
    ``documents`` against the broadcast ids, at most 2 * sample_rows of them.
    """
    known = labels.select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("label")).filter(F.col("key").isNotNull() & ~held_out("key"))
    drawn = [known.filter(F.col("label") == y).dropDuplicates(["key"]).orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(sample_rows) for y in (1, 0)]
    docs = documents.select(F.col("doc_id").alias("key"), "text").filter(F.col("text").isNotNull())
    return docs.join(F.broadcast(drawn[0].union(drawn[1])), "key")


def fit(rows: DataFrame) -> QualityModel:
    """Fit on a bounded sample (key, text, label 0/1).  Rows without text are ignored.

    Rows are taken in the order of their id's hash, so repeated runs fit alike.  Without rows of both classes the
    model scores the share of label 1 (0.5 without any).
    """
    got = sorted(((r["h"], r["text"].encode("utf-8", "replace"), r["label"]) for r in rows.select(F.xxhash64(F.col("key").cast("string")).alias("h"), "text", "label").collect() if r["text"]))
    rows = {y: [t for _, t, z in got if z == y] for y in (1, 0)}
    if not rows[1] or not rows[0]:
        share = 0.5 if not rows[1] and not rows[0] else 0.999 if rows[1] else 0.001
        return QualityModel(b"", b"", (math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    halves = {y: (ts[::2], ts[1::2] or ts) for y, ts in rows.items()}
    good, bad = _dictionary(halves[1][0]), _dictionary(halves[0][0])
    cg, cb = _compressor(good), _compressor(bad)
    x, y = [], []
    for label_, (_, rest) in halves.items():
        for t in rest:
            x.append(_inputs(*sizes(t.decode("utf-8", "replace"), cg, cb)))
            y.append(label_)
    return QualityModel(good, bad, tuple(map(float, _logistic(np.array(x), np.array(y, dtype=float)))))


def score_column(spark: SparkSession, model: QualityModel, text: str = "text"):
    """A column with the score of each whole text; the model (two dictionaries of 110 kB) is broadcast once."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = sent.value.scorer()
        for part in parts:
            yield pd.Series([one(t) for t in part], dtype="float64")

    return score(F.col(text))


def held_out(key: str):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def classify(documents: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a null doc_id gives a null held_out."""
    scored = documents.select("doc_id", "text").select("doc_id", held_out("doc_id").alias("held_out"), score_column(documents.sparkSession, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
