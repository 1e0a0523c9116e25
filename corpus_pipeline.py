"""From raw documents to token ids: quality, near duplicates, benchmark leaks, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and keeps their columns; the last returns token ids.
``labels`` and ``benchmark`` come from sf_dir.  Rows without text are as good as the model's value for an empty text,
are no duplicates and no leaks, hold no personal data, and have no ids.  Rows without doc_id are never duplicates;
rows that repeat a doc_id are judged each by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import bpe, decontaminate, minhash, pii, quality
from driftmark.llm.common import Workspace

#: Near duplicates of the pipeline have 100 * intersection >= LEAST * union; op2 has its own contract.
LEAST = 80
#: The key of surrogates, known to everyone here; a corpus that is published needs a secret one.
KEY = "known to everyone"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at its threshold or above."""
    model = quality.fit(quality.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.filter(quality.score_column(spark, model) >= quality.THRESHOLD)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return minhash.without_near_duplicates(docs, least=LEAST)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    leaks = decontaminate.leaks_column(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.filter(F.size(leaks) == 0)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets."""
    return pii.replace(docs, KEY, chars="n_chars" if "n_chars" in docs.columns else None)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, whole): packed ids, and whether they decode to the text."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = docs.select("doc_id", "text", bpe.round_trip_column(spark, path, pattern).alias("both"))
    back = both.select("doc_id", "text", "both.*")
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("back") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("whole"))


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_leaks),
    ("pii_surrogates", without_personal_data),
    ("byte_bpe", token_ids),
]

#: The classifier, the signatures and the tokenizer are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again by the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return docs
