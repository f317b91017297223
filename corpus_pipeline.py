"""A cleaning run over ``documents``: five operators, one after the other.

Every stage takes the rows that the one before it kept. All but the last return the columns of
documents; the last returns each document's tokens and the text decoded from them. In every stage an empty table gives an
empty result, null texts and rows with a null doc_id are kept, extra columns pass through whatever their names, and a row is dropped
for its own text only, also where its doc_id is repeated; rows that repeat both go or stay together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe, decontam, near_dup, pii, quality_model
from loam.llm.common import materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from labels of rows not held out.

    Null, empty and wordless texts are judged like others, by the zero vector, unless their doc_id is null.
    """
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of every group of near duplicates.

    Near duplicates are texts with a Jaccard similarity of 0.8 or more of their five-word shingles; the
    operator's own contract, three words and three differing bits, binds its query only.
    """
    return near_dup.keep_one_similar(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and the terms that reveal it, in the texts."""
    return pii.sanitise(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from the ids; null texts are empty, repeated rows give repeated rows."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("byte-level BPE", tokenised),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
