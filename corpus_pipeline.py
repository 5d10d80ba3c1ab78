"""The corpus pipeline: from raw documents to packed sequences, in five stages.

Every stage takes what its predecessor kept. The first four return the columns
of documents: poor texts are dropped, one document of every group of near
copies stays, personal data is replaced, and rows are dropped or repeated so
that the sources reach their target weights. The last returns the pieces that
fill the training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import common, mixing, neardup, packing, pii, quality

#: Vocabulary and end id of the packed tokens; near copies by shingles of five words and a likeness of 0.8.
TOKENIZER, END_ID = "word_bpe_49k.json", 2
WIDTH, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    found = quality.judged(docs, common.table(spark, sf_dir, "labels"))
    poor = common.written(found.where(~F.col("kept")).select("doc_id", "hash").distinct(), "pipeline-poor")
    return common.decided(docs, poor, "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.deduplicated(docs, WIDTH, PERCENT)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with their token ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL expresses the model, the tagger or the rounding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again by the next."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{name}")
    return docs
