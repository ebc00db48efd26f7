"""A training corpus from ``documents``: filter, deduplicate, mix and encode.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrid.llm.common import shared_dir, table
from kinegrid.llm.minhash_dedup import drop_near_duplicates
from kinegrid.llm.sentencepiece import encode_texts
from kinegrid.llm.source_mix import mix_sources
from kinegrid.llm.suffix_dedup import drop_repeats
from kinegrid.llm.toxicity import drop_toxic, held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Labels of held-out documents are not learned."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    return drop_toxic(docs, labels).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or over others, the smallest doc_id stays."""
    return drop_near_duplicates(docs, width=5, percent=80).select(*COLUMNS)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur anywhere else are cut out of every text; the rows stay."""
    return drop_repeats(docs).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    return mix_sources(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text; a repeated document is encoded each time."""
    return encode_texts(docs).select("doc_id", "lang", "source", "n_chars", "n_pieces", "piece_ids", "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", encode),
]

#: Boosted trees and signatures are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
