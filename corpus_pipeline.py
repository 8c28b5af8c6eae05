"""Corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.functions.lineage import shared_folder
from sqltally.llm import decontaminate, line_dedup, packing, simhash, toxicity
from sqltally.llm.common import held_out, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7; learned as in the query of that operator."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1), "toxic")
    return model.keep(docs, 0.7)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more; n_chars follows the text."""
    found = line_dedup.without_later_copies(docs, min_words=50)
    count = F.when(F.col("removed_lines") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*[count if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: 4-word shingles, fingerprints that differ in 4 bits at most."""
    return simhash.keep_one(docs, width=4, radius=4)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), tokens=4096).drop("text_key")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedupe_lines),
    ("near_dedup", keep_one_copy),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Trees, SimHash and packing have no SQL form; ``tests/llm/test_pipeline.py`` restates the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; intermediate tables go to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
