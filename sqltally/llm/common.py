"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.functions.lineage import cut_lineage

__all__ = ["cut_lineage", "held_out", "raw_text", "table", "tasks_for", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_text(text: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def text_key(text: str) -> Column:
    """Tells texts of rows with the same id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id written as text leaves ``remainder``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def tasks_for(rows: int, per_task: int) -> int:
    """Number of tasks that hold about ``per_task`` rows each."""
    return max(1, math.ceil(rows / per_task))
