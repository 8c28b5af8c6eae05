"""Readers and writers for question, prediction and metric files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.operators.rollout import to_long

# fixed values: separator of tagged predictions, and what an untagged entry stands for
TAG = "\t----- bird -----\t"
UNTAGGED = (" ", "financial")

QUESTION_SCHEMA = (
    "question_id long, db_id string, question string, evidence string, external_knowledge string, "
    "SQL string, query string, sql_complexity string, difficulty string"
)


def read_parquet(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All files of the list as one table."""
    return spark.read.parquet(*paths)


def read_questions(spark: SparkSession, path: str, fmt: str = "jsonl", schema: str = QUESTION_SCHEMA) -> DataFrame:
    """Questions from JSON lines (splittable) or a JSON array, with an explicit schema."""
    return spark.read.schema(schema).json(path, multiLine=(fmt == "json"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_sql_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``sql <tab> db_id``; blank lines end a session and are dropped."""
    line = F.trim("value")
    parts = F.split(line, "\t")
    return (
        _lines(spark, path)
        .where(line != "")
        .select(F.element_at(parts, 1).alias("sql"), F.trim(F.try_element_at(parts, F.lit(2))).alias("db_id"))
    )


def read_tagged_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Indented JSON map ``"id": "sql <tag> db_id"``, one entry per line.

    Read line by line, so the file splits over tasks.  Entries that are not tagged text become
    the fixed pair ``UNTAGGED``.
    """
    entry = r'^\s*"([^"]+)"\s*:\s*(.*?),?\s*$'
    found = (
        _lines(spark, path)
        .select(
            F.regexp_extract("value", entry, 1).alias("id"),
            F.regexp_extract("value", entry, 2).alias("raw"),
        )
        .where("id != ''")
    )
    text = F.get(F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>"), F.lit(0))
    is_tagged = F.col("raw").startswith('"') & F.contains(text, F.lit(TAG))
    parts = F.split(text, TAG)
    return found.select(
        F.col("id").cast("long").alias("ordinal"),
        F.when(is_tagged, F.element_at(parts, 1)).otherwise(UNTAGGED[0]).alias("sql"),
        F.when(is_tagged, F.try_element_at(parts, F.lit(2))).otherwise(UNTAGGED[1]).alias("db_id"),
    )


def merge_predictions(pred: DataFrame, meta: DataFrame) -> DataFrame:
    """Predictions joined with question metadata by position, cut at the first comment."""
    return pred.select("ordinal", F.element_at(F.split("sql", r"/\*"), 1).alias("sql")).join(
        meta.select("ordinal", "question_id", "db_id"), "ordinal"
    ).select(
        "question_id", "sql", "db_id", F.concat("sql", F.lit(TAG), "db_id").alias("tagged")
    )


def write_splits(df: DataFrame, path: str) -> None:
    """One Parquet folder per ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def error_report(scored: DataFrame, path: str | None = None) -> DataFrame:
    """Item details with an ``is_correct`` flag; written as CSV when ``path`` is given."""
    report = scored.select(
        "id", "pred_sql", "gold_sql", "schema", (F.col("ok") == 1).alias("is_correct")
    )
    if path:
        report.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return report


def failing_ids(scored: DataFrame) -> DataFrame:
    return scored.where("ok = 0").select("id")


def log_metrics(wide: DataFrame, step: str = "step", path: str | None = None) -> DataFrame:
    """Wide step metrics as long rows, appended to the metric log at ``path``."""
    rows = to_long(wide, step)
    if path:
        rows.write.mode("append").parquet(path)
    return rows
