"""Choosing one candidate per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltally.operators.compare import bag_equal, explicit_nulls, set_equal, signature

ERROR_SQL = "Error SQL"


def greedy(candidates: DataFrame) -> DataFrame:
    """The first sampled candidate."""
    return candidates.where(F.col("cand_id") == 0).select("question_id", "sql")


def mark_invalid(candidates: DataFrame) -> DataFrame:
    """Replace the text of candidates that did not run."""
    return candidates.withColumn(
        "sql", F.when(F.col("valid") == 0, ERROR_SQL).otherwise(F.col("sql"))
    )


def result_signatures(results: DataFrame, bag: bool = False) -> DataFrame:
    """One order-free signature per candidate; ``bag`` keeps duplicate rows apart."""
    ids = ["question_id", "cand_id"]
    rows = results.select(*ids, explicit_nulls().alias("cells"))
    if not bag:
        rows = rows.dropDuplicates()
    return rows.groupBy(*ids).agg(signature(F.col("cells")).alias("sig"))


def majority_vote(
    candidates: DataFrame, results: DataFrame, bag: bool = False, verify: bool = False
) -> DataFrame:
    """Largest cluster of valid candidates with equal results; ties go to the earliest cluster.

    Only signatures are grouped, never the result rows.  ``verify`` compares every member with
    its cluster's first candidate row by row and fails the job on a signature collision.
    """
    ids = ["question_id", "cand_id"]
    valid = (
        candidates.where(F.col("valid") == 1)
        .select(*ids, "sql")
        .join(result_signatures(results, bag), ids, "left")
    )
    clusters = valid.groupBy("question_id", "sig").agg(
        F.count(F.lit(1)).alias("votes"),
        F.min("cand_id").alias("first_id"),
        F.min_by("sql", "cand_id").alias("sql"),
    )
    if verify:
        first = clusters.select(
            F.col("question_id").alias("q"), F.col("sig").alias("s"), F.col("first_id").alias("gold_id")
        )
        same = (F.col("question_id") == F.col("q")) & F.col("sig").eqNullSafe(F.col("s"))
        pairs = valid.join(first, same).select("question_id", "cand_id", "gold_id")
        bad = (
            (bag_equal if bag else set_equal)(results, pairs)
            .where(~F.col("equal"))
            .select("question_id", F.col("gold_id").alias("first_id"))
            .distinct()
            .withColumn("bad", F.lit(True))
        )
        clusters = clusters.join(bad, ["question_id", "first_id"], "left").withColumn(
            "sql",
            F.when(
                F.col("bad"), F.raise_error(F.lit("result signature collision")).cast("string")
            ).otherwise(F.col("sql")),
        )
    best = F.max_by(
        F.struct("sql", "votes", "first_id"), F.struct(F.col("votes"), -F.col("first_id"))
    )
    return (
        clusters.groupBy("question_id")
        .agg(best.alias("b"))
        .select("question_id", F.col("b.sql").alias("sql"), F.col("b.votes").alias("votes"))
    )


def vote_fallback(candidates: DataFrame, policy: str = "random", seed: int = 42) -> DataFrame:
    """Answer for questions without a valid candidate: a seeded pick or ``Error SQL``."""
    if policy == "random":
        pick = F.min_by("sql", F.xxhash64(F.lit(seed), "question_id", "cand_id"))
    else:
        pick = F.lit(ERROR_SQL)
    return (
        candidates.groupBy("question_id")
        .agg(F.max("valid").alias("any_valid"), pick.alias("sql"))
        .where("any_valid = 0")
        .select("question_id", "sql")
    )


def vote(
    candidates: DataFrame,
    results: DataFrame,
    bag: bool = False,
    policy: str = "random",
    seed: int = 42,
) -> DataFrame:
    """Majority vote with the all-invalid policy: exactly one row per question."""
    lost = vote_fallback(candidates, policy, seed).withColumn("votes", F.lit(0).cast("long"))
    return majority_vote(candidates, results, bag).unionByName(lost)


def pass_at_k(scores: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of questions with a candidate that reaches ``threshold``."""
    best = scores.groupBy(*by, "question_id").agg(F.max("score").alias("best"))
    return best.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("best") >= threshold).cast("double")).alias("pass_rate"),
    )
