"""Reward tables from audited responses, and reward reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltally.functions.skew import salted_join
from sqltally.functions.text import last_match, strip
from sqltally.operators.mining import MARKERS

# fixed values of the reward scale
FORMAT_REWARD, EXEC_REWARD, RESULT_REWARD, LENGTH_LIMIT = 1.0, 2.0, 3.0, 2048


def sql_rewards(audit: DataFrame, status: DataFrame, limit: int = LENGTH_LIMIT) -> DataFrame:
    """Format, execution, result and length rewards per response, and their total.

    Lengths are those of the trimmed think and answer texts and of the SQL with white space
    squeezed; only a matching response earns a length part.
    """
    ok, state = F.col("ok"), F.col("status")
    used = F.length("think") + F.length("answer")
    sql = F.length(F.regexp_replace("sql", r"\s+", " "))
    length = F.least(F.lit(0.5), 0.5 * used / limit) + sql / F.length("answer")
    parts = {
        "format": F.when(ok, FORMAT_REWARD).otherwise(-FORMAT_REWARD),
        "exec": F.when(ok & (state == "Unexecutable"), -EXEC_REWARD)
        .when(ok & state.isin("Mismatch", "Match"), EXEC_REWARD)
        .otherwise(0.0),
        "result": F.when(ok & (state == "Mismatch"), -RESULT_REWARD)
        .when(ok & (state == "Match"), RESULT_REWARD)
        .otherwise(0.0),
        "length": F.when(ok & (state == "Match"), length).otherwise(0.0),
    }
    total = F.col("format") + F.col("exec") + F.col("result") + F.col("length")
    return (
        audit.join(status.select("response_id", "status"), "response_id", "left")
        .withColumns(parts)
        .withColumn("total", total)
    )


def reward_means(rewards: DataFrame, source: str = "source") -> DataFrame:
    parts = ("format", "exec", "result", "length", "total")
    return rewards.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(p).alias(p) for p in parts]
    )


def numeric_answer(response: Column, mode: str = "strict") -> Column:
    """``#### n`` (commas dropped), or the last number that is not just a dot."""
    if mode == "strict":
        found = F.regexp_extract(response, r"#### (-?[0-9.,]+)", 1)
        return F.when(found != "", F.replace(found, F.lit(","), F.lit("")))
    numbers = F.regexp_extract_all(response, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    usable = F.filter(numbers, lambda n: n != ".")
    # no usable number but a number-like token: the first token stays the answer
    return F.coalesce(
        F.try_element_at(usable, F.lit(-1)), F.try_element_at(numbers, F.lit(1))
    )


def numeric_rewards(
    responses: DataFrame,
    truth: DataFrame,
    mode: str = "strict",
    score: float = 1.0,
    format_score: float = 0.0,
) -> DataFrame:
    """Score per response: full, format only, or 0 without an answer."""
    found = responses.withColumn("answer", numeric_answer(F.col("response"), mode))
    return found.join(truth.select("response_id", "truth"), "response_id").withColumn(
        "score",
        F.when(F.col("answer").isNull(), 0.0)
        .when(F.col("answer") == F.col("truth"), score)
        .otherwise(format_score),
    )


def accuracy_by_source(scores: DataFrame, full: float = 1.0, source: str = "source") -> DataFrame:
    return scores.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("score") == full).cast("double")).alias("accuracy")
    )


def equation_of(response: Column) -> Column:
    """Last answer on the last line of the text after the assistant marker, or NULL."""
    at = [F.locate(m, response) for m in MARKERS]
    body = F.when(at[0] > 0, F.substring(response, at[0] + len(MARKERS[0]), F.length(response))).when(
        at[1] > 0, F.substring(response, at[1] + len(MARKERS[1]), F.length(response))
    )
    last_line = F.element_at(F.split(body, "\n", -1), -1)
    return strip(last_match(last_line, r"<answer>(.*?)</answer>"))


def number_bag_rewards(
    responses: DataFrame, truth: DataFrame, score: float = 1.0, format_score: float = 0.1
) -> DataFrame:
    """Score per response: the numbers used must be the allowed bag, and the value hit the target.

    ``responses(response_id, response, value)``: the value of the equation is supplied.
    ``truth(response_id, target, numbers ARRAY<INT>)``.
    """
    found = responses.withColumn("equation", equation_of(F.col("response"))).join(
        truth, "response_id"
    )
    used = F.array_sort(
        F.transform(
            F.regexp_extract_all("equation", F.lit(r"(\d+)"), F.lit(1)),
            lambda n: n.try_cast("decimal(38,0)"),
        )
    )
    allowed = F.array_sort(F.transform("numbers", lambda n: n.cast("decimal(38,0)")))
    near = F.abs(F.col("value") - F.col("target")) < 1e-5
    outcome = (
        F.when(F.col("equation").isNull(), "none")
        .when(~F.coalesce(used == allowed, F.lit(False)), "wrong numbers")
        .when(F.coalesce(near, F.lit(False)), "correct")
        .otherwise("wrong value")
    )
    return found.withColumn("outcome", outcome).withColumn(
        "score",
        F.when(F.col("outcome") == "none", 0.0)
        .when(F.col("outcome") == "correct", score)
        .otherwise(format_score),
    )


def score_by_source(
    df: DataFrame, registry: Mapping[str, Column], source: str = "data_source"
) -> DataFrame:
    """Score each row with the Column registered for its source; an unknown source is an error."""
    branch = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, col in registry.items():
        branch = branch.when(F.col(source) == name, col)
    unknown = F.raise_error(F.concat(F.lit("no scorer for source "), F.col(source))).cast("double")
    return df.withColumn("score", branch.otherwise(unknown))


def place_on_last_token(tokens: DataFrame, scores: DataFrame) -> DataFrame:
    """Sequence score on the last valid token (``mask = 1``), zero elsewhere."""
    last = (
        tokens.where("mask = 1")
        .groupBy("seq_id")
        .agg(F.max("t").alias("last_t"))
        .join(scores.select("seq_id", F.col("score").alias("seq_score")), "seq_id")
    )
    return (
        salted_join(tokens.drop("score"), last, ["seq_id"], "left", spread=["t"])
        .withColumn(
            "score", F.when(F.col("t") == F.col("last_t"), F.col("seq_score")).otherwise(0.0)
        )
        .drop("last_t", "seq_score")
    )


def validation_by_source(scores: DataFrame, full: float = 3.0, source: str = "data_source") -> DataFrame:
    """Share of rewards equal to the full mark."""
    return scores.groupBy(source).agg(F.avg((F.col("score") == full).cast("double")).alias("share"))


def reward_shares(
    scores: DataFrame, full: float = 3.0, fmt_err: float = -1.0, wrong: float = -0.5, by: tuple[str, ...] = ()
) -> DataFrame:
    """Mean reward and the shares of full, format-error and wrong-answer marks."""

    def share(mark: float) -> Column:
        return F.avg((F.col("score") == mark).cast("double"))

    return scores.groupBy(*by).agg(
        F.avg("score").alias("mean"),
        share(full).alias("all_correct_ratio"),
        share(fmt_err).alias("format_error_ratio"),
        share(wrong).alias("wrong_answer_ratio"),
    )
