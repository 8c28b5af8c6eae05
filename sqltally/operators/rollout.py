"""Rollout analytics on the long token table ``tokens(step, seq_id, group_id, t, mask, ...)``.

``t`` is dense from 0 within a sequence and ``mask`` is a prefix of ones.  Sequences are cut into
blocks of positions for every scan, so no window depends on the length of a sequence.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltally.functions.once import pinned
from sqltally.functions.ordering import running_sum
from sqltally.functions.skew import salted_join

#: positions per block of a scan
BLOCK = 65536


def eos_mask(tokens: DataFrame, eos: str, heavy: list[int] | None = None) -> DataFrame:
    """``mask`` = 1 up to and including the first position where ``eos`` holds.

    The first end of a sequence is aggregated and joined back; heavy sequences are spread.
    """
    first = tokens.where(F.col(eos)).groupBy("seq_id").agg(F.min("t").alias("_first"))
    return (
        salted_join(tokens, first, ["seq_id"], "left", spread=["t"], heavy=heavy)
        .withColumn("mask", F.coalesce((F.col("t") <= F.col("_first")).cast("int"), F.lit(1)))
        .drop("_first")
    )


# --- masked statistics --------------------------------------------------------------------------


def masked_stats(tokens: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum, mean and unbiased variance over valid tokens; fewer than two tokens is an error."""
    n = F.count(F.lit(1))
    guard = F.when(n < 2, F.raise_error(F.lit("fewer than two valid tokens")).cast("double"))
    return tokens.where("mask = 1").groupBy(*by).agg(
        F.sum(col).alias("sum"),
        F.avg(col).alias("mean"),
        guard.otherwise(F.var_samp(col)).alias("var"),
    )


def whiten(
    tokens: DataFrame, col: str, shift_mean: bool = True, name: str | None = None
) -> DataFrame:
    """``(x - mean) / sqrt(var + 1e-8)`` with the statistics of valid tokens.

    The statistics are one row, read back as a scalar sub-query.
    """
    stats = masked_stats(tokens, col).select(F.struct("mean", "var")).scalar()
    mean, var = stats.getField("mean"), stats.getField("var")
    out = (F.col(col) - mean) / F.sqrt(var + 1e-8)
    if not shift_mean:
        out = out + mean
    return tokens.withColumn(name or col, out)


def sequence_scores(tokens: DataFrame, col: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """Outcome score of a sequence: the sum of its token scores."""
    return tokens.groupBy("seq_id", *keep).agg(F.sum(col).alias("score"))


def group_advantage(scores: DataFrame, eps: float = 1e-6) -> DataFrame:
    """``(score - mean) / (std + eps)`` within ``group_id``; a group of one keeps mean 0, std 1."""
    n = F.count(F.lit(1))
    stats = scores.groupBy("group_id").agg(
        F.when(n == 1, 0.0).otherwise(F.avg("score")).alias("_mean"),
        F.when(n == 1, 1.0).otherwise(F.stddev_samp("score")).alias("_std"),
    )
    return salted_join(scores, stats, ["group_id"], spread=["seq_id"]).select(
        "seq_id", "group_id", ((F.col("score") - F.col("_mean")) / (F.col("_std") + eps)).alias("adv")
    )


# --- reverse scans ------------------------------------------------------------------------------


def _carry(rate: float):
    """Block-level recursion: value entering a block from the blocks after it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ascending=False, ignore_index=True)
        carry, out = 0.0, []
        for head in pdf["_head"]:
            out.append(carry)
            carry = head + rate * carry
        return pdf[["seq_id", "_blk"]].assign(_in=out)

    return run


def reverse_scan(tokens: DataFrame, x: Column, rate: float, name: str, block: int = BLOCK) -> DataFrame:
    """``A_t = x_t + rate * A_{t+1}`` along each sequence, for ``0 <= rate <= 1``.

    Inside a block the recursion is a running sum of ``x * rate^k`` scaled back by ``rate^-k``;
    the block is short enough that the scaling cannot overflow.  Only sequences longer than one
    block need the values carried from later blocks, one row per block.
    """
    if not 0.0 <= rate <= 1.0:
        raise ValueError("rate must lie in [0, 1]")
    if rate == 0.0:
        return tokens.withColumn(name, x)
    size = block if rate == 1.0 else max(1, min(block, int(300 / -math.log(rate))))
    cut = (
        tokens.withColumn("_x", x)
        .withColumn("_blk", F.floor(F.col("t") / size))
        .withColumn("_off", F.col("t") - F.col("_blk") * size)
    )
    w = (
        Window.partitionBy("seq_id", "_blk")
        .orderBy(F.desc("t"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    weight = F.pow(F.lit(rate), F.col("_off").cast("double"))
    local = cut.withColumn(name, F.sum(F.col("_x") * weight).over(w) / weight)
    several = tokens.where(F.col("t") >= size).select("seq_id").distinct()
    heads = (
        local.where("_off = 0")
        .select("seq_id", "_blk", F.col(name).alias("_head"))
        .join(several, "seq_id", "left_semi")
    )
    carried = heads.groupBy("seq_id").applyInPandas(
        _carry(rate**size), heads.select("seq_id", "_blk").schema.add("_in", "double")
    )
    reach = F.pow(F.lit(rate), (F.lit(size) - F.col("_off")).cast("double"))
    return (
        local.join(carried, ["seq_id", "_blk"], "left")
        .withColumn(name, F.col(name) + reach * F.coalesce("_in", F.lit(0.0)))
        .drop("_x", "_blk", "_off", "_in")
    )


def gae(tokens: DataFrame, gamma: float, lam: float) -> DataFrame:
    """Generalised advantage ``adv`` (whitened over valid tokens) and return ``ret``.

    With S(x)_t the discounted reverse sum at rate gamma*lam, the sum of
    ``reward + gamma * next value - value`` is ``S(reward - value + value/lam) - value/lam``:
    one scan and no shifted join.  A tiny ``lam`` uses the next value directly instead.
    """
    reward, value = F.col("score"), F.col("value")
    rate = gamma * lam
    if rate == 0.0 or lam < 0.05:
        after = tokens.select(
            "seq_id", (F.col("t") - 1).alias("t"), F.col("value").alias("_next")
        )
        lagged = tokens.join(after, ["seq_id", "t"], "left")
        delta = reward + gamma * F.coalesce("_next", F.lit(0.0)) - value
        raw = reverse_scan(lagged, delta, rate, "adv").drop("_next")
    else:
        raw = reverse_scan(tokens, reward - value + value / lam, rate, "adv")
        raw = raw.withColumn("adv", F.col("adv") - value / lam)
    return whiten(raw.withColumn("ret", F.col("adv") + value), "adv")


def discounted_return(tokens: DataFrame, gamma: float) -> DataFrame:
    """Discounted return ``ret`` that stops at the end of the valid tokens, and whitened ``adv``.

    A masked position keeps only its own reward; ``adv`` is zero there.
    """
    valid = F.when(F.col("mask") == 1, F.col("score")).otherwise(0.0)
    scanned = reverse_scan(tokens, valid, gamma, "ret").withColumn(
        "ret", F.when(F.col("mask") == 1, F.col("ret")).otherwise(F.col("score"))
    )
    return whiten(scanned, "ret", name="adv").withColumn("adv", F.col("adv") * F.col("mask"))


# --- divergence and losses ------------------------------------------------------------------------


def kl_term(logp: Column, ref: Column, kind: str = "kl") -> Column:
    """Per-token estimate of the divergence from the reference policy."""
    diff = logp - ref
    if kind == "kl":
        return diff
    if kind == "abs":
        return F.abs(diff)
    if kind == "mse":
        return 0.5 * diff * diff
    if kind == "low_var_kl":
        return F.least(F.lit(10.0), F.greatest(F.lit(-10.0), F.exp(-diff) + diff - 1))
    raise ValueError(f"unknown estimator {kind!r}")


def penalized_rewards(
    tokens: DataFrame, beta: float, kind: str = "kl", by: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Tokens with ``kl`` and ``reward = score - beta * kl``; mean KL per sequence, then per batch."""
    kl = kl_term(F.col("old_logp"), F.col("ref_logp"), kind) * F.col("mask")
    out = tokens.withColumn("kl", kl).withColumn("reward", F.col("score") - beta * F.col("kl"))
    metrics = (
        out.groupBy("seq_id", *by)
        .agg((F.sum("kl") / F.sum("mask")).alias("kl"))
        .groupBy(*by)
        .agg(F.avg("kl").alias("kl"), F.count(F.lit(1)).alias("n_seqs"), F.lit(beta).alias("kl_coeff"))
    )
    return out, metrics


def adaptive_coef(steps: DataFrame, init: float, target: float, horizon: float) -> DataFrame:
    """Coefficient after each step: multiplied by ``1 + clip(kl/target - 1, +-0.2) * n / horizon``.

    ``steps(step, kl, n)``.  The running product is kept as three blocked running sums: logarithms
    of the factors' sizes, negative factors, and zero factors.
    """
    error = F.least(F.lit(0.2), F.greatest(F.lit(-0.2), F.col("kl") / target - 1))
    steps = steps.withColumn("_m", 1 + error * F.col("n") / horizon)
    size = F.when(F.col("_m") == 0, 0.0).otherwise(F.log(F.abs("_m")))
    summed = running_sum(steps, size, "step", "_log")
    summed = running_sum(summed, (F.col("_m") < 0).cast("int"), "step", "_negative")
    summed = running_sum(summed, (F.col("_m") == 0).cast("int"), "step", "_zero")
    sign = F.when(F.col("_negative") % 2 == 1, -1.0).otherwise(1.0)
    coef = F.when(F.col("_zero") > 0, 0.0).otherwise(sign * F.exp("_log") * init)
    return summed.select("step", "kl", "n", coef.alias("coef"))


def _masked_avg(x: Column) -> Column:
    return F.avg(F.when(F.col("mask") == 1, x))


def policy_terms(clip: float) -> tuple[Column, Column, Column]:
    """Clipped loss, clipped flag and approximate KL of a token."""
    diff = F.col("logp") - F.col("old_logp")
    ratio = F.exp(diff)
    plain = -F.col("adv") * ratio
    clipped = -F.col("adv") * F.least(F.lit(1.0 + clip), F.greatest(F.lit(1.0 - clip), ratio))
    return F.greatest(plain, clipped), (clipped > plain).cast("double"), -diff


def policy_loss(tokens: DataFrame, clip: float, by: tuple[str, ...] = ()) -> DataFrame:
    loss, clipped, kl = policy_terms(clip)
    return tokens.groupBy(*by).agg(
        _masked_avg(loss).alias("loss"),
        _masked_avg(clipped).alias("clip_frac"),
        _masked_avg(kl).alias("kl"),
    )


def value_loss(tokens: DataFrame, clip: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``tokens`` carry ``vpred``, ``value`` (old) and ``ret``."""
    low, high = F.col("value") - clip, F.col("value") + clip
    held = F.greatest(F.least(F.col("vpred"), high), low)
    plain, bounded = F.pow(F.col("vpred") - F.col("ret"), 2), F.pow(held - F.col("ret"), 2)
    return tokens.groupBy(*by).agg(
        (0.5 * _masked_avg(F.greatest(plain, bounded))).alias("loss"),
        _masked_avg((bounded > plain).cast("double")).alias("clip_frac"),
    )


def with_logprob_entropy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Label log-probability and entropy of each logit vector (max-shifted log-sum-exp)."""
    vectors = pinned(df, _x=F.transform(F.col(logits), lambda v: v.cast("double")))
    shifted = pinned(vectors, _top=F.array_max("_x"))
    # one walk over the vector: sum of exp(v - top) and of exp(v - top) * v

    def add(acc: Column, v: Column) -> Column:
        e = F.exp(v - F.col("_top"))
        return F.struct((acc["s"] + e).alias("s"), (acc["d"] + e * v).alias("d"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("d"))
    summed = pinned(shifted, _sum=F.aggregate("_x", start, add))
    lse = F.log(F.col("_sum.s")) + F.col("_top")
    return summed.withColumns(
        {
            "logprob": F.element_at("_x", F.col(label).cast("int") + 1) - lse,
            "entropy": lse - F.col("_sum.d") / F.col("_sum.s"),
        }
    ).drop("_x", "_top", "_sum")


def logprob_entropy(df: DataFrame, logits: str, label: str, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Vectors with their log-probability and entropy, and masked means by ``by``."""
    out = with_logprob_entropy(df, logits, label)
    means = out.groupBy(*by).agg(
        _masked_avg(F.col("logprob")).alias("logprob"), _masked_avg(F.col("entropy")).alias("entropy")
    )
    return out, means


# --- step metrics ---------------------------------------------------------------------------------


def batch_metrics(tokens: DataFrame, use_critic: bool = True) -> DataFrame:
    """Long ``metrics(step, name, value)`` of scores, rewards, advantages, returns and lengths.

    ``tokens`` carry ``step, score, reward, adv, ret, value, mask`` and per-row ``prompt_len``.
    Maximum lengths are those seen in the step.  One pass over the tokens: sequences and the whole
    step are two grouping sets of the same aggregate.
    """
    valid = lambda x: F.when(F.col("mask") == 1, x)
    token_parts = {}
    columns = [("critic/advantages", "adv"), ("critic/returns", "ret")]
    if use_critic:
        columns.append(("critic/values", "value"))
    for title, c in columns:
        for kind, fn in (("mean", F.avg), ("max", F.max), ("min", F.min)):
            token_parts[f"{title}/{kind}"] = fn(valid(F.col(c))).cast("double")
    if use_critic:
        error = F.var_samp(valid(F.col("ret") - F.col("value")))
        token_parts["critic/vf_explained_var"] = 1 - error / (F.var_samp(valid(F.col("ret"))) + 1e-5)
    grouped = tokens.groupingSets([["step", "seq_id"], ["step"]], "step", "seq_id").agg(
        (F.grouping("seq_id") == 1).alias("whole"),
        F.sum("score").alias("score"),
        F.sum("reward").alias("reward"),
        F.sum("mask").alias("rl"),
        F.count(F.lit(1)).alias("width"),
        F.max("prompt_len").alias("pl"),
        *[v.alias(f"_tok{i}") for i, v in enumerate(token_parts.values())],
    )
    # one row per step and pair of lengths: few rows, whatever the number of sequences
    shapes = grouped.groupBy("step", "whole", "rl", "pl").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("width").alias("width"),
        *[F.max(F.when(F.col("whole"), F.col(f"_tok{i}"))).alias(f"_tok{i}") for i in range(len(token_parts))],
        *[fn(c).alias(f"{c}_{fn.__name__}") for c in ("score", "reward") for fn in (F.sum, F.max, F.min)],
    )
    in_step = Window.partitionBy("step")
    seq = lambda x: F.when(~F.col("whole"), x)
    limited = shapes.withColumns(
        {"max_rl": F.max(seq(F.col("width"))).over(in_step), "max_pl": F.max(seq(F.col("pl"))).over(in_step)}
    )
    n = F.sum(seq(F.col("n")))

    def spread(title: str, c: str) -> list[Column]:
        parts = {
            "mean": F.sum(seq(F.col(f"{c}_sum"))) / n,
            "max": F.max(seq(F.col(f"{c}_max"))),
            "min": F.min(seq(F.col(f"{c}_min"))),
        }
        return [v.cast("double").alias(f"{title}/{k}") for k, v in parts.items()]

    def lengths(title: str, c: str) -> list[Column]:
        parts = {
            "mean": F.sum(seq(F.col(c) * F.col("n"))) / n,
            "max": F.max(seq(F.col(c))),
            "min": F.min(seq(F.col(c))),
            "clip_ratio": F.sum(seq(F.when(F.col(c) == F.col(f"max_{c}"), F.col("n")).otherwise(0))) / n,
        }
        return [v.cast("double").alias(f"{title}/{k}") for k, v in parts.items()]

    wide = limited.groupBy("step").agg(
        *spread("critic/score", "score"),
        *spread("critic/rewards", "reward"),
        *lengths("response_length", "rl"),
        *lengths("prompt_length", "pl"),
        *[F.max(f"_tok{i}").alias(k) for i, k in enumerate(token_parts)],
    )
    return to_long(wide)


def to_long(wide: DataFrame, step: str = "step") -> DataFrame:
    """Wide metrics to ``metrics(step, name, value)``."""
    names = [c for c in wide.columns if c != step]
    typed = wide.select(step, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return typed.unpivot([step], [F.col(f"`{c}`") for c in names], "name", "value")


def timing_metrics(timings: DataFrame, lengths: DataFrame) -> DataFrame:
    """Seconds, and milliseconds per token, by step and section.

    ``timings(step, section, seconds)``; ``lengths(step, prompt_tokens, response_tokens)`` per row.
    Generation counts response tokens; the training sections count all tokens.
    """
    sums = lengths.groupBy("step").agg(
        F.sum("prompt_tokens").alias("p"), F.sum("response_tokens").alias("r")
    )
    joined = timings.join(sums, "step", "left")
    all_tokens = F.col("section").isin("ref", "values", "adv", "update_critic", "update_actor")
    n = F.when(F.col("section") == "gen", F.col("r")).when(all_tokens, F.col("p") + F.col("r"))
    return (
        joined.select(
            "step",
            F.explode(
                F.array(
                    F.struct(
                        F.concat(F.lit("timing_s/"), "section").alias("name"), F.col("seconds").alias("value")
                    ),
                    F.struct(
                        F.concat(F.lit("timing_per_token_ms/"), "section").alias("name"),
                        (F.col("seconds") * 1000 / n).alias("value"),
                    ),
                )
            ).alias("m"),
        )
        .select("step", "m.name", "m.value")
        .where(F.col("value").isNotNull())
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Mean of repeated metric values per step and name."""
    return metrics.groupBy("step", "name").agg(F.avg("value").alias("value"))


def dense_parameters(
    hidden: int, layers: int, heads: int, kv_heads: int, intermediate: int, vocab: int
) -> int:
    """Weights of a gated-MLP transformer that take part in the dense products."""
    head_dim = hidden // heads
    attention = hidden * head_dim * (2 * heads + 2 * kv_heads)
    return layers * (3 * hidden * intermediate + attention) + 2 * vocab * hidden


def flops_rate(lengths: DataFrame, timings: DataFrame, model: dict[str, int]) -> DataFrame:
    """Achieved TFLOPS per step: ``6 N sum(len) + 12 sum(len^2) head_dim heads layers`` over time.

    ``lengths(step, len)``; ``timings(step, seconds)``; ``model`` as for ``dense_parameters``.
    """
    n = dense_parameters(**model)
    attn = 12 * (model["hidden"] // model["heads"]) * model["heads"] * model["layers"]
    length = F.col("len").cast("double")
    sums = lengths.groupBy("step").agg(F.sum(length).alias("s"), F.sum(length * length).alias("s2"))
    flops = 6.0 * n * F.col("s") + float(attn) * F.col("s2")
    return sums.join(timings, "step").select("step", (flops / F.col("seconds") / 1e12).alias("tflops"))


def loss_report(
    tokens: DataFrame, by: tuple[str, ...], clip: float, entropy_coef: float, kl_coef: float, kind: str = "low_var_kl"
) -> DataFrame:
    """Per micro-batch: policy loss, entropy, KL and ``policy - entropy*c - kl*c``.

    ``tokens`` carry ``logp, old_logp, ref_logp, adv, entropy, mask``.
    """
    loss, clipped, approx = policy_terms(clip)
    kl = kl_term(F.col("logp"), F.col("ref_logp"), kind)
    parts = tokens.groupBy(*by).agg(
        _masked_avg(loss).alias("pg_loss"),
        _masked_avg(clipped).alias("pg_clipfrac"),
        _masked_avg(approx).alias("ppo_kl"),
        _masked_avg(F.col("entropy")).alias("entropy_loss"),
        _masked_avg(kl).alias("kl_loss"),
    )
    total = F.col("pg_loss") - F.col("entropy_loss") * entropy_coef - F.col("kl_loss") * kl_coef
    return parts.withColumn("loss", total)
