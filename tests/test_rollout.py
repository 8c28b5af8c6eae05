import random

import pytest
from pyspark.sql import functions as F

from sqltally.operators import metrics, rewards, rollout


def tokens(spark, lengths, seed=2):
    rng = random.Random(seed)
    rows = [
        (s, t, int(t < max(2, n - 2)), rng.uniform(-1, 1), rng.uniform(-1, 1))
        for s, n in enumerate(lengths)
        for t in range(n)
    ]
    return spark.createDataFrame(rows, "seq_id long, t long, mask int, score double, value double"), rows


@pytest.mark.parametrize("rate", [0.0, 0.5, 0.94, 1.0])
def test_reverse_scan_equals_recursion(spark, rate):
    df, rows = tokens(spark, [1, 7, 40, 123])
    got = {(r.seq_id, r.t): r.a for r in rollout.reverse_scan(df, F.col("score"), rate, "a", block=8).collect()}
    x = {(s, t): v for s, t, _, v, _ in rows}
    for s, n in enumerate([1, 7, 40, 123]):
        after = 0.0
        for t in reversed(range(n)):
            after = x[s, t] + rate * after
            assert got[s, t] == pytest.approx(after, abs=1e-9)


@pytest.mark.parametrize("gamma,lam", [(0.99, 0.95), (0.9, 0.0), (0.9, 0.01), (1.0, 1.0), (0.0, 0.9)])
def test_gae_equals_recursion(spark, gamma, lam):
    df, rows = tokens(spark, [3, 9, 30])
    got = {(r.seq_id, r.t): r.ret for r in rollout.gae(df, gamma, lam).collect()}
    data = {(s, t): (r, v) for s, t, _, r, v in rows}
    for s, n in enumerate([3, 9, 30]):
        adv = 0.0
        for t in reversed(range(n)):
            reward, value = data[s, t]
            after = data[s, t + 1][1] if t + 1 < n else 0.0
            adv = reward + gamma * after - value + gamma * lam * adv
            assert got[s, t] == pytest.approx(adv + value, abs=1e-9)


def test_whitened_values_have_mean_zero_and_unit_variance(spark):
    df, _ = tokens(spark, [30, 50])
    out = rollout.whiten(df, "score").where("mask = 1").agg(F.avg("score").alias("m"), F.var_samp("score").alias("v")).first()
    assert out["m"] == pytest.approx(0, abs=1e-9) and out["v"] == pytest.approx(1, abs=1e-6)


def test_one_valid_token_is_an_error(spark):
    df = spark.createDataFrame([(0, 0, 1, 1.0)], "seq_id long, t long, mask int, score double")
    with pytest.raises(Exception, match="fewer than two valid tokens"):
        rollout.masked_stats(df, "score").collect()


def test_group_of_one_keeps_its_score(spark):
    df = spark.createDataFrame([(0, 0, 2.5), (1, 1, 1.0), (2, 1, 3.0)], "seq_id long, group_id long, score double")
    got = {r.seq_id: r.adv for r in rollout.group_advantage(df).collect()}
    assert got[0] == pytest.approx(2.5, abs=1e-5) and got[1] == pytest.approx(-got[2])


def test_adaptive_coefficient_is_a_running_product(spark):
    df = spark.createDataFrame([(i, 0.01 * i, 64) for i in range(20)], "step int, kl double, n long")
    coef, want = {r.step: r.coef for r in rollout.adaptive_coef(df, 0.2, 0.05, 1000).collect()}, 0.2
    for i in range(20):
        want *= 1 + max(-0.2, min(0.2, 0.01 * i / 0.05 - 1)) * 64 / 1000
        assert coef[i] == pytest.approx(want)


def test_trim_keeps_identical_values_unless_strict(spark):
    df = spark.createDataFrame([(0, 0.1)] * 5 + [(1, 1.0)] * 20 + [(1, 100.0)], "q long, x double")
    assert {r.q: r.mean for r in metrics.trimmed_mean(df, ["q"], "x").collect()} == {0: 0.1, 1: 1.0}
    assert {r.q: r.mean for r in metrics.trimmed_mean(df, ["q"], "x", strict=True).collect()}[0] is None


def test_partial_f1_of_nothing(spark):
    df = spark.createDataFrame([("select", "easy", 1, 1, 0, 0)], "component string, level string, label_n int, pred_n int, acc int, rec int")
    assert {r.f1 for r in metrics.partial_scores(df, "level").collect()} == {0.0}
    assert {r.f1 for r in metrics.partial_scores(df, "level", compat=True).collect()} == {1.0}


def test_unknown_source_fails(spark):
    df = spark.createDataFrame([("x",)], "data_source string")
    with pytest.raises(Exception, match="no scorer for source"):
        rewards.score_by_source(df, {"y": F.lit(1.0)}).collect()
