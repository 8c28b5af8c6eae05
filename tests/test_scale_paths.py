"""Skew handling must not change results."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sqltally.functions.ordering import running_sum, with_rank
from sqltally.functions.skew import heavy_hashes, salted_join


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def skewed(spark, n=600):
    rng = random.Random(3)
    data = [(0 if rng.random() < 0.5 else rng.randrange(40), i, rng.randrange(50)) for i in range(n)]
    return spark.createDataFrame(data, "k long, id long, v long").repartition(7)


def test_heavy_keys_are_found(spark, tiny_floor):
    df = skewed(spark)
    zero = df.where("k = 0").select(F.xxhash64("k")).first()[0]
    assert zero in heavy_hashes(df, ["k"])


def test_salted_join_keeps_rows(spark, tiny_floor):
    df = skewed(spark)
    side = df.groupBy("k").agg(F.sum("v").alias("s")).where("k % 5 <> 1")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = rows(df.join(side, ["k"], how))
        assert rows(salted_join(df, side, ["k"], how, spread=["id"])) == want


def test_rank_within_heavy_group(spark, tiny_floor):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("v", "id")
    want = rows(df.withColumn("r", F.row_number().over(w) - 1).select("k", "id", "r"))
    assert rows(with_rank(df, ["v", "id"], ["k"], "r").select("k", "id", "r")) == want


def test_rank_of_whole_table_with_nulls_and_text(spark):
    data = [(None if i % 9 == 0 else f"t{i % 13}", i) for i in range(500)]
    df = spark.createDataFrame(data, "s string, id long").repartition(5)
    got = [r["id"] for r in with_rank(df, ["s", "id"]).orderBy("ordinal").collect()]
    assert got == [i for _, i in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))]
    assert with_rank(df, ["s", "id"]).agg(F.max("ordinal")).first()[0] == 499


def test_running_sum_over_blocks(spark):
    df = spark.createDataFrame([(i % 3, i, float(i % 7)) for i in range(300)], "g long, i long, x double")
    got = {(r.g, r.i): r.s for r in running_sum(df, F.col("x"), "i", "s", ["g"], block=16).collect()}
    total = {}
    for i in range(300):
        total[i % 3] = total.get(i % 3, 0) + i % 7
        assert got[i % 3, i] == total[i % 3]


def test_queries_agree_on_the_skew_path(spark, tiny_floor):
    from oracle import compare, duck
    from sqltally.plans import load_all
    from sqltally.plans.registry import ORACLES, QUERIES

    load_all()
    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    for name in (
        "rl3_group_advantage", "rl4_gae", "rw6_place_on_last_token", "mt3_trimmed_mean",
        "mt13_canonicalize", "mt15_turn_accuracy", "bt10_balanced_groups", "bt11_balance_report",
        "bt12_micro_batches", "rl12_batch_metrics",
    ):
        error, _ = compare(QUERIES[name](spark, sf), con, ORACLES[name])
        assert not error, (name, error)
