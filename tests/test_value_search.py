"""Shared substrings are searched round the core of a value, and short values by hits, not over whole texts."""

import random

from pyspark.sql import functions as F

from sqltally.operators import prep


def longest(value, text):
    return max((k for k in range(1, len(value) + 1) if any(value[i : i + k] in text for i in range(len(value) - k + 1))), default=0)


def test_text_round_the_core_is_short_and_holds_every_match(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("aab") for _ in range(n))
    rows = [(word(rng.randint(0, 60)), word(rng.randint(1, 9))) for _ in range(300)]
    rows += [("x" * 50_000 + "one two \\Ethree four" + "y" * 50_000, "one tw. \\Ethree four"), ("\0" * 9 + "ab\0" * 4, "b\0ab\0"), ("é" * 40 + "ß", "éééß")]
    df = spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(rows)], "id int, low_q string, low string")
    df = df.withColumn("need", (F.floor(F.lit(0.85) * F.length("low")) + 1).cast("int"))
    n = F.length("low")
    df = df.withColumn("core", F.substring("low", n - F.col("need") + 1, 2 * F.col("need") - n))
    near = prep._round_core(df)
    got = {r.id: r for r in near.select("*", prep._longest_shared(F.col("low"), F.col("_near"), F.col("need")).alias("size")).collect()}
    for i, (q, v) in enumerate(rows):
        size = longest(v, q)
        assert got[i].size == (size if size >= got[i].need else 0)
    assert len(got[300]._near) < 100


def test_grams_are_found_at_their_first_place(spark):
    asked = spark.createDataFrame([(1, "Éa b a b", "éa b a b"), (2, None, None), (None, "a b", "a b"), (3, "", "")], "question_id long, question string, low_q string")
    keys = spark.createDataFrame([("a b", 7), ("b", 8), ("zz", 9), ("éa", 10)], "gram string, value_id long")
    got = sorted(prep._gram_hits(asked, keys, beyond=2).select("question_id", "gram", "at", "near", "value_id").collect())
    assert [tuple(r) for r in got] == [(1, "a b", 2, "Éa b a", 7), (1, "b", 4, " b a", 8), (1, "éa", 1, "Éa b", 10)]
