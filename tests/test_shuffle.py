"""The keyed shuffle of mini-batches is a bijection that mixes."""

import pytest
from pyspark.sql import functions as F

from sqltally.operators import batching


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_every_epoch_is_a_bijection(spark, n):
    df = spark.range(n).withColumnRenamed("id", "ordinal")
    rows = batching.minibatches(df, 1, 3, seed=5).collect()
    for epoch in range(3):
        assert sorted(r.position for r in rows if r.epoch == epoch) == list(range(n))
    again = batching.minibatches(df.repartition(5), 1, 3, seed=5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_shuffles_mix_and_differ(spark):
    n = 20_000
    df = spark.range(n).withColumnRenamed("id", "ordinal")
    wide = {(r.epoch, r.ordinal): r.position for r in batching.minibatches(df, 1, 2, seed=1).collect()}
    for epoch in range(2):
        places = [wide[epoch, k] for k in range(n)]
        neighbours = sum(abs(a - b) < n / 100 for a, b in zip(places, places[1:])) / n
        assert 0.01 < neighbours < 0.03  # 0.02 by chance
        mean = n / 2
        related = sum((k - mean) * (p - mean) for k, p in enumerate(places)) / sum((k - mean) ** 2 for k in range(n))
        assert abs(related) < 0.05
    assert sum(wide[0, k] == wide[1, k] for k in range(n)) < 20


def test_rounds_run_in_many_tasks(spark):
    df = spark.range(2000).withColumnRenamed("id", "ordinal").coalesce(1)
    parts = batching.minibatches(df, 10, 3, seed=5).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 4 and max(p["count"] for p in parts) < 3000
