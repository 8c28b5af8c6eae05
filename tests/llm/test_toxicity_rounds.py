"""Rounds of the trees run as many tasks as their rows need, however many partitions the session shuffles into."""

import random

import pytest
from pyspark.sql import functions as F

from sqltally.llm import toxicity


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("per_task", [4_000, 50])
def test_tasks_follow_the_rows(spark, monkeypatch, many_partitions, per_task):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(300):
        toxic = int(rng.random() < 0.4)
        rows.append((i, " ".join([*rng.choices(words, k=30), *["grolb"] * (3 * toxic), str(i)]), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    seen = []
    fits = {c: c.fit for c in (toxicity.GBTClassifier, toxicity.IsotonicRegression)}
    for c, fit in fits.items():
        monkeypatch.setattr(c, "fit", lambda self, part, fit=fit: seen.append(part) or fit(self, part))
    monkeypatch.setattr(toxicity, "ROUND_ROWS", per_task)
    model = toxicity.train(docs, labels, F.lit(True))
    assert [part.rdd.getNumPartitions() for part in seen] == [-(-300 // per_task)] * 2
    assert sum(part.count() for part in seen) == 300  # every sampled row trains the trees or the curve
    assert {r.doc_id: r.score >= 0.7 for r in model.score(docs).collect()} == {i: bool(t) for i, _, t in rows}
