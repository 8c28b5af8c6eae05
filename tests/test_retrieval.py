"""Pruned top-k retrieval against plain BM25 over all pairs."""

import math
import random
from collections import Counter

import pytest

from sqltally.operators import prep


def tables(spark, rng, n_queries, n_values, hot, words=400):
    def text(n):
        return " ".join([*([hot] if hot else []), *(f"w{min(int(rng.paretovariate(0.6)), words)}" for _ in range(n))])

    queries = [(q, text(rng.randint(1, 6))) for q in range(n_queries)]
    values = [(v, text(rng.randint(1, 12))) for v in range(n_values)]
    values += [(n_values + v, values[v][1]) for v in range(5)] + [(n_values + 9, "")]
    return queries, values, spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(values, "value_id long, text string")


def plain(queries, values, k, k1=0.9, b=0.4):
    unique = {}
    for v, text in values:
        unique[text] = min(v, unique.get(text, v))
    bags = {v: Counter(text.split()) for text, v in unique.items() if text}
    mean = sum(sum(c.values()) for c in bags.values()) / len(bags)
    df = Counter(t for c in bags.values() for t in c)
    out = {}
    for q, text in queries:
        scores = []
        for v, bag in bags.items():
            s = 0.0
            for t, n in Counter(text.split()).items():
                if t in bag:
                    tf = bag[t]
                    idf = math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5))
                    s += n * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sum(bag.values()) / mean))
            if s > 0:
                scores.append((-round(s, 9), v))
        out[q] = [v for _, v in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("hot", ["", "every"])
@pytest.mark.parametrize("k", [1, 10])
def test_pruned_topk_equals_all_pairs(spark, hot, k):
    rng = random.Random(len(hot) + k)
    queries, values, q, v = tables(spark, rng, 60, 300, hot)
    got = {}
    for r in sorted(prep.retrieve_topk(q, v, k).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.value_id)
    assert got == {q: vs for q, vs in plain(queries, values, k).items() if vs}


def test_a_token_of_every_value_costs_little(spark):
    rng = random.Random(2)
    queries = [(q, f"every common a{q % 40} b{q % 70}") for q in range(80)]
    values = [(v, f"every common a{v % 40} b{v % 70} c{rng.randrange(999)}") for v in range(3000)]
    q, v = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(values, "value_id long, text string")
    (r,) = prep.retrieval_rows(q, v, 10).collect()
    assert r.joined_rows * 10 < r.all_rows
