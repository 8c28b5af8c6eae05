"""Groups of similar total length: differencing against all splits, ranges against whole batches."""

import itertools
import random

import numpy as np
import pytest

from sqltally.functions import differencing
from sqltally.operators import batching


def spread(groups, lengths, k):
    sums = np.bincount(groups, lengths, k)
    return int(sums.max() - sums.min())


def least_spread(lengths, k, equal):
    splits = itertools.product(range(k), repeat=len(lengths))
    return min(spread(np.array(s), lengths, k) for s in splits if not equal or all(s.count(g) * k == len(s) for g in range(k)))


@pytest.mark.parametrize("seed", range(30))
def test_small_batches_get_the_least_spread(seed):
    rng = random.Random(seed)
    k, equal = rng.choice((2, 3)), rng.random() < 0.5
    n = k * rng.randint(0, 2 + (k == 2)) if equal else rng.randint(0, 7)
    lengths = np.array(sorted((rng.randrange(30) for _ in range(n)), reverse=True), np.int64)
    groups = differencing.best_split(lengths, k, equal)
    assert len(groups) == n and spread(groups, lengths, k) == (least_spread(lengths, k, equal) if n else 0)


def heaps(states):
    """Largest differencing with plain lists: two states of largest spread merge."""
    states = [(sorted(s, reverse=True), n) for n, s in enumerate(states)]
    made = len(states)
    while len(states) > 1:
        states.sort(key=lambda s: (s[0][-1] - s[0][0], -s[0][0], s[1]))
        (a, _), (b, _), *rest = states
        states = [*rest, (sorted((x + y for x, y in zip(a, b[::-1])), reverse=True), made)]
        made += 1
    return states[0][0]


@pytest.mark.parametrize("seed", range(30))
def test_differencing_equals_plain_lists(seed):
    rng = random.Random(seed)
    k, equal = rng.randint(1, 6), rng.random() < 0.5
    n = k * rng.randint(1, 30) if equal else rng.randint(1, 90)
    lengths = np.array(sorted((int(rng.paretovariate(1) * 10) for _ in range(n)), reverse=True), np.int64)
    groups, sums, dealt = differencing.split(lengths, k, equal)
    assert sorted(np.bincount(groups, lengths, k), reverse=True) == sums.tolist()
    states = lengths.reshape(-1, k).tolist() if equal else [[x] + [0] * (k - 1) for x in lengths.tolist()]
    assert sums.tolist() == heaps(states)
    assert dealt.tolist() == np.bincount(differencing.dealt(n, k), lengths, k).tolist()
    if equal:
        assert set(np.bincount(groups, minlength=k)) == {n // k}


def batches(spark, seed, k, sizes):
    rng = random.Random(seed)
    rows = [(b, key, rng.choice((0, 1, int(rng.paretovariate(0.7) * 20) % 5000, rng.randrange(900))), "x") for b, n in sizes for key in range(n)]
    return rows, spark.createDataFrame(rows, "b string, key int, n int, other string").repartition(3)


@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("range_rows, ranges", [(32_768, 1024), (12, 3), (24, 1024), (1, 2)])
def test_ranges_never_do_worse_than_dealing(spark, equal, range_rows, ranges):
    k = 4
    rows, df = batches(spark, 7, k, [("a", 400), ("b", 4), (None, 60), ("c", 48), ("d", 8)])
    got = batching.balanced_groups(df, "b", "n", k, "key", equal, range_rows, ranges).collect()
    assert sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(map(str, rows))
    assert set(got[0].asDict()) == {"b", "key", "n", "other", "group"}
    for b in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.b == b), key=lambda r: (-r.n, r.key))
        lengths, groups = np.array([r.n for r in mine]), np.array([r.group for r in mine])
        assert spread(groups, lengths, k) <= spread(differencing.dealt(len(mine), k), lengths, k)
        if equal:
            assert set(np.bincount(groups, minlength=k)) == {len(mine) // k}
        if len(mine) <= min(10, max(range_rows, k)):
            assert spread(groups, lengths, k) == least_spread(lengths, k, equal)


def test_uneven_batches_fail_and_lengths_may_be_null(spark):
    _, df = batches(spark, 1, 3, [("a", 7)])
    with pytest.raises(Exception, match="equal groups"):
        batching.balanced_groups(df, "b", "n", 3, "key").collect()
    nulls = spark.createDataFrame([("a", k, None) for k in range(6)], "b string, key int, n int")
    got = batching.balanced_groups(nulls, "b", "n", 3, "key").collect()
    assert sorted(r.group for r in got) == [0, 0, 1, 1, 2, 2]
    assert batching.balanced_groups(nulls.limit(0), "b", "n", 3, "key").collect() == []


@pytest.mark.parametrize("range_rows", [32_768, 64])
def test_many_micro_batches_in_shards(spark, monkeypatch, range_rows):
    monkeypatch.setattr(batching, "SHARD_GROUPS", 8)
    rows, df = batches(spark, 3, 1, [("a", 900), ("b", 30), ("c", 1)])
    got = batching.micro_batches(df, "b", "n", 5000, "key", range_rows, 3).collect()
    assert len(got) == len(rows)
    for b in "abc":
        mine = sorted((r for r in got if r.b == b), key=lambda r: (-r.n, r.key))
        lengths, groups = np.array([r.n for r in mine]), np.array([r.micro for r in mine])
        k = max(1, -(-int(lengths.sum()) // 5000))
        assert groups.min() >= 0 and groups.max() < k
        assert k > 20 or b != "a"
        dealt = np.bincount(differencing.dealt(len(mine), k), lengths, k)
        sums = np.bincount(groups, lengths, k)
        assert sums.max() - sums.min() <= dealt.max() - dealt.min()
