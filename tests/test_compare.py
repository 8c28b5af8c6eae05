import itertools
import random

import pytest
from pyspark.sql import functions as F

from sqltally.functions.canonical import canonical_order, every_order
from sqltally.functions.cells import canonical_row
from sqltally.operators import compare, voting


def tables(spark, results, pairs):
    """results: {(question, cand): [row, ...]}"""
    flat = [
        (q, c, i, [None if x is None else str(x) for x in row])
        for (q, c), rs in results.items()
        for i, row in enumerate(rs)
    ]
    res = spark.createDataFrame(flat, "question_id long, cand_id int, row_ix long, cells array<string>")
    return res, spark.createDataFrame(pairs, "question_id long, cand_id int, gold_id int")


def verdicts(df, col="equal"):
    return {r["question_id"]: r[col] for r in df.collect()}


def brute(pred, gold, ordered):
    if not pred and not gold:
        return True
    if len(pred) != len(gold) or len(pred[0]) != len(gold[0]):
        return False
    key = lambda rs: rs if ordered else sorted(rs, key=repr)
    return any(
        key([tuple(r[j] for j in perm) for r in pred]) == key([tuple(r) for r in gold])
        for perm in itertools.permutations(range(len(gold[0])))
    )


@pytest.mark.parametrize("ordered", [False, True])
def test_permuted_equal_matches_brute_force(spark, ordered):
    rng = random.Random(11)
    results, want = {}, {}
    for q in range(120):
        width, height = rng.randint(1, 4), rng.randint(0, 4)
        gold = [tuple(rng.choice([None, "a", "b"]) for _ in range(width)) for _ in range(height)]
        perm = rng.sample(range(width), width)
        pred = [tuple(r[j] for j in perm) for r in gold]
        if rng.random() < 0.5:
            rng.shuffle(pred)
        if pred and rng.random() < 0.4:
            i = rng.randrange(len(pred))
            pred[i] = tuple(rng.choice(["a", "b", "c"]) for _ in range(width))
        if rng.random() < 0.1:
            pred = pred[:-1]
        results[q, 0], results[q, 1] = gold, pred
        want[q] = brute(pred, gold, ordered)
    res, pairs = tables(spark, results, [(q, 1, 0) for q in want])
    assert verdicts(compare.permuted_equal(res, pairs, ordered)) == want
    assert set(want.values()) == {True, False}


def test_identical_columns_need_no_cap(spark):
    gold = [(str(i), *["x"] * 9) for i in range(3)]
    pred = [(*["x"] * 9, str(i)) for i in range(3)]
    res, pairs = tables(spark, {(0, 0): gold, (0, 1): pred}, [(0, 1, 0)])
    assert verdicts(compare.permuted_equal(res, pairs)) == {0: True}


@pytest.mark.parametrize("ordered", [False, True])
def test_many_flag_columns_in_fixed_passes(spark, ordered, monkeypatch):
    """Columns of equal bags but different content; the row check finds one changed cell pair."""
    rng = random.Random(3)
    columns = [rng.sample([0, 1] * 20, 40) for _ in range(24)]
    gold = list(zip(*columns))
    mixed = list(zip(*rng.sample(columns, 24)))
    torn = [list(c) for c in columns]
    a, b = torn[0].index(0), torn[0].index(1)
    torn[0][a], torn[0][b] = 1, 0
    results = {(0, 0): gold, (0, 1): mixed, (1, 0): gold, (1, 1): list(zip(*rng.sample(torn, 24)))}
    res, pairs = tables(spark, results, [(0, 1, 0), (1, 1, 0)])
    signatures = []
    whole = compare.signature
    monkeypatch.setattr(compare, "signature", lambda *c: signatures.append(c) or whole(*c))
    assert verdicts(compare.permuted_equal(res, pairs, ordered)) == {0: True, 1: False}
    assert len(signatures) < 8


def test_symmetric_results_grow_by_column(spark):
    """Unit rows look alike from every column, so colours alone decide nothing."""
    unit = [tuple(int(i == j) for j in range(5)) for i in range(5)]
    ring = [tuple(int(j in (i, (i + 1) % 6)) for j in range(6)) for i in range(6)]
    two = [tuple(int(j in (i, i // 3 * 3 + (i + 1) % 3)) for j in range(6)) for i in range(6)]
    results = {(0, 0): unit, (0, 1): unit[::-1], (1, 0): ring, (1, 1): two, (2, 0): two, (2, 1): [r[::-1] for r in two]}
    res, pairs = tables(spark, results, [(q, 1, 0) for q in range(3)])
    assert verdicts(compare.permuted_equal(res, pairs)) == {0: True, 1: False, 2: True}


def symmetric_designs():
    """Results in which many columns look alike."""
    latin = [tuple((r + j) % 5 for j in range(5)) for r in range(5)]
    blocks = [tuple(int(j == i or j == i + 3) for j in range(6)) for i in range(3)]
    even = [r for r in itertools.product((0, 1), repeat=4) if sum(r) % 2 == 0]
    odd = [r for r in itertools.product((0, 1), repeat=4) if sum(r) % 2]
    every = list(itertools.permutations("abc"))
    paired = [("a", "b", "x"), ("b", "a", "x"), ("a", "b", "y"), ("b", "a", "y")]
    klein = [(0, 1, 2, 3), (1, 0, 3, 2), (2, 3, 0, 1), (3, 2, 1, 0)]
    cycle = [(0, 1, 2, 3), (1, 2, 3, 0), (2, 3, 0, 1), (3, 0, 1, 2)]
    return [latin, blocks, even, odd, every, paired, klein, cycle, [("q",) * 4] * 2, [tuple(int(i == j) for j in range(5)) for i in range(5)]]


@pytest.mark.parametrize("weak", [False, True])
def test_symmetric_designs_match_brute_force(spark, monkeypatch, weak):
    """With ``weak`` all pairs of columns look alike, so that the rows must decide among all orders."""
    rng = random.Random(4)
    designs = symmetric_designs()
    results, want = {}, {}
    for a, b in [(k, k) for k in range(len(designs))] * 2 + list(itertools.combinations(range(len(designs)), 2)):
        q, gold, pred = len(want), designs[a], designs[b]
        perm = rng.sample(range(len(pred[0])), len(pred[0]))
        pred = [tuple(r[j] for j in perm) for r in pred]
        if rng.random() < 0.3:
            r = rng.randrange(len(pred))
            pred[r] = pred[r][::-1]
        rng.shuffle(pred)
        results[q, 0], results[q, 1], want[q] = gold, pred, brute(pred, gold, False)
    res, pairs = tables(spark, results, [(q, 1, 0) for q in want])
    if weak:
        monkeypatch.setattr(compare, "_pair_hash", lambda *c: F.count(F.lit(1)) * 0)
    assert verdicts(compare.permuted_equal(res, pairs)) == want
    assert verdicts(compare.permuted_equal(res, pairs, verify=False)) == want
    assert 10 < sum(want.values()) < len(want)


@pytest.mark.parametrize("seed", range(20))
def test_canonical_order_of_matrices(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 6)
    entries = rng.choice((1, 2, 3))
    matrix = [[rng.randrange(entries) for _ in range(n)] for _ in range(n)]
    if rng.random() < 0.5:
        matrix = [[(i - j) % n in (1, n - 1) for j in range(n)] for i in range(n)]
    face = lambda m, o: tuple(m[i][j] for i in o for j in o)
    order, group = canonical_order(matrix)
    perm = rng.sample(range(n), n)
    moved = [[matrix[perm[i]][perm[j]] for j in range(n)] for i in range(n)]
    assert face(moved, canonical_order(moved)[0]) == face(matrix, order)
    same = {p for p in itertools.permutations(range(n)) if face(matrix, p) == face(matrix, order)}
    assert {tuple(o) for o in every_order(order, group)} == same


def test_wide_symmetric_results_are_quick(spark):
    wide = [tuple(int(i == j) for j in range(40)) for i in range(40)]
    res, pairs = tables(spark, {(0, 0): wide, (0, 1): wide[::-1], (1, 0): wide, (1, 1): wide[1:] + wide[1:2]}, [(0, 1, 0), (1, 1, 0)])
    assert verdicts(compare.permuted_equal(res, pairs)) == {0: True, 1: False}


def test_set_bag_ordered(spark):
    results = {
        (0, 0): [("a",), ("b",)], (0, 1): [("b",), ("a",)],
        (1, 0): [("a",)], (1, 1): [("a",), ("a",)],
        (2, 0): [], (2, 1): [],
        (3, 0): [], (3, 1): [("a",)],
        (4, 0): [(None, "a")], (4, 1): [(None, "a")],
        (5, 0): [("a", "b")], (5, 1): [("b", "a")],
    }
    res, pairs = tables(spark, results, [(q, 1, 0) for q in range(6)])
    assert verdicts(compare.set_equal(res, pairs)) == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False}
    assert verdicts(compare.bag_equal(res, pairs)) == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}
    assert verdicts(compare.ordered_equal(res, pairs)) == {0: False, 1: False, 2: True, 3: False, 4: True, 5: False}
    assert verdicts(compare.quick_reject(res, pairs), "possible")[5] is True


def test_bag_equality_survives_row_shuffle(spark):
    rng = random.Random(5)
    gold = [(str(rng.randrange(4)), str(rng.randrange(4))) for _ in range(60)]
    pred = rng.sample(gold, len(gold))
    res, pairs = tables(spark, {(0, 0): gold, (0, 1): pred}, [(0, 1, 0)])
    assert verdicts(compare.bag_equal(res, pairs)) == {0: True}


def test_cells_compare_by_value(spark):
    a = spark.sql("SELECT 1 AS x, CAST(NULL AS STRING) AS y, -0.0D AS z")
    b = spark.sql("SELECT 1.0D AS x, CAST(NULL AS STRING) AS y, 0 AS z")
    text = spark.sql("SELECT '1' AS x")
    one, two = (d.select(canonical_row(d).alias("c")).first()["c"] for d in (a, b))
    assert one == two
    assert text.select(canonical_row(text).alias("c")).first()["c"][0] != one[0]


def test_gold_error_is_reported_or_raised(spark):
    cand = spark.createDataFrame([(0, 0, "g", 0), (0, 1, "p", 1)], "question_id long, cand_id int, sql string, valid int")
    pairs = spark.createDataFrame([(0, 1, 0)], "question_id long, cand_id int, gold_id int")
    same = pairs.withColumn("equal", F.lit(True))
    assert compare.match_status(pairs, cand, same).first()["status"] == "Gold Error"
    with pytest.raises(Exception, match="gold query failed"):
        compare.match_status(pairs, cand, same, on_gold_error="raise").collect()


def test_majority_vote_ties_empties_and_bags(spark):
    results = {(0, 0): [("a",)], (0, 1): [("b",)], (0, 2): [("b",), ("b",)], (1, 0): [], (1, 1): []}
    res, _ = tables(spark, results, [(0, 1, 0)])
    rows = [(q, c, f"s{c}", 1) for q in (0, 1) for c in range(3) if (q, c) in results]
    rows += [(2, 0, "bad0", 0), (2, 1, "bad1", 0)]
    cand = spark.createDataFrame(rows, "question_id long, cand_id int, sql string, valid int")
    got = {r.question_id: (r.sql, r.votes) for r in voting.vote(cand, res, policy="error").collect()}
    assert got == {0: ("s1", 2), 1: ("s0", 2), 2: ("Error SQL", 0)}
    bag = {r.question_id: (r.sql, r.votes) for r in voting.majority_vote(cand, res, bag=True, verify=True).collect()}
    assert bag[0] == ("s0", 1)
    picks = {r.sql for r in voting.vote_fallback(cand, seed=7).collect()}
    assert picks <= {"bad0", "bad1"} and len(picks) == 1


def test_run_pairs_marks_failures_and_keeps_order(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("five")
    statements = [
        (0, 0, "SELECT id FROM five ORDER BY id DESC;"),
        (0, 1, "SELECT nope FROM five"),
        (0, 2, "DROP VIEW five"),
        (0, 3, "SELECT id FROM five WHERE id > 99"),
    ]
    cand, res = compare.run_pairs(spark, statements, str(tmp_path / "rows"))
    assert {r.cand_id: r.valid for r in cand.collect()} == {0: 1, 1: 0, 2: 0, 3: 1}
    first = [r.cells[0] for r in res.where("cand_id = 0").orderBy("row_ix").collect()]
    assert first == [f"n:{i}.0" for i in (4, 3, 2, 1, 0)]
    assert spark.table("five").count() == 5


def test_slow_statement_times_out(spark, tmp_path):
    slow = "SELECT sum(a.id * b.id) AS s FROM range(2000000) a JOIN range(2000000) b ON a.id % 3 = b.id % 3"
    cand, res = compare.run_pairs(
        spark, [(0, 1, "SELECT 1 AS x"), (0, 0, slow)], str(tmp_path / "slow"), timeout=10, parallelism=1
    )
    assert {r.cand_id: r.valid for r in cand.collect()} == {0: 0, 1: 1}
    assert {r.cand_id for r in res.collect()} == {1}
