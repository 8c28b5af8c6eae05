"""Small inputs on which plain hashing, logarithms or casts would go wrong."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.functions.cells import canonical_cell
from sqltally.operators import compare, metrics, rollout, voting


def test_null_cells_keep_their_place(spark):
    rows = [(0, 0, 0, ["s:z"]), (0, 1, 0, [None, "s:a"]), (0, 2, 0, ["s:a", None]), (0, 3, 0, ["s:z"])]
    results = spark.createDataFrame(rows, "question_id long, cand_id int, row_ix long, cells array<string>")
    candidates = spark.createDataFrame([(0, i, f"q{i}", 1) for i in range(4)], "question_id long, cand_id int, sql string, valid int")
    row = voting.majority_vote(candidates, results).first()
    assert (row.sql, row.votes) == ("q0", 2)


def test_cells_are_exact(spark):
    def cells(kind, *values):
        df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", kind)]))
        return [r[0] for r in df.select(canonical_cell(F.col("x"), kind)).collect()]

    from decimal import Decimal

    assert len(set(cells(T.LongType(), 9007199254740993, 9007199254740992))) == 2
    assert len(set(cells(T.DecimalType(38, 20), Decimal("0.12345678901234567891"), Decimal("0.12345678901234567892")))) == 2
    one = {*cells(T.IntegerType(), 1), *cells(T.DoubleType(), 1.0), *cells(T.DecimalType(10, 2), Decimal("1.00")), *cells(T.BooleanType(), True)}
    assert one == {"n:1.0"}
    assert cells(T.DoubleType(), 0.5, -0.0) == cells(T.DecimalType(10, 2), Decimal("0.50"), Decimal("0"))


def test_coefficient_follows_the_product(spark):
    steps = [(1, 0.0, 60_000), (2, 0.0, 50_000), (3, 5.0, 60_000)]
    want, at = [], 0.2
    for _, kl, n in steps:
        at *= 1 + min(0.2, max(-0.2, kl / 0.1 - 1)) * n / 10_000
        want.append(at)
    df = spark.createDataFrame(steps, "step int, kl double, n long")
    got = [r.coef for r in rollout.adaptive_coef(df, 0.2, 0.1, 10_000).orderBy("step").collect()]
    assert got == pytest.approx(want) and got[0] < 0 and got[1] == 0
    got = [r.coef for r in rollout.adaptive_coef(df.where("step <> 2"), 0.2, 0.1, 10_000).orderBy("step").collect()]
    assert got == pytest.approx([-0.04, -0.04 * 2.2])


def test_wrong_union_is_no_exact_match(spark):
    def part(side, scope, item):
        return [(1, side, scope, "select", 0, item, item), (1, side, scope, "table", 1, "t", "t")]

    layout = "question_id long, side string, scope string, clause string, pos int, item string, item_no_agg string"
    for union, exact in (("b", 1), ("c", 0), (None, 0)):
        rows = part("gold", "main", "a") + part("pred", "main", "a") + part("gold", "union", "b")
        rows += part("pred", "union", union) if union else []
        comp = spark.createDataFrame(rows, layout)
        scores = metrics.component_scores(comp, comp.select("question_id").distinct())
        assert metrics.exact_match(scores, comp.where("clause = 'table'"))[1].first().exact == exact
    assert metrics.hardness(comp.where("side = 'gold'")).first().level == "hard"


def test_a_second_run_does_not_see_the_first(spark, tmp_path):
    compare.run_pairs(spark, [(0, 0, "SELECT 1"), (7, 0, "SELECT 2")], str(tmp_path))
    candidates, rows = compare.run_pairs(spark, [(0, 0, "SELECT nope")], str(tmp_path))
    assert candidates.first().valid == 0 and rows.collect() == []
