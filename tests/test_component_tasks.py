"""Components are scored in tasks of a bounded number of rows."""

from sqltally.operators import metrics


def test_tasks_follow_the_rows(spark, monkeypatch):
    rows = [(q, s, sc, c, p, i, i[0]) for q in range(20) for s in ("gold", "pred") for sc in ("main", "union", "union/except") for p, (c, i) in enumerate([("select", "a1"), ("table", "t"), ("order", f"o{q % 2 if s == 'gold' else 0}")])]
    comp = spark.createDataFrame(rows, "question_id long, side string, scope string, clause string, pos int, item string, item_no_agg string")
    monkeypatch.setattr(metrics, "TASK_ROWS", 100, raising=False)
    nested, scores = metrics.nested_match(comp), metrics.component_scores(comp, comp.select("question_id").distinct())
    for df, tasks in ((nested, 3), (scores, 4)):
        assert f", {tasks}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, nested.collect())) == [(q, 1, 1, 1 - q % 2) for q in range(20)]
