"""Set operations inside nested queries, scored bottom up by hand."""

import random

from sqltally.operators import metrics

OPS = ("intersect", "except", "union")


def query(rng, depth):
    """A query: its item, and the queries of its set operations."""
    parts = {op: query(rng, depth - 1) for op in OPS if depth and rng.random() < 0.4}
    return rng.choice("ab"), parts


def rows(number, side, q, path=""):
    item, parts = q
    out = [(number, side, path or "main", "select", 0, item, item), (number, side, path or "main", "table", 0, "t", "t")]
    for op, inner in parts.items():
        out += rows(number, side, inner, f"{path}/{op}" if path else op)
    return out


def exact(p, g):
    return p[0] == g[0] and p[1].keys() == g[1].keys() and all(exact(p[1][op], g[1][op]) for op in p[1])


def test_nested_set_operations_match_recursion(spark):
    rng = random.Random(6)
    cells, want, pairs = [], {}, {}
    for n in range(150):
        g = query(rng, 3)
        p = g if rng.random() < 0.5 else query(rng, 3)
        pairs[n] = p, g
        cells += rows(n, "pred", p) + rows(n, "gold", g)
        if p[1] or g[1]:
            hits = sum(op in p[1] and op in g[1] and exact(p[1][op], g[1][op]) for op in OPS)
            want[n] = len(g[1]), len(p[1]), hits
    comp = spark.createDataFrame(cells, "question_id long, side string, scope string, clause string, pos int, item string, item_no_agg string")
    got = {r.question_id: (r.label_n, r.pred_n, r.hit) for r in metrics.nested_match(comp).collect()}
    assert got == want
    overlaps = metrics.component_scores(comp, comp.select("question_id").distinct())
    whole = {r.question_id: r.exact for r in metrics.exact_match(overlaps, comp.where("clause = 'table'"))[1].collect()}
    assert whole == {n: int(exact(p, g)) for n, (p, g) in pairs.items()}


def test_a_wrong_inner_except_is_no_exact_match(spark):
    def one(c):
        return "a", {"union": ("b", {"except": (c, {})})}

    cells = rows(0, "pred", one("x")) + rows(0, "gold", one("c")) + rows(1, "pred", one("c")) + rows(1, "gold", one("c"))
    comp = spark.createDataFrame(cells, "question_id long, side string, scope string, clause string, pos int, item string, item_no_agg string")
    assert {r.question_id: r.hit for r in metrics.nested_match(comp).collect()} == {0: 0, 1: 1}
