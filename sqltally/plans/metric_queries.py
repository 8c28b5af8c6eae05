"""Accuracy, efficiency, component and session metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltally.operators import metrics
from sqltally.plans.registry import query
from sqltally.plans.views import table

# --- questions scored from orders: difficulty = priority, correct = a price predicate -----------


def orders_scored(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_id"),
        F.col("o_orderpriority").alias("difficulty"),
        (F.col("o_totalprice") > 150000).cast("int").alias("correct"),
    )


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


ORDERS = """scored AS (
  SELECT o_orderkey AS question_id, o_orderpriority AS difficulty,
         CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS correct FROM orders)"""


@query(
    "mt2_accuracy_by_level",
    f"""WITH {ORDERS}
SELECT coalesce(difficulty, 'total') AS difficulty, count(*) AS n, round(avg(correct), 6) AS accuracy
FROM scored GROUP BY ROLLUP (difficulty)""",
)
def accuracy_by_level(spark, sf):
    return _round(metrics.accuracy_by_level(orders_scored(spark, sf), "difficulty"), "accuracy")


@query(
    "mt3_trimmed_mean",
    """WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1)
SELECT e.user_id, round(avg(CASE WHEN abs(value - m) < 3 * sd THEN value END), 8) AS mean
FROM events e JOIN s USING (user_id) GROUP BY 1""",
)
def trimmed_mean(spark, sf):
    return _round(metrics.trimmed_mean(table(spark, sf, "events"), ["user_id"], "value"), "mean", digits=8)


@query(
    "mt4_efficiency_score",
    """WITH t AS (
  SELECT l_orderkey AS q, l_quantity / (10 + 100 * l_tax) AS ratio FROM lineitem),
s AS (SELECT q, avg(ratio) AS m, stddev_pop(ratio) AS sd, min(ratio) = max(ratio) AS flat FROM t GROUP BY 1),
r AS (
  SELECT t.q, avg(CASE WHEN flat OR abs(ratio - m) < 3 * sd THEN ratio END) AS mean
  FROM t JOIN s USING (q) GROUP BY 1),
scored AS (
  SELECT o_orderpriority AS difficulty,
         CASE WHEN o_totalprice > 150000 THEN sqrt(coalesce(mean, 0)) ELSE 0 END AS score
  FROM orders LEFT JOIN r ON q = o_orderkey)
SELECT coalesce(difficulty, 'total') AS difficulty, count(*) AS n, round(avg(score) * 100, 4) AS score
FROM scored GROUP BY ROLLUP (difficulty)""",
)
def efficiency_score(spark, sf):
    """Question = order, one timing per line: quantity over a tax-derived time."""
    timings = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_id"),
        F.col("l_quantity").alias("gold_s"),
        (10 + 100 * F.col("l_tax")).alias("pred_s"),
    )
    scored = metrics.efficiency_score(timings, orders_scored(spark, sf), "difficulty")
    return _round(scored, "score", digits=4)


# --- components from lineitem --------------------------------------------------------------------
# question = order, side = parity of the line number, clause by return flag and shipping quarter


CLAUSES = ["select", "where", "group", "having", "order", "limit", "connective", "keyword", "table", "nested", "agg", "op"]


def components(spark, sf, scopes=False, mixed=False):
    """``scopes``: set operations only; ``mixed``: a third of the lines of every fifth order in one of them."""
    li = table(spark, sf, "lineitem")
    n = F.element_at(
        F.array(*[F.lit(c) for c in CLAUSES]), (F.col("l_partkey") % 12 + 1).cast("int")
    )
    item = (
        F.when(n == "connective", F.when(F.col("l_suppkey") % 2 == 0, "or").otherwise("and"))
        .when(n == "op", F.when(F.col("l_suppkey") % 2 == 0, "like").otherwise("="))
        .when(n == "group", F.concat(F.lit("t"), (F.col("l_suppkey") % 2).cast("string"), F.lit("."), F.col("l_linestatus")))
        .otherwise(F.concat("l_linestatus", F.lit("-"), F.floor(F.col("l_quantity") / 25).cast("string")))
    )
    scope = F.element_at(
        F.array(*[F.lit(s) for s in ("intersect", "except", "union")]), (F.col("l_suppkey") % 3 + 1).cast("int")
    )
    if mixed:
        scope = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_suppkey") % 3 == 1), "union").otherwise("main")
        scopes = True
    # question = a run of lines of one order; the line number places items within a clause
    return li.select(
        F.col("l_orderkey").alias("question_id"),
        F.when(F.col("l_linenumber") % 2 == 1, "gold").otherwise("pred").alias("side"),
        (scope if scopes else F.lit("main")).alias("scope"),
        n.alias("clause"),
        F.col("l_linenumber").alias("pos"),
        item.alias("item"),
        F.col("l_linestatus").alias("item_no_agg"),
    )


COMPONENTS = """comp AS (
  SELECT l_orderkey AS question_id, CASE WHEN l_linenumber % 2 = 1 THEN 'gold' ELSE 'pred' END AS side,
         ['intersect','except','union'][l_suppkey % 3 + 1] AS scope,
         CASE WHEN l_orderkey % 5 = 0 AND l_suppkey % 3 = 1 THEN 'union' ELSE 'main' END AS mixed, cl AS clause, l_linenumber AS pos,
         CASE cl WHEN 'connective' THEN CASE WHEN l_suppkey % 2 = 0 THEN 'or' ELSE 'and' END
                 WHEN 'op' THEN CASE WHEN l_suppkey % 2 = 0 THEN 'like' ELSE '=' END
                 WHEN 'group' THEN 't' || (l_suppkey % 2) || '.' || l_linestatus
                 ELSE l_linestatus || '-' || CAST(floor(l_quantity / 25) AS BIGINT) END AS item,
         l_linestatus AS item_no_agg
  FROM (SELECT *, ['select','where','group','having','order','limit','connective','keyword','table','nested','agg','op'][l_partkey % 12 + 1] AS cl FROM lineitem))"""


def _hits(clause: str, item: str, where: str = "") -> str:
    return f"""(SELECT question_id, sum(least(p, g)) AS hit, sum(p) AS pred_n, sum(g) AS label_n FROM (
    SELECT question_id, {item} AS i, count(*) FILTER (side = 'pred') AS p, count(*) FILTER (side = 'gold') AS g
    FROM comp WHERE clause = '{clause}' {where} GROUP BY 1, 2) GROUP BY 1)"""


CAST_N = "CAST(label_n AS BIGINT) AS label_n, CAST(pred_n AS BIGINT) AS pred_n, CAST(hit AS BIGINT) AS hit"


@query(
    "mt5_hardness",
    f"""WITH {COMPONENTS}, n AS (
  SELECT question_id,
         count(*) FILTER (mixed = 'main' AND clause = 'where') AS w, count(*) FILTER (mixed = 'main' AND clause = 'group') AS gr,
         count(*) FILTER (mixed = 'main' AND clause = 'order') AS o, count(*) FILTER (mixed = 'main' AND clause = 'limit') AS l,
         count(*) FILTER (mixed = 'main' AND clause = 'table') AS t, count(*) FILTER (mixed = 'main' AND clause = 'select') AS s,
         count(*) FILTER (mixed = 'main' AND clause = 'nested') AS ne, count(DISTINCT mixed) FILTER (mixed <> 'main') AS sc, count(*) FILTER (mixed = 'main' AND clause = 'agg') AS a,
         count(*) FILTER (mixed = 'main' AND clause = 'connective' AND item = 'or') AS orr,
         count(*) FILTER (mixed = 'main' AND clause = 'op' AND item = 'like') AS lk
  FROM comp GROUP BY 1),
c AS (SELECT question_id, greatest(ne, sc) AS n2,
        CAST(w > 0 AS INT) + CAST(gr > 0 AS INT) + CAST(o > 0 AS INT) + CAST(l > 0 AS INT)
        + greatest(t - 1, 0) + orr + lk AS c1,
        CAST(a > 1 AS INT) + CAST(s > 1 AS INT) + CAST(w > 1 AS INT) + CAST(gr > 1 AS INT) AS c3 FROM n)
SELECT question_id, CASE
  WHEN c1 <= 1 AND c3 = 0 AND n2 = 0 THEN 'easy'
  WHEN n2 = 0 AND ((c3 <= 2 AND c1 <= 1) OR (c1 <= 2 AND c3 < 2)) THEN 'medium'
  WHEN (n2 = 0 AND c3 > 2 AND c1 <= 2) OR (n2 = 0 AND c1 > 2 AND c1 <= 3 AND c3 <= 2) OR (c1 <= 1 AND c3 = 0 AND n2 <= 1) THEN 'hard'
  ELSE 'extra' END AS level
FROM c""",
)
def hardness(spark, sf):
    return metrics.hardness(components(spark, sf, mixed=True)).select("question_id", "level")


@query(
    "mt6_component_overlap",
    f"""WITH {COMPONENTS}
SELECT a.question_id, {CAST_N.replace('label_n AS', 'a.label_n AS').replace('pred_n AS', 'a.pred_n AS').replace('hit AS', 'a.hit AS')}, CAST(b.hit AS BIGINT) AS hit_loose
FROM {_hits('select', 'item')} a JOIN {_hits('select', 'item_no_agg')} b USING (question_id)""",
)
def component_overlap(spark, sf):
    return metrics.component_overlap(components(spark, sf), "select")


@query(
    "mt7_group_overlap",
    f"""WITH {COMPONENTS} SELECT question_id, {CAST_N} FROM {_hits('group', "split_part(item, '.', 2)")}""",
)
def group_overlap(spark, sf):
    return metrics.group_overlap(components(spark, sf))




def fewer_clauses(spark, sf):
    """Components folded to four clauses and pairwise positions, so whole clauses can agree."""
    return components(spark, sf).withColumns(
        {
            "clause": F.when(F.col("clause").isin("select", "where", "group"), "group")
            .when(F.col("clause").isin("having", "op", "agg"), "having")
            .when(F.col("clause").isin("limit", "nested"), "limit")
            .otherwise("order"),
            "pos": F.floor((F.col("pos") - 1) / 2),
            "item": F.col("item_no_agg"),
        }
    )


FEWER = (
    COMPONENTS
    + """, comp2 AS (
  SELECT question_id, side, scope,
         CASE WHEN clause IN ('select','where','group') THEN 'group' WHEN clause IN ('having','op','agg') THEN 'having'
              WHEN clause IN ('limit','nested') THEN 'limit' ELSE 'order' END AS clause,
         (pos - 1) // 2 AS pos, item_no_agg AS item FROM comp),
ls AS (
  SELECT question_id,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'order' AND side = 'pred') AS op,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'order' AND side = 'gold') AS og,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'group' AND side = 'pred') AS gp,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'group' AND side = 'gold') AS gg,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'having' AND side = 'pred') AS hp,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'having' AND side = 'gold') AS hg,
         count(*) FILTER (clause = 'limit' AND side = 'pred') AS lp,
         count(*) FILTER (clause = 'limit' AND side = 'gold') AS lg
  FROM comp2 GROUP BY 1)"""
)


@query(
    "mt8_order_equal",
    f"""WITH {FEWER}
SELECT question_id, CAST(og IS NOT NULL AS INTEGER) AS label_n, CAST(op IS NOT NULL AS INTEGER) AS pred_n,
       CAST(og IS NOT NULL AND og IS NOT DISTINCT FROM op AND ((lp > 0) = (lg > 0)) AS INTEGER) AS hit
FROM ls WHERE og IS NOT NULL OR op IS NOT NULL OR lp > 0 OR lg > 0""",
)
def order_equal(spark, sf):
    return metrics.clause_equal(fewer_clauses(spark, sf), "order")


@query(
    "mt8_having_equal",
    f"""WITH {FEWER}
SELECT question_id, CAST(gg IS NOT NULL AS INTEGER) AS label_n, CAST(gp IS NOT NULL AS INTEGER) AS pred_n,
       CAST(gg IS NOT NULL AND gg IS NOT DISTINCT FROM gp AND hg IS NOT DISTINCT FROM hp AS INTEGER) AS hit
FROM ls WHERE gg IS NOT NULL OR gp IS NOT NULL OR hg IS NOT NULL OR hp IS NOT NULL""",
)
def having_equal(spark, sf):
    return metrics.clause_equal(fewer_clauses(spark, sf), "having")


@query(
    "mt9_connective_match",
    f"""WITH {COMPONENTS}, s AS (
  SELECT question_id, list(DISTINCT item ORDER BY item) FILTER (side = 'pred') AS p,
         list(DISTINCT item ORDER BY item) FILTER (side = 'gold') AS g
  FROM comp WHERE clause = 'connective' GROUP BY 1)
SELECT question_id,
       CAST(CASE WHEN p IS NOT DISTINCT FROM g THEN 1 ELSE coalesce(len(p), 0) END AS BIGINT) AS label_n,
       CAST(CASE WHEN p IS NOT DISTINCT FROM g THEN 1 ELSE coalesce(len(g), 0) END AS BIGINT) AS pred_n,
       CAST(p IS NOT DISTINCT FROM g AS BIGINT) AS hit FROM s""",
)
def connective_match(spark, sf):
    return metrics.connective_match(components(spark, sf))


@query(
    "mt9_keyword_match",
    f"""WITH {COMPONENTS}, k AS (SELECT DISTINCT question_id, side, item FROM comp WHERE clause = 'keyword')
SELECT question_id, CAST(sum(g) AS BIGINT) AS label_n, CAST(sum(p) AS BIGINT) AS pred_n, CAST(sum(least(p, g)) AS BIGINT) AS hit
FROM (SELECT question_id, item, count(*) FILTER (side = 'pred') AS p, count(*) FILTER (side = 'gold') AS g FROM k GROUP BY 1, 2)
GROUP BY 1""",
)
def keyword_match(spark, sf):
    return metrics.keyword_match(components(spark, sf))


def nested_components(spark, sf):
    """Set-operation scopes with two clauses, so nested queries can match exactly."""
    return components(spark, sf, scopes=True).withColumns(
        {
            "clause": F.when(F.col("clause").isin("select", "where", "group", "having", "order", "limit"), "select").otherwise("table"),
            "item": F.col("item_no_agg"),
        }
    )


@query(
    "mt10_nested_match",
    f"""WITH {COMPONENTS}, c AS (
  SELECT question_id, scope, side, CASE WHEN clause IN ('select','where','group','having','order','limit') THEN 'select' ELSE 'table' END AS clause, item_no_agg AS item FROM comp),
ls AS (
  SELECT question_id, scope,
         list(item ORDER BY item) FILTER (side = 'pred' AND clause = 'select') AS sp,
         list(item ORDER BY item) FILTER (side = 'gold' AND clause = 'select') AS sg,
         list(item ORDER BY item) FILTER (side = 'pred' AND clause = 'table') AS tp,
         list(item ORDER BY item) FILTER (side = 'gold' AND clause = 'table') AS tg,
         max(CAST(side = 'pred' AS INT)) AS p, max(CAST(side = 'gold' AS INT)) AS g
  FROM c GROUP BY 1, 2)
SELECT question_id, CAST(sum(g) AS BIGINT) AS label_n, CAST(sum(p) AS BIGINT) AS pred_n,
       CAST(sum(CASE WHEN p = 1 AND g = 1 AND sp IS NOT DISTINCT FROM sg AND (tg IS NULL OR tp IS NOT DISTINCT FROM tg) THEN 1 ELSE 0 END) AS BIGINT) AS hit
FROM ls GROUP BY 1""",
)
def nested_match(spark, sf):
    return metrics.nested_match(nested_components(spark, sf))


@query(
    "mt10_nested_depth",
    f"""WITH {COMPONENTS}, c AS (
  SELECT question_id, scope || CASE WHEN pos >= 6 THEN '/except/union' WHEN pos >= 4 THEN '/except' ELSE '' END AS path, side,
    CASE WHEN clause IN ('select','where','group','having','order','limit') THEN 'select' ELSE 'table' END AS clause, item_no_agg AS item FROM comp),
ls AS (
  SELECT question_id, path,
         list(item ORDER BY item) FILTER (side = 'pred' AND clause = 'select') AS sp,
         list(item ORDER BY item) FILTER (side = 'gold' AND clause = 'select') AS sg,
         list(item ORDER BY item) FILTER (side = 'pred' AND clause = 'table') AS tp,
         list(item ORDER BY item) FILTER (side = 'gold' AND clause = 'table') AS tg,
         max(CAST(side = 'pred' AS INT)) AS p, max(CAST(side = 'gold' AS INT)) AS g
  FROM c GROUP BY 1, 2),
own AS (SELECT *, p = 1 AND g = 1 AND sp IS NOT DISTINCT FROM sg AND (tg IS NULL OR tp IS NOT DISTINCT FROM tg) AS same FROM ls),
roots AS (SELECT question_id, split_part(path, '/', 1) AS root, max(g) AS g, max(p) AS p, bool_and(same) AS same FROM own GROUP BY 1, 2)
SELECT question_id, CAST(sum(g) AS BIGINT) AS label_n, CAST(sum(p) AS BIGINT) AS pred_n, CAST(sum(CAST(same AS INT)) AS BIGINT) AS hit FROM roots GROUP BY 1""",
)
def nested_depth(spark, sf):
    """Set operations inside set operations: later lines go one or two levels down."""
    deeper = F.when(F.col("pos") >= 6, "/except/union").when(F.col("pos") >= 4, "/except").otherwise("")
    return metrics.nested_match(nested_components(spark, sf).withColumn("scope", F.concat("scope", deeper)))


def _flat_sql(source: str, tag: str, last: str = "") -> str:
    """Nine components of the queries in ``source``, as relations ending in ``tag``."""
    hits = lambda clause, item: _hits(clause, item).replace("FROM comp", f"FROM {source}")
    return f"""
q{tag} AS (SELECT DISTINCT question_id FROM {source}),
lists{tag} AS (
  SELECT question_id,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'order' AND side = 'pred') AS op,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'order' AND side = 'gold') AS og,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'group' AND side = 'pred') AS gp,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'group' AND side = 'gold') AS gg,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'having' AND side = 'pred') AS hp,
         list((pos, item) ORDER BY pos, item) FILTER (clause = 'having' AND side = 'gold') AS hg,
         count(*) FILTER (clause = 'limit' AND side = 'pred') AS lp,
         count(*) FILTER (clause = 'limit' AND side = 'gold') AS lg
  FROM {source} GROUP BY 1),
raw{tag} AS (
  SELECT question_id, 'select' AS component, label_n, pred_n, hit FROM {hits('select', 'item')}
  UNION ALL SELECT question_id, 'select(no AGG)', label_n, pred_n, hit FROM {hits('select', 'item_no_agg')}
  UNION ALL SELECT question_id, 'where', label_n, pred_n, hit FROM {hits('where', 'item')}
  UNION ALL SELECT question_id, 'where(no OP)', label_n, pred_n, hit FROM {hits('where', 'item_no_agg')}
  UNION ALL SELECT question_id, 'group(no Having)', label_n, pred_n, hit FROM {hits('group', "split_part(item, '.', 2)")}
  UNION ALL SELECT question_id, 'group', CAST(gg IS NOT NULL AS INT), CAST(gp IS NOT NULL AS INT),
    CAST(gg IS NOT NULL AND gg IS NOT DISTINCT FROM gp AND hg IS NOT DISTINCT FROM hp AS INT) FROM lists{tag}
  UNION ALL SELECT question_id, 'order', CAST(og IS NOT NULL AS INT), CAST(op IS NOT NULL AS INT),
    CAST(og IS NOT NULL AND og IS NOT DISTINCT FROM op AND ((lp > 0) = (lg > 0)) AS INT) FROM lists{tag}
  UNION ALL SELECT question_id, 'and/or',
    CASE WHEN p IS NOT DISTINCT FROM g THEN 1 ELSE coalesce(len(p), 0) END,
    CASE WHEN p IS NOT DISTINCT FROM g THEN 1 ELSE coalesce(len(g), 0) END, CAST(p IS NOT DISTINCT FROM g AS INT)
    FROM (SELECT question_id, list(DISTINCT item ORDER BY item) FILTER (side = 'pred') AS p,
                 list(DISTINCT item ORDER BY item) FILTER (side = 'gold') AS g
          FROM {source} WHERE clause = 'connective' GROUP BY 1)
  UNION ALL SELECT question_id, 'keywords', sum(g), sum(p), sum(least(p, g)) FROM (
    SELECT question_id, item, count(DISTINCT item) FILTER (side = 'pred') AS p, count(DISTINCT item) FILTER (side = 'gold') AS g
    FROM {source} WHERE clause = 'keyword' GROUP BY 1, 2) GROUP BY 1),
grid{tag} AS (
  SELECT question_id, component FROM q{tag} CROSS JOIN (SELECT unnest(['select','select(no AGG)','where','where(no OP)',
    'group(no Having)','group','order','and/or','keywords']) AS component)),
overlap{tag} AS (
  SELECT g.question_id, g.component,
         coalesce(label_n, CASE WHEN g.component = 'and/or' THEN 1 ELSE 0 END) AS label_n,
         coalesce(pred_n, CASE WHEN g.component = 'and/or' THEN 1 ELSE 0 END) AS pred_n,
         coalesce(hit, CASE WHEN g.component = 'and/or' THEN 1 ELSE 0 END) AS hit
  FROM grid{tag} g LEFT JOIN raw{tag} r ON r.question_id = g.question_id AND r.component = g.component),
part{tag} AS (
  SELECT question_id, component, label_n, pred_n,
         CASE WHEN label_n = pred_n AND hit = pred_n THEN 1 ELSE 0 END AS f1 FROM overlap{tag}{last})
"""


#: Main query and nested queries are scored alike; a nested query is known by question and scope.
SCORES = f"""main AS (SELECT * FROM comp WHERE mixed = 'main'),
inner_ AS (SELECT * REPLACE (question_id * 10 + 1 AS question_id) FROM comp WHERE mixed <> 'main'),
{_flat_sql('inner_', '_in')},
tables_in AS (
  SELECT question_id, list(item ORDER BY item) FILTER (side = 'gold') AS g, list(item ORDER BY item) FILTER (side = 'pred') AS p
  FROM inner_ WHERE clause = 'table' GROUP BY 1),
sides AS (SELECT question_id, max(CAST(side = 'gold' AS INT)) AS g, max(CAST(side = 'pred' AS INT)) AS p FROM inner_ GROUP BY 1),
iuen AS (
  SELECT s.question_id // 10 AS question_id, 'IUEN' AS component, s.g AS label_n, s.p AS pred_n,
         CASE WHEN s.g = 1 AND s.p = 1 AND e.f = 1 AND (t.g IS NULL OR t.g IS NOT DISTINCT FROM t.p) THEN 1 ELSE 0 END AS hit
  FROM sides s JOIN (SELECT question_id, min(f1) AS f FROM part_in GROUP BY 1) e USING (question_id)
  LEFT JOIN tables_in t USING (question_id)),
{_flat_sql('main', '', """
  UNION ALL SELECT q.question_id, 'IUEN', coalesce(label_n, 0), coalesce(pred_n, 0),
         CASE WHEN coalesce(label_n, 0) = coalesce(pred_n, 0) AND coalesce(hit, 0) = coalesce(pred_n, 0) THEN 1 ELSE 0 END
  FROM (SELECT DISTINCT question_id FROM comp) q LEFT JOIN iuen USING (question_id)""").replace("q AS (SELECT DISTINCT question_id FROM main)", "q AS (SELECT DISTINCT question_id FROM comp)")}
"""


def _scores(spark, sf):
    comp = components(spark, sf, mixed=True)
    questions = comp.select("question_id").distinct()
    return comp, metrics.component_scores(comp, questions)


@query(
    "mt12_exact_match",
    f"""WITH {COMPONENTS}, {SCORES}, tab AS (
  SELECT question_id, list(item ORDER BY item) FILTER (side = 'gold') AS g, list(item ORDER BY item) FILTER (side = 'pred') AS p
  FROM main WHERE clause = 'table' GROUP BY 1)
SELECT e.question_id, CAST(CASE WHEN tab.g IS NULL OR tab.g IS NOT DISTINCT FROM tab.p THEN e.f ELSE 0 END AS INTEGER) AS exact
FROM (SELECT question_id, min(f1) AS f FROM part GROUP BY 1) e LEFT JOIN tab USING (question_id)""",
)
def exact_match(spark, sf):
    comp, overlaps = _scores(spark, sf)
    return metrics.exact_match(overlaps, comp.where("clause = 'table'"))[1]


@query(
    "mt13_canonicalize",
    """SELECT n_regionkey AS column_id, count(*) AS n, count(DISTINCT c_mktsegment) AS items
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
)
def canonicalize(spark, sf):
    """Nation ids stand for columns, their region for the root of a foreign-key group."""
    comp = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("question_id"),
        F.col("c_nationkey").alias("column_id"),
        F.col("c_mktsegment").alias("item"),
        F.col("c_name").alias("value"),
        (F.col("c_acctbal") > 0).alias("is_distinct"),
    )
    key_map = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("column_id"), F.col("n_regionkey").alias("root_id")
    )
    out = metrics.canonicalize_components(comp, key_map)
    masked = out.where(F.col("value").isNull() & F.col("is_distinct").isNull())
    return masked.groupBy("column_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("items")
    )


@query(
    "mt14_partial_scores",
    f"""WITH {COMPONENTS}, {SCORES}, lv AS (
  SELECT p.*, o_orderpriority AS level FROM part p JOIN orders ON o_orderkey = question_id
  UNION ALL SELECT p.*, 'all' FROM part p),
m AS (
  SELECT component, level,
         coalesce(avg(f1) FILTER (pred_n > 0), 0) AS acc, coalesce(avg(f1) FILTER (label_n > 0), 0) AS rec
  FROM lv GROUP BY 1, 2)
SELECT component, level, round(acc, 6) AS acc, round(rec, 6) AS rec,
       round(CASE WHEN acc = 0 AND rec = 0 THEN 0.0 ELSE 2 * acc * rec / (acc + rec) END, 6) AS f1 FROM m""",
)
def partial_scores(spark, sf):
    comp, overlaps = _scores(spark, sf)
    partial, _ = metrics.exact_match(overlaps)
    level = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("level")
    )
    return _round(
        metrics.partial_scores(partial.join(level, "question_id"), "level"), "acc", "rec", "f1"
    )


# --- sessions from conversations -----------------------------------------------------------------


def sessions(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn_ix"),
        (F.length("text") > 150).cast("int").alias("correct"),
    )


@query(
    "mt15_turn_accuracy",
    """WITH s AS (
  SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, CASE WHEN length(text) > 150 THEN 1 ELSE 0 END AS correct FROM conversations)
SELECT CASE WHEN pos <= 4 THEN 'turn ' || pos ELSE 'turn > 4' END AS turn, count(*) AS n, round(avg(correct), 6) AS accuracy
FROM s GROUP BY 1""",
)
def turn_accuracy(spark, sf):
    return _round(metrics.turn_accuracy(sessions(spark, sf)), "accuracy")


@query(
    "mt16_joint_accuracy",
    """SELECT count(*) AS sessions, round(avg(ok), 6) AS accuracy FROM (
  SELECT conv_id, min(CASE WHEN length(text) > 150 THEN 1 ELSE 0 END) AS ok FROM conversations GROUP BY 1)""",
)
def joint_accuracy(spark, sf):
    return _round(metrics.joint_accuracy(sessions(spark, sf)), "accuracy")


@query(
    "mt17_empty_predictions",
    f"""WITH {COMPONENTS}, n AS (
  SELECT o_orderkey AS question_id, s.side, count(c.question_id) AS items
  FROM orders CROSS JOIN (SELECT unnest(['gold', 'pred']) AS side) s
  LEFT JOIN comp c ON c.question_id = o_orderkey AND c.side = s.side GROUP BY 1, 2)
SELECT side, CAST(items > 0 AS INTEGER) AS parsed, count(*) AS questions, CAST(sum(items) AS BIGINT) AS items FROM n GROUP BY 1, 2""",
)
def empty_predictions(spark, sf):
    questions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"))
    filled = metrics.with_empty_predictions(components(spark, sf), questions)
    return (
        filled.groupBy("question_id", "side")
        .agg(F.max("parsed").alias("parsed"), F.sum("parsed").alias("items"))
        .groupBy("side", "parsed")
        .agg(F.count(F.lit(1)).alias("questions"), F.sum("items").alias("items"))
    )
