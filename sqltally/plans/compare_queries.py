"""Comparison and voting queries over ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.functions.lineage import shared_folder
from sqltally.operators import compare, metrics, voting
from sqltally.plans import views
from sqltally.plans.registry import query


def _flag(df: DataFrame, name: str = "equal") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("int"))


def _two_way(name: str, expr: str, column: str = "equal"):
    sql = f"""WITH {views.EVENTS}
SELECT question_id, cand_id, gold_id, CAST({expr} AS INTEGER) AS "{column}" FROM two"""
    return query(name, sql)


@_two_way("cmp2_set_equal", "ps IS NOT DISTINCT FROM gs")
def set_equal(spark, sf):
    return _flag(compare.set_equal(views.results(spark, sf, False), views.pairs(spark, sf)))


@_two_way("cmp3_bag_equal", "pb IS NOT DISTINCT FROM gb")
def bag_equal(spark, sf):
    return _flag(compare.bag_equal(views.results(spark, sf, False), views.pairs(spark, sf)))


@_two_way("cmp4_ordered_equal", "pl IS NOT DISTINCT FROM gl")
def ordered_equal(spark, sf):
    return _flag(compare.ordered_equal(views.results(spark, sf), views.pairs(spark, sf)))


@_two_way("cmp5_quick_reject", "plo IS NOT DISTINCT FROM glo", "possible")
def quick_reject(spark, sf):
    rejected = compare.quick_reject(views.results(spark, sf, False), views.pairs(spark, sf))
    return _flag(rejected, "possible")


@_two_way("cmp6_permuted_equal", "(pb IS NOT DISTINCT FROM gb) OR (pw IS NOT DISTINCT FROM gb)")
def permuted_equal(spark, sf):
    return _flag(compare.permuted_equal(views.results(spark, sf, False), views.pairs(spark, sf)))


@query(
    "cmp8_suite_match",
    f"""WITH {views.EVENTS},
eq AS (
  SELECT question_id, cand_id,
         CASE WHEN question_id % 2 = 0
              THEN (pl IS NOT DISTINCT FROM gl) OR (plw IS NOT DISTINCT FROM gl)
              ELSE (pb IS NOT DISTINCT FROM gb) OR (pw IS NOT DISTINCT FROM gb) END AS e
  FROM two),
fills AS (SELECT question_id // 2 AS question_id, cand_id AS fill_id, bool_and(e) AS ok FROM eq GROUP BY 1, 2)
SELECT question_id, CAST(bool_or(ok) AS INTEGER) AS passed FROM fills GROUP BY 1""",
)
def suite_match(spark, sf):
    """Two neighbouring questions form a suite of two databases; each candidate is a slot fill."""
    gold = F.when(F.col("question_id") % 2 == 0, "SELECT k ORDER BY k").otherwise("SELECT k")
    pairs = views.pairs(spark, sf).withColumn("gold_sql", gold)
    same = compare.denotation_equal(views.results(spark, sf), pairs)
    per_db = same.select(
        F.floor(F.col("question_id") / 2).alias("question_id"),
        F.col("question_id").alias("db_id"),
        F.col("cand_id").alias("fill_id"),
        "equal",
    )
    return _flag(compare.suite_match(per_db), "passed")


def statuses(spark, sf):
    cand = views.candidates(spark, sf)
    every = cand.where("cand_id > 0").select(
        "question_id", "cand_id", F.lit(0).alias("gold_id"), (F.col("question_id") % 3).alias("db_id")
    )
    ids = every.select("question_id", "cand_id", "gold_id")
    equality = compare.permuted_equal(views.results(spark, sf, False), ids)
    return compare.match_status(every, cand, equality)


STATUS = f"""WITH {views.EVENTS},
status AS (
  SELECT c.question_id, c.cand_id, c.question_id % 3 AS db_id,
         CASE WHEN c.valid = 0 THEN 'Unexecutable' WHEN g.valid = 0 THEN 'Gold Error'
              WHEN (t.pb IS NOT DISTINCT FROM t.gb) OR (t.pw IS NOT DISTINCT FROM t.gb) THEN 'Match'
              ELSE 'Mismatch' END AS status
  FROM cand c JOIN cand g ON g.question_id = c.question_id AND g.cand_id = 0
  LEFT JOIN two t ON t.question_id = c.question_id AND t.cand_id = c.cand_id
  WHERE c.cand_id > 0)
"""


@query(
    "cmp9_match_status",
    STATUS + "SELECT db_id, status, count(*) AS n FROM status GROUP BY 1, 2",
)
def match_status(spark, sf):
    return compare.status_counts(statuses(spark, sf))


PAIR_SQL = [
    (0, 0, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"),
    (0, 1, "SELECT c_mktsegment, count(c_custkey) AS n FROM customer GROUP BY 1"),
    (1, 0, "SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY o_orderpriority ORDER BY 1"),
    (1, 1, "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority"),
    (2, 0, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    (2, 1, "SELECT no_such_column FROM nation"),
    (3, 0, "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 25"),
    (3, 1, "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 26;"),
]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "cmp1_run_pairs",
    "\nUNION ALL ".join(
        f"SELECT CAST({q} AS BIGINT) AS question_id, CAST({c} AS INTEGER) AS cand_id, "
        + (
            "0 AS valid, CAST(0 AS BIGINT) AS n_rows"
            if "no_such_column" in text
            else f"1 AS valid, (SELECT count(*) FROM ({text.rstrip(';')})) AS n_rows"
        )
        for q, c, text in PAIR_SQL
    ),
)
def run_pairs(spark, sf):
    for name in ("customer", "orders", "nation", "region", "lineitem"):
        views.table(spark, sf, name).createOrReplaceTempView(name)
    cand, rows = compare.run_pairs(spark, PAIR_SQL, scratch_path(spark, "pairs"), timeout=300)
    n = rows.groupBy("question_id", "cand_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return cand.join(n, ["question_id", "cand_id"], "left").select(
        "question_id", "cand_id", "valid", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


#: statements over each nation: two that run, one that cannot be analysed, one that fails for a single nation
NATION_SQL = (
    "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey = {} GROUP BY c_mktsegment ORDER BY 1",
    "SELECT c_custkey FROM customer WHERE c_nationkey = {}",
    "SELECT no_such_column FROM customer WHERE c_nationkey = {}",
    "SELECT CASE WHEN c_nationkey = 7 THEN raise_error('seven') ELSE c_custkey END AS x FROM customer WHERE c_nationkey = {}",
)


@query(
    "cmp1_run_statements",
    """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS question_id FROM nation),
s AS (
  SELECT c_nationkey AS question_id, count(*) AS rows, count(DISTINCT c_mktsegment) AS segments, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS listed
  FROM customer GROUP BY 1)
SELECT question_id, cand_id, CASE WHEN cand_id = 2 OR (cand_id = 3 AND question_id = 7 AND rows > 0) THEN 0 ELSE 1 END AS valid,
  CAST(CASE WHEN cand_id = 2 OR (cand_id = 3 AND question_id = 7) THEN 0 WHEN cand_id = 0 THEN coalesce(segments, 0) ELSE coalesce(rows, 0) END AS BIGINT) AS n_rows,
  CASE WHEN cand_id = 0 THEN listed END AS first_cells
FROM n CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS cand_id) LEFT JOIN s USING (question_id)""",
)
def run_statements(spark, sf):
    """A table of statements, four for each nation, run in slices; rows keep their order."""
    views.table(spark, sf, "customer").createOrReplaceTempView("customer")
    texts = F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("n_nationkey").cast("string")) for t in NATION_SQL])
    statements = views.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("question_id"), F.posexplode(texts).alias("cand_id", "sql"))
    cand, rows = compare.run_pairs(spark, statements, scratch_path(spark, "statements"), timeout=300)
    label = F.when(F.col("cand_id") == 0, F.struct("row_ix", F.substring(F.col("cells")[0], 3, 100).alias("cell")))
    per = rows.groupBy("question_id", "cand_id").agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(label)).alias("cells"))
    return cand.join(per, ["question_id", "cand_id"], "left").select(
        "question_id", "cand_id", "valid", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(F.col("cand_id") == 0, F.array_join(F.transform("cells", lambda c: c["cell"]), ",")).alias("first_cells"),
    )


@query("vt1_greedy", f"WITH {views.EVENTS} SELECT question_id, sql FROM cand WHERE cand_id = 0")
def greedy(spark, sf):
    return voting.greedy(views.candidates(spark, sf))


@query(
    "vt2_mark_invalid",
    f"""WITH {views.EVENTS}
SELECT question_id, cand_id, CASE WHEN valid = 0 THEN 'Error SQL' ELSE sql END AS sql, valid FROM cand""",
)
def mark_invalid(spark, sf):
    return voting.mark_invalid(views.candidates(spark, sf))


def _vote_sql(column: str) -> str:
    return f"""WITH {views.EVENTS},
clusters AS (
  SELECT c.question_id, a.{column} AS rows, count(*) AS votes, min(c.cand_id) AS first_id, arg_min(c.sql, c.cand_id) AS sql
  FROM cand c LEFT JOIN agg a USING (question_id, cand_id) WHERE c.valid = 1 GROUP BY 1, 2),
best AS (
  SELECT question_id, sql, votes,
         row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, first_id) AS rn FROM clusters)
"""


@query("vt3_majority_vote", _vote_sql("as_set") + "SELECT question_id, sql, votes FROM best WHERE rn = 1")
def majority_vote(spark, sf):
    return voting.majority_vote(views.candidates(spark, sf), views.results(spark, sf, False))


@query("vt3_majority_vote_bag", _vote_sql("as_bag") + "SELECT question_id, sql, votes FROM best WHERE rn = 1")
def majority_vote_bag(spark, sf):
    return voting.majority_vote(
        views.candidates(spark, sf), views.results(spark, sf, False), bag=True, verify=True
    )


@query(
    "vt4_vote_fallback",
    f"""WITH {views.EVENTS}
SELECT question_id, 'Error SQL' AS sql FROM cand GROUP BY question_id HAVING max(valid) = 0""",
)
def vote_fallback(spark, sf):
    return voting.vote_fallback(views.candidates(spark, sf), policy="error")


@query(
    "vt4_vote",
    _vote_sql("as_set") + """SELECT question_id, sql, votes FROM best WHERE rn = 1
UNION ALL SELECT question_id, 'Error SQL', CAST(0 AS BIGINT) FROM cand GROUP BY question_id HAVING max(valid) = 0""",
)
def vote(spark, sf):
    return voting.vote(views.candidates(spark, sf), views.results(spark, sf, False), policy="error")


@query(
    "vt5_pass_at_k",
    f"""WITH {views.EVENTS}, best AS (
  SELECT question_id, max(valid * (cand_id + 1)) AS s FROM cand GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN s >= 4 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM best""",
)
def pass_at_k(spark, sf):
    scores = views.candidates(spark, sf).withColumn(
        "score", F.col("valid") * (F.col("cand_id") + 1)
    )
    return voting.pass_at_k(scores, 4).withColumn("pass_rate", F.round("pass_rate", 6))


def scored(spark, sf):
    """Winner of each vote against candidate 0's result."""
    cand, res = views.candidates(spark, sf), views.results(spark, sf, False)
    winner = voting.majority_vote(cand, res).select("question_id", "sql")
    picked = (
        cand.join(winner, ["question_id", "sql"])
        .select("question_id", "cand_id", F.lit(0).alias("gold_id"))
    )
    gold_ok = cand.where("cand_id = 0 AND valid = 1").select("question_id")
    same = compare.set_equal(res, picked.join(gold_ok, "question_id", "left_semi"))
    return (
        cand.select("question_id")
        .distinct()
        .join(same, "question_id", "left")
        .select(
            "question_id",
            F.coalesce(F.col("equal").cast("int"), F.lit(0)).alias("correct"),
        )
    )


@query(
    "mt1_execution_accuracy",
    _vote_sql("as_set")
    + """, hit AS (
  SELECT q.question_id,
         CASE WHEN g.valid = 1 AND b.sql IS NOT NULL AND ap.as_set IS NOT DISTINCT FROM ag.as_set THEN 1 ELSE 0 END AS correct
  FROM (SELECT DISTINCT question_id FROM cand) q
  LEFT JOIN (SELECT * FROM best WHERE rn = 1) b USING (question_id)
  LEFT JOIN cand w ON w.question_id = q.question_id AND w.sql = b.sql
  LEFT JOIN agg ap ON ap.question_id = q.question_id AND ap.cand_id = w.cand_id
  LEFT JOIN cand g ON g.question_id = q.question_id AND g.cand_id = 0
  LEFT JOIN agg ag ON ag.question_id = q.question_id AND ag.cand_id = 0)
SELECT count(*) AS n, round(avg(correct), 6) AS accuracy FROM hit""",
)
def execution_accuracy(spark, sf):
    return metrics.execution_accuracy(scored(spark, sf)).withColumn(
        "accuracy", F.round("accuracy", 6)
    )
