"""Response mining, SQL-log reports and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltally.operators import mining, rewards
from sqltally.plans import views
from sqltally.plans.registry import query


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "rx1_mine_candidates",
    rf"""WITH {views.RESPONSES}, each AS (
  SELECT response_id // 4 AS question_id, response_id,
         trim(coalesce(regexp_extract_all(response, '(?s)```sql\s*(.*?)\s*```', 1)[-1], ''), e' \n\t\r') AS raw FROM resp),
clean AS (
  SELECT question_id, response_id,
         trim(regexp_replace(regexp_replace(regexp_replace(raw, '(?s)/\*.*?\*/', '', 'g'), '(?m)--.*$', '', 'g'), '[\n\t]', ' ', 'g'), ' ') AS c FROM each),
fixed AS (SELECT question_id, response_id, CASE WHEN c = '' THEN 'Error SQL' ELSE replace(c, '> =', '>=') END AS sql FROM clean)
SELECT question_id, sql, count(*) AS n_samples,
       CAST(min(response_id) - 4 * question_id AS INTEGER) AS cand_id
FROM fixed GROUP BY 1, 2""",
)
def mine_candidates(spark, sf):
    """Four neighbouring responses are the samples of one question."""
    by = F.floor(F.col("response_id") / 4)
    sampled = (
        views.responses(spark, sf)
        .groupBy(by.alias("question_id"))
        .agg(F.array_sort(F.collect_list(F.struct("response_id", "response"))).alias("rs"))
        .select("question_id", F.col("rs.response").alias("responses"))
    )
    return mining.mine_candidates(sampled)


@query(
    "rx2_format_audit",
    f"""WITH {views.RESPONSES}
SELECT response_id, CAST(reason IS NULL AS INTEGER) AS ok, reason, length(answer) AS answer_len,
       length(think) AS think_len, sql FROM audited""",
)
def format_audit(spark, sf):
    return mining.format_audit(views.responses(spark, sf)).select(
        "response_id",
        F.col("ok").cast("int").alias("ok"),
        "reason",
        F.length("answer").cast("long").alias("answer_len"),
        F.length("think").cast("long").alias("think_len"),
        "sql",
    )


@query(
    "rx2_format_rates",
    f"""WITH {views.RESPONSES}, e AS (
  SELECT source, coalesce(reason, 'ok') AS reason FROM audited
  UNION ALL SELECT 'all', coalesce(reason, 'ok') FROM audited),
n AS (SELECT source, reason, count(*) AS n FROM e GROUP BY 1, 2)
SELECT source, reason, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM n""",
)
def format_rates(spark, sf):
    return _round(mining.format_rates(mining.format_audit(views.responses(spark, sf))), "share")


@query(
    "rx7_query_templates",
    f"""WITH {views.SQL_LOG}, t AS (
  SELECT k, count(*) AS n,
         CASE k WHEN 0 THEN 'select o_custkey from orders where orders.o_orderpriority = value and o_totalprice > value'
                WHEN 1 THEN 'select count(*) from orders where o_orderstatus = value group by o_custkey having count(*) > value order by o_custkey desc limit value'
                WHEN 2 THEN 'select t1.o_orderkey from orders as t1 where t1.o_custkey between value and value'
                WHEN 3 THEN 'select o_orderkey from orders where o_orderstatus like value or o_custkey in (value, value)'
                WHEN 4 THEN 'select o_orderkey from orders except select l_orderkey from lineitem where t2.l_quantity < value'
                ELSE 'select value , o_custkey from orders where not o_custkey = value' END AS template,
         CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 2 END AS INTEGER) AS slots,
         CASE k WHEN 0 THEN count(DISTINCT prio) + count(DISTINCT price)
                WHEN 1 THEN count(DISTINCT state) + 2
                WHEN 2 THEN count(DISTINCT o_custkey) + 1
                WHEN 3 THEN count(DISTINCT state) + count(DISTINCT o_custkey) FILTER (o_custkey <> 2) + 1
                WHEN 4 THEN 1 ELSE 1 + count(DISTINCT o_custkey) END AS n_literals
  FROM lg GROUP BY k)
SELECT template, n, slots, n_literals FROM t""",
)
def query_templates(spark, sf):
    return mining.query_templates(views.sql_log(spark, sf))


@query(
    "rx8_fill_slots",
    """WITH v AS (
  SELECT o_orderkey AS question_id, list_sort(['''' || o_orderpriority || '''', CAST(o_custkey AS VARCHAR)]) AS vals FROM orders),
f AS (SELECT *, unnest([0, 1, 2, 3]) AS f FROM v)
SELECT question_id, CAST(f AS BIGINT) AS fill_id, CAST(4 AS BIGINT) AS n_fills,
       'SELECT a FROM t WHERE q > ' || vals[f // 2 + 1] || ' AND p = ' || vals[f % 2 + 1] || ' LIMIT ALL' AS sql
FROM f""",
)
def fill_slots(spark, sf):
    pairs = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_id"),
        F.concat(
            F.lit("SELECT a FROM t WHERE p = '"), "o_orderpriority", F.lit("' AND q > "),
            F.col("o_custkey").cast("string"),
        ).alias("gold"),
        F.lit("SELECT a FROM t WHERE q > 1.5 AND p = 'x y' LIMIT ALL").alias("pred"),
    )
    return mining.fill_slots(pairs)


@query(
    "rx9_literal_usage",
    f"""WITH {views.SQL_LOG}, h AS (
  SELECT 'orders' AS "table", 'O_ORDERPRIORITY' AS "column", prio AS value FROM lg WHERE k = 0
  UNION ALL SELECT NULL, 'O_TOTALPRICE', price FROM lg WHERE k = 0
  UNION ALL SELECT NULL, 'O_ORDERSTATUS', state FROM lg WHERE k IN (1, 3)
  UNION ALL SELECT 't1', 'O_CUSTKEY', CAST(o_custkey AS VARCHAR) FROM lg WHERE k = 2
  UNION ALL SELECT 't1', 'O_CUSTKEY', '99999' FROM lg WHERE k = 2
  UNION ALL SELECT NULL, 'L_QUANTITY', '5' FROM lg WHERE k = 4
  UNION ALL SELECT NULL, 'O_CUSTKEY', CAST(o_custkey AS VARCHAR) FROM lg WHERE k = 5)
SELECT "table", "column", value, count(*) AS n FROM h GROUP BY 1, 2, 3""",
)
def literal_usage(spark, sf):
    return mining.literal_usage(views.sql_log(spark, sf))


KEYWORD_SETS = """kw AS (
  SELECT CASE k WHEN 0 THEN ['where'] WHEN 1 THEN ['where','group','having','order','desc','limit']
                WHEN 2 THEN ['where'] WHEN 3 THEN ['where','or','in','like'] WHEN 4 THEN ['where','except'] ELSE ['where','not'] END AS ks
  FROM lg)"""


@query(
    "rx12_keyword_shares",
    f"""WITH {views.SQL_LOG}, {KEYWORD_SETS}
SELECT keyword, count(*) AS n, round(count(*) / (SELECT count(*) FROM lg), 6) AS share
FROM (SELECT unnest(ks) AS keyword FROM kw) GROUP BY 1""",
)
def keyword_shares(spark, sf):
    return _round(mining.keyword_profile(views.sql_log(spark, sf))[0], "share")


@query(
    "rx12_keyword_pairs",
    f"""WITH {views.SQL_LOG}, {KEYWORD_SETS},
p AS (SELECT unnest(ks) AS a, ks FROM kw), q AS (SELECT a, unnest(ks) AS b FROM p)
SELECT a, b, count(*) AS n FROM q WHERE a < b GROUP BY 1, 2""",
)
def keyword_pairs(spark, sf):
    return mining.keyword_profile(views.sql_log(spark, sf))[1]


# --- rewards -------------------------------------------------------------------------------------

STATUS = ["Match", "Mismatch", "Unexecutable", "Gold Error"]


def _status(spark, sf):
    names = F.array(*[F.lit(s) for s in STATUS])
    return views.table(spark, sf, "documents").select(
        F.col("doc_id").alias("response_id"),
        F.element_at(names, (F.col("n_chars") % 4 + 1).cast("int")).alias("status"),
    )


REWARDS = f"""{views.RESPONSES}, st AS (
  SELECT doc_id AS response_id, ['Match','Mismatch','Unexecutable','Gold Error'][n_chars % 4 + 1] AS status FROM documents),
rw AS (
  SELECT a.response_id, source,
    CASE WHEN reason IS NULL THEN 1.0 ELSE -1.0 END AS format,
    CASE WHEN reason IS NULL AND status = 'Unexecutable' THEN -2.0 WHEN reason IS NULL AND status IN ('Match','Mismatch') THEN 2.0 ELSE 0.0 END AS exec,
    CASE WHEN reason IS NULL AND status = 'Mismatch' THEN -3.0 WHEN reason IS NULL AND status = 'Match' THEN 3.0 ELSE 0.0 END AS result,
    CASE WHEN reason IS NULL AND status = 'Match' THEN least(0.5, 0.5 * (length(think) + length(answer)) / 2048)
         + length(regexp_replace(sql, '\\s+', ' ', 'g')) / length(answer) ELSE 0.0 END AS length
  FROM audited a JOIN st ON st.response_id = a.response_id)"""


@query(
    "rw1_sql_rewards",
    f"""WITH {REWARDS}
SELECT response_id, CAST(format AS DOUBLE) AS format, CAST(exec AS DOUBLE) AS exec, CAST(result AS DOUBLE) AS result,
       round(CAST(length AS DOUBLE), 9) AS length, round(CAST(format + exec + result + length AS DOUBLE), 9) AS total FROM rw""",
)
def sql_rewards(spark, sf):
    audit = mining.format_audit(views.responses(spark, sf))
    out = rewards.sql_rewards(audit, _status(spark, sf))
    return _round(
        out.select("response_id", "format", "exec", "result", "length", "total"), "length", "total", digits=9
    )


@query(
    "rw1_reward_means",
    f"""WITH {REWARDS}
SELECT source, count(*) AS n, round(avg(CAST(format AS DOUBLE)), 6) AS format, round(avg(CAST(exec AS DOUBLE)), 6) AS exec,
       round(avg(CAST(result AS DOUBLE)), 6) AS result, round(avg(CAST(length AS DOUBLE)), 6) AS length,
       round(avg(CAST(format + exec + result + length AS DOUBLE)), 6) AS total FROM rw GROUP BY 1""",
)
def reward_means(spark, sf):
    audit = mining.format_audit(views.responses(spark, sf))
    out = rewards.reward_means(rewards.sql_rewards(audit, _status(spark, sf)))
    return _round(out, "format", "exec", "result", "length", "total")


def _numeric(spark, sf):
    d = views.table(spark, sf, "documents")
    shown = F.when(F.col("doc_id") % 3 == 0, F.format_number("n_chars", 0)).otherwise(
        (F.col("n_chars") + F.col("doc_id") % 2).cast("string")
    )
    tail = F.when(F.col("doc_id") % 5 == 4, F.lit("")).otherwise(F.concat(F.lit("\n#### "), shown))
    responses = d.select(
        F.col("doc_id").alias("response_id"), "source", F.concat("text", tail).alias("response")
    )
    truth = d.select(
        F.col("doc_id").alias("response_id"), F.col("n_chars").cast("string").alias("truth")
    )
    return responses, truth


NUMERIC = r"""num AS (
  SELECT source, CAST(n_chars AS VARCHAR) AS truth,
         text || CASE WHEN doc_id % 5 = 4 THEN '' ELSE e'\n#### ' || CASE WHEN doc_id % 3 = 0 THEN format('{:,}', n_chars) ELSE CAST(n_chars + doc_id % 2 AS VARCHAR) END END AS response
  FROM documents)"""


@query(
    "rw3_numeric_rewards",
    "WITH " + NUMERIC + r""", a AS (
  SELECT source, truth, replace(nullif(regexp_extract(response, '#### (-?[0-9.,]+)', 1), ''), ',', '') AS answer FROM num)
SELECT source, count(*) AS n, round(avg(CASE WHEN answer = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM a GROUP BY 1""",
)
def numeric_rewards(spark, sf):
    scored = rewards.numeric_rewards(*_numeric(spark, sf))
    return _round(rewards.accuracy_by_source(scored), "accuracy")


@query(
    "rw3_numeric_rewards_flexible",
    "WITH " + NUMERIC + r""", a AS (
  SELECT source, truth, [x for x in regexp_extract_all(response, '-?[0-9.,]+') if x <> '.'] AS u,
         regexp_extract_all(response, '-?[0-9.,]+') AS every FROM num),
b AS (SELECT source, truth, coalesce(u[-1], every[1]) AS answer FROM a)
SELECT source, round(CAST(sum(CASE WHEN answer IS NULL THEN 0 WHEN answer = truth THEN 1.0 ELSE 0.25 END) AS DOUBLE), 4) AS total FROM b GROUP BY 1""",
)
def numeric_rewards_flexible(spark, sf):
    scored = rewards.numeric_rewards(*_numeric(spark, sf), mode="flexible", format_score=0.25)
    return scored.groupBy("source").agg(F.round(F.sum("score"), 4).alias("total"))


@query(
    "rw4_number_bag_rewards",
    """WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS a, o_orderkey % 97 AS b FROM orders),
s AS (
  SELECT CASE WHEN k % 7 = 6 THEN 'none' WHEN k % 3 = 2 AND b <> b + 1 THEN 'wrong numbers'
              WHEN k % 5 = 4 THEN 'wrong value' ELSE 'correct' END AS outcome FROM o)
SELECT outcome, count(*) AS n, round(avg(CASE outcome WHEN 'none' THEN 0.0 WHEN 'correct' THEN 1.0 ELSE 0.1 END), 6) AS score FROM s GROUP BY 1""",
)
def number_bag_rewards(spark, sf):
    o = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("response_id"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 97).alias("b")
    )
    k = F.col("response_id")
    equation = F.concat(F.col("b").cast("string"), F.lit(" + "), F.col("a").cast("string"))
    response = F.concat(
        F.lit("Assistant: thinking <answer>0</answer>\n<answer> "), equation,
        F.when(k % 7 == 6, F.lit(" ")).otherwise(F.lit(" </answer>")),
    )
    responses = o.select(
        "response_id", response.alias("response"), (F.col("a") + F.col("b")).cast("double").alias("value")
    )
    truth = o.select(
        "response_id",
        (F.col("a") + F.col("b") + F.when(k % 5 == 4, 1).otherwise(0)).alias("target"),
        F.array("a", F.when(k % 3 == 2, F.col("b") + 1).otherwise(F.col("b"))).alias("numbers"),
    )
    scored = rewards.number_bag_rewards(responses, truth)
    return scored.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score")
    )


@query(
    "rw5_score_by_source",
    """SELECT lang AS data_source, count(*) AS n,
  round(avg(CASE lang WHEN 'en' THEN n_chars / 1000 WHEN 'de' THEN 1.0 WHEN 'fr' THEN doc_id % 2 ELSE CASE WHEN n_chars > 500 THEN 3.0 ELSE -1.0 END END), 6) AS score
FROM documents GROUP BY 1""",
)
def score_by_source(spark, sf):
    registry = {
        "en": F.col("n_chars") / 1000,
        "de": F.lit(1.0),
        "fr": (F.col("doc_id") % 2).cast("double"),
        "es": F.when(F.col("n_chars") > 500, 3.0).otherwise(-1.0),
    }
    d = views.table(spark, sf, "documents").withColumnRenamed("lang", "data_source")
    return (
        rewards.score_by_source(d, registry)
        .groupBy("data_source")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))
    )


@query(
    "rw6_place_on_last_token",
    f"""WITH {views.TOKENS}, l AS (SELECT seq_id, max(t) AS last_t FROM tok WHERE mask = 1 GROUP BY 1)
SELECT tok.seq_id, t, CASE WHEN t = last_t THEN o_totalprice ELSE 0 END AS score
FROM tok JOIN l USING (seq_id) JOIN orders ON o_orderkey = tok.seq_id""",
)
def place_on_last_token(spark, sf):
    scores = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq_id"), F.col("o_totalprice").alias("score")
    )
    placed = rewards.place_on_last_token(views.tokens(spark, sf), scores)
    return placed.select("seq_id", "t", "score")


def _marks(spark, sf):
    marks = F.element_at(F.array(*[F.lit(x) for x in (3.0, -1.0, -0.5, 1.5)]), (F.col("n_chars") % 4 + 1).cast("int"))
    return views.table(spark, sf, "documents").select(
        F.col("source").alias("data_source"), marks.alias("score")
    )


MARKS = "m AS (SELECT source AS data_source, [3.0, -1.0, -0.5, 1.5][n_chars % 4 + 1] AS score FROM documents)"


@query(
    "rw7_validation_by_source",
    f"WITH {MARKS} SELECT data_source, round(avg(CASE WHEN score = 3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM m GROUP BY 1",
)
def validation_by_source(spark, sf):
    return _round(rewards.validation_by_source(_marks(spark, sf)), "share")


@query(
    "rw8_reward_shares",
    f"""WITH {MARKS} SELECT round(avg(CAST(score AS DOUBLE)), 6) AS mean,
  round(avg(CASE WHEN score = 3 THEN 1.0 ELSE 0.0 END), 6) AS all_correct_ratio,
  round(avg(CASE WHEN score = -1 THEN 1.0 ELSE 0.0 END), 6) AS format_error_ratio,
  round(avg(CASE WHEN score = -0.5 THEN 1.0 ELSE 0.0 END), 6) AS wrong_answer_ratio FROM m""",
)
def reward_shares(spark, sf):
    out = rewards.reward_shares(_marks(spark, sf))
    return _round(out, "mean", "all_correct_ratio", "format_error_ratio", "wrong_answer_ratio")
