"""Evaluation tables derived from the provided tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.functions.cells import canonical_cell
from sqltally.functions.ordering import with_rank
from sqltally.functions.skew import heavy_hashes, salted_join
from sqltally.operators import rollout

TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- candidates and results: question = a run of 20 events, candidate = event type -----------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.floor(F.col("event_id") / 20).alias("question_id"),
        (F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1)
        .cast("int")
        .alias("cand_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Five candidates per question; one with a row k < 10 did not run; some are empty."""
    ev = _events(spark, sf)
    slots = (
        ev.groupBy("question_id")
        .agg(F.max("event_id").alias("m"))
        .select(
            "question_id",
            F.posexplode(F.array(*[F.lit(t) for t in TYPES])).alias("cand_id", "kind"),
        )
        .select("question_id", "cand_id", F.concat(F.lit("SELECT "), "kind").alias("sql"))
    )
    bad = ev.where("k < 10").select("question_id", "cand_id").distinct().withColumn("bad", F.lit(1))
    return slots.join(bad, ["question_id", "cand_id"], "left").select(
        "question_id", "cand_id", "sql", (1 - F.coalesce("bad", F.lit(0))).alias("valid")
    )


def results(spark: SparkSession, sf: str, ordered: bool = True) -> DataFrame:
    """Rows (k % 2, floor(value) % 2) of the candidates that ran."""
    ev = _events(spark, sf)
    ids = ["question_id", "cand_id"]
    bad = ev.where("k < 10").select(*ids).distinct()
    ok = ev.join(bad, ids, "left_anti").select(
        *ids,
        "event_id",
        F.array(
            canonical_cell(F.col("k") % 2, T.IntegerType()),
            canonical_cell(F.floor("value") % 2, T.LongType()),
        ).alias("cells"),
    )
    if not ordered:
        return ok.withColumnRenamed("event_id", "row_ix")
    # a question is 20 consecutive events, so no window holds more than 20 rows
    w = Window.partitionBy(*ids).orderBy("event_id")
    return ok.withColumn("row_ix", (F.row_number().over(w) - 1).cast("long")).drop("event_id")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates 1-4 against candidate 0 as gold, both valid."""
    ok = candidates(spark, sf).where("valid = 1")
    gold = ok.where("cand_id = 0").select("question_id", F.col("cand_id").alias("gold_id"))
    return ok.where("cand_id > 0").select("question_id", "cand_id").join(gold, "question_id")


EVENTS = """
ev AS (
  SELECT event_id, event_id // 20 AS question_id,
         CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS cand_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, value
  FROM events),
bad AS (SELECT DISTINCT question_id, cand_id FROM ev WHERE k < 10),
cand AS (
  SELECT q.question_id, CAST(u.cand_id AS INTEGER) AS cand_id,
         'SELECT ' || ['click','error','purchase','signup','view'][u.cand_id + 1] AS sql,
         CAST(CASE WHEN b.cand_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS valid
  FROM (SELECT DISTINCT question_id FROM ev) q
  CROSS JOIN (SELECT unnest([0,1,2,3,4]) AS cand_id) u
  LEFT JOIN bad b ON b.question_id = q.question_id AND b.cand_id = u.cand_id),
res AS (
  SELECT question_id, cand_id, event_id,
         row_number() OVER (PARTITION BY question_id, cand_id ORDER BY event_id) - 1 AS row_ix,
         k % 2 AS a, CAST(floor(value) AS BIGINT) % 2 AS b
  FROM ev WHERE (question_id, cand_id) NOT IN (SELECT (question_id, cand_id) FROM bad)),
pr AS (
  SELECT c.question_id, c.cand_id, g.cand_id AS gold_id
  FROM cand c JOIN cand g ON g.question_id = c.question_id AND g.cand_id = 0 AND g.valid = 1
  WHERE c.cand_id > 0 AND c.valid = 1),
agg AS (
  SELECT question_id, cand_id,
         list(DISTINCT (a, b) ORDER BY (a, b)) AS as_set,
         list((a, b) ORDER BY a, b) AS as_bag,
         list((b, a) ORDER BY b, a) AS as_swap,
         list((a, b) ORDER BY row_ix) AS as_list,
         list((b, a) ORDER BY row_ix) AS as_list_swap,
         list(DISTINCT (least(a, b), greatest(a, b)) ORDER BY (least(a, b), greatest(a, b))) AS as_loose
  FROM res GROUP BY 1, 2),
two AS (
  SELECT pr.*, p.as_set AS ps, g.as_set AS gs, p.as_bag AS pb, g.as_bag AS gb, p.as_swap AS pw,
         p.as_list AS pl, g.as_list AS gl, p.as_list_swap AS plw, p.as_loose AS plo, g.as_loose AS glo
  FROM pr LEFT JOIN agg p ON p.question_id = pr.question_id AND p.cand_id = pr.cand_id
  LEFT JOIN agg g ON g.question_id = pr.question_id AND g.cand_id = pr.gold_id)
"""


# --- responses: documents wrapped in answer tags, one of six shapes per document ----------------


def responses(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    kind = F.col("doc_id") % 6
    sql = F.concat(
        F.lit("```sql\nSELECT "),
        F.col("n_chars").cast("string"),
        F.lit(" /* all\n of it */ FROM t -- end\nWHERE a > = 1\n```"),
    )
    think = F.concat(F.lit("<think> "), F.col("text"), F.lit(" </think>"))
    answer = F.concat(F.lit("<answer>\nHere:\n"), sql, F.lit("\n</answer>"))
    plain = F.lit("<answer>nothing</answer>")
    text = (
        F.when(kind == 0, F.concat(F.lit("User: x\nAssistant: "), think, answer))
        .when(kind == 1, F.concat(F.lit("<|im_start|>assistant\n"), think, plain))
        .when(kind == 2, F.concat(think, answer))
        .when(kind == 3, F.concat(F.lit("Assistant: "), think, answer, plain))
        .when(kind == 4, F.concat(F.lit("Assistant: "), answer, think))
        .otherwise(F.concat(F.lit("<|im_start|>assistant\n"), think, F.lit("\n"), answer))
    )
    return d.select(F.col("doc_id").alias("response_id"), "source", "lang", text.alias("response"))


RESPONSES = r"""
resp0 AS (
  SELECT doc_id, source, lang, n_chars,
         '<think> ' || text || ' </think>' AS think,
         e'<answer>\nHere:\n```sql\nSELECT ' || n_chars || e' /* all\n of it */ FROM t -- end\nWHERE a > = 1\n```\n</answer>' AS answer,
         '<answer>nothing</answer>' AS plain FROM documents),
resp AS (
  SELECT doc_id AS response_id, source, lang,
    CASE doc_id % 6 WHEN 0 THEN e'User: x\nAssistant: ' || think || answer
      WHEN 1 THEN e'<|im_start|>assistant\n' || think || plain
      WHEN 2 THEN think || answer
      WHEN 3 THEN 'Assistant: ' || think || answer || plain
      WHEN 4 THEN 'Assistant: ' || answer || think
      ELSE e'<|im_start|>assistant\n' || think || e'\n' || answer END AS response
  FROM resp0),
body AS (
  SELECT *, CASE WHEN position('Assistant:' IN response) > 0 THEN substr(response, position('Assistant:' IN response) + 10)
                 WHEN position('<|im_start|>assistant' IN response) > 0 THEN substr(response, position('<|im_start|>assistant' IN response) + 21)
            END AS body FROM resp),
found AS (
  SELECT *, trim(regexp_extract_all(body, '(?s)<answer>(.*?)</answer>', 1)[-1], e' \n\t\r') AS answer,
         trim(regexp_extract_all(body, '(?s)<think>(.*?)</think>', 1)[-1], e' \n\t\r') AS think FROM body),
audit AS (
  SELECT *, trim(regexp_extract_all(answer, '(?s)```sql(.*?)```', 1)[-1], e' \n\t\r') AS sql,
    len(regexp_extract_all(body, '<think>')) = 1 AND len(regexp_extract_all(body, '</think>')) = 1
    AND len(regexp_extract_all(body, '<answer>')) = 1 AND len(regexp_extract_all(body, '</answer>')) = 1 AS once,
    position('<think>' IN body) <= position('</think>' IN body) AND position('</think>' IN body) <= position('<answer>' IN body)
    AND position('<answer>' IN body) <= position('</answer>' IN body) AS in_order
  FROM found),
audited AS (
  SELECT *, CASE WHEN body IS NULL THEN 'no header' WHEN NOT once THEN 'tag count' WHEN NOT in_order THEN 'tag order'
                 WHEN coalesce(sql, '') = '' THEN 'no sql' END AS reason FROM audit)
"""

# --- a SQL log written from orders ---------------------------------------------------------------


def sql_log(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 6
    cust, price = F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string")
    prio, state = F.col("o_orderpriority"), F.col("o_orderstatus")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    sql = (
        F.when(
            k == 0,
            text(
                "SELECT DISTINCT o_custkey FROM orders WHERE orders.o_orderpriority = '",
                prio, "' AND o_totalprice > ", price,
            ),
        )
        .when(
            k == 1,
            text(
                "SELECT count(*) FROM orders WHERE o_orderstatus = '", state,
                "' GROUP BY o_custkey HAVING count(*) > 2 ORDER BY o_custkey DESC LIMIT 5",
            ),
        )
        .when(k == 2, text("SELECT T1.o_orderkey FROM orders AS T1 WHERE T1.o_custkey between ", cust, " and 99999"))
        .when(
            k == 3,
            text(
                "select O_ORDERKEY from orders where O_ORDERSTATUS like '", state,
                "' or o_custkey in (", cust, ", 2)",
            ),
        )
        .when(
            k == 4,
            F.lit("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE T2.l_quantity < 5"),
        )
        .otherwise(text("SELECT  'Distinct  Value' , o_custkey FROM orders WHERE NOT o_custkey = ", cust))
    )
    return o.select("o_orderkey", sql.alias("sql"))


SQL_LOG = """
lg AS (
  SELECT o_orderkey, o_orderkey % 6 AS k, o_custkey, o_orderpriority AS prio, o_orderstatus AS state, CAST(o_totalprice AS VARCHAR) AS price,
    CASE o_orderkey % 6
      WHEN 0 THEN 'SELECT DISTINCT o_custkey FROM orders WHERE orders.o_orderpriority = ''' || o_orderpriority || ''' AND o_totalprice > ' || o_totalprice
      WHEN 1 THEN 'SELECT count(*) FROM orders WHERE o_orderstatus = ''' || o_orderstatus || ''' GROUP BY o_custkey HAVING count(*) > 2 ORDER BY o_custkey DESC LIMIT 5'
      WHEN 2 THEN 'SELECT T1.o_orderkey FROM orders AS T1 WHERE T1.o_custkey between ' || o_custkey || ' and 99999'
      WHEN 3 THEN 'select O_ORDERKEY from orders where O_ORDERSTATUS like ''' || o_orderstatus || ''' or o_custkey in (' || o_custkey || ', 2)'
      WHEN 4 THEN 'SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE T2.l_quantity < 5'
      ELSE 'SELECT  ''Distinct  Value'' , o_custkey FROM orders WHERE NOT o_custkey = ' || o_custkey END AS sql
  FROM orders)
"""

# --- tokens: sequence = order, group = customer, step = order year ------------------------------


def tokens(spark: SparkSession, sf: str, grouped: bool = False) -> DataFrame:
    """``tokens`` rows from lineitem; ``mask`` is 1 up to and including the first returned line."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", *order, "l_discount", "l_tax", "l_returnflag"
    )
    # looked up once on the plain scan; the hash of a key does not depend on its column name
    heavy = heavy_hashes(li, ["l_orderkey"])
    ranked = with_rank(li, order, ["l_orderkey"], "t", heavy).withColumnRenamed("l_orderkey", "seq_id")
    masked = rollout.eos_mask(ranked.withColumn("eos", F.col("l_returnflag") == "R"), "eos", heavy)
    out = masked.select(
        "seq_id",
        "t",
        "mask",
        (-F.col("l_discount")).alias("logp"),
        (-F.col("l_tax")).alias("old_logp"),
        (-(F.col("l_discount") + F.col("l_tax")) / 2).alias("ref_logp"),
        (F.col("l_quantity") / 50).alias("value"),
        (F.col("l_extendedprice") / 100000).alias("score"),
    )
    if not grouped:
        return out
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq_id"),
        F.col("o_custkey").alias("group_id"),
        F.year("o_orderdate").alias("step"),
    )
    return salted_join(out, o, ["seq_id"], spread=["t"], heavy=heavy)


TOKENS = """
tok0 AS (
  SELECT l_orderkey AS seq_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS BIGINT) AS t,
         -l_discount AS logp, -l_tax AS old_logp, -(l_discount + l_tax) / 2 AS ref_logp,
         l_quantity / 50 AS value, l_extendedprice / 100000 AS score, l_returnflag = 'R' AS eos
  FROM lineitem),
tok1 AS (
  SELECT *, CAST(CASE WHEN t <= coalesce(min(CASE WHEN eos THEN t END) OVER (PARTITION BY seq_id), 999999999) THEN 1 ELSE 0 END AS INTEGER) AS mask FROM tok0),
tok AS (
  SELECT k.*, o_custkey AS group_id, CAST(year(o_orderdate) AS INTEGER) AS step
  FROM tok1 k JOIN orders ON o_orderkey = seq_id)
"""
