"""Batch shaping over ``documents`` and file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltally.functions.ordering import with_rank
from sqltally.operators import batching
from sqltally.plans.compare_queries import scratch_path
from sqltally.plans.registry import query
from sqltally.plans.views import sql_log, table, SQL_LOG
from sqltally.sources import io


def _batch(spark, sf):
    """Documents as one batch, ordered by length then id."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return with_rank(d, ["n_chars", "doc_id"])


BATCH = "b AS (SELECT row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS ordinal, doc_id, source, lang, n_chars FROM documents)"


@query("bt1_reshape", "SELECT doc_id AS uid, n_chars AS length, lang FROM documents")
def reshape(spark, sf):
    return batching.reshape(
        table(spark, sf, "documents"),
        keep=["doc_id", "n_chars", "lang", "source"],
        drop=["source"],
        rename={"doc_id": "uid", "n_chars": "length"},
    )


@query("bt2_column_union", f"WITH {BATCH} SELECT ordinal, doc_id, n_chars, source, lang FROM b")
def column_union(spark, sf):
    b = _batch(spark, sf)
    return batching.column_union(
        b.select("ordinal", "doc_id", "n_chars", "source"), b.select("ordinal", "doc_id", "lang")
    )


@query(
    "bt3_concat_batches",
    """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey AS id FROM orders),
e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS ordinal, event_id AS id FROM events)
SELECT ordinal, id, 0 AS source FROM o UNION ALL SELECT ordinal + (SELECT count(*) FROM o), id, 1 FROM e""",
)
def concat_batches(spark, sf):
    o = with_rank(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), ["id"])
    e = with_rank(table(spark, sf, "events").select(F.col("event_id").alias("id")), ["id"])
    return batching.concat_batches([o, e])


@query("bt4_chunk", f"WITH {BATCH} SELECT ordinal, doc_id, ordinal // ((SELECT count(*) FROM b) // 8) AS chunk FROM b")
def chunk(spark, sf):
    """Chunks of an eighth of the documents; up to seven left over are chunks from 8 on."""
    return batching.chunk(_batch(spark, sf).select("ordinal", "doc_id"), 8, strict=False)


@query(
    "bt5_repeat",
    f"""WITH {BATCH} SELECT 'interleave' AS mode, ordinal * 3 + j AS ordinal, doc_id FROM b CROSS JOIN (SELECT unnest([0,1,2]) AS j)
UNION ALL SELECT 'tile', j * (SELECT count(*) FROM b) + ordinal, doc_id FROM b CROSS JOIN (SELECT unnest([0,1,2]) AS j)""",
)
def repeat(spark, sf):
    b = _batch(spark, sf).select("ordinal", "doc_id")
    return (
        batching.repeat(b, 3).withColumn("mode", F.lit("interleave"))
        .unionByName(batching.repeat(b, 3, interleave=False).withColumn("mode", F.lit("tile")))
    )


@query(
    "bt6_reorder",
    f"""WITH {BATCH}, i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, ordinal AS source FROM b)
SELECT i.ordinal, b.doc_id, r.ordinal AS back FROM i JOIN b ON b.ordinal = i.source JOIN i r ON r.source = i.ordinal""",
)
def reorder(spark, sf):
    b = _batch(spark, sf).select("ordinal", "doc_id")
    index = with_rank(b.withColumnRenamed("ordinal", "source"), ["doc_id"]).select("ordinal", "source")
    moved = batching.reorder(b, index)
    # inverse(index): row `source` of the inverse is where the row of that ordinal went
    back = batching.inverse(index).select(F.col("source").alias("back"), "ordinal")
    return moved.join(back, "ordinal").select("ordinal", "doc_id", "back")


@query(
    "bt7_pad_to",
    f"""WITH {BATCH}, n AS (SELECT count(*) AS n FROM b)
SELECT ordinal, doc_id, 0 AS padded FROM b
UNION ALL SELECT ordinal + n, doc_id, 1 FROM b, n WHERE ordinal < (7 - n % 7) % 7""",
)
def pad_to(spark, sf):
    padded = batching.pad_to(_batch(spark, sf).select("ordinal", "doc_id"), 7)
    return padded.withColumn("padded", F.col("padded").cast("int"))


@query("bt7_unpad", f"WITH {BATCH} SELECT ordinal, doc_id FROM b")
def unpad(spark, sf):
    return batching.unpad(batching.pad_to(_batch(spark, sf).select("ordinal", "doc_id"), 7))


def _shuffle_sql(seed: int, epochs: int) -> str:
    """Relations s0 to s<ROUNDS>: column x is the place after that many rounds."""
    keys = [batching.shuffle_keys(seed, e) for e in range(epochs)]
    pick = lambda r, k: "CASE epoch " + " ".join(f"WHEN {e} THEN {keys[e][r][k]}" for e in range(epochs)) + " END"
    steps = [f"s0 AS (SELECT epoch, ordinal, doc_id, ordinal AS x, (SELECT count(*) FROM b) AS n FROM b CROSS JOIN (SELECT unnest(range(0, {epochs})) AS epoch))"]
    for r in range(batching.ROUNDS):
        steps.append(
            f"""m{r} AS (SELECT *, (({pick(r, 0)} - x) % n + n) % n AS m FROM s{r}),
h{r} AS (SELECT *, (greatest(x, m) % {batching.PRIME} * 48271 + {pick(r, 1)}) % {batching.PRIME} AS y FROM m{r}),
s{r + 1} AS (SELECT epoch, ordinal, doc_id, CASE WHEN y * y % {batching.PRIME} // 1024 % 2 = 1 THEN m ELSE x END AS x, n FROM h{r})"""
        )
    return ",\n".join(steps)


@query(
    "bt8_minibatches",
    f"""WITH {BATCH}, {_shuffle_sql(42, 3)}
SELECT ordinal, doc_id, CAST(epoch AS INTEGER) AS epoch, CAST(x AS BIGINT) AS position, CAST(x // 64 AS BIGINT) AS batch FROM s{batching.ROUNDS} WHERE x // 64 < n // 64""",
)
def minibatches(spark, sf):
    return batching.minibatches(_batch(spark, sf).select("ordinal", "doc_id"), 64, 3, seed=42)


@query(
    "bt8_batch_sizes",
    """WITH n AS (SELECT count(*) // 64 AS n_full FROM documents)
SELECT epoch, CAST(unnest(range(0, n_full)) AS BIGINT) AS batch, CAST(64 AS BIGINT) AS n FROM n, (SELECT unnest([0, 1, 2]) AS epoch)""",
)
def batch_sizes(spark, sf):
    """Rows of every mini-batch: full batches only."""
    return minibatches(spark, sf).groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"))


@query(
    "bt8_epoch_rows",
    """WITH n AS (SELECT count(*) // 64 * 64 AS n FROM documents)
SELECT epoch, CAST(n AS BIGINT) AS n_rows, CAST(n AS BIGINT) AS n_docs FROM n, (SELECT unnest([0, 1, 2]) AS epoch) WHERE n > 0""",
)
def epoch_rows(spark, sf):
    """Rows and different documents of every epoch: none is dealt twice."""
    per = minibatches(spark, sf).groupBy("epoch", "ordinal").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("epoch").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_docs"))


@query(
    "bt9_collate",
    f"""WITH {BATCH} SELECT ordinal // 16 AS batch, string_agg(doc_id, ',' ORDER BY ordinal) AS ids,
  count(*) AS n FROM b GROUP BY 1""",
)
def collate(spark, sf):
    b = _batch(spark, sf).withColumn("batch", F.floor(F.col("ordinal") / 16))
    out = batching.collate(b, "batch", "ordinal", ["doc_id", "n_chars"])
    return out.select(
        "batch", F.array_join(F.col("doc_id").cast("array<string>"), ",").alias("ids"), F.size("n_chars").cast("long").alias("n")
    )


@query("bt9_fold_unfold", f"WITH {BATCH} SELECT ordinal, doc_id, n_chars FROM b")
def fold_unfold(spark, sf):
    cols = ["doc_id", "n_chars"]
    b = _batch(spark, sf).select("ordinal", *cols)
    # about 1024 rows to an array; the size must divide the batch
    n = b.count()
    arrays = next((k for k in range(-(-n // 1024), n + 1) if n % k == 0), 1) if n else 1
    return batching.unfold(batching.fold(b, arrays, cols), cols)


RANKED = """r AS (
  SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rk,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents)"""


def _differencing(k: str, states: str) -> str:
    """Group totals by largest differencing, one merge of the two states of largest spread per step.

    ``states`` has (source, id, sums, k): the first states of each source, sums in falling order.  The
    totals when dealing back and forth are taken where their spread is smaller.
    """
    return f"""WITH RECURSIVE {RANKED}, kr AS (SELECT *, {k} AS k FROM r), first_states AS ({states}),
ld AS (
  SELECT source, k, list({{'a': sums[k] - sums[1], 'b': -sums[1], 'id': id, 'sums': sums}}) AS st, count(*) AS made FROM first_states GROUP BY source, k
  UNION ALL
  SELECT source, k, list_append(st[3:], {{'a': m[k] - m[1], 'b': -m[1], 'id': made, 'sums': m}}), made + 1
  FROM (SELECT source, k, st, made, list_reverse_sort([st[1].sums[i] + st[2].sums[k + 1 - i] for i in range(1, k + 1)]) AS m
        FROM (SELECT source, k, list_sort(st) AS st, made FROM ld WHERE len(st) > 1))),
ends AS (SELECT source, st[1].sums AS sums FROM ld WHERE len(st) = 1),
dl AS (SELECT source, k, CASE WHEN (rk // k) % 2 = 0 THEN rk % k ELSE k - 1 - rk % k END AS grp, sum(n_chars) AS s FROM kr GROUP BY 1, 2, 3),
dealt AS (SELECT source, list_reverse_sort(list(s)) AS sums FROM dl GROUP BY source),
best AS (SELECT source, CASE WHEN e.sums[1] - e.sums[-1] <= d.sums[1] - d.sums[-1] THEN e.sums ELSE d.sums END AS sums, d.sums[1] - d.sums[-1] AS dealt_spread
         FROM ends e JOIN dealt d USING (source))"""


EQUAL_STATES = _differencing("5", "SELECT source, rk // 5 AS id, list_reverse_sort(list(n_chars)) AS sums, k FROM kr GROUP BY source, rk // 5, k")
FREE_STATES = _differencing(
    "CAST(ceil(total / 200000) AS BIGINT)",
    "SELECT source, rk AS id, [CASE WHEN i = 1 THEN n_chars ELSE 0 END for i in range(1, k + 1)] AS sums, k FROM kr",
)


def _group_totals(grouped, group: str):
    """Totals of the groups of each source, largest first; ``most`` is what every group has, ``n // k`` in SQL."""
    totals = grouped.groupBy("source", group).agg(F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("n"))
    listed = totals.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list("total"))).alias("sums"), F.sum("n").alias("n"), F.min("n").alias("most"))
    each = listed.select("source", "n", "most", F.posexplode("sums").alias("place", "total"))
    return each.select("source", F.col("place").cast("long").alias("place"), "total", "n", "most")


@query(
    "bt10_balanced_groups",
    f"""{EQUAL_STATES}, c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT source, CAST(i - 1 AS BIGINT) AS place, CAST(sums[i] AS BIGINT) AS total, n, n // 5 AS most FROM (SELECT *, unnest(range(1, 6)) AS i FROM best) JOIN c USING (source)""",
)
def balanced_groups(spark, sf):
    """Group totals of each source; every group has a fifth of the rows.  SQL has no exact split, so small sources get none.

    Sources that do not divide are dealt, as in the statement, where a short state has no spread to compare.
    """
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return _group_totals(batching.balanced_groups(d, "source", "n_chars", 5, key="doc_id", exact_rows=0, uneven="deal"), "group")


@query(
    "bt10_dealt_and_differenced",
    f"""{EQUAL_STATES} SELECT source, CAST(sums[1] - sums[-1] AS BIGINT) AS spread, CAST(dealt_spread AS BIGINT) AS dealt_spread FROM best""",
)
def dealt_and_differenced(spark, sf):
    """Spread of the differenced groups beside that of rows dealt back and forth."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    ranked = with_rank(batching.balanced_groups(d, "source", "n_chars", 5, key="doc_id", exact_rows=0, uneven="deal").withColumn("neg", -F.col("n_chars")), ["neg", "doc_id"], ["source"], "rk")
    lap, at = F.floor(F.col("rk") / 5), F.col("rk") % 5
    dealt = ranked.withColumn("dealt", F.when(lap % 2 == 0, at).otherwise(4 - at))
    totals = dealt.groupBy("source", "group", "dealt").agg(F.sum("n_chars").alias("s"))
    spread = lambda by, name: totals.groupBy("source", by).agg(F.sum("s").alias("s")).groupBy("source").agg((F.max("s") - F.min("s")).alias(name))
    return spread("group", "spread").join(spread("dealt", "dealt_spread"), "source")


@query(
    "bt11_balance_report",
    f"""{EQUAL_STATES}, bf AS (SELECT source, place // (n // 5) AS p, sum(n_chars) AS s FROM r GROUP BY 1, 2),
b1 AS (SELECT source, min(s) AS mn, max(s) AS mx, sum(s) / 5 AS mean FROM bf GROUP BY 1)
SELECT source, CAST(mn AS BIGINT) AS min, CAST(mx AS BIGINT) AS max, CAST(mx - mn AS BIGINT) AS minmax_diff,
       CAST(sums[-1] AS BIGINT) AS balanced_min, CAST(sums[1] AS BIGINT) AS balanced_max, CAST(mean AS DOUBLE) AS mean FROM b1 JOIN best USING (source)""",
)
def balance_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    grouped = batching.balanced_groups(d, "source", "n_chars", 5, key="doc_id", exact_rows=0, uneven="deal")
    return batching.balance_report(grouped, "source", "n_chars", 5, "doc_id")


@query(
    "bt12_micro_batches",
    f"""{FREE_STATES}, c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT source, CAST(i - 1 AS BIGINT) AS place, CAST(sums[i] AS BIGINT) AS total, n FROM (SELECT *, unnest(range(1, len(sums) + 1)) AS i FROM best) JOIN c USING (source)""",
)
def micro_batches(spark, sf):
    """Totals of the micro-batches of each source; their number follows from the budget."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return _group_totals(batching.micro_batches(d, "source", "n_chars", 200_000, key="doc_id", exact_rows=0), "micro").drop("most")


# --- sources and sinks ----------------------------------------------------------------------------


@query("io1_read_parquet", "SELECT l_returnflag, 2 * count(*) AS n FROM lineitem GROUP BY 1")
def read_parquet(spark, sf):
    path = f"{sf}/lineitem.parquet"
    both = io.read_parquet(spark, [path, path])
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"),
        F.concat(F.lit("db"), (F.col("item_id") % 3).cast("string")).alias("db_id"),
        F.col("text").alias("question"),
    )


@query("io2_read_questions", "SELECT item_id AS question_id, 'db' || (item_id % 3) AS db_id, text AS question FROM benchmark")
def read_questions(spark, sf):
    path = scratch_path(spark, "questions")
    _questions(spark, sf).write.json(path)
    return io.read_questions(spark, path).select("question_id", "db_id", "question")


@query("io3_read_sql_pairs", f"WITH {SQL_LOG} SELECT trim(sql) AS sql, 'db' || (k % 3) AS db_id, count(*) AS n FROM lg GROUP BY 1, 2")
def read_sql_pairs(spark, sf):
    path = scratch_path(spark, "pairs")
    db = F.concat(F.lit("db"), (F.col("o_orderkey") % 6 % 3).cast("string"))
    sql_log(spark, sf).select(F.concat("sql", F.lit("\t"), db).alias("value")).write.text(path)
    return io.read_sql_pairs(spark, path).groupBy("sql", "db_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "io3_read_tagged",
    f"""WITH {SQL_LOG} SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 10 = 9 THEN ' ' ELSE sql END AS sql,
  CASE WHEN o_orderkey % 10 = 9 THEN 'financial' ELSE 'db' || (k % 3) END AS db_id FROM lg""",
)
def read_tagged(spark, sf):
    path = scratch_path(spark, "tagged")
    key = F.col("o_orderkey")
    db = F.concat(F.lit("db"), (key % 6 % 3).cast("string"))
    quoted = F.regexp_replace(F.to_json(F.array(F.concat("sql", F.lit(io.TAG), db))), r"^\[|\]$", "")
    text = F.when(key % 10 == 9, F.lit("0")).otherwise(F.col("q"))
    line = F.concat(F.lit('    "'), key.cast("string"), F.lit('": '), text, F.lit(","))
    sql_log(spark, sf).withColumn("q", quoted).select(line.alias("value")).write.text(path)
    return io.read_tagged_predictions(spark, path)


@query(
    "io4_merge_predictions",
    """SELECT o_orderkey AS question_id, 'SELECT ' || o_custkey || ' ' AS sql, c_mktsegment AS db_id FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def merge_predictions(spark, sf):
    o = table(spark, sf, "orders")
    ranked = with_rank(o.select("o_orderkey", "o_custkey"), ["o_orderkey"])
    pred = ranked.select(
        "ordinal", F.concat(F.lit("SELECT "), F.col("o_custkey").cast("string"), F.lit(" /* why */ FROM t")).alias("sql")
    )
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("db_id"))
    meta = ranked.join(c, "o_custkey").withColumnRenamed("o_orderkey", "question_id")
    return io.merge_predictions(pred, meta).select("question_id", "sql", "db_id")


@query(
    "io5_write_splits",
    "SELECT CASE WHEN doc_id % 5 = 4 THEN 'test' ELSE 'train' END AS split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
)
def write_splits(spark, sf):
    path = scratch_path(spark, "splits")
    split = F.when(F.col("doc_id") % 5 == 4, "test").otherwise("train")
    io.write_splits(table(spark, sf, "documents").withColumn("split", split), path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def _scored_log(spark, sf):
    ok = (F.col("o_orderkey") % 4 != 0).cast("int")
    return sql_log(spark, sf).select(
        F.col("o_orderkey").alias("id"), F.col("sql").alias("pred_sql"), F.lit("SELECT 1").alias("gold_sql"),
        F.lit("orders(o_orderkey)").alias("schema"), ok.alias("ok"),
    )


@query(
    "io6_error_report",
    f"WITH {SQL_LOG} SELECT o_orderkey AS id, sql AS pred_sql, CASE WHEN o_orderkey % 4 <> 0 THEN 'true' ELSE 'false' END AS is_correct FROM lg",
)
def error_report(spark, sf):
    path = scratch_path(spark, "errors")
    io.error_report(_scored_log(spark, sf), path)
    schema = "id long, pred_sql string, gold_sql string, schema string, is_correct string"
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return back.select("id", "pred_sql", "is_correct")


@query("io6_failing_ids", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0")
def failing_ids(spark, sf):
    return io.failing_ids(_scored_log(spark, sf))


@query(
    "io7_log_metrics",
    """WITH w AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS step, CAST(count(*) AS DOUBLE) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1)
SELECT step, 'n' AS name, n AS value FROM w UNION ALL SELECT step, 'mean', mean FROM w""",
)
def log_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    wide = (
        table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("step"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    )
    io.log_metrics(wide, path=path)
    return spark.read.parquet(path)
