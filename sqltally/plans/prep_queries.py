"""Dataset preparation, value retrieval and token sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltally.functions.ordering import with_rank
from sqltally.operators import catalog, prep
from sqltally.plans.catalog_queries import SCHEMAS
from sqltally.plans.registry import query
from sqltally.plans.views import SQL_LOG, sql_log, table


def _documents(spark, sf):
    return with_rank(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), ["doc_id"])


@query(
    "dp1_split_by_position",
    """WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents)
SELECT doc_id, CASE WHEN ordinal < 120 THEN 'train' ELSE 'test' END AS split, CASE WHEN ordinal < 120 THEN ordinal ELSE ordinal - 120 END AS "index"
FROM b WHERE ordinal < 180""",
)
def split_by_position(spark, sf):
    out = prep.split_by_position(_documents(spark, sf), 120, 60)
    return out.select("doc_id", "split", "index")


@query("dp2_take_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def take_first(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return prep.take_first(o, ["o_orderkey"], 100)


PROMPT = "Engine {engine}\n{schema}\nEvidence: {knowledge}\nLevel: {complexity}\nQ: {question}\nA: <think>"


def _asked(spark, sf):
    """Conversation turns as questions on three databases."""
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        F.concat(F.lit("db"), (F.col("conv_id") % 3).cast("string")).alias("db_id"),
        F.col("text").alias("question"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("role\nis "), "role")).otherwise(F.lit(" ")).alias("knowledge"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("complexity"),
    )


def _ddl(spark, sf):
    """One schema text per database: regions by id modulo three."""
    r = table(spark, sf, "region")
    return r.groupBy(F.concat(F.lit("db"), (F.col("r_regionkey") % 3).cast("string")).alias("db_id")).agg(
        F.concat(F.lit("TABLE "), F.min("r_name")).alias("ddl")
    )


ASKED = """a AS (
  SELECT conv_id * 1000 + turn AS question_id, 'db' || (conv_id % 3) AS db_id, text AS question,
         CASE WHEN turn % 2 = 0 THEN 'role' || chr(10) || 'is ' || role ELSE ' ' END AS knowledge, 'turn ' || turn AS complexity FROM conversations),
d AS (SELECT 'db' || (r_regionkey % 3) AS db_id, 'TABLE ' || min(r_name) AS ddl FROM region GROUP BY 1)"""


@query(
    "dp3_build_prompts",
    f"""WITH {ASKED}
SELECT question_id, 'Engine SQLite' || chr(10) || ddl || chr(10) || 'Evidence: ' || replace(knowledge, chr(10), ' ') || chr(10) || 'Level: ' || complexity
  || chr(10) || 'Q: ' || replace(question, chr(10), ' ') || chr(10) || 'A: <think>' AS prompt FROM a JOIN d USING (db_id)""",
)
def build_prompts(spark, sf):
    return prep.build_prompts(_asked(spark, sf), _ddl(spark, sf), PROMPT, one_line=True)


@query(
    "dp3_joined_knowledge",
    f"""WITH {ASKED}
SELECT question_id, ddl || chr(10) || CASE WHEN trim(knowledge) = '' THEN question ELSE knowledge || chr(10) || question END AS prompt FROM a JOIN d USING (db_id)""",
)
def joined_knowledge(spark, sf):
    return prep.build_prompts(_asked(spark, sf), _ddl(spark, sf), "{schema}\n{question}")


@query(
    "dp4_training_records",
    f"""WITH {ASKED}
SELECT question_id, 'synthetic' AS data_source, 'user' AS role, ddl || chr(10) || CASE WHEN trim(knowledge) = '' THEN question ELSE knowledge || chr(10) || question END AS content,
  'logic' AS ability, 'rule' AS style, db_id, 'SELECT ' || question_id AS sql, CASE WHEN question_id % 4 = 0 THEN 'test' ELSE 'train' END AS split
FROM a JOIN d USING (db_id)""",
)
def training_records(spark, sf):
    asked = _asked(spark, sf)
    prompts = prep.build_prompts(asked, _ddl(spark, sf), "{schema}\n{question}")
    gold = asked.select(
        "question_id", "db_id",
        F.concat(F.lit("SELECT "), F.col("question_id").cast("string")).alias("sql"),
        F.when(F.col("question_id") % 4 == 0, "test").otherwise("train").alias("split"),
        F.col("question_id").alias("index"),
    )
    rec = prep.training_records(prompts, gold, "synthetic")
    return rec.select(
        "question_id", "data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"),
        "ability", "reward_model.style", "reward_model.ground_truth.db_id", "reward_model.ground_truth.sql", "extra_info.split",
    )


@query(
    "dp5_unify_questions",
    """SELECT 'a' AS data_source, 'db' || (item_id % 3) AS db_id, text AS question, 'SELECT ' || item_id AS sql, 'item ' || item_id AS knowledge FROM benchmark
UNION ALL SELECT 'b', source, text, 'SELECT ' || n_chars, '' FROM documents""",
)
def unify_questions(spark, sf):
    a = table(spark, sf, "benchmark").select(
        F.concat(F.lit("db\n"), (F.col("item_id") % 3).cast("string")).alias("db_id"),
        F.struct(
            F.col("text").alias("question"),
            F.struct(F.concat(F.lit("SELECT "), F.col("item_id").cast("string")).alias("SQL")).alias("gold"),
        ).alias("extra"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("evidence"),
    )
    b = table(spark, sf, "documents").select(
        F.col("source").alias("db_id"), F.col("text").alias("question"),
        F.concat(F.lit("SELECT "), F.col("n_chars").cast("string")).alias("query"),
    )
    mapping = {
        "a": {"question": "extra.question", "sql": "extra.gold.SQL", "knowledge": "evidence"},
        "b": {"question": "question", "sql": "query", "knowledge": None},
    }
    return prep.unify_questions({"a": a, "b": b}, mapping)


@query(
    "dp6_word_ngrams",
    """WITH w AS (SELECT item_id, text, regexp_extract_all(text, '[\\w]+|[^\\w\\s]') AS w FROM benchmark),
g AS (
  SELECT item_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS ngram
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest([1,2,3,4,5,6,7,8]) AS n FROM w))
  UNION ALL SELECT item_id, 9, 1, text FROM w),
f AS (SELECT item_id, ngram, min(n * 1000000 + i) AS spot FROM g GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY spot) - 1 AS INTEGER) AS rank, ngram FROM f""",
)
def word_ngrams(spark, sf):
    return prep.word_ngrams(table(spark, sf, "benchmark"), "item_id", "text")


def _retrieval(spark, sf):
    queries = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"
    )
    return queries, table(spark, sf, "benchmark").select(F.col("item_id").alias("value_id"), "text")


@query(
    "dp7_retrieve_topk",
    """WITH v AS (SELECT min(item_id) AS value_id, text FROM benchmark GROUP BY text),
p AS (SELECT value_id, token, count(*) AS tf FROM (SELECT value_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS token FROM v) GROUP BY 1, 2),
l AS (SELECT value_id, sum(tf) AS dl FROM p GROUP BY 1),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT conv_id * 1000 + turn AS query_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS token FROM conversations) GROUP BY 1, 2),
sc AS (
  SELECT query_id, value_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))), 9) AS score
  FROM q JOIN p USING (token) JOIN df USING (token) JOIN l USING (value_id), s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, value_id) AS rank FROM sc)
SELECT query_id, value_id, round(score + 2e-10, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def retrieve_topk(spark, sf):
    """Conversation turns ask for benchmark passages."""
    out = prep.retrieve_topk(*_retrieval(spark, sf))
    return out.withColumn("score", F.round(F.col("score") + 2e-10, 6))


def _sentences(spark, sf):
    """Benchmark sentences as stored values; the column is the passage group."""
    b = table(spark, sf, "benchmark").select(
        "item_id", F.posexplode(F.split("text", r"[.\n]")).alias("at", "value")
    )
    return (
        b.withColumn("value", F.trim("value"))
        .where("value != ''")
        .select(
            (F.col("item_id") * 1000 + F.col("at")).alias("value_id"),
            F.concat(F.lit("col"), (F.col("item_id") % 4).cast("string")).alias("column"),
            "value",
        )
    )


def _doc_questions(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"))


SENTENCES = """s0 AS (SELECT item_id, regexp_split_to_array(text, '[.\\n]') AS parts FROM benchmark),
s AS (SELECT item_id * 1000 + i - 1 AS value_id, 'col' || (item_id % 4) AS "column", trim(parts[i]) AS value
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s0) WHERE trim(parts[i]) <> '')"""


@query(
    "dp7_retrieval_rows",
    """WITH v AS (SELECT min(item_id) AS value_id, text FROM benchmark GROUP BY text),
p AS (SELECT DISTINCT value_id, token FROM (SELECT value_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS token FROM v)),
q AS (SELECT DISTINCT query_id, token FROM (SELECT conv_id * 1000 + turn AS query_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS token FROM conversations))
SELECT count(*) AS all_rows, 1 AS fewer FROM q JOIN p USING (token)""",
)
def retrieval_rows(spark, sf):
    """How many rows a join on all tokens makes, and whether the pruned one makes fewer."""
    rows = prep.retrieval_rows(*_retrieval(spark, sf))
    return rows.select("all_rows", (F.col("joined_rows") < F.col("all_rows")).cast("int").alias("fewer"))


@query(
    "dp8_match_values",
    f"""WITH {SENTENCES}, v AS (
  SELECT *, lower(value) AS low, length(value) AS n, CAST(floor(0.85 * length(value)) AS BIGINT) + 1 AS need FROM s),
pairs AS (
  SELECT doc_id AS question_id, lower(text) AS q, v.* FROM documents JOIN v ON contains(lower(text), substr(low, n - need + 1, 2 * need - n))),
m AS (
  SELECT question_id, value_id, "column", value, n, list_max([size FOR size IN range(need, n + 1)
    IF list_bool_or([contains(q, substr(low, st, size)) FOR st IN range(1, n - size + 2)])]) AS best FROM pairs),
r AS (
  SELECT *, best / n AS score, row_number() OVER (PARTITION BY question_id ORDER BY best / n DESC, n DESC, value_id DESC) AS rank FROM m WHERE best IS NOT NULL)
SELECT question_id, "column", value_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""",
)
def match_values(spark, sf):
    out = prep.match_values(_doc_questions(spark, sf), _sentences(spark, sf))
    return out.select("question_id", "column", "value_id", F.round("score", 6).alias("score"), "rank")


@query(
    "dp8_matches_by_column",
    f"""WITH {SENTENCES}, v AS (
  SELECT *, lower(value) AS low, length(value) AS n, CAST(floor(0.85 * length(value)) AS BIGINT) + 1 AS need FROM s),
pairs AS (
  SELECT doc_id AS question_id, lower(text) AS q, v.* FROM documents JOIN v ON contains(lower(text), substr(low, n - need + 1, 2 * need - n))),
m AS (
  SELECT question_id, value_id, "column", value, n, list_max([size FOR size IN range(need, n + 1)
    IF list_bool_or([contains(q, substr(low, st, size)) FOR st IN range(1, n - size + 2)])]) AS best FROM pairs),
r AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY best / n DESC, n DESC, value_id DESC) AS rank FROM m WHERE best IS NOT NULL)
SELECT question_id, "column", string_agg(value, chr(10) ORDER BY rank) AS "values" FROM r WHERE rank <= 20 GROUP BY 1, 2""",
)
def matches_by_column(spark, sf):
    out = prep.matches_by_column(prep.match_values(_doc_questions(spark, sf), _sentences(spark, sf)))
    return out.withColumn("values", F.array_join("values", "\n"))


@query("dp9_fuzzy_link")
def fuzzy_link(spark, sf):
    return prep.fuzzy_link(_doc_questions(spark, sf), _sentences(spark, sf))


#: every text column of the provided tables
TEXT_COLUMNS = [(t, c) for t, columns in SCHEMAS.items() for c, kind in columns.items() if kind == "varchar"]


def _column_values(spark, sf):
    tables = {n: table(spark, sf, n) for n in dict(TEXT_COLUMNS)}
    long = catalog.long_values(tables, [c for _, c in TEXT_COLUMNS])
    return long.select(F.concat_ws(".", "table_name", "column_name").alias("column"), "value")


LOOKUP = "cv AS (" + "\n  UNION ".join(
    f"""SELECT '{t}.{c}' AS "column", lower(trim({c})) AS low FROM {t}""" for t, c in TEXT_COLUMNS
) + """),
tk AS (
  SELECT DISTINCT lower(token) AS token FROM (
    SELECT unnest(regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand, '\\w+')) AS token FROM part
    UNION ALL SELECT unnest(regexp_extract_all(text, '\\w+')) FROM conversations)
  WHERE token <> '')"""


def _lookup_tokens(spark, sf):
    part = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    words = lambda c: F.explode(F.regexp_extract_all(c, F.lit(r"(\w+)"), F.lit(1))).alias("token")
    return table(spark, sf, "part").select(words(part)).unionByName(
        table(spark, sf, "conversations").select(words(F.col("text")))
    )


@query(
    "dp10_lookup_prefix",
    f"""WITH {LOOKUP}, heads AS (
  SELECT "column", substr(low, 1, n) AS head FROM cv JOIN (SELECT DISTINCT length(token) AS n FROM tk) ON length(low) >= n)
SELECT token, "column", count(*) AS n_values FROM tk JOIN heads ON head = token GROUP BY 1, 2""",
)
def lookup_prefix(spark, sf):
    return prep.lookup_values(_lookup_tokens(spark, sf), _column_values(spark, sf), "prefix")


@query(
    "dp10_lookup_exact",
    f"""WITH {LOOKUP} SELECT token, "column", count(*) AS n_values FROM tk JOIN cv ON low = token GROUP BY 1, 2""",
)
def lookup_exact(spark, sf):
    return prep.lookup_values(_lookup_tokens(spark, sf), _column_values(spark, sf), "exact")


@query(
    "dp11_dedupe_queries",
    f"""WITH {SQL_LOG}, n AS (
  SELECT o_orderkey AS ordinal, sql, CASE k WHEN 5 THEN 'select ''Distinct Value'', o_custkey from orders where not o_custkey = ' || o_custkey
    WHEN 0 THEN 'select distinct o_custkey from orders where orders.o_orderpriority = ''' || prio || ''' and o_totalprice > ' || price
    WHEN 1 THEN 'select count(*) from orders where o_orderstatus = ''' || state || ''' group by o_custkey having count(*) > 2 order by o_custkey desc limit 5'
    WHEN 3 THEN 'select o_orderkey from orders where o_orderstatus like ''' || state || ''' or o_custkey in (' || o_custkey || ', 2)'
    ELSE lower(sql) END AS norm FROM lg)
SELECT norm, min(ordinal) AS ordinal, arg_min(sql, ordinal) AS sql, count(*) AS n_dups FROM n GROUP BY 1""",
)
def dedupe_queries(spark, sf):
    return prep.dedupe_queries(sql_log(spark, sf).withColumnRenamed("o_orderkey", "ordinal"))


@query(
    "dp12_identifier_vocabulary",
    f"""WITH {SQL_LOG}, i AS (
  SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(sql, '''[^'']*''', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_.]*')) AS name FROM lg) GROUP BY 1),
w AS (SELECT name, n, unnest(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_.\\s]+', ' ', 'g')), ' ')) AS word FROM i)
SELECT word, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT name) AS n_names FROM w WHERE word <> '' GROUP BY 1""",
)
def identifier_vocabulary(spark, sf):
    bare = F.regexp_replace("sql", "'[^']*'", " ")
    name = F.explode(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1)))
    names = sql_log(spark, sf).select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return prep.identifier_vocabulary(names)


# --- token sequences: a token id is the length of a blank-separated word ---------------------------


def _ids(col):
    return F.transform(F.split(col, " ", -1), lambda w: F.length(w))


def _dot(ids):
    """Position-weighted sum: changes when any token or its place changes."""
    return F.aggregate(
        F.transform(ids, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x
    )


IDS = "[len(x) FOR x IN string_split(text, ' ')]"


def _dot_sql(ids: str) -> str:
    return f"CAST(list_sum([CAST(x AS BIGINT) * i FOR x, i IN {ids}]) AS BIGINT)"


@query(
    "dp13_training_sequences",
    f"""WITH t AS (SELECT doc_id, {IDS} AS ids, len({IDS}) AS n FROM documents),
c AS (SELECT doc_id, n, CASE WHEN n > 256 THEN ids[n - 255:n] ELSE ids END AS kept, least(n, 256) AS m FROM t),
p AS (SELECT doc_id, n, m, [0 FOR z IN range(0, 256 - m)] || kept AS ids FROM c)
SELECT doc_id, CAST(n AS INTEGER) AS n_tokens, CAST(m AS INTEGER) AS n_valid, {_dot_sql('ids')} AS ids_sum,
  CAST(m * (m - 1) // 2 AS BIGINT) AS position_sum,
  CAST(CASE WHEN list_position(ids, 1) IS NULL OR list_position(ids, 1) = 0 THEN 256 ELSE list_position(ids, 1) END AS INTEGER) AS n_before_eos FROM p""",
)
def training_sequences(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", _ids(F.col("text")).alias("ids"))
    seq = prep.training_sequences(docs, 256, "left", "left", pad_id=0, eos_id=1)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return seq.select(
        "doc_id", "n_tokens", total("mask").alias("n_valid"), _dot(F.col("ids")).alias("ids_sum"),
        total("position_ids").cast("long").alias("position_sum"), total("eos_mask").alias("n_before_eos"),
    )


@query(
    "dp13_remove_padding",
    f"""WITH t AS (SELECT doc_id, {IDS} AS ids, len({IDS}) AS n FROM documents),
c AS (SELECT doc_id, CASE WHEN n > 256 THEN ids[n - 255:n] ELSE ids END AS kept FROM t)
SELECT doc_id, CAST(len(kept) AS INTEGER) AS n_ids, {_dot_sql('kept')} AS ids_sum FROM c""",
)
def remove_padding(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", _ids(F.col("text")).alias("ids"))
    bare = prep.remove_padding(prep.training_sequences(docs, 256, "left", "left"))
    return bare.select("doc_id", F.size("ids").alias("n_ids"), _dot(F.col("ids")).alias("ids_sum"))


@query(
    "dp13_sequence_report",
    f"""WITH t AS (SELECT source, len({IDS}) AS n FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (n > 256) AS truncated, count(*) FILTER (n < 256) AS padded,
  CAST(sum(greatest(256 - n, 0)) AS BIGINT) AS pad_tokens FROM t GROUP BY 1""",
)
def sequence_report(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", _ids(F.col("text")).alias("ids"))
    return prep.sequence_report(prep.training_sequences(docs, 256, "right", "right"), 256).withColumn(
        "pad_tokens", F.col("pad_tokens").cast("long")
    )


def _turns(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", _ids(F.col("text")).alias("ids"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("response_ids"))
    return c.withColumnRenamed("ids", "prompt_ids").join(after, ["conv_id", "turn"])


TURNS = """c AS (SELECT conv_id, turn, role, [len(x) FOR x IN string_split(text, ' ')] AS ids FROM conversations),
tn AS (SELECT a.conv_id, a.turn, a.role, a.ids AS p, b.ids AS r, len(a.ids) AS np, len(b.ids) AS nr FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


@query(
    "dp17_supervised_records",
    f"""WITH {TURNS}, j AS (SELECT conv_id, turn, np, nr, (p || r)[1:200] AS kept, least(np + nr, 200) AS m FROM tn),
f AS (SELECT *, kept || [0 FOR z IN range(0, 200 - m)] AS ids,
  [CASE WHEN (np > 1 AND i < least(np, 200) - 1) OR i = least(np + nr, 200) - 1 OR i >= m THEN 0 ELSE 1 END FOR i IN range(0, 200)] AS loss FROM j)
SELECT conv_id, turn, {_dot_sql('ids')} AS ids_sum, {_dot_sql('loss')} AS loss_sum FROM f""",
)
def supervised_records(spark, sf):
    rec = prep.supervised_records(_turns(spark, sf), 200, "right")
    return rec.select(
        "conv_id", "turn", _dot(F.col("ids")).alias("ids_sum"), _dot(F.col("loss_mask")).alias("loss_sum")
    )


@query(
    "dp17_trainable_tokens",
    f"""WITH {TURNS}, f AS (SELECT role, list_sum([CASE WHEN (np > 1 AND i < least(np, 200) - 1) OR i = least(np + nr, 200) - 1 OR i >= least(np + nr, 200) THEN 0 ELSE 1 END FOR i IN range(0, 200)]) AS k FROM tn)
SELECT role, count(*) AS n, CAST(sum(k) AS BIGINT) AS trainable FROM f GROUP BY 1""",
)
def trainable_tokens(spark, sf):
    return prep.trainable_tokens(prep.supervised_records(_turns(spark, sf), 200, "right"), "role")


@query(
    "dp19_preference_pairs",
    f"""WITH {TURNS}, j AS (
  SELECT conv_id, turn, [(p || r || [1])[1:128], (p || list_reverse(r) || [1])[1:128]] AS two, least(np + nr + 1, 128) AS m FROM tn),
k AS (SELECT conv_id, turn, m, two[1] || [0 FOR z IN range(0, 128 - m)] AS ch, two[2] || [0 FOR z IN range(0, 128 - m)] AS rj FROM j)
SELECT conv_id, turn, {_dot_sql('ch')} AS chosen_sum, {_dot_sql('rj')} AS rejected_sum, CAST(m AS INTEGER) AS mask_sum FROM k""",
)
def preference_pairs(spark, sf):
    """Chosen is the next turn, rejected the same turn read backwards."""
    turns = _turns(spark, sf).withColumnRenamed("response_ids", "chosen_ids")
    turns = turns.withColumn("rejected_ids", F.reverse("chosen_ids"))
    pair = prep.preference_pairs(turns, 128, eos_id=1)
    return pair.select(
        "conv_id", "turn",
        _dot(F.col("pair")[0]["ids"]).alias("chosen_sum"),
        _dot(F.col("pair")[1]["ids"]).alias("rejected_sum"),
        F.aggregate(F.col("pair")[1]["mask"], F.lit(0), lambda a, m: a + m).alias("mask_sum"),
    )
