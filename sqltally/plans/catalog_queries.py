"""Catalog, value profiling and schema text over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltally.functions.once import pinned
from sqltally.operators import catalog, prep
from sqltally.plans.registry import query
from sqltally.plans.views import SQL_LOG, sql_log, table

#: column -> type name of every provided table, in column order
SCHEMAS = {
    "region": {"r_regionkey": "integer", "r_name": "varchar"},
    "nation": {"n_nationkey": "integer", "n_name": "varchar", "n_regionkey": "integer"},
    "customer": {"c_custkey": "bigint", "c_name": "varchar", "c_nationkey": "integer", "c_acctbal": "double", "c_mktsegment": "varchar"},
    "supplier": {"s_suppkey": "bigint", "s_name": "varchar", "s_nationkey": "integer", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "varchar", "p_brand": "varchar", "p_type": "varchar", "p_size": "integer", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "varchar", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "varchar"},
    "events": {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "varchar", "value": "double", "props": "varchar"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "integer", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "varchar", "l_linestatus": "varchar", "l_shipdate": "timestamp"},
    "documents": {"doc_id": "bigint", "text": "varchar", "lang": "varchar", "source": "varchar", "n_chars": "bigint"},
    "labels": {"doc_id": "bigint", "quality": "integer", "toxic": "integer"},
    "benchmark": {"item_id": "bigint", "text": "varchar"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "varchar", "text": "varchar"},
    "pages": {"page_id": "bigint", "url": "varchar", "html": "varchar"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "integer"},
}
#: foreign keys by name
FKS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]
RESERVED = ["VALUE"]  # the only reserved word among the column names above


def _tables(spark, sf, names=tuple(SCHEMAS)):
    return {n: table(spark, sf, n) for n in names}


def _meta_rows() -> str:
    rows, i = [], 0
    for t, (name, cols) in enumerate(SCHEMAS.items()):
        for c, kind in cols.items():
            i += 1
            rows.append(f"({i}, {t}, '{name}', '{c}', '{kind}')")
    return ", ".join(rows)


#: long values of all columns as text, and the column list with ids
VALUES = "vals AS (" + "\n  UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t}"
    for t, cols in SCHEMAS.items()
    for c, kind in cols.items()
    if not kind.startswith("array")
) + f"""),
cells AS (SELECT * FROM vals UNION ALL SELECT 'embeddings', 'embedding', CASE WHEN embedding IS NOT NULL THEN '[]' END FROM embeddings),
meta AS (SELECT * FROM (VALUES {_meta_rows()}) AS m(column_id, table_id, table_name, column_name, declared)),
dv AS (SELECT table_name, column_name, value, count(*) AS n FROM vals GROUP BY 1, 2, 3)"""

KIND = """CASE WHEN declared IN ('varchar') THEN 'text' WHEN declared IN ('integer','bigint','double','array<float>') THEN 'number'
  WHEN declared = 'timestamp' THEN 'time' ELSE 'others' END"""
MISSING = ", ".join(f"'{v}'" for v in catalog.MISSING)
PAIRS = ", ".join(f"'{a} {b}'" for a, b in catalog.BOOLEAN_PAIRS)
#: example text of a value in a DDL comment
QUOTED = """CASE WHEN contains(value, '''') AND NOT contains(value, '"') THEN '"' || value || '"'
    ELSE '''' || replace(value, '''', '\\''') || '''' END"""


@query(
    "cat1_build_catalog",
    f"""WITH {VALUES}
SELECT column_id, m.table_name, m.column_name, replace(lower(m.column_name), '_', ' ') AS display, count(v.value) AS n_values
FROM meta m JOIN cells v ON v.table_name = m.table_name AND v.column_name = m.column_name GROUP BY 1, 2, 3, 4""",
)
def build_catalog(spark, sf):
    tables = _tables(spark, sf)
    _, columns = catalog.build_catalog(spark, tables)
    counts = catalog.column_counts(tables)
    return columns.join(counts, ["table_name", "column_name"]).select(
        "column_id", "table_name", "column_name", "display", "n_values"
    )


@query(
    "cat2_normalize_types",
    f"""WITH {VALUES}
SELECT {KIND} AS kind, count(DISTINCT column_id) AS n_columns, count(v.value) AS n_values
FROM meta m JOIN cells v ON v.table_name = m.table_name AND v.column_name = m.column_name GROUP BY 1""",
)
def normalize_types(spark, sf):
    tables = _tables(spark, sf)
    columns = catalog.normalize_types(catalog.build_catalog(spark, tables)[1])
    counts = catalog.column_counts(tables)
    return (
        columns.join(counts, ["table_name", "column_name"])
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n_values").alias("n_values"))
    )


@query(
    "cat3_infer_content_type",
    f"""WITH {VALUES}, s AS (
  SELECT table_name, column_name, count(value) AS n, min(lower(value)) AS lo, max(lower(value)) AS hi,
    count(*) FILTER (regexp_full_match(value, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) AS nums,
    count(*) FILTER (regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9:.]+')) AS dates
  FROM (SELECT table_name, column_name, CASE WHEN value NOT IN ({MISSING}) THEN value END AS value FROM dv) GROUP BY 1, 2)
SELECT table_name, column_name, n AS n_distinct,
  CASE WHEN n = 2 AND lo || ' ' || hi IN ({PAIRS}) THEN 'boolean' WHEN n - nums - dates > CASE WHEN n > 7 THEN 1 ELSE 0 END THEN 'text' WHEN n < 2 THEN 'unknown' WHEN dates > nums THEN 'date' ELSE 'number' END AS kind
FROM s""",
)
def infer_content_type(spark, sf):
    return catalog.infer_content_type(catalog.distinct_values(_tables(spark, sf), digests=True))


@query(
    "cat4_sample_values",
    f"""WITH {VALUES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS rank FROM dv WHERE value IS NOT NULL AND value <> '')
SELECT table_name, column_name, CAST(rank AS INTEGER) AS rank, substr(value, 1, 40) AS value FROM r WHERE rank <= 6""",
)
def sample_values(spark, sf):
    return catalog.sample_values(catalog.lowest_values(_tables(spark, sf), 6), 6)


@query(
    "cat5_first_values",
    f"""WITH {VALUES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value NULLS FIRST) AS rank FROM dv)
SELECT table_name, column_name, CAST(rank AS INTEGER) AS rank, value FROM r WHERE rank <= 5 AND (value IS NULL OR value <> '')""",
)
def first_values(spark, sf):
    return catalog.first_values(catalog.lowest_values(_tables(spark, sf), 5, blanks=True), 5)


@query("cat6_picklist", "SELECT DISTINCT o_custkey AS value FROM orders")
def picklist(spark, sf):
    return catalog.picklist(table(spark, sf, "orders"), "o_custkey")


@query(
    "cat7_duplicate_columns",
    f"""WITH {VALUES} SELECT table_name, column_name, count(value) AS n_distinct, CAST(coalesce(sum(CASE WHEN value IS NOT NULL THEN n END), 0) AS BIGINT) AS n_values,
  CAST(count(value) <> coalesce(sum(CASE WHEN value IS NOT NULL THEN n END), 0) AS INTEGER) AS has_dups FROM dv GROUP BY 1, 2""",
)
def duplicate_columns(spark, sf):
    out = catalog.duplicate_columns(catalog.distinct_values(_tables(spark, sf), digests=True))
    return out.withColumn("has_dups", F.col("has_dups").cast("int"))


CONTAINED = [
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("events", "user_id", "nation", "n_nationkey"),
]


@query(
    "cat8_column_contained",
    "\nUNION ALL ".join(
        f"""SELECT '{ca}' AS a, '{cb}' AS b, na AS n_a, nb AS n_b, CASE WHEN na > nb THEN ob ELSE oa END AS misses,
  CAST(na = 0 OR nb = 0 OR CASE WHEN na > nb THEN ob ELSE oa END <= 1 AS INTEGER) AS contained FROM (
  SELECT (SELECT count(DISTINCT {ca}) FROM {ta}) AS na, (SELECT count(DISTINCT {cb}) FROM {tb}) AS nb,
    (SELECT count(DISTINCT {ca}) FROM {ta} WHERE {ca} NOT IN (SELECT {cb} FROM {tb})) AS oa,
    (SELECT count(DISTINCT {cb}) FROM {tb} WHERE {cb} NOT IN (SELECT {ca} FROM {ta})) AS ob)"""
        for ta, ca, tb, cb in CONTAINED
    ),
)
def column_contained(spark, sf):
    out = None
    for ta, ca, tb, cb in CONTAINED:
        one = catalog.column_contained(table(spark, sf, ta), ca, table(spark, sf, tb), cb).select(
            F.lit(ca).alias("a"), F.lit(cb).alias("b"), "n_a", "n_b", "misses",
            F.col("contained").cast("int").alias("contained"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "cat8_all_contained",
    f"""WITH {VALUES}, d AS (SELECT DISTINCT table_name || '.' || column_name AS c, value FROM dv WHERE regexp_matches(column_name, '(key|_id)$')),
n AS (SELECT c, count(*) AS n, count(value) AS known FROM d GROUP BY c),
common AS (SELECT x.c AS a, y.c AS b, count(*) AS common FROM d x JOIN d y ON x.value = y.value AND x.c < y.c GROUP BY 1, 2),
p AS (SELECT x.c AS a, y.c AS b, x.n AS n_a, y.n AS n_b, CASE WHEN x.n > y.n THEN y.known ELSE x.known END - coalesce(common, 0) AS misses
  FROM n x JOIN n y ON x.c < y.c LEFT JOIN common k ON k.a = x.c AND k.b = y.c)
SELECT a, b, n_a, n_b, misses, CAST(misses <= 1 AS INTEGER) AS contained FROM p""",
)
def all_contained(spark, sf):
    """Every pair of the key columns of all tables."""
    named = [c for cols in SCHEMAS.values() for c in cols if c.endswith(("key", "_id"))]
    out = catalog.columns_contained(catalog.distinct_values(_tables(spark, sf), named, digests=True))
    return out.withColumn("contained", F.col("contained").cast("int"))


def _keys(spark, sf, names=tuple(SCHEMAS)):
    """Primary keys found in the data (a ``...key`` column without duplicates), declared foreign keys."""
    tables = _tables(spark, sf, names)
    _, columns = catalog.build_catalog(spark, tables)
    named = [c for cols in SCHEMAS.values() for c in cols if c.endswith(("key", "_id"))]
    found = (
        catalog.duplicate_columns(catalog.distinct_values(tables, named))
        .where(~F.col("has_dups"))
        .join(columns, ["table_name", "column_name"])
        .select("db_id", F.lit("pk").alias("kind"), "column_id", F.lit(None).cast("int").alias("ref_column_id"))
    )
    names = spark.createDataFrame(
        [("db", *r) for r in FKS if r[0] in tables], "db_id string, table string, column string, ref_table string, ref_column string"
    )
    return tables, columns, found.unionByName(catalog.resolve_foreign_keys(names, columns))


FK_VALUES = ", ".join(str(r) for r in FKS)
KEYS = f"""{VALUES}, fkn AS (SELECT * FROM (VALUES {FK_VALUES}) AS f(t, c, rt, rc)),
fk AS (SELECT a.column_id, b.column_id AS ref_column_id FROM fkn JOIN meta a ON a.table_name = t AND a.column_name = c JOIN meta b ON b.table_name = rt AND b.column_name = rc),
pk AS (
  SELECT m.column_id, m.table_id, m.column_name FROM meta m JOIN (
    SELECT table_name, column_name FROM dv GROUP BY 1, 2
    HAVING count(value) = coalesce(sum(CASE WHEN value IS NOT NULL THEN n END), 0)) d
  ON d.table_name = m.table_name AND d.column_name = m.column_name WHERE regexp_matches(m.column_name, '(key|_id)$'))"""


@query(
    "cat9_key_columns",
    f"WITH {KEYS} SELECT column_id FROM pk UNION SELECT column_id FROM fk UNION SELECT ref_column_id FROM fk",
)
def key_columns(spark, sf):
    return catalog.key_columns(_keys(spark, sf)[2]).select("column_id")


@query(
    "cat10_resolve_foreign_keys",
    f"""WITH {KEYS}, c AS (SELECT column_id, count(v.value) AS n_values FROM meta m JOIN vals v ON v.table_name = m.table_name AND v.column_name = m.column_name GROUP BY 1)
SELECT fk.column_id, ref_column_id, n_values FROM fk JOIN c USING (column_id)""",
)
def resolve_foreign_keys(spark, sf):
    tables = _tables(spark, sf)
    _, columns = catalog.build_catalog(spark, tables)
    names = spark.createDataFrame(
        [("db", *r) for r in FKS], "db_id string, table string, column string, ref_table string, ref_column string"
    )
    fk = catalog.resolve_foreign_keys(names, columns)
    counts = catalog.column_counts(tables).join(columns, ["table_name", "column_name"])
    return fk.join(counts.select("column_id", "n_values"), "column_id").select("column_id", "ref_column_id", "n_values")


@query(
    "cat11_key_equivalence",
    """WITH c AS (SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
ids AS (
  SELECT c_custkey AS column_id, n_regionkey AS comp FROM c
  UNION SELECT 1000000000 + n_nationkey, n_regionkey FROM nation
  UNION SELECT 2000000000 + n_regionkey, n_regionkey FROM nation)
SELECT column_id, min(column_id) OVER (PARTITION BY comp) AS root_id FROM ids""",
)
def key_equivalence(spark, sf):
    """Customer ids linked to nation ids, nation ids to region ids: one group per region."""
    nation, region = F.lit(1_000_000_000), F.lit(2_000_000_000)
    a = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("column_id"), (nation + F.col("c_nationkey")).cast("long").alias("ref_column_id")
    )
    b = table(spark, sf, "nation").select(
        (nation + F.col("n_nationkey")).cast("long").alias("column_id"),
        (region + F.col("n_regionkey")).cast("long").alias("ref_column_id"),
    )
    keys = a.unionByName(b).select(F.lit("db").alias("db_id"), F.lit("fk").alias("kind"), "column_id", "ref_column_id")
    return catalog.key_equivalence(keys).select("column_id", "root_id")


EXAMPLES = f"""ex0 AS (
  SELECT table_name, column_name, substr(value, 1, 40) AS value, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS rank
  FROM dv WHERE value IS NOT NULL AND value <> ''),
ex AS (
  SELECT m.column_id, string_agg(CASE WHEN {KIND} = 'number' THEN value ELSE {QUOTED} END, ', ' ORDER BY rank) AS examples
  FROM (SELECT table_name, column_name, value, min(rank) AS rank FROM ex0 WHERE rank <= 3 GROUP BY 1, 2, 3) e JOIN meta m USING (table_name, column_name) GROUP BY 1)"""


@query(
    "cat12_render_ddl",
    f"""WITH {KEYS}, {EXAMPLES}, parts AS (
  SELECT table_id, 0 AS section, m.column_id AS i, '    ' || CASE WHEN column_name = 'value' THEN '`value`' ELSE column_name END || ' ' || declared || ',' ||
    CASE WHEN examples IS NULL THEN '' ELSE ' -- example: [' || examples || ']' END AS text
  FROM meta m LEFT JOIN ex USING (column_id)
  UNION ALL SELECT table_id, 1, 0, '    PRIMARY KEY (' || string_agg(column_name, ', ' ORDER BY column_id) || '),' FROM pk GROUP BY table_id
  UNION ALL SELECT a.table_id, 2, a.column_id, '    CONSTRAINT fk_' || a.table_name || '_' || a.column_name || ' FOREIGN KEY (' || a.column_name || ') REFERENCES ' || b.table_name || ' (' || b.column_name || '),'
    FROM fk JOIN meta a ON a.column_id = fk.column_id JOIN meta b ON b.column_id = fk.ref_column_id),
bodies AS (SELECT table_id, regexp_replace(string_agg(text, chr(10) ORDER BY section, i), ',$', '') AS body FROM parts GROUP BY 1),
t AS (SELECT DISTINCT table_id, table_name FROM meta)
SELECT 'db' AS db_id, string_agg('CREATE TABLE ' || table_name || ' (' || chr(10) || body || chr(10) || ');', chr(10) || chr(10) ORDER BY table_id) AS ddl
FROM bodies JOIN t USING (table_id)""",
)
def render_ddl(spark, sf):
    tables, columns, keys = _keys(spark, sf)
    cat_tables, _ = catalog.build_catalog(spark, tables)
    values = catalog.sample_values(catalog.lowest_values(tables, 3), 3)
    return catalog.render_ddl(cat_tables, columns, keys, values, RESERVED)


def _drawn(*parts: str) -> str:
    """The seeded hash text of a question's item."""
    return "md5('42|' || " + " || '|' || ".join(parts) + ")"


def _number(draw: str, n: int) -> str:
    return f"CAST('0x' || substr({draw}, 1, 8) AS BIGINT) % {n}"


#: columns of each question: needed ones, and spare ones by the order of their hashes
CHOSEN = f"""allc AS (SELECT column_id, table_id, lower(column_name) AS low FROM meta UNION ALL SELECT 0, -1, '*'),
kc AS (SELECT column_id FROM pk UNION SELECT column_id FROM fk UNION SELECT ref_column_id FROM fk),
qc AS (
  SELECT o_orderkey AS q, column_id, table_id, contains(lower(sql), low) OR column_id IN (SELECT column_id FROM kc) AS needed,
    {_drawn("o_orderkey", "'column'", "column_id")} AS h, {_number(_drawn("o_orderkey", "'share'"), 10)} + 1 AS share FROM lg CROSS JOIN allc),
qs AS (
  SELECT *, count(*) FILTER (needed) OVER (PARTITION BY q) AS nn, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY NOT needed, h) AS r FROM qc),
ch AS (SELECT q, column_id, table_id, needed FROM qs WHERE r <= nn + least(share * (n - nn) // 10, greatest(0, 225 - nn)))"""


@query(
    "cat13_training_columns",
    f"""WITH {KEYS}, {SQL_LOG}, {CHOSEN}
SELECT q AS question_id, count(*) AS n_columns, count(*) FILTER (needed) AS n_needed, string_agg(column_id, ',' ORDER BY column_id) AS columns FROM ch GROUP BY 1""",
)
def training_columns(spark, sf):
    """Every query of the log against the catalog; needed and sampled columns per question."""
    _, columns, keys = _keys(spark, sf)
    questions = sql_log(spark, sf).select(
        F.col("o_orderkey").alias("question_id"), F.lit("db").alias("db_id"), "sql"
    )
    shown = catalog.training_columns(questions, columns, keys, seed=42)
    listed = F.array_join(F.array_sort(F.collect_list("column_id")).cast("array<string>"), ",")
    return shown.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count_if("needed").alias("n_needed"), listed.alias("columns")
    )


#: tables of the schema texts of questions; their column ids are those of the whole catalog
STAR = tuple(SCHEMAS)[:8]
STAR_META = "(SELECT * FROM meta WHERE table_id < 8)"


def _question_text(shown: str, order: str, chosen: str) -> str:
    """DDL per question: ``chosen`` columns, comments where ``shown``, tables by ``order``."""
    return f"""ex0 AS (
  SELECT table_name, column_name, substr(value, 1, 40) AS value, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS rank
  FROM dv WHERE value IS NOT NULL AND value <> ''),
ex AS (SELECT column_id, list(value ORDER BY rank) AS vs FROM (SELECT table_name, column_name, value, min(rank) AS rank FROM ex0 WHERE rank <= 3 GROUP BY 1, 2, 3) JOIN meta USING (table_name, column_name) GROUP BY 1),
mt AS (SELECT o_orderkey AS q, column_id, prio FROM lg JOIN meta ON column_name = 'o_orderpriority' WHERE k = 0),
ql AS (
  SELECT c.q, m.*, CASE WHEN prio IS NULL THEN coalesce(vs, []) ELSE list_prepend(prio, list_filter(coalesce(vs, []), lambda x: x <> prio)) END AS vals
  FROM {chosen} c JOIN {STAR_META} m ON m.column_id = c.column_id LEFT JOIN ex ON ex.column_id = c.column_id LEFT JOIN mt ON mt.q = c.q AND mt.column_id = c.column_id),
qv AS (
  SELECT *, CASE WHEN column_name = 'value' THEN '`value`' ELSE column_name END AS ident,
    'example: [' || array_to_string(list_transform(vals, lambda value: CASE WHEN {KIND} = 'number' THEN value ELSE {QUOTED} END), ', ') || ']' AS examples FROM ql),
parts AS (
  SELECT q, table_id, 0 AS section, column_id AS i, '    ' || ident || ' ' || declared || ',' || CASE WHEN {shown} THEN ' -- ' || replace(lower(column_name), '_', ' ')
    || CASE WHEN len(vals) > 0 THEN ', ' || examples ELSE '' END WHEN len(vals) > 0 THEN ' -- ' || examples ELSE '' END AS text FROM qv
  UNION ALL SELECT q, table_id, 1, 0, '    PRIMARY KEY (' || string_agg(ident, ', ' ORDER BY column_id) || '),' FROM qv WHERE column_id IN (SELECT column_id FROM pk) GROUP BY q, table_id
  UNION ALL SELECT q, a.table_id, 2, a.column_id, '    CONSTRAINT fk_' || a.table_name || '_' || a.column_name || ' FOREIGN KEY (' || a.column_name || ') REFERENCES ' || b.table_name || ' (' || b.column_name || '),'
    FROM fk JOIN qv a ON a.column_id = fk.column_id JOIN meta b ON b.column_id = fk.ref_column_id),
bodies AS (SELECT q, table_id, regexp_replace(string_agg(text, chr(10) ORDER BY section, i), ',$', '') AS body FROM parts GROUP BY 1, 2),
t AS (SELECT DISTINCT table_id, table_name FROM meta),
texts AS (
  SELECT q, string_agg('CREATE TABLE ' || table_name || ' (' || chr(10) || body || chr(10) || ');', chr(10) || chr(10) ORDER BY {order}, table_id) AS ddl FROM bodies JOIN t USING (table_id) GROUP BY 1)
SELECT q AS question_id, md5(ddl) AS ddl_md5, length(ddl) AS n_chars FROM texts"""


def _question_schemas(spark, sf, **how):
    """Schema texts for the queries of the log; priorities that stand in a query are its matched values."""
    tables, columns, keys = _keys(spark, sf, STAR)
    cat_tables, _ = catalog.build_catalog(spark, tables)
    questions = sql_log(spark, sf).select(F.col("o_orderkey").alias("question_id"), F.lit("db").alias("db_id"), "sql")
    stored = catalog.picklist(table(spark, sf, "orders"), "o_orderpriority")
    # pinned: a literal would be folded out of the join with the catalog and leave a product that matches anew for each of its parts
    stored = pinned(stored.select(F.xxhash64("value").alias("value_id"), "value"), column=F.lit("o_orderpriority"))
    found = prep.match_values(questions.withColumnRenamed("sql", "question"), stored)
    matches = found.join(columns.select("column_id", F.col("column_name").alias("column")), "column").select("question_id", "column_id", "rank", "value")
    values = catalog.sample_values(catalog.lowest_values(tables, 3), 3)
    out = catalog.question_schemas(questions, cat_tables, columns, keys, values, RESERVED, matches, **how)
    return out.select("question_id", F.md5(F.col("ddl").cast("binary")).alias("ddl_md5"), "n_chars")


STAR_KEYS = KEYS.replace(" FROM meta m JOIN (", f" FROM {STAR_META} m JOIN (")


@query(
    "cat13_question_schemas",
    f"""WITH {STAR_KEYS}, {SQL_LOG}, {CHOSEN.replace("FROM meta UNION", f"FROM {STAR_META} UNION")}, """
    + _question_text(
        f"{_number(_drawn('q', chr(39) + 'comment' + chr(39), 'column_id'), 1000)} < {_number(_drawn('q', chr(39) + 'share of' + chr(39), 'table_id'), 11)} * 100",
        _drawn("q", "'table'", "table_id"),
        "ch",
    ),
)
def question_schemas(spark, sf):
    """Training texts: chosen columns, matched values first, tables in seeded order, a share of the comments."""
    return _question_schemas(spark, sf, training=True, hide_comments=True)


@query(
    "cat12_question_ddl",
    f"WITH {STAR_KEYS}, {SQL_LOG}, everything AS (SELECT o_orderkey AS q, column_id FROM lg CROSS JOIN {STAR_META}), " + _question_text("false", "table_id", "everything"),
)
def question_ddl(spark, sf):
    """Texts for inference: all columns and tables in order, matched values first."""
    return _question_schemas(spark, sf, training=False)


@query(
    "cat14_serialize_schema",
    f"""WITH {VALUES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS rank FROM dv WHERE value IS NOT NULL AND value <> ''),
mv AS (SELECT table_name, column_name, string_agg(substr(value, 1, 40), ' , ' ORDER BY rank) AS vs, string_agg(substr(value, 1, 40), ', ' ORDER BY rank) AS vv FROM r WHERE rank <= 2 GROUP BY 1, 2),
c AS (
  SELECT table_id, table_name, string_agg(column_name || coalesce(' ( ' || vs || ' )', ''), ' , ' ORDER BY column_id) AS cs,
         string_agg(column_name || coalesce(' (' || vv || ')', ''), ', ' ORDER BY column_id) AS cv
  FROM meta LEFT JOIN mv USING (table_name, column_name) GROUP BY 1, 2)
SELECT 'compact' AS style, 'db' AS db_id, ' | db' || string_agg(' | ' || table_name || ' : ' || cs, '' ORDER BY table_id) AS text FROM c
UNION ALL SELECT 'verbose', 'db', 'Database: db. ' || string_agg('Table: ' || table_name || '. Columns: ' || cv, '. ' ORDER BY table_id) FROM c""",
)
def serialize_schema(spark, sf):
    tables = _tables(spark, sf)
    _, columns = catalog.build_catalog(spark, tables)
    matches = catalog.sample_values(catalog.lowest_values(tables, 2), 2).join(
        columns.select("db_id", "column_id", "table_name", "column_name"), ["table_name", "column_name"]
    )
    both = [
        catalog.serialize_schema(columns, matches, style).withColumn("style", F.lit(style))
        for style in ("compact", "verbose")
    ]
    return both[0].unionByName(both[1])


@query(
    "cat15_distinct_schemas",
    "SELECT source AS db_id, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1",
)
def distinct_schemas(spark, sf):
    examples = table(spark, sf, "documents").select(
        F.col("source").alias("db_id"), F.struct("lang", "n_chars").alias("schema"), F.col("doc_id").alias("ordinal")
    )
    return catalog.distinct_schemas(examples).select("db_id", "schema.lang", "schema.n_chars")
