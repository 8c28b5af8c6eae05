"""Schema texts of many questions: draws, texts and value hits are made for whole batches, with the rows of the row-wise forms."""

import hashlib
from unittest import mock

import pyarrow as pa
from pyspark.sql import functions as F

from sqltally.functions.digests import seeded_draws
from sqltally.functions.schema_text import schema_texts
from sqltally.operators import catalog, prep

SEED = 42


def md5(*parts):
    return hashlib.md5("|".join(str(p) for p in (SEED, *parts) if p is not None).encode()).hexdigest()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_md5_texts():
    ids = [None, "", "7", "é", "x" * 60, "y" * 130, *(str(k * 7919) for k in range(50))]
    tails = ["share", "column|5", "column|45", "z" * 70]
    first, last = seeded_draws(SEED, pa.array(ids), tails)
    for i, tail in enumerate(tails):
        assert [f"{a:016x}{b:016x}" for a, b in zip(first[i].tolist(), last[i].tolist())] == [md5(q, tail) for q in ids]


def catalogs(spark):
    names = [("a", ["a_id", "a_name", "a,"]), ("b", ["b_id"]), ("c", ["c_x", "c_y", "c_z", "c_w"])]
    tables = spark.createDataFrame([("db", t, n) for t, (n, _) in enumerate(names)], "db_id string, table_id int, table_name string")
    rows = [("db", 0, -1, None, "*", "text", "*")]
    for t, (n, cols) in enumerate(names):
        rows += [("db", len(rows) + k, t, n, c, "bigint", c.replace("_", " ")) for k, c in enumerate(cols)]
    columns = spark.createDataFrame(rows, "db_id string, column_id int, table_id int, table_name string, column_name string, declared_type string, display string")
    keys = spark.createDataFrame([("db", "pk", 1, None), ("db", "fk", 2, 1)], "db_id string, kind string, column_id int, ref_column_id int")
    values = spark.createDataFrame([("a", "a_name", 1, "5")], "table_name string, column_name string, rank int, value string")
    sql = F.when(F.col("id") % 3 > 0, F.concat(F.lit("SELECT B_ID, c_"), F.substring(F.lit("xyzw"), (F.col("id") % 4 + 1).cast("int"), F.lit(1))))
    questions = spark.range(60).select(F.col("id").alias("question_id"), F.lit("db").alias("db_id"), sql.alias("sql"))
    return tables, columns, keys, values, questions.unionByName(questions.select(F.lit(None).cast("long").alias("question_id"), "db_id", "sql").limit(3))


def test_training_texts_show_the_training_columns(spark):
    tables, columns, keys, values, questions = catalogs(spark)
    lists = catalog.training_columns(questions, columns, keys, SEED).where("question_id IS NOT NULL").groupBy("question_id").agg(F.collect_set("column_id").alias("ids"))
    shown = {r.question_id: set(r.ids) for r in lists.collect()}
    by_id = {r.column_id: r for r in columns.collect()}
    got = catalog.question_schemas(questions, tables, columns, keys, values, [], None, seed=SEED, hide_comments=True)
    assert got.where("question_id IS NULL").count() == 3
    for r in got.where("question_id IS NOT NULL").collect():
        texts = []
        for t, name in enumerate("abc"):
            share, lines, keyed, links = int(md5(r.question_id, "share of", t)[:8], 16) % 11, [], [], []
            for i in sorted(shown.get(r.question_id, ())):
                c = by_id[i]
                if c.table_id != t:
                    continue
                said = [c.display] if int(md5(r.question_id, "comment", i)[:8], 16) % 1000 < share * 100 else []
                said += ["example: [5]"] if i == 2 else []
                quoted = f"`{c.column_name}`" if "," in c.column_name else c.column_name
                lines.append(f"    {quoted} bigint," + (" -- " + ", ".join(said) if said else ""))
                keyed += ["    PRIMARY KEY (a_id),"] if i == 1 else []
                links += ["    CONSTRAINT fk_a_a_name FOREIGN KEY (a_name) REFERENCES a (a_id),"] if i == 2 else []
            body = "\n".join(lines + keyed + links)
            if body:
                texts.append((md5(r.question_id, "table", t), f"CREATE TABLE {name} (\n{body.removesuffix(',')}\n);"))
        assert r.ddl == "\n\n".join(t for _, t in sorted(texts))


def test_a_question_without_columns_has_an_empty_text():
    one = {"table_id": 0, "ident": "t", "columns": [{"column_id": 1, "ident": "x", "head": "    x text,", "comment": "x,\n", "silent": False, "number": False, "samples": [], "pk": False, "fks": []}]}
    known = {"db": {"tables": [one], "cols": [{"column_id": 1, "low": "x", "is_key": False}]}}
    asked = pa.RecordBatch.from_pydict({"question_id": [1, 2, 3], "db_id": ["db", "db", "no"], "_id": ["1", "2", "3"], "_sql": ["x", "y", "x"]})
    (got,) = schema_texts(known, True, False, SEED, 0, 6)(iter([asked]))
    # a cap of 0 leaves what the query names; a comma before the last line break goes, as the end of a text does in Java
    assert got["ddl"].to_pylist() == ["CREATE TABLE t (\n    x text, -- x\n\n);", ""]
    assert got["n_chars"].to_pylist() == [len(t) for t in got["ddl"].to_pylist()]


def test_texts_are_written_in_batches_over_all_tasks(spark):
    tables, columns, keys, values, questions = catalogs(spark)
    stored = spark.createDataFrame([(1, "a_name", "b_id, c")], "value_id long, column string, value string")
    matched = prep.match_values(questions.withColumnRenamed("sql", "question"), stored)
    assert "REPARTITION_BY_NUM" in plan(matched) and "REPARTITION_BY_COL" not in plan(matched)
    matches = matched.select("question_id", F.lit(2).alias("column_id"), "rank", "value")
    for training in (False, True):
        text = plan(catalog.question_schemas(questions, tables, columns, keys, values, [], matches, training=training))
        assert "MapInArrow written(question_id" in text


def test_grams_do_not_reach_from_one_text_into_the_next(spark):
    texts = [(1, "xa"), (2, "bx"), (3, ""), (4, "ab ab"), (5, "éa"), (6, "b")]
    asked = spark.createDataFrame(texts, "question_id long, low_q string").coalesce(1)
    keys = spark.createDataFrame([("ab", 7), ("éa", 8)], "gram string, value_id long")
    got = sorted(tuple(r) for r in prep._gram_hits(asked, keys).select("question_id", "gram", "at").collect())
    assert got == [(4, "ab", 1), (5, "éa", 1)]


def test_short_rows_are_looked_through_in_large_parts():
    batch = pa.RecordBatch.from_pydict({"t": [str(k * 7919 % 10_007) for k in range(10_000)], "k": list(range(10_000, 0, -1))})
    with mock.patch.object(catalog.pc, "not_equal", wraps=catalog.pc.not_equal) as looked:
        (got,) = catalog._smallest(["t", "k"], 2, False)(iter([batch]))
    assert got["value"].to_pylist() == [*sorted(batch["t"].to_pylist())[:2], "1", "10"]
    assert looked.call_count <= 4


def test_whole_numbers_are_counted_as_numbers(spark):
    df = spark.createDataFrame([(1, 2, 1.0, "1"), (1, None, -0.0, None), (-3, 2, 0.0, "1")], "a long, b short, c double, d string")
    found = catalog.distinct_values({"t": df, "u": df.select("a")})
    assert "hashpartitioning(at" in plan(found)
    got = sorted((r.table_name, r.column_name, str(r.value), r.n) for r in found.collect())
    assert got == [("t", "a", "-3", 1), ("t", "a", "1", 2), ("t", "b", "2", 2), ("t", "b", "None", 1), ("t", "c", "-0.0", 1), ("t", "c", "0.0", 1), ("t", "c", "1.0", 1), ("t", "d", "1", 2), ("t", "d", "None", 1), ("u", "a", "-3", 1), ("u", "a", "1", 2)]
