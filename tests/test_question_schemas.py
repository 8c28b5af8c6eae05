"""Schema texts of questions whose database is a literal: no product, and matched values first."""

from pyspark.sql import functions as F

from sqltally.operators import catalog


def made(spark, training):
    tables = {"t": spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "t_id long, t_name string, value double"), "u": spark.createDataFrame([(1,)], "u_id long")}
    cat_tables, columns = catalog.build_catalog(spark, tables)
    keys = spark.createDataFrame([("db", "pk", 1, None), ("db", "fk", 4, 1)], "db_id string, kind string, column_id int, ref_column_id int")
    values = spark.createDataFrame([("t", "t_name", 1, "x"), ("t", "t_name", 2, "y")], "table_name string, column_name string, rank int, value string")
    matches = spark.createDataFrame([(1, 2, 1, "y"), (1, 2, 2, "z")], "question_id long, column_id int, rank int, value string")
    questions = spark.range(4).select(F.col("id").alias("question_id"), F.lit("db").alias("db_id"), F.lit("select t_name from t").alias("sql"))
    return catalog.question_schemas(questions, cat_tables, columns, keys, values, ["VALUE"], matches, training=training)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_literal_database_makes_no_product(spark):
    for training in (False, True):
        text = plan(made(spark, training))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_texts_with_and_without_matched_values(spark):
    got = {r.question_id: r.ddl for r in made(spark, False).collect()}
    text = (
        "CREATE TABLE t (\n    t_id bigint,\n    t_name varchar, -- example: [{}]\n    `value` double,\n    PRIMARY KEY (t_id)\n);\n\n"
        "CREATE TABLE u (\n    u_id bigint,\n    CONSTRAINT fk_u_u_id FOREIGN KEY (u_id) REFERENCES t (t_id)\n);"
    )
    assert got == {k: text.format("'y', 'z', 'x'" if k == 1 else "'x', 'y'") for k in range(4)}


def test_questions_of_one_database_do_not_meet_in_one_task(spark):
    for training in (False, True):
        many = made(spark, training)
        assert "hashpartitioning(_db" not in plan(many)
        assert many.select(F.spark_partition_id().alias("p")).distinct().count() > 1
