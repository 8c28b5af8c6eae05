"""Batches whose size does not divide, through the queries and beside their statements."""

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sqltally.operators import batching


def documents(spark, folder, sizes):
    rows = [(1000 * b + i, f"s{b}", "xx", 7 + (37 * i + 11 * b) % 101) for b, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long")
    df.coalesce(1).write.parquet(f"{folder}/all")
    (folder / "documents.parquet").write_bytes(next((folder / "all").glob("part-*")).read_bytes())
    return str(folder)


@pytest.mark.parametrize("name", ["bt10_balanced_groups", "bt10_dealt_and_differenced", "bt11_balance_report", "bt4_chunk"])
def test_sizes_that_do_not_divide(spark, tmp_path, name):
    sf = documents(spark, tmp_path, (40, 33, 12, 7))
    con = duck(sf)
    err, n = compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name])
    assert not err and n


@pytest.mark.parametrize("range_rows, exact_rows", [(32_768, 10), (8, 0)])
def test_uneven_batches_are_dealt(spark, range_rows, exact_rows):
    df = spark.range(29).select(F.lit("a").alias("b"), F.col("id").alias("key"), (F.col("id") * 13 % 31).alias("n"))
    got = batching.balanced_groups(df, "b", "n", 4, "key", range_rows=range_rows, ranges=2, exact_rows=exact_rows, uneven="deal").collect()
    sizes = sorted(sum(r.group == g for r in got) for g in range(4))
    assert sizes == [7, 7, 7, 8] and sorted(r.key for r in got) == list(range(29))
    with pytest.raises(ValueError, match="uneven"):
        batching.balanced_groups(df, "b", "n", 4, "key", uneven="?")
