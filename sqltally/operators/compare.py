"""Result-set comparison.

Inputs: ``results(question_id, cand_id, row_ix, cells)`` with canonical cells and
``pairs(question_id, cand_id, gold_id)``.  A valid but empty result has no rows, so every
comparison starts from ``pairs``.  Extra identity columns (a database, a slot fill) go into
``keys``.  Both sides are tagged and unioned, then grouped by the row itself: the work of a large
result spreads over its rows, and duplicates are combined before the shuffle.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import chain, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.functions.canonical import canonical_order, every_order
from sqltally.functions.cells import canonical_row
from sqltally.functions.lineage import cut_lineage
from sqltally.functions.ordering import with_rank

KEYS = ("question_id",)


def explicit_nulls(cells: str = "cells") -> Column:
    """Cells with a token in place of NULL, which hashing would skip; no canonical cell has its form."""
    return F.transform(cells, lambda c: F.coalesce(c, F.lit("null")))


def signature(*cols: Column) -> Column:
    """Order-free signature of a bag of rows without nulls: row count and sums of two 64-bit hashes.

    The salt is hashed first, so that the two hashes are independent.  Each hash is summed in three parts of at most 22 bits, so a long sum holds 2^41 rows.
    """
    sums = []
    for salt in (0, 1):
        h = F.xxhash64(F.lit(salt), *cols)
        for i, part in enumerate(
            (
                h.bitwiseAND(F.lit(0x3FFFFF)),
                F.shiftrightunsigned(h, 22).bitwiseAND(F.lit(0x3FFFFF)),
                F.shiftrightunsigned(h, 44),
            )
        ):
            sums.append(F.sum(part).alias(f"h{salt}{i}"))
    return F.struct(F.count(F.lit(1)).alias("n"), *sums)


def _tagged(results: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    pairs = pairs.select(*keys, "cand_id", "gold_id")
    rows = results.select(*keys, "cand_id", "row_ix", "cells")
    cols = [*keys, "cand_id", "gold_id", "row_ix", "cells"]
    # both join sides come straight from a shuffle, so adaptive skew-join splits a hot result
    pred = rows.join(pairs, [*keys, "cand_id"])
    gold = rows.withColumnRenamed("cand_id", "gold_id").join(pairs, [*keys, "gold_id"])
    return pred.select(*cols, F.lit(1).alias("side")).unionByName(
        gold.select(*cols, F.lit(-1).alias("side"))
    )


def _verdict(pairs: DataFrame, rows: DataFrame, keys: Sequence[str], same: Column) -> DataFrame:
    pair = [*keys, "cand_id", "gold_id"]
    verdict = rows.groupBy(*pair).agg(F.bool_and(same).alias("_same"))
    return (
        pairs.select(*pair)
        .join(verdict, pair, "left")
        .select(*pair, F.coalesce("_same", F.lit(True)).alias("equal"))
    )


def set_equal(results: DataFrame, pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Equal as sets of rows: duplicates and row order ignored, column order kept."""
    rows = (
        _tagged(results, pairs, keys)
        .groupBy(*keys, "cand_id", "gold_id", "cells")
        .agg(F.max("side").alias("hi"), F.min("side").alias("lo"))
    )
    return _verdict(pairs, rows, keys, (F.col("hi") == 1) & (F.col("lo") == -1))


def bag_equal(results: DataFrame, pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Equal as bags of rows."""
    rows = (
        _tagged(results, pairs, keys)
        .groupBy(*keys, "cand_id", "gold_id", "cells")
        .agg(F.sum("side").alias("surplus"))
    )
    return _verdict(pairs, rows, keys, F.col("surplus") == 0)


def ordered_equal(results: DataFrame, pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Equal row by row (``row_ix`` dense and unique within a result)."""
    rows = (
        _tagged(results, pairs, keys)
        .groupBy(*keys, "cand_id", "gold_id", "row_ix")
        .agg(
            F.max(F.when(F.col("side") == 1, F.col("cells"))).alias("p"),
            F.max(F.when(F.col("side") == -1, F.col("cells"))).alias("g"),
        )
    )
    return _verdict(pairs, rows, keys, F.col("p").eqNullSafe(F.col("g")))


def quick_reject(
    results: DataFrame, pairs: DataFrame, ordered: bool = False, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Necessary condition for equality under column permutation: cells sorted within each row."""
    loose = results.withColumn("cells", F.array_sort("cells"))
    same = (ordered_equal if ordered else set_equal)(loose, pairs, keys)
    return same.withColumnRenamed("equal", "possible")


def _column_colors(results: DataFrame, keys: Sequence[str], ordered: bool) -> DataFrame:
    """(keys, cand_id, j, color, content) per column; columns that may stand for each other share a colour.

    For ordered rows the colour is the content.  Else a row is coloured by the bag of its cells and
    a column by the bag of its cells next to their rows' colours.  No colour depends on the order of
    rows or columns.
    """
    one = [*keys, "cand_id"]
    row = F.xxhash64(F.array_sort("cells"))
    cells = results.select(*one, "row_ix", row.alias("_row"), F.posexplode("cells").alias("j", "cell"))
    content = signature(F.col("row_ix"), F.col("cell"))
    if ordered:
        return cells.groupBy(*one, "j").agg(content.alias("color")).withColumn("content", F.col("color"))
    return cells.groupBy(*one, "j").agg(signature(F.col("_row"), F.col("cell")).alias("color"), content.alias("content"))


def _matrix_orders(widths: pd.Series, entries: pd.Series) -> pd.DataFrame:
    """Canonical order of each matrix and what its automorphisms make of it."""
    out = []
    for width, cells in zip(widths, entries):
        matrix = [[0] * width for _ in range(width)]
        for c in cells:
            matrix[c["i"]][c["j"]] = c["h"]
        order, group = canonical_order(matrix)
        out.append((order, [[a[j] for j in order] for a in group]))
    return pd.DataFrame(out, columns=["first", "others"])


def _all_orders(first: pd.Series, others: pd.Series) -> pd.Series:
    """All orders that the automorphisms behind ``others`` generate."""
    out = []
    for order, made in zip(first, others):
        order = list(order)
        group = [[dict(zip(order, other))[j] for j in range(len(order))] for other in made]
        out.append([list(o) for o in every_order(order, group)])
    return pd.Series(out)


def _pair_hash(row: Column, a: Column, b: Column) -> Column:
    """Colour of two columns: the bag of their cells side by side, next to their rows' colours."""
    return F.xxhash64(signature(row, a, b))


def _symmetric_orders(results: DataFrame, keys: Sequence[str], unclear: DataFrame) -> DataFrame:
    """``(keys, cand_id, perm)`` for results whose columns the colours do not tell apart.

    A matrix of pair colours per result has one canonical order; others with the same matrix differ by
    its automorphisms.  If the rows do not change under their generators, as nearly always, the
    order is settled; else the order of least row signature among all of them is taken.
    """
    one = [*keys, "cand_id"]
    rows = results.join(unclear.select(*one), one, "left_semi")
    row = F.xxhash64(F.array_sort("cells")).alias("_row")
    left = rows.select(*one, "cells", row, F.posexplode("cells").alias("i", "a"))
    both = left.select(*one, "_row", "i", "a", F.posexplode("cells").alias("j", "b"))
    entries = both.groupBy(*one, "i", "j").agg(_pair_hash(F.col("_row"), F.col("a"), F.col("b")).alias("h"))
    matrices = entries.groupBy(*one).agg((F.max("i") + 1).alias("_width"), F.collect_list(F.struct("i", "j", "h")).alias("_entries"))
    orders = F.pandas_udf(_matrix_orders, "first array<int>, others array<array<int>>")
    # asked twice below; the exchange lets Spark run the search once
    found = matrices.select(*one, orders("_width", "_entries").alias("_o")).repartition(*one)

    def signed(perms: DataFrame) -> DataFrame:
        """Signature of the rows under each order."""
        each = rows.select(*one, "row_ix", "cells").join(perms, one)
        picked = F.transform("perm", lambda j: F.get("cells", j))
        return each.groupBy(*one, "perm").agg(signature(picked).alias("sig"))

    tried = found.select(*one, F.explode(F.concat(F.array("_o.first"), F.col("_o.others"))).alias("perm"))
    settled = signed(tried).groupBy(*one).agg(F.min_by("perm", F.struct("sig", "perm")).alias("perm"), (F.count_distinct("sig") == 1).alias("_same"))
    closure = F.pandas_udf(_all_orders, "array<array<int>>")
    rest = found.join(settled.where(~F.col("_same")).select(*one), one, "left_semi")
    rest = signed(rest.select(*one, F.explode(closure("_o.first", "_o.others")).alias("perm")))
    return settled.where("_same").select(*one, "perm").unionByName(
        rest.groupBy(*one).agg(F.min_by("perm", F.struct("sig", "perm")).alias("perm"))
    )


def canonical_results(results: DataFrame, ordered: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Results with the cells of each in its canonical column order: equal up to columns becomes equal.

    Columns are sorted by colour.  Columns of one colour are identical in most results, where any order
    will do; the others go through ``_symmetric_orders``.  The number of passes does not depend on the columns.
    """
    one = [*keys, "cand_id"]
    results = results.select(*one, "row_ix", explicit_nulls().alias("cells"))
    columns = _column_colors(results, keys, ordered)
    listed = columns.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("color", "j", "content"))).alias("_c"))
    kinds = lambda field: F.size(F.array_distinct(F.transform("_c", lambda c: c[field])))
    # one small row per result, read several times by what follows
    orders = cut_lineage(
        listed.select(*one, F.transform("_c", lambda c: c["j"]).alias("perm"), (kinds("color") == kinds("content")).alias("_clear"))
    )
    if not ordered and not orders.where(~F.col("_clear")).isEmpty():
        symmetric = _symmetric_orders(results, keys, orders.where(~F.col("_clear")))
        orders = cut_lineage(orders.where("_clear").select(*one, "perm").unionByName(symmetric))
    laid = results.join(orders.select(*one, "perm"), one)
    return laid.select(*one, "row_ix", F.transform("perm", lambda j: F.get("cells", j)).alias("cells"))


def permuted_equal(
    results: DataFrame,
    pairs: DataFrame,
    ordered: bool = False,
    keys: Sequence[str] = KEYS,
    verify: bool = True,
) -> DataFrame:
    """Equal under some permutation of the candidate's columns (bag or ordered rows).

    Every result is brought into its canonical column order and signed once; pairs are decided by one
    join on the signatures.  ``verify`` compares the rows of pairs with equal signatures.
    """
    keys = list(keys)
    pair = [*keys, "cand_id", "gold_id"]
    canonical = canonical_results(results, ordered, keys)
    at = [F.col("row_ix")] if ordered else []
    signed = canonical.groupBy(*keys, "cand_id").agg(signature(F.col("cells"), *at).alias("_p"))
    gold = signed.select(*keys, F.col("cand_id").alias("gold_id"), F.col("_p").alias("_g"))
    decided = pairs.select(*pair).join(signed, [*keys, "cand_id"], "left").join(gold, [*keys, "gold_id"], "left")
    decided = decided.select(*pair, F.col("_p").eqNullSafe(F.col("_g")).alias("equal"), F.col("_p").isNotNull().alias("_some"))
    if not verify:
        return decided.select(*pair, "equal")
    compared = (ordered_equal if ordered else bag_equal)(canonical, decided.where("equal AND _some"), keys)
    return decided.select(*pair, "equal").join(compared.withColumnRenamed("equal", "_rows"), pair, "left").select(
        *pair, (F.col("equal") & F.coalesce("_rows", F.lit(True))).alias("equal")
    )


def order_matters(gold_sql: Column) -> Column:
    """Row order counts only if the gold text orders its rows."""
    return F.contains(F.lower(gold_sql), F.lit("order by"))


def denotation_equal(
    results: DataFrame, pairs: DataFrame, gold_sql: str = "gold_sql", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Permuted equality, ordered where the pair's gold text orders its rows."""
    is_ordered = order_matters(F.col(gold_sql))
    return permuted_equal(results, pairs.where(~is_ordered), False, keys).unionByName(
        permuted_equal(results, pairs.where(is_ordered), True, keys)
    )


def suite_match(per_db: DataFrame, fill: str = "fill_id") -> DataFrame:
    """A question passes if one slot fill is equal on every database of its suite."""
    return (
        per_db.groupBy("question_id", fill)
        .agg(F.bool_and("equal").alias("ok"))
        .groupBy("question_id")
        .agg(F.bool_or("ok").alias("passed"))
    )


def match_status(
    pairs: DataFrame, candidates: DataFrame, equality: DataFrame, on_gold_error: str = "status"
) -> DataFrame:
    """Unexecutable / Gold Error / Mismatch / Match per pair.

    ``on_gold_error``: ``status`` reports ``Gold Error``; ``raise`` fails the job.
    """
    valid = candidates.select("question_id", "cand_id", "valid")
    gold = valid.select("question_id", F.col("cand_id").alias("gold_id"), F.col("valid").alias("gv"))
    gold_error = F.lit("Gold Error")
    if on_gold_error == "raise":
        gold_error = F.raise_error(F.lit("a gold query failed")).cast("string")
    status = (
        F.when(F.col("valid") == 0, "Unexecutable")
        .when(F.col("gv") == 0, gold_error)
        .when(F.col("equal"), "Match")
        .otherwise("Mismatch")
    )
    return (
        pairs.join(valid, ["question_id", "cand_id"])
        .join(gold, ["question_id", "gold_id"])
        .join(equality, ["question_id", "cand_id", "gold_id"], "left")
        .withColumn("status", status)
        .drop("valid", "gv", "equal")
    )


def status_counts(status: DataFrame, by: Sequence[str] = ("db_id",)) -> DataFrame:
    return status.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


#: Statements that run as one job.
SLICE = 50
_ROWS = "question_id long, cand_id int, row_pos long, cells array<string>"


def _slices(statements: Iterable, size: int) -> Iterator[list[tuple[int, int, str]]]:
    """Statements in lists of ``size``; a table is read one partition at a time."""
    rows = statements.toLocalIterator() if isinstance(statements, DataFrame) else iter(statements)
    while part := [(r[0], r[1], r[2]) for r in islice(rows, size)]:
        yield part


def _branch(spark: SparkSession, question_id: int, cand_id: int, text: str) -> DataFrame | None:
    """Rows of one statement, or None where it cannot be analysed."""
    try:
        df = spark.sql(f"SELECT * FROM ({text.strip().rstrip(';')}\n)")
        named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        return named.select(
            F.lit(question_id).cast("long").alias("question_id"), F.lit(cand_id).cast("int").alias("cand_id"),
            F.monotonically_increasing_id().alias("row_pos"), canonical_row(named).alias("cells"),
        )
    except Exception:  # no query, an unknown name, a type that has no cell form
        return None


def run_pairs(
    spark: SparkSession,
    statements: DataFrame | Iterable[tuple[int, int, str]],
    path: str,
    timeout: float | None = 30.0,
    parallelism: int = 4,
    slice_size: int = SLICE,
) -> tuple[DataFrame, DataFrame]:
    """Run ``(question_id, cand_id, sql)`` on the registered views; tables go to a new folder in ``path``.

    Statements are taken in slices.  Each is analysed on its own, wrapped as a sub-query so that only queries
    run and nothing is changed; the valid ones of a slice are one union and one job, which also writes
    a mark per statement.  A slice that fails, or that is interrupted by its tag after ``timeout``
    seconds, is halved and run again, so in the end only the statements at fault are invalid.  Returns
    ``candidates, results``, both read from written tables; the driver keeps a folder per slice and no outcomes.
    """
    path = f"{path.rstrip('/')}/run-{uuid.uuid4().hex}"
    names = ["question_id", "cand_id", "sql"]
    given = statements.toDF(*names) if isinstance(statements, DataFrame) else None
    if given is None:
        statements = list(statements)
        given = spark.createDataFrame(statements, "question_id long, cand_id int, sql string")

    def write(branches: list[tuple[tuple, DataFrame]]) -> list[str]:
        """Folders of the rows of all branches that can be run."""
        folder, tag = f"{path}/rows-{uuid.uuid4().hex}", f"slice-{uuid.uuid4().hex}"
        timer = threading.Timer(timeout, spark.interruptTag, [tag]) if timeout else None
        marks = spark.createDataFrame([(q, c, None, None) for (q, c, _), _ in branches], _ROWS)
        spark.addTag(tag)
        try:
            if timer:
                timer.start()
            reduce(DataFrame.union, [rows for _, rows in branches], marks).write.parquet(folder)
            return [folder]
        except Exception:  # some statement failed while it ran, or the slice took too long
            half = len(branches) // 2
        finally:
            if timer:
                timer.cancel()
            spark.removeTag(tag)
        return write(branches[:half]) + write(branches[half:]) if half else []

    def run(part: list[tuple[int, int, str]]) -> list[str]:
        branches = [(item, rows) for item in part if (rows := _branch(spark, *item)) is not None]
        return write(branches) if branches else []

    # a folder per slice: concurrent commits into one folder would collide
    spark.createDataFrame([], _ROWS).write.parquet(f"{path}/none")
    with ThreadPoolExecutor(parallelism) as pool:
        folders = [f"{path}/none", *chain.from_iterable(pool.map(run, _slices(statements, slice_size)))]
    written = spark.read.schema(_ROWS).parquet(*folders)
    ran = written.where("row_pos IS NULL").select("question_id", "cand_id", F.lit(1).alias("valid")).distinct()
    marked = given.join(ran, ["question_id", "cand_id"], "left").select(*names, F.coalesce("valid", F.lit(0)).alias("valid"))
    marked.write.parquet(f"{path}/candidates")
    rows = with_rank(written.where("row_pos IS NOT NULL"), ["row_pos"], ["question_id", "cand_id"], "row_ix").drop("row_pos")
    return spark.read.parquet(f"{path}/candidates"), rows
