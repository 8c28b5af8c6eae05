"""Joins that stay balanced when one key holds a large share of the rows.

A key is heavy from a fixed number of rows on, whatever the size of the table.  Keys are counted
exactly, combined in each task before the shuffle; only the hashes of heavy keys are listed, at most
one per ``heavy_floor`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with this many rows is salted.
HEAVY_FLOOR = 1_000_000
#: Tasks a heavy key is spread over.
SALTS = 128


def heavy_floor(df: DataFrame) -> int:
    """Row count from which a key counts as heavy (``sqltally.heavy.floor`` overrides it)."""
    return int(df.sparkSession.conf.get("sqltally.heavy.floor", str(HEAVY_FLOOR)))


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_hashes(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys with at least ``heavy_floor`` rows."""
    counted = df.groupBy(key_hash(keys).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return [r["h"] for r in counted.where(F.col("n") >= heavy_floor(df)).select("h").collect()]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all shuffle partitions by ``keys``, for rows that are small but cost much.

    The number is named: Spark would put small rows together into a few tasks otherwise.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    heavy: list[int] | None = None,
) -> DataFrame:
    """Equi-join ``big`` with ``small``; rows of heavy keys are spread by the ``spread`` columns.

    Only ``small`` rows of heavy keys are replicated.  ``how`` is ``inner``, ``left``,
    ``left_semi`` or ``left_anti``: ``big`` is the row-preserving side.  ``heavy`` passes on the
    result of an earlier ``heavy_hashes`` for the same keys.
    """
    keys = list(keys)
    heavy = heavy_hashes(big, keys) if heavy is None else heavy
    if not heavy:
        return big.join(small, keys, how)
    is_heavy = key_hash(keys).isin(heavy)
    by = list(spread) or [c for c in big.columns if c not in keys]
    salted_big = big.withColumn(
        "_salt",
        F.when(is_heavy, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)),
    )
    salted_small = small.withColumn(
        "_salt",
        F.explode(
            F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")
