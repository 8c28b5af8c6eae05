"""Distributed ordinals and scans: no window ever holds an unbounded partition.

``with_rank`` numbers rows within a group (or the whole table) without one task sorting the
group: rows are sorted by value ranges, numbered within each range, and shifted by the row counts
of the earlier ranges.  The sorted rows are checkpointed, so a recomputed task reads the same
ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltally.functions.lineage import cut_lineage
from sqltally.functions.skew import heavy_hashes, key_hash

#: Rows of one value range; the number of ranges follows from the number of rows.
RANGE_ROWS = 1_000_000


def _numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the 0-based place of every row of ``df`` by ascending ``order`` (nulls first)."""
    rows = int(df.sparkSession.conf.get("sqltally.range.rows", str(RANGE_ROWS)))
    ranges = max(1, -(-df.count() // rows))
    # a row's id holds its range above bit 33 and its place in the range below
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_id", 33))
    # one small row per range
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return placed.join(before, "_range").withColumn(name, place).drop("_id", "_range", "_before")


def with_rank(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "ordinal",
    heavy: list[int] | None = None,
) -> DataFrame:
    """Add a dense 0-based ``name`` by ascending ``order`` within ``by`` (whole table if empty).

    ``order`` must identify a row within its group.  Groups that are not heavy are numbered by a
    plain window; heavy groups, and the whole table, by value ranges: a row's place among all heavy
    rows, less the first place of its group.  ``heavy`` passes on the result of an earlier
    ``heavy_hashes`` for ``by``.
    """
    by, order = list(by), list(order)
    if not by:
        return _numbered(df, order, name)
    heavy = heavy_hashes(df, by) if heavy is None else heavy
    w = Window.partitionBy(*by).orderBy(*order)
    if not heavy:
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    is_heavy = F.coalesce(key_hash(by).isin(heavy), F.lit(False))
    light = df.where(~is_heavy).withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    ranged = _numbered(df.where(is_heavy), [*by, *order], "_place")
    first = ranged.groupBy(*by).agg(F.min("_place").alias("_first"))
    keys = first.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    # one row per heavy key
    shifted = ranged.join(keys, same).withColumn(name, F.col("_place") - F.col("_first"))
    return light.unionByName(shifted.select(*df.columns, name))


def running_sum(
    df: DataFrame, value: Column, index: str, name: str, by: Sequence[str] = (), block: int = 4096, levels: int = 3
) -> DataFrame:
    """Inclusive running sum of ``value`` by the integer column ``index`` (unique within ``by``).

    Inside blocks of ``block`` index values first, then over the block totals in the same way; the
    last of ``levels`` levels sums what is left, one row per ``block ** levels`` index values.
    """
    by = list(by)
    if levels == 0:
        upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy(index)
        return df.withColumn(name, F.sum(value).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    cut = df.withColumn("_v", value).withColumn("_blk", F.floor(F.col(index) / block))
    inner = Window.partitionBy(*by, "_blk").orderBy(index)
    totals = cut.groupBy(*by, "_blk").agg(F.sum("_v").alias("_total"))
    totals = totals.select(*by, F.col("_blk").alias("_at"), "_total")
    before = running_sum(totals, F.col("_total"), "_at", "_upto", by, block, levels - 1)
    before = before.select(*by, F.col("_at").alias("_blk"), (F.col("_upto") - F.col("_total")).alias("_before"))
    return (
        cut.withColumn("_in", F.sum("_v").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        .join(before, [*by, "_blk"])
        .withColumn(name, F.col("_in") + F.col("_before"))
        .drop("_in", "_before", "_blk", "_v")
    )
