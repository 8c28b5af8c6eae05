"""Batch shaping.  Batches are DataFrames with a dense 0-based ``ordinal`` (see ``with_rank``).

Totals are scalar sub-queries, so nothing is counted on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltally.functions.differencing import EXACT_ROWS, best_split, difference, split
from sqltally.functions.ordering import with_rank
from sqltally.functions.skew import dealt, salted_join


def size_of(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _checked(value: Column, bad: Column, message: str) -> Column:
    """``value``, or a failed job where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("long")).otherwise(value)


def reshape(
    df: DataFrame,
    keep: Sequence[str] | None = None,
    drop: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Select, pop and rename columns."""
    out = df.select(*keep) if keep is not None else df
    return out.drop(*drop).withColumnsRenamed(dict(rename or {}))


def column_union(a: DataFrame, b: DataFrame, key: str = "ordinal") -> DataFrame:
    """Columns of both batches; same rows required, and shared columns must agree."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in shared}).withColumn("_in_b", F.lit(True))
    joined = a.withColumn("_in_a", F.lit(True)).join(right, key, "full_outer")
    bad = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    for c in shared:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    checked = _checked(F.col(key).cast("long"), bad, "batches differ in size or in a shared column")
    return joined.withColumn(key, checked).drop("_in_a", "_in_b", *[f"_b_{c}" for c in shared])


def concat_batches(dfs: Sequence[DataFrame]) -> DataFrame:
    """Batches one after another, with a running ``ordinal`` and their ``source`` index."""
    parts, before = [], F.lit(0).cast("long")
    for i, df in enumerate(dfs):
        parts.append(
            df.withColumn("ordinal", F.col("ordinal") + before).withColumn("source", F.lit(i))
        )
        before = before + size_of(df)
    return reduce(DataFrame.unionByName, parts)


def chunk(df: DataFrame, n: int, strict: bool = True) -> DataFrame:
    """Equal contiguous chunks; a size that does not divide is an error.

    Without ``strict`` chunks have the whole part of a ``n``-th of the rows, and the rows left over follow in
    chunks numbered from ``n`` on (NULL for fewer than ``n`` rows).
    """
    total = size_of(df)
    if not strict:
        return df.withColumn("chunk", F.floor(F.try_divide(F.col("ordinal"), F.floor(total / n))))
    part = F.floor(F.col("ordinal") / (total / n))
    return df.withColumn("chunk", _checked(part, total % n != 0, "batch does not divide into chunks"))


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Each row ``times`` times: next to each other, or the whole batch after itself."""
    each = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        at = F.col("ordinal") * times + F.col("_j")
    else:
        at = F.col("_j") * size_of(df) + F.col("ordinal")
    return each.withColumn("ordinal", at).drop("_j")


def reorder(df: DataFrame, index: DataFrame) -> DataFrame:
    """Row ``index.source`` moves to ``index.ordinal``."""
    moved = df.withColumnRenamed("ordinal", "source").join(index.select("ordinal", "source"), "source")
    return moved.drop("source")


def inverse(index: DataFrame) -> DataFrame:
    """The index that undoes ``index``."""
    return index.select(F.col("source").alias("ordinal"), F.col("ordinal").alias("source"))


def pad_to(df: DataFrame, divisor: int) -> DataFrame:
    """Append leading rows until the size divides; added rows carry ``padded = true``."""
    total = size_of(df)
    missing = (divisor - total % divisor) % divisor
    extra = df.where(F.col("ordinal") < missing).withColumn("ordinal", F.col("ordinal") + total)
    return df.withColumn("padded", F.lit(False)).unionByName(extra.withColumn("padded", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    """Drop the rows added by ``pad_to``."""
    return df.where(~F.col("padded")).drop("padded")


#: Rounds of the shuffle, and a prime below 2^31 for its arithmetic.
ROUNDS, PRIME = 24, 2_147_483_647


def shuffle_keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """Two numbers below PRIME for every round."""
    digest = b"".join(hashlib.sha256(f"{seed}|{epoch}|{r}".encode()).digest()[:16] for r in range(ROUNDS))
    numbers = [int.from_bytes(digest[k : k + 8], "big") % PRIME for k in range(0, len(digest), 8)]
    return list(zip(numbers[::2], numbers[1::2]))


def shuffled_place(place: Column, size: Column, keys: Column) -> Column:
    """Place of a row after a keyed shuffle of ``0 .. size - 1``: a bijection, so no rows are sorted.

    In every round a place and its mirror ``(key - place) mod size`` change places or stay, as a bit of the
    larger one says.
    """

    def step(x: Column, key: Column) -> Column:
        mirror = F.pmod(key["a"] - x, size)
        y = (F.greatest(x, mirror) % PRIME * 48271 + key["b"]) % PRIME
        return F.when(F.floor(y * y % PRIME / 1024) % 2 == 1, mirror).otherwise(x)

    return F.aggregate(keys, place.cast("bigint"), step)


def minibatches(
    df: DataFrame, size: int, epochs: int, seed: int, key: str = "ordinal"
) -> DataFrame:
    """``epoch``, ``position`` and ``batch`` of a seeded shuffle per epoch; the incomplete last batch is dropped.

    ``key`` counts the rows from 0.  Every epoch is a projection: a row finds its position by
    ``shuffled_place``, without sorting anything.  The rows are dealt over all tasks before: counted rows come in few
    large ranges, and the rounds of all epochs are the work.
    """
    keys = F.array(*[F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in shuffle_keys(seed, e)]) for e in range(epochs)])
    total = size_of(df)
    each = dealt(df, key).withColumn("_n", total).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = each.withColumn("position", shuffled_place(F.col(key), F.col("_n"), F.get(keys, F.col("epoch"))))
    return placed.withColumn("batch", F.floor(F.col("position") / size)).where(F.col("batch") < F.floor(F.col("_n") / size)).drop("_n")


def collate(df: DataFrame, batch: str, order: str, cols: Sequence[str]) -> DataFrame:
    """One row per batch with the ordered values of ``cols`` as arrays (batch size bounds them)."""
    rows = F.array_sort(F.collect_list(F.struct(order, *cols)))
    return df.groupBy(batch).agg(rows.alias("_r")).select(
        batch, *[F.col(f"_r.{c}").alias(c) for c in cols]
    )


def fold(df: DataFrame, new_size: int, cols: Sequence[str]) -> DataFrame:
    """``new_size`` rows, each holding the arrays of its run of consecutive rows."""
    return collate(chunk(df, new_size), "chunk", "ordinal", cols).withColumnRenamed("chunk", "ordinal")


def unfold(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Undo ``fold``: one row per array position, in order."""
    rows = df.select("ordinal", F.posexplode(F.arrays_zip(*cols)).alias("_p", "_r"), F.size(cols[0]).alias("_n"))
    return rows.select(
        (F.col("ordinal") * F.col("_n") + F.col("_p")).alias("ordinal"), *[F.col(f"_r.{c}") for c in cols]
    )


def _serpentine(rank: Column, k: Column) -> Column:
    """0..k-1, then k-1..0, and so on down the ranked lengths."""
    lap, place = F.floor(rank / k), rank % k
    return F.when(lap % 2 == 0, place).otherwise(k - 1 - place)


#: Rows of one length range that are differenced in one task, and ranges whose states are.
RANGE_ROWS, RANGES = 32_768, 1024
#: Groups told apart by one state; batches with more groups of free size are cut into shards first.
SHARD_GROUPS = 64


def _split_ranges(lengths: pd.Series, k: pd.Series, first: pd.Series, whole: pd.Series, equal: pd.Series, strict: pd.Series, few: pd.Series) -> pd.DataFrame:
    """Groups and sums of each range of lengths; ``whole`` ranges are a batch of their own, exact up to ``few`` rows."""
    out = []
    for values, n, at, alone, same, both, most in zip(lengths, k, first, whole, equal, strict, few):
        values = np.asarray(values, np.int64)
        out.append((best_split(values, n, same, both, most), None, None) if alone else split(values, n, same, at))
    return pd.DataFrame(out, columns=["slots", "sums", "dealt"])


def _merge_states(states: pd.Series) -> pd.DataFrame:
    """One state out of several, and the group that each of their entries comes to."""
    out = []
    for group in states:
        slots, sums = difference([np.asarray(s["sums"], np.int64) for s in group])
        out.append(([s.tolist() for s in slots], sums, np.sum([s["dealt"] for s in group], axis=0)))
    return pd.DataFrame(out, columns=["slots", "sums", "dealt"])


def _merged(states: DataFrame, by: Sequence[str], part: str) -> DataFrame:
    """Merge the states of each group of ``by``; one row per ``part`` with the merged sums and its ``slots``."""
    merge = F.pandas_udf(_merge_states, "slots array<array<bigint>>, sums array<bigint>, dealt array<bigint>")
    listed = F.array_sort(F.collect_list(F.struct(part, "sums", "dealt")))
    found = states.groupBy(*by).agg(listed.alias("_states")).withColumn("_m", merge("_states"))
    each = F.arrays_zip(F.col(f"_states.{part}").alias(part), F.col("_m.slots").alias("slots"))
    return found.select(*by, F.col("_m.sums").alias("sums"), F.col("_m.dealt").alias("dealt"), F.inline(each))


def _differenced(ranked: DataFrame, by: Sequence[str], equal: bool, rows: int, ranges: int, exact_rows: int) -> DataFrame:
    """``_group`` for rows (*by, _rank, _len, _k, _n, _strict): rank by falling length, groups and rows of the batch.

    Ranges of ``rows`` rows are differenced on their own, then the states of up to ``ranges`` ranges, then
    those of the batch.
    """
    by, k = list(by), F.col("_k")
    span = k * F.greatest(F.floor(F.lit(rows) / k), F.lit(1))
    cut = ranked.withColumn("_range", F.floor(F.col("_rank") / span)).withColumn("_at", (F.col("_rank") % span).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("_at", "_len")))
    once = [F.first(c).alias(c) for c in ("_k", "_n", "_strict")]
    blocks = cut.groupBy(*by, "_range").agg(listed.alias("_rows"), F.first(span).alias("_span"), *once)
    alone = F.col("_n") <= F.col("_span")
    split_up = F.pandas_udf(_split_ranges, "slots array<bigint>, sums array<bigint>, dealt array<bigint>")
    found = split_up(F.col("_rows._len"), k, F.col("_range") * F.col("_span"), alone, F.lit(equal), F.col("_strict"), F.lit(exact_rows))
    blocks = blocks.withColumn("_s", found)
    done = blocks.where(alone).select(*by, "_range", F.col("_s.slots").alias("_slots"))
    # ranges of larger batches are read twice; one more exchange lets Spark run them once
    whole_rows = F.lit(not equal) | (F.col("_n") % k == 0)
    several = blocks.where(~alone).select(*by, "_range", "_strict", whole_rows.alias("_even"), "_s.*").repartition(*by, "_range")
    first = several.withColumn("_part", F.floor(F.col("_range") / ranges))
    strict = several.groupBy(*by).agg(F.first("_strict").alias("_strict"), F.first("_even").alias("_even"))
    first = _merged(first.select(*by, "_part", "_range", "sums", "dealt"), [*by, "_part"], "_range")
    parts = first.groupBy(*by, "_part").agg(F.first("sums").alias("sums"), F.first("dealt").alias("dealt"))
    last = _merged(parts, by, "_part").join(strict, by)
    most, least = (lambda c: F.array_max(c)), (lambda c: F.array_min(c))
    ends = (most("sums") <= most("dealt")) & (least("sums") >= least("dealt"))
    keep = F.when(F.col("_strict"), ends).otherwise(most("sums") - least("sums") <= most("dealt") - least("dealt"))
    last = last.select(*by, "_part", F.col("slots").alias("_top"), (F.col("_even") & keep).alias("_keep"))
    path = first.select(*by, "_part", "_range", F.col("slots").alias("_middle")).join(last, [*by, "_part"])
    path = several.select(*by, "_range", F.col("slots").alias("_low")).join(path, [*by, "_range"])
    through = F.transform("_low", lambda s: F.get("_top", F.get("_middle", s.cast("int")).cast("int")))
    path = path.select(*by, "_range", F.when(F.col("_keep"), through).alias("_slots"))
    joined = cut.join(done.unionByName(path), [*by, "_range"])
    group = F.coalesce(F.get("_slots", F.col("_at")), _serpentine(F.col("_rank"), k))
    return joined.withColumn("_group", group).drop("_range", "_at", "_slots")


def _grouped(df: DataFrame, batch: str, length: str, k: Column, key: str, equal: bool, rows: int, ranges: int, exact_rows: int) -> DataFrame:
    """``df`` with ``_group``; ``k`` is an expression over ``_n``, ``_total`` and ``_longest`` of the batch."""
    rows_of = df.withColumn("_len", F.coalesce(F.col(length).cast("long"), F.lit(0))).withColumn("_batch", F.struct(batch))
    sizes = rows_of.groupBy("_batch").agg(F.count(F.lit(1)).alias("_n"), F.sum("_len").alias("_total"), F.max("_len").alias("_longest"))
    sizes = sizes.select("_batch", "_n", F.greatest(k, F.lit(1)).cast("long").alias("_all"))
    ranked = with_rank(rows_of.withColumn("_neg", -F.col("_len")), ["_neg", key], [batch], "_place")
    joined = salted_join(ranked, sizes, ["_batch"], spread=[key])
    groups, place = F.col("_all"), F.col("_place")
    lap, seat = F.floor(place / groups), _serpentine(place, groups)
    if equal:
        laid = joined.withColumns({"_shard": F.lit(0), "_k": groups, "_rank": place, "_strict": F.lit(False)})
    else:
        # neighbouring groups of the dealing make a shard; ranks, rows and groups are counted within it
        joined = joined.withColumn("_shard", F.floor(seat / SHARD_GROUPS))
        low = F.col("_shard") * SHARD_GROUPS
        own = F.least(F.lit(SHARD_GROUPS), groups - low)
        at = F.when(lap % 2 == 0, seat - low).otherwise(low + own - 1 - seat)
        left, full = F.col("_n") % groups, F.floor(F.col("_n") / groups)
        over = F.when(full % 2 == 0, left - low).otherwise(low + own - groups + left)
        laid = joined.withColumns({
            "_k": own, "_rank": lap * own + at, "_strict": groups > SHARD_GROUPS,
            "_n": full * own + F.least(F.greatest(over, F.lit(0)), own),
        })
    found = _differenced(laid, ["_batch", "_shard"], equal, rows, ranges, exact_rows)
    found = found.withColumn("_group", F.col("_group") + F.col("_shard") * SHARD_GROUPS)
    return found.select(*df.columns, "_group")


def balanced_groups(
    df: DataFrame, batch: str, length: str, k: int, key: str = "ordinal", equal_size: bool = True, range_rows: int = RANGE_ROWS, ranges: int = RANGES,
    exact_rows: int = EXACT_ROWS, uneven: str = "error",
) -> DataFrame:
    """Assign the rows of each batch to ``k`` groups of similar total length by largest differencing.

    With ``equal_size`` groups have equal counts, and a batch whose size does not divide is an error, or with
    ``uneven="deal"`` dealt, longest first, back and forth, so that counts differ by one;
    without ``equal_size`` counts are free.  No batch gets a larger spread than by dealing its rows, longest first, back
    and forth, and a batch of up to ``exact_rows`` rows gets the least spread there is.  Lengths are whole
    numbers of zero or more, null counts as zero; ``key`` tells the rows of a batch apart.  Ranges of
    ``range_rows`` lengths are split in one task each, and so are the states of ``ranges`` ranges.
    """
    if uneven not in ("error", "deal"):
        raise ValueError(f"unknown uneven {uneven!r}")
    groups = F.lit(k).cast("long")
    if equal_size and uneven == "error":
        groups = _checked(groups, F.col("_n") % k != 0, "batch does not divide into equal groups")
    out = _grouped(df, batch, length, groups, key, equal_size, range_rows, ranges, exact_rows)
    return out.withColumnRenamed("_group", "group")


def balance_report(grouped: DataFrame, batch: str, length: str, k: int, order: str) -> DataFrame:
    """Spread of total length over contiguous chunks (before) and over ``group`` (after).

    Chunks have the whole part of a ``k``-th of the rows; rows left over are one more, and a batch of fewer than
    ``k`` rows is a single one.
    """
    ranked = with_rank(grouped, [order], [batch], "_at")
    sizes = grouped.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    cut = salted_join(ranked, sizes, [batch], spread=[order]).withColumn(
        "_part", F.floor(F.try_divide(F.col("_at"), F.floor(F.col("_n") / k)))
    )
    # both spreads from one pass over (part, group) totals
    totals = cut.groupBy(batch, "_part", "group").agg(F.sum(length).alias("s"))
    before = totals.groupBy(batch, "_part").agg(F.sum("s").alias("s")).groupBy(batch).agg(
        F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff")
    )
    after = totals.groupBy(batch, "group").agg(F.sum("s").alias("s")).groupBy(batch).agg(
        F.min("s").alias("balanced_min"),
        F.max("s").alias("balanced_max"),
        (F.sum("s") / k).alias("mean"),
    )
    return before.join(after, batch)


def micro_batches(
    df: DataFrame, batch: str, length: str, max_tokens: int, key: str = "ordinal", range_rows: int = RANGE_ROWS, ranges: int = RANGES,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """``micro``: ceil(total / max_tokens) groups per batch of similar total length, counts free.

    Split as by ``balanced_groups``; batches of more than ``SHARD_GROUPS`` groups are dealt to shards of that
    many groups first.  A sequence longer than the budget is an error.
    """
    groups = _checked(F.ceil(F.col("_total") / max_tokens), F.col("_longest") > max_tokens, "a sequence is longer than the token budget")
    return _grouped(df, batch, length, groups, key, False, range_rows, ranges, exact_rows).withColumnRenamed("_group", "micro")
