"""Line dedup over a suffix array of line ids, in DataFrame functions only.

Lines that occur once cannot be in a repeated run, so the sequences to sort are the stretches of
repeated lines ("islands") of every document.  Prefix doubling ranks their suffixes by the first
1, 2, 4, ... lines: a suffix's next rank is the place of its pair (rank here, rank 2^t lines later)
among all pairs, found by a distributed sort of the distinct pairs; islands end with rank 0.

Suffixes with a common prefix of m lines form one interval of the suffix array.  Two blocks of
2^t <= m lines, one at either end of the prefix, have the ranks that tell whether m lines agree, so
an interval is named by (m, rank of the first block, rank of the last block).  The intervals asked
for are those at which a run reaches ``min_words`` words, from its first line on and up to its last
line; the union of an interval's later members in a document is its maximal repeated runs of that
many words.  The first copy, by id, text key and line, stays; the lines of later copies go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltally.functions.ordering import with_rank
from sqltally.llm.common import cut_lineage, text_key

LINE = ["doc_id", "key"]


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), text_key(text).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")
    )
    # two hashes with different seeds make an id of 128 bits
    return rows.select(
        *LINE, "pos", F.xxhash64("line").alias("id1"), F.xxhash64(F.lit("line"), "line").alias("id2"),
        F.regexp_count("line", F.lit(r"\S+")).alias("words"),
    )


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, pos, words, island, r0): lines that occur more than once, r0 their rank from 1."""
    lines = _lines(docs, doc_id, text)
    often = lines.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id1", "id2")
    ranked = with_rank(cut_lineage(often), ["id1", "id2"], name="r0").withColumn("r0", F.col("r0") + 1)
    found = lines.join(ranked, ["id1", "id2"]).select(*LINE, "pos", "words", "r0").distinct()
    place = Window.partitionBy(*LINE).orderBy("pos")
    return cut_lineage(found.withColumn("island", F.col("pos") - F.row_number().over(place)))


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, start, m): shortest runs of at least ``min_words`` words from or up to a line of an island."""
    island = [*LINE, "island"]
    upto = Window.partitionBy(*island).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*island)
    summed = lines.withColumn("upto", F.sum("words").over(upto)).withColumn("ahead", F.col("upto") - F.col("words"))
    summed = summed.withColumn("total", F.sum("words").over(whole)).withColumn("first", F.min("pos").over(whole)).withColumn("last", F.max("pos").over(whole))
    # frames start at the far end of the island, where a growing frame costs one step a row
    later = Window.partitionBy(*island).orderBy(F.desc("ahead")).rangeBetween(Window.unboundedPreceding, -min_words)
    earlier = Window.partitionBy(*island).orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    reach = F.when(F.col("total") - F.col("ahead") >= min_words, F.col("last") + 1)
    back = F.when(F.col("upto") >= min_words, F.col("first"))
    ends = summed.withColumn("stop", F.coalesce(F.min("pos").over(later), reach)).withColumn("start", F.coalesce(F.max("pos").over(earlier) + 1, back))
    forward = ends.where("stop is not null").select(*LINE, F.col("pos").alias("start"), (F.col("stop") - F.col("pos")).alias("m"))
    backward = ends.where("start is not null").select(*LINE, "start", (F.col("pos") - F.col("start") + 1).alias("m"))
    return forward.unionByName(backward).distinct()


def suffix_ranks(lines: DataFrame, levels: int) -> DataFrame:
    """Add r1, ..., r<levels>: rank of every suffix by its first 2^t lines, among all suffixes."""
    order = Window.partitionBy(*LINE, "island").orderBy("pos")
    ranked = lines
    for t in range(levels):
        here = f"r{t}"
        ranked = ranked.withColumn("_then", F.coalesce(F.lead(here, 1 << t).over(order), F.lit(0).cast("bigint")))
        pairs = cut_lineage(ranked.select(here, "_then").distinct())
        named = with_rank(pairs, [here, "_then"], name=f"r{t + 1}").withColumn(f"r{t + 1}", F.col(f"r{t + 1}") + 1)
        ranked = cut_lineage(ranked.join(named, [here, "_then"]).drop("_then"))
    return ranked


def later_copies(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, start, stop): maximal runs of lines, stop exclusive, that repeat an earlier run.

    Only runs of at least ``min_words`` words count; blank lines inside them belong to them.  Rows
    of equal id and text are one document.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    lines = repeated_lines(docs, doc_id, text)
    wanted = cut_lineage(windows(lines, min_words))
    longest = wanted.agg(F.max("m")).first()[0] or 1
    levels = int(longest).bit_length() - 1
    ranks = suffix_ranks(lines, levels)
    every = F.array(*[F.col(f"r{t}") for t in range(levels + 1)])
    level = sum([(F.col("m") >= (1 << t)).cast("int") for t in range(1, levels + 1)], F.lit(0))
    wanted = wanted.withColumn("t", level).withColumn("tail", F.col("start") + F.col("m") - F.expr("shiftleft(1, t)"))
    cells = ranks.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "pos", every.alias("r"))

    def at(rows: DataFrame, place: str, name: str) -> DataFrame:
        on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col(place) == F.col("pos"))
        return rows.join(cells, on).withColumn(name, F.get("r", F.col("t"))).drop("d", "k", "pos", "r")

    members = cut_lineage(at(at(wanted, "start", "head"), "tail", "foot"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), F.col("start").alias("start"))
    interval = ["m", "head", "foot"]
    firsts = members.groupBy(*interval).agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = members.join(firsts, interval).where(~place.eqNullSafe(F.col("kept")))
    spans = later.select(*LINE, "start", (F.col("start") + F.col("m")).alias("stop")).distinct()
    upto = Window.partitionBy(*LINE).orderBy("start", "stop")
    reached = F.max("stop").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (reached < F.col("start")), 1).otherwise(0)
    runs = spans.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*LINE, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def kept_text(text: Column, runs: Column) -> Column:
    """``text`` without the lines of ``runs``, a sorted array of (start, stop)."""
    lines = F.split(text, "\n")
    part = lambda i: F.slice(
        lines,
        F.coalesce(F.get(runs, i - 1)["stop"], F.lit(0)) + 1,
        F.coalesce(F.get(runs, i)["start"], F.size(lines)) - F.coalesce(F.get(runs, i - 1)["stop"], F.lit(0)),
    )
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), part)), "\n")


def without_later_copies(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs``; ``text`` lost its later copies, ``removed_runs`` and ``removed_lines`` tell them.

    A text whose lines all repeat earlier ones is empty, a null text stays null, and an empty table
    gives no row.
    """
    runs = later_copies(docs, min_words, doc_id, text)
    listed = runs.groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed_runs"))
    listed = cut_lineage(listed).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "removed_runs")
    keyed = docs.withColumn("_text_key", text_key(text))
    on = keyed[doc_id].eqNullSafe(listed["_id"]) & (keyed["_text_key"] == listed["_key"]) & keyed[text].isNotNull()
    lines = F.coalesce(F.aggregate("removed_runs", F.lit(0), lambda n, r: n + r["stop"] - r["start"]), F.lit(0))
    joined = keyed.join(listed, on, "left")
    shown = [
        F.when(F.col("removed_runs").isNull(), docs[c]).otherwise(kept_text(docs[c], F.col("removed_runs"))).alias(c) if c == text else docs[c]
        for c in docs.columns
    ]
    return joined.select(*shown, listed["removed_runs"], lines.alias("removed_lines"))
