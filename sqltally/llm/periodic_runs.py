"""Stretches of words that repeat with a short period, and texts without the repeats.

A run is a stretch of consecutive words with smallest period ``q`` that no neighbouring word extends.
Each text is searched on its own:

1. Grams of a few words are compared by hash.  Consecutive
   places whose gram stands elsewhere in the text are an island; a run lies wholly in one island, so
   islands too short for their own nearest recurrence are left out (a collision only adds islands).
2. The words of the islands, now compared exactly, are ranked by prefix doubling, which gives a
   suffix array and its longest common prefixes.
3. Its LCP intervals are visited bottom up.  An interval keeps the places of its word sequence in
   order, each with its class: the word to its left.  Two places of different children and different
   classes are a maximal pair; at distance ``q`` and common prefix ``l`` it is a stretch of ``l + q``
   words with period ``q`` that cannot be extended on either side.  Pairs with ``(exponent - 1) * q <= l``
   are exactly the runs, once under every multiple of the smallest period that is short enough.

Places closer than half their common prefix stand at equal steps (both steps are periods of the
sequence).  All but the last of them have the same right neighbour and all but the first the same
class, so a place has at most one partner on each side: the next one of the other children to the
right and the farthest one in reach to the left.  Classes need not be walked through, and merging
the smaller list into the larger keeps the work near ``n log n``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltally.llm.common import raw_text

#: Words searched together; a longer text is searched alone.
TOGETHER = 250_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29))

Run = tuple[int, int, int]


def gram_size(exponent: int, shortest: int) -> int:
    """Longest gram whose recurrences leave no gap in any allowed run of period ``q``.

    The first two copies share ``max(shortest - q, (exponent - 1) * q)`` words or more; the places of
    both copies touch when that leaves ``q`` grams.
    """
    return min(max(shortest - q, (exponent - 1) * q) - q + 1 for q in range(1, shortest + 1))


def islands(hashes: np.ndarray, text: np.ndarray, stops: np.ndarray, gram: int, exponent: int, shortest: int) -> list[tuple[int, int]]:
    """(first, end) of word stretches that may hold a run; ``text`` is the number of each word's text."""
    mul, fold, shift = _MIX
    n = len(hashes) - gram + 1
    if n < 2:
        return []
    mixed = text[:n].astype(np.uint64)
    for k in range(gram):
        mixed = (mixed ^ hashes[k : k + n]) * mul
        mixed = (mixed ^ (mixed >> shift)) * fold
    inside = np.arange(gram, n + gram) <= stops[text[:n]]
    at = np.flatnonzero(inside)
    bits = np.uint64(int(n).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    keys = np.sort((mixed[at] & ~low) | at.astype(np.uint64))  # the place breaks ties
    place, same = (keys & low).astype(np.int64), (keys[1:] >> bits) == (keys[:-1] >> bits)
    step = np.full(n, np.iinfo(np.int64).max)
    step[place[:-1][same]] = np.diff(place)[same]
    kept = np.zeros(n, bool)
    kept[place[1:][same]] = kept[place[:-1][same]] = True
    found = np.flatnonzero(kept)
    if not len(found):
        return []
    cut = np.flatnonzero((np.diff(found) > 1) | (np.diff(text[found]) != 0)) + 1
    heads = np.concatenate([[0], cut])
    sizes = np.diff(np.concatenate([heads, [len(found)]])) + gram - 1
    nearest = np.minimum.reduceat(step[found], heads)
    # an island whose places all recur in earlier islands only has no step of its own
    able = (nearest <= sizes) & (sizes >= np.maximum(shortest, exponent * np.minimum(nearest, sizes)))
    first = found[heads[able]]
    return list(zip(first.tolist(), (first + sizes[able]).tolist()))


def suffixes(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes of neighbours; a suffix stops at its entry of ``ends``.

    ``codes`` of different stretches differ, so that no prefix is shared between stretches.
    """
    size = len(codes)
    ranks = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, width = [ranks.astype(np.int32)], 1
    while ranks.max() + 1 < size:
        after = np.zeros(size, np.int64)
        at = np.flatnonzero(np.arange(size) + width < ends)
        after[at] = ranks[at + width] + 1
        ranks = np.unique(ranks * (size + 1) + after, return_inverse=True)[1].astype(np.int64)
        levels.append(ranks.astype(np.int32))
        width *= 2
    order = np.argsort(ranks)
    a, b = order[:-1], order[1:]
    common = np.zeros(size - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        live = np.flatnonzero((i < ends[a]) & (j < ends[b]))
        same = live[levels[k][i[live]] == levels[k][j[live]]]
        common[same] += 1 << k
    return order, common


def maximal_pairs(order: list[int], common: list[int], left: list[int], least: int, exponent: int) -> Iterator[Run]:
    """(first place, common prefix, distance) of maximal pairs with ``(exponent - 1) * distance <= prefix``."""

    def join(places: list[int], others: list[int], prefix: int) -> list[int]:
        reach = prefix // (exponent - 1)
        if len(places) < len(others):
            places, others = others, places
        for x in others:
            at = bisect_left(places, x - reach)
            if at < len(places) and places[at] < x and left[places[at]] != left[x]:
                found.append((places[at], prefix, x - places[at]))
            at = bisect_right(places, x, at)
            if at < len(places) and places[at] - x <= reach and left[places[at]] != left[x]:
                found.append((x, prefix, places[at] - x))
        for x in others:
            insort(places, x)
        return places

    found: list[Run] = []
    stack: list[tuple[int, list[int]]] = []
    done = [order[0]] if order else []
    for at, prefix in zip(order[1:] + [-1], common + [0]):
        while stack and stack[-1][0] > prefix:
            deeper, places = stack.pop()
            done = join(places, done, deeper)
        if stack and stack[-1][0] == prefix:
            stack[-1] = (prefix, join(stack[-1][1], done, prefix))
        elif prefix >= least:
            stack.append((prefix, done))
        done = [at]
    return iter(found)


def find_runs(texts: list[list[bytes]], exponent: int = 4, shortest: int = 6) -> list[list[Run]]:
    """(start, length, period) of all runs of each text's words, by start, then period."""
    gram = gram_size(exponent, shortest)
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    begins = stops - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    hashes = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, len(text)).view(np.uint64)
    smallest: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    stretches = islands(hashes, text, stops, gram, exponent, shortest)
    if stretches:
        known: dict[tuple[int, bytes], int] = {}
        codes, ends, owner, left = [], [], [], []
        for k, (first, end) in enumerate(stretches):
            doc = int(text[first])
            base = int(begins[doc])
            words = texts[doc][first - base : end - base]
            here = [known.setdefault((k, w), len(known)) for w in words]
            # the word before the island is no word of it with the same neighbours; any code tells it apart
            before = texts[doc][first - base - 1] if first > base else None
            left += [-1 if before is None else known.setdefault((k, before), len(known)), *here[:-1]]
            codes += here
            ends += [len(codes)] * len(here)
            owner += [(doc, first - base - (len(codes) - len(here)))] * len(here)
        order, common = suffixes(np.array(codes), np.array(ends))
        for at, prefix, period in maximal_pairs(order.tolist(), common.tolist(), left, gram, exponent):
            if prefix + period >= shortest:
                doc, shift = owner[at]
                key = (at + shift, prefix + period)
                smallest[doc][key] = min(period, smallest[doc].get(key, period))
    return [sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2])) for found in smallest]


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words that stand in no run after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """(doc_id, runs, collapsed): one row per row of ``docs``, repeated rows included.

    ``runs`` lists (start, length, period) in words of at least ``shortest`` words and ``exponent``
    periods (three or more), by start, then period; ``collapsed`` holds the words left when each run keeps its
    first period, joined by one space.  Words are maximal stretches without ASCII white space.  A null,
    empty or blank text has no runs and an empty ``collapsed``; an empty table gives no row; other
    columns are left out.  A text is searched in one task, however long it is.
    """
    if exponent < 3:
        raise ValueError("exponent must be 3 or more")
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, words, size = 0, [], 0
            for n, value in enumerate(b.column(1)):
                words.append(value.as_py().split())
                size += len(words[-1])
                if size >= TOGETHER or n + 1 == b.num_rows:
                    runs = find_runs(words, exponent, shortest)
                    left = [b" ".join(collapse(w, r)) for w, r in zip(words, runs)]
                    spans = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(first, len(words)), pa.array(spans, pa.list_(span)), pa.array(left, pa.binary())],
                        ["doc_id", "runs", "collapsed"],
                    )
                    first, words, size = n + 1, [], 0

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), raw_text(text).alias("text"))
    layout = f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    return rows.mapInArrow(searched, layout).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): a tenth of the texts made periodic from some word on, as crc32 of the id says.

    With ``h`` that checksum (a null id counts as ''), ``g = floor(h / 10)`` and ``n`` words, texts with
    ``h % 10 = 0`` repeat the first ``1 + floor((n - a) / (3 + g % 8))`` words from word ``a = g % n`` on;
    their words are joined by one space.
    """
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), h.alias("h"))
    words = F.filter(F.split(F.when(F.col("h") % 10 == 0, F.col("text")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    cut = chosen.select("*", F.inline(F.array(F.struct(words.alias("words"))))).withColumn("n", F.size("words").cast("bigint"))
    g = F.floor(F.col("h") / 10)
    cut = cut.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    cut = cut.select("doc_id", "text", F.inline(F.array(F.struct("words", "n", "a", "p"))))
    a, p = F.col("a"), F.col("p")
    head = F.slice("words", F.lit(1), a.cast("int"))
    tail = F.transform(F.sequence(F.lit(0), (F.col("n") - a - 1).cast("int")), lambda i: F.get("words", (a + i % p).cast("int")))
    changed = F.array_join(F.concat(head, tail), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))
