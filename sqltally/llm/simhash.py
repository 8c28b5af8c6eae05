"""SimHash near-duplicates by tiled exact comparison.

Every document gets a 64-bit SimHash of its word shingles.  Distinct fingerprints are compared
exactly: tiles of fingerprints meet as numpy matrices of exclusive-or and bit counts, and tile
pairs whose population counts differ by more than the radius are never formed.  Tiles meet only
inside a bucket of equal bit blocks: two words that differ in at most ``radius`` of 64 bits agree
on at least ``blocks - radius`` of their blocks, so no link is lost and no tile meets all others.
Links leave a tile pair as a spanning forest, and components grow by star contraction.

A wide radius also joins unrelated texts by chance.  With ``agreement`` a link needs, besides, that
this share of a small min-hash sketch of the shingles agrees; the tiles carry the sketches along.

``near_copies`` needs no fingerprint distance: it links texts by the exact Jaccard similarity of
their shingle sets.  Sets that reach ``share`` have a shingle in common among the first few of any
fixed order of shingles (prefix filter), so only sets that meet there are compared.  Parity maps of
the sets bound their difference from below and discard most of those pairs without the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltally.llm.common import cut_lineage, raw_text, text_key

SEED = 42
#: Shingles whose bits are counted at once.
BIT_CHUNK = 1 << 16
#: Compared pairs that cost as much as one row of a bucket, which is shuffled twice and checkpointed.
COMPARED = 4000
#: Bytes of a sketch.
SKETCH = 32
#: Texts that tell which shingles are common, and how many of those the order of shingles puts last.
ORDER_TEXTS, ORDER_SHINGLES = 10_000, 300_000
#: Bits of the longest parity map.
PARITY_BITS = 4096


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of every word shingle of UTF-8 ``data``: A-Z lowered, ASCII white space separates words."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - width + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def simhash64(hashes: np.ndarray) -> int:
    """Unsigned number whose bits are set in over half of the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BIT_CHUNK):
        octets = hashes[at : at + BIT_CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A byte of the smallest hash in each of SKETCH classes of hashes; 0 marks an empty class."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (hashes % np.uint64(SKETCH)).astype(np.int64), hashes // np.uint64(SKETCH))
    empty = least == np.iinfo(np.uint64).max
    return np.where(empty, 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, sketched: bool = False) -> DataFrame:
    """(doc_id, text_key, fp BIGINT, sketch BINARY) for every row; null and wordless texts have fingerprint zero."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sketches = [], []
            for raw in b.column(2):
                found = shingle_hashes(raw.as_py(), width)
                fps.append(simhash64(found))
                sketches.append(sketch(found).tobytes() if sketched else None)
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, pa.array(sketches, pa.binary())], ["doc_id", "text_key", "fp", "sketch"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), raw_text(text).alias("raw"))
    return rows.mapInArrow(hashed, f"doc_id {kind}, text_key bigint, fp bigint, sketch binary")


def _block_count(distinct: int, radius: int) -> int:
    """Number of blocks with the least work: rows per bucket key, and pairs compared at a part of COMPARED of a row."""

    def work(blocks: int) -> float:
        return comb(blocks, blocks - radius) * (1 + distinct / 2 ** (64 * (blocks - radius) // blocks) / COMPARED)

    return min(range(radius + 1, min(63, radius + 6) + 1), key=work)


def _bucket_keys(fp: Column, blocks: int, radius: int) -> Column:
    """One key per choice of ``blocks - radius`` blocks: the choice and the bits under its mask."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for n, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def _forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links in a boolean ``rows`` x ``cols`` matrix, as star edges."""
    edges = []
    todo = linked.any(1)
    while todo.any():
        first = int(todo.argmax())
        in_rows, in_cols = np.zeros(len(rows), bool), np.zeros(len(cols), bool)
        fresh = np.zeros(len(rows), bool)
        fresh[first] = True
        while fresh.any():
            in_rows |= fresh
            reached = linked[fresh].any(0) & ~in_cols
            in_cols |= reached
            fresh = linked[:, reached].any(1) & ~in_rows
        root = int(rows[first])
        for value in {*rows[in_rows].tolist(), *cols[in_cols].tolist()} - {root}:
            edges.append((root, value))
        todo &= ~in_rows
    return edges


def _agree(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Whether sketches agree in at least ``share`` of the classes that either of them fills."""
    filled = ((a != 0) | (b != 0)).sum(1)
    return ((a == b) & (a != 0)).sum(1) >= share * np.maximum(filled, 1)


def _compare(radius: int, agreement: float | None):
    def cells(tile: pa.ListScalar) -> tuple[np.ndarray, np.ndarray | None]:
        fps = tile.values.field("fp").to_numpy().view(np.uint64)
        if agreement is None:
            return fps, None
        return fps, np.frombuffer(b"".join(tile.values.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[int, int]] = set()
            for left, right in zip(b.column("left"), b.column("right")):
                x, x_sketch = cells(left)
                y, y_sketch = cells(right) if right.is_valid else (x, x_sketch)
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                if not right.is_valid:
                    np.fill_diagonal(near, False)
                if agreement is not None and near.any():
                    i, j = np.nonzero(near)
                    near[i, j] = _agree(x_sketch[i], y_sketch[j], agreement)
                if near.any():
                    found.update(_forest(near, x.view(np.int64), y.view(np.int64)))
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return links


def fingerprint_links(distinct: DataFrame, radius: int = 4, agreement: float | None = None, tile: int = 1024) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints joined by chains of links.

    ``distinct`` has one row per fingerprint, columns ``fp`` and ``sketch``.  A bucket of at most
    ``tile`` rows is one tile; a larger one is cut into bands of neighbouring population counts, and
    each band into equal shares, so that every tile stays small and pairs of tiles whose counts
    differ by more than ``radius`` are skipped.
    """
    span = radius // 2 + 1
    blocks = _block_count(distinct.count(), radius)
    keyed = distinct.select("fp", "sketch", F.floor(F.bit_count("fp") / span).cast("int").alias("ones"), F.explode(_bucket_keys(F.col("fp"), blocks, radius)).alias("key"))
    by_ones = keyed.groupBy("key", "ones").agg(F.count(F.lit(1)).alias("n"))
    sized = by_ones.groupBy("key").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("ones", "n"))).alias("counts"))
    shares = F.ceil(F.element_at("counts", F.col("ones")) / F.lit(tile))
    cut = F.col("total") > tile
    placed = (
        keyed.join(sized.where("total > 1"), "key")
        .withColumn("band", F.when(cut, F.col("ones")).otherwise(F.lit(-1)))
        .withColumn("share", F.when(cut, F.pmod(F.xxhash64("fp"), shares)).otherwise(F.lit(0)))
    )
    place = ["key", "band", "share"]
    tiles = cut_lineage(placed.groupBy(*place).agg(F.collect_list(F.struct("fp", "sketch")).alias("left")))
    alone = tiles.where(F.size("left") > 1).select("left", F.lit(None).cast(tiles.schema["left"].dataType).alias("right"))
    large = tiles.where("band >= 0")
    other = large.select("key", F.col("band").alias("band2"), F.col("share").alias("share2"), F.col("left").alias("right"))
    ahead = (F.col("band2") > F.col("band")) | ((F.col("band2") == F.col("band")) & (F.col("share2") > F.col("share")))
    paired = large.join(other, "key").where(ahead & ((F.col("band2") - F.col("band")) * span - (span - 1) <= radius)).select("left", "right")
    return alone.unionByName(paired).mapInArrow(_compare(radius, agreement), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes that have an edge.

    Alternating large-star and small-star steps; the edges stay as many as the nodes and every
    round is checkpointed.  Ends when a round changes nothing.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        two = both(e)
        low = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return two.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        kept = joined.where("b <> m").select(F.col("m").alias("a"), "b")
        return kept.unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = state(now)
    while mark[0]:
        now = cut_lineage(small(large(now)))
        after = state(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, agreement: float | None = None
) -> DataFrame:
    """(doc_id, text_key, fp, component_id), one row per input row.

    ``component_id`` is the smallest id reachable over links; equal fingerprints are linked.
    Null ids keep their rows and never name a component that has another id.  Rows of equal id
    count as separate documents.  An empty table gives an empty result.
    """
    marked = cut_lineage(fingerprints(docs, doc_id, text, width, agreement is not None))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sketch")).alias("first")
    distinct = cut_lineage(marked.groupBy("fp").agg(one).select("fp", F.col("first.doc_id").alias("low"), F.col("first.sketch").alias("sketch")))
    roots = components(fingerprint_links(distinct, radius, agreement))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "text_key", "fp", "component_id")


def fp_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted different shingle hashes."""
    return np.unique(shingle_hashes(data, width))


def parity(hashes: np.ndarray) -> bytes:
    """A bit per class of hashes: whether the class has an odd number of them; about a class per hash."""
    size = min(PARITY_BITS, max(64, 1 << (max(1, len(hashes)) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(maps: list[bytes], length: int) -> np.ndarray:
    """Parity maps of at least ``length`` bytes with their classes joined down to that many bytes."""
    out = np.zeros((len(maps), length), np.uint8)
    for n, m in enumerate(maps):
        out[n] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, length), axis=0)
    return out


def _may_reach(sizes: np.ndarray, maps: list[bytes], left: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    """Which pairs of sets (places ``left`` and ``right``) can have that Jaccard similarity: never false for one that has.

    The sets differ in at least as many hashes as their parity maps in bits.
    """
    lengths = np.array([len(m) for m in maps], np.int64)
    shorter = np.minimum(lengths[left], lengths[right])
    most = (sizes[left] + sizes[right]) * (1 - share) / (1 + share) + 1e-6
    fits = np.minimum(sizes[left], sizes[right]) >= share * np.maximum(sizes[left], sizes[right]) - 1e-6
    for length in np.unique(shorter[fits]).tolist():
        at = np.flatnonzero(fits & (shorter == length))
        used, place = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
        folded = _folded([maps[k] for k in used.tolist()], length)
        for k in range(0, len(at), BIT_CHUNK):
            some = at[k : k + BIT_CHUNK]
            x, y = place[k : k + len(some)], place[len(at) + k : len(at) + k + len(some)]
            fits[some] = np.bitwise_count(folded[x] ^ folded[y]).sum(1, dtype=np.int64) <= most[some]
    return fits


def _shingle_order(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that several of some texts have, and in how many; any choice is a valid order."""
    every = max(1, docs.count() // ORDER_TEXTS)
    some = docs.select(text_key(text).alias("k"), raw_text(text).alias("raw")).where(F.pmod("k", F.lit(every)) == 0).dropDuplicates(["k"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(raw.as_py(), width) for raw in b.column(1)]
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    common = some.mapInArrow(counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    rows = common.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toPandas()
    hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["n"].to_numpy(np.int64)[order]


def _shingled(docs: DataFrame, doc_id: str, text: str, width: int, share: float) -> DataFrame:
    """(doc_id, text_key, fp, size, parity, prefix) of every row; ``fp`` tells shingle sets apart."""
    common, counts = _shingle_order(docs, text, width)

    def prefix(found: np.ndarray) -> np.ndarray:
        length = len(found) - ceil(share * len(found) - 1e-9) + 1 if len(found) else 0
        if not len(common):
            return found[:length]
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        return found[np.lexsort((found, np.where(common[at] == found, counts[at], 0)))[:length]]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [[], [], [], []]
            for raw in b.column(2):
                found = shingle_set(raw.as_py(), width)
                values = (xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63), len(found), parity(found), prefix(found).view(np.int64))
                for cell, value in zip(cells, values):
                    cell.append(value)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cells, kinds)]], ["doc_id", "text_key", "fp", "size", "parity", "prefix"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), raw_text(text).alias("raw"))
    return rows.mapInArrow(made, f"doc_id {kind}, text_key bigint, fp bigint, size bigint, parity binary, prefix array<bigint>")


def _possible(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) that their parity maps leave possible."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sizes = np.concatenate([b.column(k).to_numpy() for k in (2, 4)])
            maps = b.column(3).to_pylist() + b.column(5).to_pylist()
            ok = _may_reach(sizes, maps, np.arange(n), np.arange(n, 2 * n), share)
            yield b.select([0, 1]).filter(pa.array(ok))

    x, y = (nodes.select(F.col("fp").alias(c), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "size_a", "parity_a", "size_b", "parity_b")
    return both.mapInArrow(kept, "a bigint, b bigint")


def _exact(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, width: int, share: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have a Jaccard similarity of ``share`` at least; sets are made of the texts again."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(raw.as_py(), width).tobytes() for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["fp", "hashes"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(same >= share * (len(x) + len(y) - same) - 1e-9)
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes.select("fp", "text_key"), "fp")
    texts = docs.select(text_key(text).alias("text_key"), raw_text(text).alias("raw")).join(wanted, "text_key")
    sets = cut_lineage(texts.select("fp", "raw").dropDuplicates(["fp"]).mapInArrow(shingled, "fp bigint, hashes binary"))
    x, y = (sets.select(F.col("fp").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(linked, "a bigint, b bigint")


def _across(shared: DataFrame, nodes: DataFrame, share: float, tile: int) -> DataFrame:
    """Pairs (a, b) of different roots that meet at a token and whose sizes and parity maps leave them possible.

    A token of more than ``tile`` sets is cut into bands of sizes, and those into equal shares.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs: set[tuple[int, int]] = set()
            for left, right in zip(b.column("left"), b.column("right")):
                parts = [left.values] + ([right.values] if right.is_valid else [])
                fps, roots, sizes = (np.concatenate([p.field(c).to_numpy() for p in parts]) for c in ("fp", "root", "size"))
                maps = [m for p in parts for m in p.field("parity").to_pylist()]
                n = len(left.values)
                differ = roots[:n, None] != (roots[None, n:] if right.is_valid else roots[None, :])
                i, j = np.nonzero(differ if right.is_valid else np.triu(differ))
                j = j + n if right.is_valid else j
                ok = _may_reach(sizes, maps, i, j, share)
                x, y = fps[i[ok]], fps[j[ok]]
                pairs.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
            cells = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0]), pa.array(cells[:, 1])], ["a", "b"])

    met = shared.join(nodes.select("fp", "size", "parity", "root"), "fp")
    several = met.groupBy("token").agg(F.count(F.lit(1)).alias("total"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token", "total")
    level = F.floor(F.log("size") / F.lit(float(np.log(1 / share)))).cast("int")
    cut = F.col("total") > tile
    shares = F.ceil(F.col("total") / F.lit(tile))
    placed = (
        met.join(several, "token")
        .withColumn("band", F.when(cut, level).otherwise(F.lit(-1)))
        .withColumn("part", F.when(cut, F.pmod(F.xxhash64("fp"), shares)).otherwise(F.lit(0)))
    )
    tiles = cut_lineage(placed.groupBy("token", "band", "part").agg(F.collect_list(F.struct("fp", "root", "size", "parity")).alias("left")))
    alone = tiles.where(F.size("left") > 1).select("left", F.lit(None).cast(tiles.schema["left"].dataType).alias("right"))
    large = tiles.where("band >= 0")
    other = large.select("token", F.col("band").alias("band2"), F.col("part").alias("part2"), F.col("left").alias("right"))
    ahead = ((F.col("band2") == F.col("band")) & (F.col("part2") > F.col("part"))) | (F.col("band2") - F.col("band")).between(1, 2)
    paired = large.join(other, "token").where(ahead).select("left", "right")
    return alone.unionByName(paired).mapInArrow(found, "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, share: float = 0.8, tile: int = 256) -> DataFrame:
    """(doc_id, text_key, fp, component_id) as ``near_duplicates``, linked by exact Jaccard similarity.

    Texts are linked when their sets of ``width``-word shingles have a similarity of ``share`` at
    least.  Every set is first compared with the least one it meets at a token; after that only sets
    that are not yet joined are compared, so a large group of near copies costs little more than its rows.
    """
    marked = cut_lineage(_shingled(docs, doc_id, text, width, share))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("low")
    named = marked.groupBy("fp").agg(one, *[F.first(c).alias(c) for c in ("size", "parity", "prefix")])
    nodes = cut_lineage(named.select("fp", F.col("low.doc_id").alias("low"), F.col("low.text_key").alias("text_key"), "size", "parity", "prefix"))
    at_token = Window.partitionBy("token")
    keyed = nodes.select("fp", F.explode("prefix").alias("token"))
    counted = keyed.withColumn("n", F.count(F.lit(1)).over(at_token)).withColumn("least", F.min("fp").over(at_token))
    shared = cut_lineage(counted.where("n > 1").select("token", "fp", "least"))
    nodes = nodes.drop("prefix")
    stars = shared.where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    links = cut_lineage(_exact(cut_lineage(_possible(stars, nodes, share)), nodes, docs, text, width, share))
    first = components(links)
    rooted = nodes.join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut_lineage(rooted)
    more = _exact(cut_lineage(_across(shared, rooted, share, tile)), nodes, docs, text, width, share)
    roots = components(links.unionByName(more))
    last = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = last.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(last.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "text_key", "fp", "component_id")


def _one_of_each(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of ``docs``, one per component of ``found``: smallest id, then smallest text key, then one of equal rows."""
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    kept = found.groupBy(group.alias("g")).agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    keyed = docs.withColumn("_key_of", text_key(text))
    same = keyed[doc_id].eqNullSafe(kept["_id"]) & (keyed["_key_of"] == kept["_key"])
    one = Window.partitionBy(doc_id, "_key_of").orderBy(F.lit(0))
    return (
        keyed.join(kept, same, "left_semi")
        .withColumn("_copy", F.row_number().over(one))
        .where("_copy = 1")
        .select(*[docs[c] for c in docs.columns])
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """Rows of ``docs`` with one row per component of ``near_duplicates``: smallest id, then smallest text key, then one of equal rows.

    Null ids come last.  Texts without words are one component.  An empty table gives no row.
    """
    return _one_of_each(docs, near_duplicates(docs, doc_id, text, width, radius), doc_id, text)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, share: float = 0.8) -> DataFrame:
    """Rows of ``docs`` with one row per component of ``near_copies``, chosen as by ``keep_one``."""
    return _one_of_each(docs, near_copies(docs, doc_id, text, width, share), doc_id, text)
