"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed, ``k`` neighbouring word hashes are rolled into a gram hash by rotation and
exclusive-or, and of every ``window`` neighbouring grams the smallest is chosen, the rightmost of
equals.  Positions are kept: two texts that share ``k + window - 1`` words in a row share a chosen
gram.  Grams are ordered by the upper 31 bits of their hash; a position below them in the same
number makes the rightmost of equals the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltally.functions.once import pinned
from sqltally.llm.common import text_key

_UPPER = 0x7FFFFFFF00000000
_LOWER = 0xFFFFFFFF
_LAST = 0x7FFFFFFF


def _roll(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b)


def _head(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = 3, window: int = 6) -> DataFrame:
    """Add ``name ARRAY<STRUCT<position, hash>>``: the chosen grams of column ``text`` by position.

    White space separates words and case does not count.  A text of fewer than ``k`` words is one
    gram; a text of fewer grams than ``window`` is one window; a null or wordless text has no gram.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    out = pinned(df, _h=F.transform(words, lambda w: F.xxhash64(w)))
    gram = F.col("_h")
    for j in range(1, k):
        rest = _shifted(F.col("_h"), j)
        gram = F.zip_with(_head(gram, F.size("_h") - j), rest, _roll)
    whole = F.array(F.aggregate("_h", F.lit(0).cast("bigint"), _roll))
    gram = F.when(F.size("_h") == 0, F.array().cast("array<bigint>")).when(F.size("_h") < k, whole).otherwise(gram)
    out = pinned(out, _g=gram)
    ranked = F.transform("_g", lambda g, i: g.bitwiseAND(F.lit(_UPPER)).bitwiseOR(F.lit(_LAST) - i.cast("bigint")))
    out = pinned(out, _m=ranked)
    lowest, span = F.col("_m"), 1  # smallest of ``span`` neighbours, by doubling
    while span < window:
        step = min(span, window - span)
        narrowed = F.zip_with(_head(lowest, F.size(lowest) - step), _shifted(lowest, step), lambda a, b: F.least(a, b))
        span += step
        out = pinned(out, **{f"_m{span}": narrowed})
        lowest = F.col(f"_m{span}")
    few = F.when(F.size("_g") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.array_min("_m")))
    chosen = F.array_distinct(F.when(F.size("_g") < window, few).otherwise(lowest))
    at = lambda m: (F.lit(_LAST) - m.bitwiseAND(F.lit(_LOWER))).cast("int")
    kept = F.transform(chosen, lambda m: F.struct(at(m).alias("position"), F.get("_g", at(m)).alias("hash")))
    out = pinned(out, **{name: kept})
    return out.select(*df.columns, name)


def as_text(fingerprint: str) -> Column:
    """``position:hash`` of every chosen gram, hashes as 16 hexadecimal digits."""
    return F.array_join(
        F.transform(fingerprint, lambda g: F.concat(g["position"].cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(g["hash"]), 16, "0")))), " "
    )


def likeness(a: str, b: str) -> Column:
    """Shared share of the distinct hashes of two fingerprints; two empty ones are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(docs: DataFrame, carried: list[str], doc_id: str, key: str, rows: int = 2_000, small: int = 1_000_000) -> DataFrame:
    """Add ``next_<c>`` for the carried columns: those of the next row by descending integer id, the last row's of the first.

    Equal ids follow each other by ``key``; null ids come last.  Rows are shuffled once, by equal
    stretches of ids of about ``rows`` rows; the first row of a stretch also goes to the one before
    it, as found from a table of the first rows (broadcast while there are at most ``small``).
    """
    ends = docs.agg(F.min(doc_id), F.max(doc_id), F.count(F.lit(1))).first()
    low, high, total = (ends[0] or 0), (ends[1] or 0), ends[2]
    stretches = max(1, total // rows)
    step = max(1, -(-(high - low + 1) // stretches))
    stretch = F.coalesce(F.floor((F.col(doc_id).cast("decimal(38,0)") - F.lit(low)) / F.lit(step)), F.lit(-1)).cast("bigint")
    place = F.struct(F.col(doc_id).isNull().alias("none"), (-F.col(doc_id).cast("decimal(38,0)")).alias("down"), F.col(key).alias("key"))
    by_number = Window.orderBy(F.desc("stretch"))
    firsts = docs.groupBy(stretch.alias("stretch")).agg(F.min(place).alias("p"))
    # one small row per stretch
    before = F.coalesce(F.lag("stretch").over(by_number), F.min("stretch").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.withColumn("_before", before).select(F.col("p").alias("_first"), "_before")
    placed = docs.withColumn("_place", place).withColumn("_stretch", stretch)
    firsts = F.broadcast(firsts) if stretches <= small else firsts
    dealt = (
        placed.join(firsts, F.col("_place") == F.col("_first"), "left")
        .withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(F.struct(F.lit(0).alias("ghost"), F.col("_stretch").alias("at")))).otherwise(
            F.array(F.struct(F.lit(0).alias("ghost"), F.col("_stretch").alias("at")), F.struct(F.lit(1).alias("ghost"), F.col("_before").alias("at"))))))
        .withColumn("_at", F.col("_to.at"))
        .withColumn("_ghost", F.col("_to.ghost"))
    )
    order = Window.partitionBy("_at").orderBy("_ghost", "_place")
    following = F.lead(F.struct(*carried)).over(order)
    found = dealt.withColumn("_next", following).where("_ghost = 0")
    return found.select(*docs.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in carried])


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, window: int = 6) -> DataFrame:
    """Fingerprint of every text and of the text whose last third gives way to the next document's start.

    (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), the last two
    as likeness of hashes.  Null texts count as empty; a single document is its own next.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), text_key(text).alias("key"))
    # only texts are shuffled; fingerprinting the next text again costs less than moving its grams
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    pairs = with_next(rows, ["text"], "doc_id", "key")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    marked = pinned(pairs, n_chars=n.cast("bigint"), edited=edited)
    for text, name in (("text", "fingerprint"), ("next_text", "next_fingerprint")):
        marked = with_fingerprint(marked, text, name, k, window).drop(text)
    marked = with_fingerprint(marked, "edited", "edited_fingerprint", k, window)
    hashes = [F.array_distinct(F.col(f"{c}fingerprint.hash")).alias(f"{c}hashes") for c in ("", "edited_", "next_")]
    return marked.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", *hashes).select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness("hashes", "edited_hashes").alias("near_edited"), likeness("hashes", "next_hashes").alias("near_next"),
    )


