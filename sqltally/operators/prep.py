"""Dataset preparation: splits, prompts, records, value retrieval and token sequences."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sqltally.functions.once import pinned
from sqltally.functions.skew import dealt
from sqltally.functions.text import outside_quotes

# --- splits and records -------------------------------------------------------------------------


def split_by_position(df: DataFrame, n_train: int, n_test: int) -> DataFrame:
    """First ``n_train`` rows train, next ``n_test`` test, by dense ``ordinal``; too few rows fail."""
    total = df.agg(F.count(F.lit(1))).scalar()
    short = F.raise_error(F.lit("fewer rows than train + test")).cast("long")
    at = F.when(total < n_train + n_test, short).otherwise(F.col("ordinal"))
    return (
        df.where(F.col("ordinal") < n_train + n_test)
        .withColumn("split", F.when(F.col("ordinal") < n_train, "train").otherwise("test"))
        .withColumn("index", F.when(at < n_train, at).otherwise(at - n_train))
    )


def take_first(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows (top-n per task, then merged)."""
    return df.orderBy(*order).limit(n)


#: default prompt; callers pass their own text with the same slots
TEMPLATE = (
    "Database engine: {engine}\nSchema:\n{schema}\nKnowledge: {knowledge}\nQuestion:\n{question}\n"
    "Think inside <think> </think>, then give the query in a ```sql block inside <answer> </answer>.\n"
)


def join_knowledge(question: Column, knowledge: Column) -> Column:
    """Knowledge on the line before the question, unless it is blank."""
    blank = F.trim(F.coalesce(knowledge, F.lit(""))) == ""
    return F.when(blank, question).otherwise(F.concat(knowledge, F.lit("\n"), question))


def fill_template(template: str, slots: Mapping[str, Column]) -> Column:
    """``template`` with ``{name}`` slots replaced; the text is cut once, values are never re-read."""
    parts, rest = [], template
    while rest:
        hits = [(rest.find("{" + name + "}"), name) for name in slots if "{" + name + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(slots[name], F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def build_prompts(
    questions: DataFrame,
    ddl: DataFrame,
    template: str = TEMPLATE,
    engine: str = "SQLite",
    one_line: bool = False,
) -> DataFrame:
    """``(question_id, prompt)``; ``one_line`` turns newlines in the question fields into blanks.

    ``questions(question_id, db_id, question, knowledge, complexity)`` and ``ddl(db_id, ddl)``.
    With a ``{knowledge}`` slot the knowledge stands apart, else it precedes the question.
    """

    def clean(c: str) -> Column:
        return F.replace(c, F.lit("\n"), F.lit(" ")) if one_line else F.col(c)

    apart = "{knowledge}" in template
    question = clean("question") if apart else join_knowledge(clean("question"), clean("knowledge"))
    slots = {
        "engine": F.lit(engine),
        "schema": F.col("ddl"),
        "knowledge": clean("knowledge"),
        "complexity": clean("complexity"),
        "question": question,
    }
    rows = questions.withColumn("db_id", F.replace("db_id", F.lit("\n"), F.lit("")))
    return rows.join(ddl, "db_id").select("question_id", fill_template(template, slots).alias("prompt"))


def training_records(
    prompts: DataFrame, questions: DataFrame, source: str, ability: str = "logic"
) -> DataFrame:
    """Nested training records; ``questions`` carry ``db_id, sql, split, index``."""
    return prompts.join(questions, "question_id").select(
        "question_id",
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(
            F.lit("rule").alias("style"), F.struct("db_id", "sql").alias("ground_truth")
        ).alias("reward_model"),
        F.struct("split", "index").alias("extra_info"),
    )


#: field names of the known question layouts: column path, or None for an empty text (fixed values)
SOURCE_FIELDS = {
    "evidence": {"question": "question", "sql": "SQL", "knowledge": "evidence"},
    "plain": {"question": "question", "sql": "query", "knowledge": None},
    "synonym": {"question": "SpiderSynQuestion", "sql": "query", "knowledge": None},
    "synthetic": {"question": "question", "sql": "sql", "knowledge": "external_knowledge"},
}


def unify_questions(
    dfs: Mapping[str, DataFrame], mapping: Mapping[str, Mapping[str, str | None]] = SOURCE_FIELDS
) -> DataFrame:
    """Question tables of several sources as one; field paths may be nested (``a.b``)."""
    parts = []
    for name, df in dfs.items():
        fields = mapping[name]
        cols = [
            (F.col(path) if path else F.lit("")).cast("string").alias(field)
            for field, path in fields.items()
        ]
        db = F.replace("db_id", F.lit("\n"), F.lit(""))
        parts.append(df.select(F.lit(name).alias("data_source"), db.alias("db_id"), *cols))
    return reduce(DataFrame.unionByName, parts)


# --- n-grams and vocabulary ---------------------------------------------------------------------

WORD = r"\w+|[^\w\s]"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"({WORD})"), F.lit(1))


def word_ngrams(df: DataFrame, key: str, col: str, max_n: int = 8) -> DataFrame:
    """``(key, rank, ngram)``: n-grams of length 1..max_n and the whole text, first seen first."""
    # tokens one blank apart; each match eats one blank and captures the n tokens after it
    spaced = F.concat(F.lit(" "), F.array_join(words_of(F.col(col)), " "))
    sized = df.select(key, F.col(col).alias("_text"), spaced.alias("_spaced"))
    grams = [
        F.regexp_extract_all("_spaced", F.lit(rf" (?=(\S+(?: \S+){{{n - 1}}}(?!\S)))"), F.lit(1))
        for n in range(1, max_n + 1)
    ]
    every = F.concat(*grams, F.array("_text"))
    return sized.select(key, F.posexplode(F.array_distinct(every)).alias("rank", "ngram"))


def identifier_vocabulary(names: DataFrame, name: str = "name", n: str = "n") -> DataFrame:
    """Words of snake_case, camelCase and dotted names: occurrences and number of names.

    ``names`` holds one row per distinct name with its number of uses.
    """
    spaced = F.regexp_replace(F.col(name), r"([a-z])([A-Z])", "$1 $2")
    words = F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[_.\s]+", " ")), " "), lambda w: w != "")
    each = names.select(F.col(name).alias("name"), F.col(n).alias("n"), F.explode(words).alias("word"))
    return (
        each.groupBy("word", "name")
        .agg(F.sum("n").alias("n"))
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_names"))
    )


def normalized_query(sql: Column) -> Column:
    """Lower case outside quotes, single blanks, no blank before a comma."""
    low = outside_quotes(sql, F.lower)
    return F.replace(F.trim(F.regexp_replace(low, r"\s+", " ")), F.lit(" , "), F.lit(", "))


def dedupe_queries(df: DataFrame, sql: str = "sql", ordinal: str = "ordinal") -> DataFrame:
    """First query of each normalised text, with the size of its group."""
    return (
        df.groupBy(normalized_query(F.col(sql)).alias("norm"))
        .agg(F.min(ordinal).alias(ordinal), F.min_by(sql, ordinal).alias(sql), F.count(F.lit(1)).alias("n_dups"))
    )


# --- value retrieval ----------------------------------------------------------------------------


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    token = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1)))
    return df.select(key, token.alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def _weighted(queries: DataFrame, values: DataFrame, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """(query_id, token, qtf) of the queries, and (token, value_id, weight) of the values' postings that they ask for."""
    unique = values.groupBy("text").agg(F.min("value_id").alias("value_id"))
    postings = _terms(unique, "value_id", "text")
    lengths = postings.groupBy("value_id").agg(F.sum("tf").alias("dl"))
    stats = lengths.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))).scalar()
    n, avgdl = stats.getField("n"), stats.getField("avgdl")
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl)
    wanted = _terms(queries, "query_id", "text").withColumnRenamed("tf", "qtf")
    # postings nobody asks for leave before the weights are joined on
    weights = (
        postings.join(wanted.select("token").distinct(), "token", "left_semi")
        .join(df, "token")
        .join(lengths, "value_id")
        .select("token", "value_id", (idf * F.col("tf") * (k1 + 1) / norm).alias("weight"))
    )
    return wanted, weights


#: What rounding may add to a sum of weights.
SLACK = 1e-6


def _essential(wanted: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Query tokens with ``df``, ``floor`` (a bound of the query's k-th score from below), ``rest`` and ``essential``.

    The ``k`` heaviest postings of every token give partial scores of some values; the k-th best of a query
    is its floor.  Tokens stand in order of their postings; those at the end whose greatest weights together
    (``rest``) stay below the floor cannot lift a value without any other token into the top ``k``.
    """
    by_weight = Window.partitionBy("token").orderBy(F.desc("weight"), "value_id")
    heavy = weights.withColumn("_r", F.row_number().over(by_weight)).where(F.col("_r") <= k)
    some = wanted.join(heavy, "token").groupBy("query_id", "value_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "value_id")
    floors = some.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("query_id", (F.col("score") - SLACK).alias("floor"))
    tokens = weights.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("most"))
    asked = wanted.join(tokens, "token").join(floors, "query_id", "left")
    onwards = Window.partitionBy("query_id").orderBy("df", "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    asked = asked.withColumn("_from", F.sum(F.col("qtf") * F.col("most")).over(onwards))
    # a query with fewer than k values has no floor and leaves nothing out
    asked = asked.withColumn("essential", F.coalesce(F.col("_from") >= F.col("floor"), F.lit(True)))
    whole = Window.partitionBy("query_id")
    rest = F.coalesce(F.sum(F.when(~F.col("essential"), F.col("qtf") * F.col("most"))).over(whole), F.lit(0.0))
    return asked.select("query_id", "token", "qtf", "df", "floor", "essential", rest.alias("rest"))


def retrieve_topk(
    queries: DataFrame, values: DataFrame, k: int = 10, k1: float = 0.9, b: float = 0.4
) -> DataFrame:
    """Top ``k`` values per query by BM25; values of equal text are kept once (smallest id).

    ``queries(query_id, text)``, ``values(value_id, text)``.  Postings carry their finished term
    weight.  Only a query's essential tokens (``_essential``) are joined with all their postings; the others,
    which stand in many values, are looked up for the pairs that can still reach the floor.  Scores are
    rounded before ranking, so equal scores tie whatever the order of summation.
    """
    wanted, weights = _weighted(queries, values, k1, b)
    # read four times by its token: one exchange serves them
    weights = weights.repartition("token")
    asked = _essential(wanted, weights, k)
    met = asked.where("essential").join(weights, "token")
    partial = met.groupBy("query_id", "value_id").agg(
        F.sum(F.col("qtf") * F.col("weight")).alias("part"), F.first("rest").alias("rest"), F.first("floor").alias("floor")
    )
    reach = partial.where(F.col("floor").isNull() | (F.col("part") + F.col("rest") >= F.col("floor")))
    others = asked.where("NOT essential").select("query_id", "token", "qtf")
    # one row per pair and token left: a key of both, so no token is hot
    added = reach.where("rest > 0").select("query_id", "value_id").join(others, "query_id").join(weights, ["token", "value_id"])
    added = added.groupBy("query_id", "value_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("more"))
    scored = reach.join(added, ["query_id", "value_id"], "left").select(
        "query_id", "value_id", F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 9).alias("score")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "value_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieval_rows(queries: DataFrame, values: DataFrame, k: int = 10, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """Rows out of the token join of ``retrieve_topk`` beside those of a join on all tokens: (all_rows, joined_rows)."""
    wanted, weights = _weighted(queries, values, k1, b)
    asked = _essential(wanted, weights.repartition("token"), k)
    return asked.agg(F.sum("df").alias("all_rows"), F.sum(F.when(F.col("essential"), F.col("df"))).alias("joined_rows"))


#: gram lengths used to index text for values with a core
CORE_GRAMS = (1, 2, 4, 8, 16)


def _gram_size(room: Column) -> Column:
    """The largest gram length that fits."""
    size = F.lit(None).cast("int")
    for g in CORE_GRAMS:
        size = F.when(room >= g, g).otherwise(size)
    return size


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of length ``size``: a zero-width match per position, linear in the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


#: Bits of the hash by which a table of flags tells whether any value may have a gram.
FLAG_BITS = 22
#: Hits handed on at once by a task.
HITS_AT_ONCE = 100_000
#: Characters of texts that are rolled through together.
CHARS_AT_ONCE = 200_000


def _rolled(text: str, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes from one to ``most`` that fit, each with a hash of the gram at every place."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    h = codes
    for size in range(1, min(most, len(codes)) + 1):
        if size > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + codes[size - 1 :]
        yield size, h


def _flag(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FLAG_BITS)


@F.pandas_udf(T.IntegerType())
def _gram_flag(grams: pd.Series) -> pd.Series:
    last = (list(_rolled(g, len(g)))[-1][1] for g in grams)
    return pd.Series([int(_flag(h)[0]) for h in last], dtype="int32")


def _gram_hits(asked: DataFrame, keys: DataFrame, beyond: int = 0) -> DataFrame:
    """``(question_id, asked_hash, gram, at, near)``: grams of ``keys`` in each ``low_q``, at their first places (from 1).

    Texts are rolled through together, once per gram size.  Flags of the hashes of all keys, 2 ** FLAG_BITS at most, drop nearly
    all other grams in place; the join by the gram itself decides.  With ``beyond``, ``near`` is ``question`` from the
    character before the gram to as many after it.
    """
    known = keys.select(F.length("gram").alias("size"), _gram_flag("gram").alias("flag")).distinct().toArrow()
    sizes = frozenset(known["size"].to_pylist())
    wanted = np.zeros(1 << FLAG_BITS, bool)
    wanted[known["flag"].to_numpy()] = True
    packed, most = np.packbits(wanted), max(sizes, default=0)

    def hits_of(part: pa.RecordBatch, ends: np.ndarray, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The hits in texts that end at ``ends`` when written one after another."""
        text, starts = "".join(part["low_q"].to_pylist()), np.concatenate([[0], ends[:-1]])
        shown = part["question"].to_pylist() if beyond else None
        for size, h in _rolled(text, most):
            if size not in sizes:
                continue
            places = np.flatnonzero(flags[_flag(h)])
            rows = np.searchsorted(starts, places, side="right") - 1
            inside = places + size <= ends[rows]  # not from one text into the next
            places, rows = places[inside], rows[inside]
            order = np.lexsort((h[places], rows))
            places, rows = places[order], rows[order]
            first = np.ones(len(places), bool)
            first[1:] = (rows[1:] != rows[:-1]) | (h[places[1:]] != h[places[:-1]])
            places, rows = places[first], rows[first]
            at = places - starts[rows]
            grams = [text[i : i + size] for i in places.tolist()]
            near = [shown[r][max(i - 1, 0) : i + size + beyond] for r, i in zip(rows.tolist(), at.tolist())] if beyond else [None] * len(rows)
            own = (pc.take(part[c], pa.array(rows)).cast(t) for c, t in zip(names, kinds[:2]))
            yield pa.RecordBatch.from_arrays([*own, pa.array(grams, pa.string()), pa.array(at + 1, pa.int32()), pa.array(near, pa.string())], names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(packed).astype(bool)
        held, n_held = [], 0
        for b in batches:
            if b["question_id"].null_count or b["low_q"].null_count:
                b = b.filter(pc.and_(pc.is_valid(b["question_id"]), pc.is_valid(b["low_q"])))
            ends, at = np.cumsum(pc.utf8_length(b["low_q"]).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + CHARS_AT_ONCE, side="right")))
                for hits in hits_of(b.slice(at, to - at), ends[at:to] - before, flags):
                    if hits.num_rows:
                        held.append(hits)
                        n_held += hits.num_rows
                    if n_held >= HITS_AT_ONCE:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, n_held = [], 0
                at = to
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    names = ["question_id", "asked_hash", "gram", "at", "near"]
    key_type = asked.schema["question_id"].dataType
    kinds = [to_arrow_type(key_type), pa.int64(), pa.string(), pa.int32(), pa.string()]
    read = asked.select("question_id", F.xxhash64("low_q").alias("asked_hash"), "low_q", *["question"] * bool(beyond))
    hits = read.mapInArrow(found, f"question_id {key_type.simpleString()}, asked_hash long, gram string, at int, near string")
    return hits.join(keys, "gram")


def _block_pairs(asked: DataFrame, values: DataFrame) -> DataFrame:
    """Candidate (question_id, value_id) pairs by a shared gram of the value's ``core``.

    A match must contain the whole core, hence each of its grams; one of them (the smallest by
    hash) is the value's only join key.  The texts are read once.
    """
    grams = F.lit(None).cast("array<string>")
    for g in CORE_GRAMS:
        grams = F.when(F.col("q") == g, _grams(F.col("core"), g)).otherwise(grams)
    listed = pinned(values.where("q IS NOT NULL"), _all=grams)
    least = F.array_min(F.transform("_all", lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    keys = listed.select("value_id", least["g"].alias("gram"))
    return _gram_hits(asked, keys).select("question_id", "value_id").distinct()


def _round_core(df: DataFrame) -> DataFrame:
    """``df`` with ``_near``: what of ``low_q`` may hold a shared substring of ``need`` characters of ``low``.

    Such a substring contains the whole core, so the text is cut at the occurrences of the core from left to right;
    one that overlaps an earlier one ends at most the length of the core after it.  Of what lies between, only the ends
    within reach are kept, with a character between them that the value does not have.
    """
    reach = F.length("low") - F.col("need")
    after = F.length("core") + reach
    quoted = F.concat(F.lit(r"\Q"), F.replace("core", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    absent = lambda c: F.when(~F.contains("low", F.lit(c)), F.lit(c))
    # the value itself is all there is to find where it stands as a whole
    parts = F.when(~F.contains("low_q", F.col("low")), F.split("low_q", quoted, -1))
    cut = pinned(df, _parts=parts, _gap=F.coalesce(*[absent(chr(c)) for c in (0, 1, 2)]))

    def ends(part: Column, i: Column) -> Column:
        last = i == F.size("_parts") - 1
        between = F.concat(F.left(part, after), F.col("_gap"), F.right(part, reach))
        kept = F.when(F.col("_gap").isNull(), part).when(i == 0, F.right(part, reach)).when(last, F.left(part, after))
        kept = kept.when(F.length(part) > after + reach, between).otherwise(part)
        return F.concat(kept, F.when(last, "").otherwise(F.col("core")))

    near = F.when(F.col("_parts").isNull(), F.col("low")).otherwise(F.array_join(F.transform("_parts", ends), ""))
    return pinned(cut, _near=near).drop("_parts", "_gap")


def _longest_shared(value: Column, text: Column, least: Column) -> Column:
    """Length of the longest substring of ``value`` in ``text``, 0 if shorter than ``least``."""
    n = F.length(value)

    def occurs(size: Column) -> Column:
        starts = F.sequence(F.lit(1), n - size + 1)
        return F.exists(starts, lambda s: F.contains(text, F.substring(value, s, size)))

    return F.aggregate(
        F.sequence(n, least, F.lit(-1)),
        F.lit(0),
        lambda best, size: F.when(best > 0, best).when(occurs(size), size).otherwise(0),
    )


def match_values(
    questions: DataFrame, values: DataFrame, min_share: float = 0.85, k: int = 20
) -> DataFrame:
    """Stored values of which more than ``min_share`` occurs in the question as one substring.

    ``questions(question_id, question)``, ``values(value_id, column, value)``.  Top ``k`` per
    question by share, length and id, all descending; exact for shares of at least one half.
    """
    if not 0.5 <= min_share < 1:
        raise ValueError("min_share must lie in [0.5, 1)")
    n = F.length("value")
    low = values.where(F.col("value") != "").withColumn("low", F.lower("value"))
    # shortest length above the share; every such substring covers the middle of the value
    need = (F.floor(F.lit(min_share) * n) + 1).cast("int")
    cored = (
        low.withColumn("need", need)
        .withColumn("core", F.substring("low", n - F.col("need") + 1, 2 * F.col("need") - n))
        .withColumn("q", _gram_size(F.length("core")))
    )
    # lower case once, below the joins, so that the search loops do not repeat it; one shuffle of
    # the texts serves the gram index and the final check
    asked = dealt(questions, "question_id").select(
        "question_id", F.lower("question").alias("low_q")
    )
    pairs = _block_pairs(asked, cored)
    scored = (
        pairs.join(cored.select("value_id", "column", "value", "low", "need", "core"), "value_id")
        .join(asked, "question_id")
        .where(F.contains("low_q", F.col("core")))
    )
    size = _longest_shared(F.col("low"), F.col("_near"), F.col("need"))
    scored = pinned(_round_core(scored), _size=size).where("_size > 0").withColumn(
        "score", F.col("_size") / F.length("low")
    )
    w = Window.partitionBy("question_id").orderBy(
        F.desc("score"), F.desc(F.length("value")), F.desc("value_id")
    )
    return (
        scored.select("question_id", "column", "value_id", "value", "score")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def matches_by_column(matches: DataFrame) -> DataFrame:
    """At most ``k`` matched values of a question, listed by column in rank order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return matches.groupBy("question_id", "column").agg(
        F.transform(listed, lambda r: r["value"]).alias("values")
    )


# fixed values: words that never count as a match, and characters that bound a span
STOP_WORDS = frozenset("""
a about above after again against ain all am an and any are aren aren't as at be because been before being below
between both but by can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few
for from further had hadn hadn't has hasn hasn't have haven haven't having he her here hers herself him himself his
how i if in into is isn isn't it it's its itself just ll m ma me mightn mightn't more most mustn mustn't my myself
needn needn't nor not now o of off on once only or other our ours ourselves out over own re s same shan shan't she
she's should should've shouldn shouldn't so some such t than that that'll the their theirs them themselves then there
these they this those through to too under until up ve very was wasn wasn't we were weren weren't what when where
which while who whom why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours yourself
yourselves
""".split())
COMMON_WORDS = frozenset({"no", "yes", "many"})
SEPARATORS = "'\"()`,.?! "


def indel_similarity(a: str, b: str) -> float:
    """1 - insert/delete distance over total length, from a bit-parallel common subsequence."""
    if not a or not b:
        return float(a == b)
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


_BOUND = "['\"()`,.?! ]"
#: Characters a span may reach beyond its block.
BEYOND = 3


def word_span(text: Column, at: Column, size: Column) -> Column:
    """Word-bounded span around the block of ``size`` characters at ``at`` (from 1), else NULL.

    The block begins the text, begins with a separator, or follows one; the span ends before the
    first separator from the block's last character on, or with the text, at most BEYOND characters
    after the block.  Separators around it are cut off.
    """
    first, before = F.substr(text, at, F.lit(1)), F.substr(text, F.greatest(at - 1, F.lit(1)), F.lit(1))
    begins = (at == 1) | first.rlike(_BOUND) | before.rlike(_BOUND)
    tail = F.substr(text, at + size - 1, F.lit(BEYOND + 1))
    stop = F.regexp_instr(tail, F.lit(_BOUND))
    more = F.when(stop > 0, stop - 1).when(F.length(tail) <= BEYOND, F.length(tail))
    return F.when(begins, F.btrim(F.substr(text, at, size - 1 + more), F.lit(SEPARATORS)))


def link_allowed(value: Column, block: Column, span: Column) -> Column:
    """Whether a value may link through this block and span at all."""
    low, part, src = (F.lower(F.trim(c)) for c in (value, block, span))
    number = F.replace(part, F.lit(","), F.lit("")).try_cast("double").isNotNull()
    stops = reduce(Column.__or__, [c.isin(*sorted(STOP_WORDS)) for c in (low, part, src)])
    return span.isNotNull() & (F.length(span) >= 2) & (part != "") & ~number & (part != "id") & ~stops


def link_score(value: Column, block: Column, span: Column) -> Column:
    """Similarity of value and span; 0 if their first letters differ, or a near match is not enough.

    Common words and values in capitals link by equality only.
    """
    low, part, src = (F.lower(F.trim(c)) for c in (value, block, span))
    head = [F.substr(F.ltrim(c, F.lit(SEPARATORS)), F.lit(1), F.lit(1)) for c in (low, src)]
    score = F.when(head[0] == head[1], _similarity(low, src)).otherwise(0.0)
    common = reduce(Column.__or__, [c.isin(*sorted(COMMON_WORDS)) for c in (low, part, src)])
    capitals = (value == F.upper(value)) & (value != F.lower(value))
    return F.when((score < 1) & (common | capitals), 0.0).otherwise(score)


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_similarity(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def fuzzy_link(
    questions: DataFrame, values: DataFrame, theta: float = 0.85, k: int = 2
) -> DataFrame:
    """Values whose longest common block with the question grows into a similar word span.

    A span is at most three characters longer than its block, so a similarity of ``theta`` needs a
    block of about ``theta / (2 - theta)`` of the value; that bound gives the blocking gram.  Above
    0.8 a value of two or more characters cannot reach ``theta`` through a single shared one, so no
    hit is lost; lower ``theta`` are refused.  Only the similarity of value and span is computed in
    an Arrow function.
    """
    if theta <= 0.8:
        raise ValueError("theta must be above 0.8")
    n = F.length("low")
    share = theta / (2 - theta)
    need = F.greatest(
        F.lit(1), F.ceil(share * n) - 3, F.least(F.lit(2), n)
    ).cast("int")
    trimmed = values.withColumn("low", F.lower(F.trim("value"))).where("low != ''")
    sized = trimmed.withColumn("need", need)
    # a block of at least `need` covers the middle when 2 * need > n
    mid = 2 * F.col("need") - n
    has_core = mid >= 4
    cored = sized.withColumn("core", F.substring("low", n - F.col("need") + 1, mid)).withColumn("q", _gram_size(mid))
    spread = questions.repartition("question_id")
    asked = spread.select("question_id", F.trim("question").alias("question")).withColumn(
        "low_q", F.lower("question")
    )
    pairs = _block_pairs(asked, cored.where(has_core))
    found = (
        pairs.join(cored.where(has_core).select("value_id", "column", "value", "low", "need", "core"), "value_id")
        .join(asked, "question_id")
        .where(F.contains("low_q", F.col("core")))
    )
    found = pinned(_round_core(found), size=_longest_shared(F.col("low"), F.col("_near"), F.col("need"))).where("size > 0")
    # earliest block in the question, then in the value
    spots = F.transform(
        F.sequence(F.lit(1), n - F.col("size") + 1),
        lambda s: F.struct(
            F.position(F.substring("low", s, F.col("size")), F.col("low_q")).alias("at"), s.alias("s")
        ),
    )
    best = F.array_min(F.filter(spots, lambda p: p["at"] > 0))
    placed = pinned(found, best=best).select("question_id", "value_id", "column", "value", "size", "best.at", "best.s", F.col("question").alias("near"))
    # values without a core may share any of their substrings: all are looked up, so a hit is the block itself
    short = cored.where(~has_core)
    sizes = F.sequence("need", n)
    parts = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.struct(F.substring("low", s, k).alias("gram"), s.alias("s")))))
    keys = short.select("value_id", "column", "value", F.inline(parts))
    hits = _gram_hits(asked, keys, beyond=BEYOND)
    first = F.max(F.struct(F.length("gram").alias("size"), (-F.col("at")).alias("at"), (-F.col("s")).alias("s"), "near"))
    blocks = hits.groupBy("question_id", "asked_hash", "value_id", "column", "value").agg(first.alias("b"))
    at = F.when(F.col("b.at") == -1, 1).otherwise(2)
    short_placed = blocks.select("question_id", "value_id", "column", "value", "b.size", at.alias("at"), (-F.col("b.s")).alias("s"), "b.near")
    placed = placed.unionByName(short_placed)
    placed = placed.withColumn("block", F.substring(F.trim("value"), F.col("s"), F.col("size")))
    placed = pinned(placed, span=word_span(F.col("near"), F.col("at"), F.col("size")))
    allowed = placed.where(link_allowed(F.col("value"), F.col("block"), F.col("span")))
    # similar texts begin alike and have similar lengths; the others need no comparison
    low, src = F.lower(F.trim("value")), F.lower(F.trim("span"))
    bare = [F.substr(F.ltrim(c, F.lit(SEPARATORS)), F.lit(1), F.lit(1)) for c in (low, src)]
    close = 2 * F.least(F.length(low), F.length(src)) >= (theta - 1e-9) * (F.length(low) + F.length(src))
    allowed = allowed.where((bare[0] == bare[1]) & close)
    scored = allowed.withColumn("score", link_score(F.col("value"), F.col("block"), F.col("span"))).where(F.col("score") >= theta)
    # name columns take exact matches only; one value per block text
    scored = scored.where(~(F.contains("column", F.lit("name")) & (F.col("score") < 1)))
    one = Window.partitionBy("question_id", "column", "block").orderBy(F.desc("score"), "value_id")
    top = Window.partitionBy("question_id", "column").orderBy(F.desc("score"), F.desc("size"), "value_id")
    return (
        scored.withColumn("_one", F.row_number().over(one)).where("_one = 1")
        .withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        .select("question_id", "column", "value_id", "value", "score", "rank")
    )


def lookup_values(tokens: DataFrame, cat_values: DataFrame, mode: str = "prefix") -> DataFrame:
    """Columns holding a value that starts with (or equals) a token, with the number of values.

    Values are trimmed and compared without case.  Prefixes of the lengths that tokens have are
    counted per column before the join, so it is an equality join with one row per (column, prefix).
    Long values are shuffled as a digest and a beginning as long as the longest token.
    """
    low = F.lower(F.trim("value"))
    values = cat_values.select("column", low.alias("low")).where("low != ''")
    wanted = tokens.select(F.lower("token").alias("token")).where("token != ''").distinct()
    size = F.length("token")
    asked = wanted.agg(F.struct(F.collect_set(size).alias("sizes"), F.max(size).alias("longest"))).scalar()
    if mode == "prefix":
        head = F.substring("low", F.lit(1), asked.getField("longest"))
        distinct = values.select("column", head.alias("head"), F.sha2("low", 256).alias("digest")).distinct()
        each = distinct.select("column", "head", F.explode(asked.getField("sizes")).alias("i")).where(F.length("head") >= F.col("i"))
        keyed = each.select("column", F.substring("head", F.lit(1), F.col("i")).alias("token"))
    else:
        keyed = values.where(F.length("low") <= asked.getField("longest")).distinct().withColumnRenamed("low", "token")
    counted = keyed.groupBy("column", "token").agg(F.count(F.lit(1)).alias("n_values"))
    return counted.join(wanted, "token").select("token", "column", "n_values")


# --- token sequences ----------------------------------------------------------------------------


def _filled(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))


def _cut(ids: Column, length: int, truncation: str) -> Column:
    """At most ``length`` tokens: the last, the first, or an error."""
    n = F.size(ids)
    if truncation == "left":
        short = F.slice(ids, F.greatest(n - length, F.lit(0)) + 1, F.lit(length))
    elif truncation == "right":
        short = F.slice(ids, F.lit(1), F.lit(length))
    elif truncation == "error":
        short = F.raise_error(F.lit("a sequence is longer than the limit")).cast("array<int>")
    else:
        raise ValueError(f"unknown truncation {truncation!r}")
    return F.when(n > length, short).otherwise(ids)


def _ones(mask: str) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, m: a + m)


def with_position_ids(df: DataFrame, mask: str = "mask", name: str = "position_ids") -> DataFrame:
    """Positions ``max(cumsum(mask) - 1, 0)`` of a mask that is one run of ones."""
    first = F.greatest(F.array_position(mask, 1) - 1, F.lit(0)).cast("int")
    at = F.transform(
        mask,
        lambda m, i: F.greatest(F.least(i - F.col("_first"), F.col("_valid") - 1), F.lit(0)),
    )
    return pinned(df, _valid=_ones(mask), _first=first).withColumn(name, at).drop("_valid", "_first")


def training_sequences(
    df: DataFrame,
    length: int,
    side: str = "left",
    truncation: str = "error",
    pad_id: int = 0,
    eos_id: int | None = None,
) -> DataFrame:
    """``ids`` padded or cut to ``length`` with ``mask``, ``position_ids`` and optional ``eos_mask``.

    ``n_tokens`` keeps the original length for the report.
    """
    raw = pinned(df.withColumnRenamed("ids", "_raw"), n_tokens=F.size("_raw"))
    cut = pinned(raw, _kept=_cut(F.col("_raw"), length, truncation)).drop("_raw")
    room = F.lit(length) - F.size("_kept")
    ones, pads, fill = _filled(1, F.size("_kept")), _filled(0, room), _filled(pad_id, room)
    if side == "left":
        mask, ids = F.concat(pads, ones), F.concat(fill, "_kept")
    else:
        mask, ids = F.concat(ones, pads), F.concat("_kept", fill)
    out = with_position_ids(pinned(cut, mask=mask, ids=ids).drop("_kept"))
    if eos_id is not None:
        out = pinned(out, _end=F.array_position("ids", eos_id))
        out = out.withColumn(
            "eos_mask",
            F.transform("ids", lambda _, i: ((F.col("_end") == 0) | (i < F.col("_end"))).cast("int")),
        ).drop("_end")
    return out


def remove_padding(df: DataFrame, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """Undo left padding."""
    valid = pinned(df, _valid=_ones(mask))
    start = F.size(ids) - F.col("_valid") + 1
    return valid.withColumn(ids, F.slice(ids, start, F.col("_valid"))).drop("_valid")


def sequence_report(sequences: DataFrame, length: int, source: str = "source") -> DataFrame:
    """Truncated and padded sequences, and padding tokens, by source."""
    n = F.col("n_tokens")
    return sequences.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(n > length).alias("truncated"),
        F.count_if(n < length).alias("padded"),
        F.sum(F.greatest(F.lit(length) - n, F.lit(0))).alias("pad_tokens"),
    )


def supervised_records(df: DataFrame, length: int, truncation: str = "error", pad_id: int = 0) -> DataFrame:
    """Prompt ++ response, right-padded, with a loss mask for training.

    The loss hides the prompt but for its last token, and the final response token.
    """
    p, r = F.size("prompt_ids"), F.size("response_ids")
    joined = df.withColumns({"_p": p, "_r": r, "ids": F.concat("prompt_ids", "response_ids")})
    seq = training_sequences(joined, length, "right", truncation, pad_id)
    hidden = F.when(F.col("_p") > 1, F.least("_p", F.lit(length)) - 1).otherwise(0)
    last = F.least(F.col("_p") + F.col("_r"), F.lit(length)) - 1
    loss = F.transform("mask", lambda m, i: F.when((i < hidden) | (i == last), 0).otherwise(m))
    return seq.withColumn("loss_mask", loss).drop("_p", "_r")


def trainable_tokens(records: DataFrame, source: str = "source") -> DataFrame:
    total = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, m: a + m)
    return records.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("trainable"))


def preference_pairs(df: DataFrame, length: int, eos_id: int | None = None) -> DataFrame:
    """``pair``: chosen and rejected sequences with their masks, padded with zeros or cut to length."""

    def side(response: str) -> Column:
        ids = F.concat("prompt_ids", response)
        if eos_id is not None:
            ids = F.concat(ids, F.array(F.lit(eos_id)))
        kept = F.slice(ids, F.lit(1), F.lit(length))
        room = F.lit(length) - F.size(kept)
        return F.struct(
            F.concat(kept, _filled(0, room)).alias("ids"),
            F.concat(_filled(1, F.size(kept)), _filled(0, room)).alias("mask"),
        )

    return df.withColumn("pair", F.array(side("chosen_ids"), side("rejected_ids")))
