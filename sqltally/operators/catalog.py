"""Schema catalog and column-value profiling.

Catalog tables are long: ``cat_tables(db_id, table_id, table_name, display)``,
``cat_columns(db_id, column_id, table_id, table_name, column_name, display, declared_type)`` and
``cat_keys(db_id, kind, column_id, ref_column_id)`` with ``kind`` in {pk, fk}.  They are metadata:
their size is the number of columns, not of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.functions.lineage import cut_lineage
from sqltally.functions.once import pinned
from sqltally.functions.schema_text import schema_texts
from sqltally.functions.skew import dealt

#: Spark type -> declared SQL type name
DECLARED = {
    "string": "varchar", "int": "integer", "bigint": "bigint", "smallint": "smallint",
    "tinyint": "tinyint", "double": "double", "float": "float", "boolean": "boolean",
    "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date",
}

# fixed values: words that decide the type group, tested in this order
TYPE_RULES = (
    ("text", ("char", "text", "var")),
    ("number", ("int", "numeric", "decimal", "number", "id", "real", "double", "float")),
    ("time", ("date", "time", "year")),
    ("boolean", ("boolean",)),
)


#: Values longer than this are counted by digest.
DIGEST_OVER = 64
#: Rows of a batch that are looked through at once for the lowest values, or more as long as they are no more than so many bytes.
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 1 << 20


def build_catalog(
    spark: SparkSession, tables: Mapping[str, DataFrame], db_id: str = "db"
) -> tuple[DataFrame, DataFrame]:
    """Table and column lists with display names; column 0 is ``*``."""
    table_rows = [(db_id, i, name) for i, name in enumerate(tables)]
    column_rows = [(db_id, 0, -1, None, "*", "text")]
    for i, (name, df) in enumerate(tables.items()):
        for f in df.schema.fields:
            declared = DECLARED.get(f.dataType.simpleString(), f.dataType.simpleString())
            column_rows.append((db_id, len(column_rows), i, name, f.name, declared))

    def display(col: str) -> Column:
        return F.replace(F.lower(col), F.lit("_"), F.lit(" "))

    cat_tables = spark.createDataFrame(table_rows, "db_id string, table_id int, table_name string")
    cat_columns = spark.createDataFrame(
        column_rows,
        "db_id string, column_id int, table_id int, table_name string, column_name string, declared_type string",
    )
    return (
        cat_tables.withColumn("display", display("table_name")),
        cat_columns.withColumn("display", display("column_name")),
    )


def normalize_types(cat_columns: DataFrame) -> DataFrame:
    """``kind``: text, number, time, boolean or others, by the first rule that fits."""
    declared = F.lower("declared_type")
    kind = F.when(declared == "", "text")
    for name, words in TYPE_RULES:
        hit = reduce(Column.__or__, [F.contains(declared, F.lit(w)) for w in words])
        kind = kind.when(hit, name)
    return cat_columns.withColumn("kind", kind.otherwise("others"))


def _whole(df: DataFrame) -> set[str]:
    """Columns of whole numbers, whose text is the same in Spark and Arrow and different for different numbers."""
    return {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))}


def _atomic(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def column_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Non-null cells per column: one pass and one output row per table, then unpivoted."""
    parts = []
    for name, df in tables.items():
        wide = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns])
        parts.append(
            wide.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "n_values").select(
                F.lit(name).alias("table_name"), "column_name", "n_values"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def long_values(tables: Mapping[str, DataFrame], columns: Sequence[str] | None) -> DataFrame:
    """``(column_name, value, table_name)``: every plain cell as text, one scan per table."""
    parts = []
    for name, df in tables.items():
        cols = [c for c in _atomic(df) if columns is None or c in columns]
        if cols:
            long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot(
                [], [F.col(f"`{c}`") for c in cols], "column_name", "value"
            )
            parts.append(long.withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def distinct_values(
    tables: Mapping[str, DataFrame], columns: Sequence[str] | None = None, digests: bool = False
) -> DataFrame:
    """``(table_name, column_name, value, n)`` over all plain columns, values as text.

    One scan per table and kind; equal values are combined before the shuffle, whole numbers as numbers with the
    place of their column in a list.  With ``digests`` a mark and the SHA-256 stand for a value of more than
    DIGEST_OVER characters that is no number, for uses that only count or tell kinds apart.
    """
    read = {name: [c for c in _atomic(df) if columns is None or c in columns] for name, df in tables.items()}
    others = {name: df.drop(*_whole(df)) for name, df in tables.items()}
    parts = []
    if any(_atomic(df) and (columns is None or set(_atomic(df)) & set(columns)) for df in others.values()):
        long = long_values(others, columns)
        if digests:
            whole = (F.length("value") <= DIGEST_OVER) | F.col("value").rlike(NUMBER)
            short = F.when(whole, F.col("value")).otherwise(F.concat(F.lit("~"), F.sha2("value", 256)))
            long = long.withColumn("value", short)
        parts.append(long.groupBy("table_name", "column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    numbers = [(name, c) for name, cols in read.items() for c in cols if c in _whole(tables[name])]
    if numbers:
        cells = []
        for name, df in tables.items():
            own = [(F.lit(i + 1), F.col(f"`{c}`").cast("long")) for i, (t, c) in enumerate(numbers) if t == name]
            if own:
                cells.append(df.select(F.stack(F.lit(len(own)), *[x for pair in own for x in pair]).alias("at", "value")))
        counted = reduce(DataFrame.unionByName, cells).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
        named = (F.element_at(F.array(*[F.lit(x) for x in names]), F.col("at")) for names in zip(*numbers))
        parts.append(counted.select(*[x.alias(c) for x, c in zip(named, ("table_name", "column_name"))], F.col("value").cast("string").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def lowest_values(tables: Mapping[str, DataFrame], n: int, blanks: bool = False) -> DataFrame:
    """Distinct ``(table_name, column_name, value)`` with at least the ``n`` smallest values of every column.

    Each table is read once: a task keeps the ``n`` smallest different values of every column while its Arrow
    batches go by, so ``n`` values per column and task are all that is shuffled.  NULL and blank values are
    left out unless ``blanks``.
    """
    parts = []
    for name, df in tables.items():
        cols = _atomic(df)
        if cols:
            # whole numbers become text in Arrow
            text = df.select(*[F.col(f"`{c}`") if c in _whole(df) else F.col(f"`{c}`").cast("string").alias(c) for c in cols])
            found = text.mapInArrow(_smallest(cols, n, blanks), "column_name string, value string")
            parts.append(found.select(F.lit(name).alias("table_name"), "column_name", "value"))
    return reduce(DataFrame.unionByName, parts).distinct()


def _smallest(cols: Sequence[str], n: int, blanks: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {c: pa.array([], pa.string()) for c in cols}
        empty = set()
        # a part of a batch at a time, so that no copies of a whole column of long texts are made
        steps = ((b, max(ROWS_AT_ONCE, BYTES_AT_ONCE * b.num_rows // (b.nbytes + 1))) for b in batches)
        for part in (b.slice(at, step) for b, step in steps for at in range(0, b.num_rows, step)):
            for c, column in zip(cols, part.columns):
                if column.null_count:
                    empty.add(c)
                values = column.drop_null().cast(pa.string())
                if not blanks:
                    values = values.filter(pc.not_equal(values, ""))
                if len(least[c]) >= n:  # bytes are compared, as Spark does
                    values = values.filter(pc.less(values, least[c][-1]))
                if len(values):
                    new = pc.unique(pa.concat_arrays([least[c], values]))
                    least[c] = new.take(pc.array_sort_indices(new)[:n])
        names = [c for c in cols for _ in range(len(least[c]))] + (sorted(empty) if blanks else [])
        cells = pa.concat_arrays([*least.values(), pa.nulls(len(empty) if blanks else 0, pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), cells], ["column_name", "value"])

    return kept


def _ranked(values: DataFrame) -> DataFrame:
    # only the first ranks are kept, so each task passes on a few rows per column
    w = Window.partitionBy("table_name", "column_name").orderBy(F.asc_nulls_first("value"))
    return values.withColumn("rank", F.row_number().over(w))


def sample_values(values: DataFrame, n: int = 6, max_len: int = 40) -> DataFrame:
    """First ``n`` distinct non-blank values per column, cut to ``max_len``; names lower-cased."""
    kept = values.where(F.col("value").isNotNull() & (F.col("value") != ""))
    return (
        _ranked(kept)
        .where(F.col("rank") <= n)
        .select(
            F.lower("table_name").alias("table_name"),
            F.lower("column_name").alias("column_name"),
            "rank",
            F.substring("value", 1, max_len).alias("value"),
        )
    )


def first_values(values: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` ordered distinct values (NULL first), blanks dropped after the cut."""
    return (
        _ranked(values)
        .where(F.col("rank") <= n)
        .where(F.col("value").isNull() | (F.col("value") != ""))
        .select("table_name", "column_name", "rank", "value")
    )


def picklist(df: DataFrame, col: str) -> DataFrame:
    """All distinct values of a column."""
    return df.select(F.col(col).alias("value")).distinct()


def duplicate_columns(values: DataFrame) -> DataFrame:
    """``has_dups`` where the number of distinct non-null values is not the number of cells."""
    cells = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
    return values.groupBy("table_name", "column_name").agg(
        F.count("value").alias("n_distinct"), cells.alias("n_values")
    ).withColumn("has_dups", F.col("n_distinct") != F.col("n_values"))


def column_contained(
    a: DataFrame, col_a: str, b: DataFrame, col_b: str, max_miss: int = 1
) -> DataFrame:
    """The smaller distinct set lies in the larger but for ``max_miss`` values; empty sides pass."""
    sides = (
        a.select(F.col(col_a).cast("string").alias("value"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
        .unionByName(
            b.select(F.col(col_b).cast("string").alias("value"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
        )
        .groupBy("value")
        .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    )
    # sizes count NULL as a value, a missing NULL is never a miss
    sized = sides.agg(
        F.sum("in_a").alias("n_a"),
        F.sum("in_b").alias("n_b"),
        F.count_if((F.col("in_b") == 0) & F.col("value").isNotNull()).alias("only_a"),
        F.count_if((F.col("in_a") == 0) & F.col("value").isNotNull()).alias("only_b"),
    ).na.fill(0)
    misses = F.when(F.col("n_a") > F.col("n_b"), F.col("only_b")).otherwise(F.col("only_a"))
    empty = (F.col("n_a") == 0) | (F.col("n_b") == 0)
    return sized.select("n_a", "n_b", misses.alias("misses")).withColumn(
        "contained", empty | (F.col("misses") <= max_miss)
    )


def columns_contained(values: DataFrame, max_miss: int = 1) -> DataFrame:
    """``column_contained`` for every pair of columns of ``values`` (as from ``distinct_values``) at once.

    ``(a, b, n_a, n_b, misses, contained)`` with columns as ``table.column`` and ``a`` before ``b``.  Every value is
    mapped to the set of columns that hold it; different sets are few, and pairs are counted from those.
    """
    held = values.select(F.concat_ws(".", "table_name", "column_name").alias("c"), "value")
    sets = held.where("value IS NOT NULL").groupBy("value").agg(F.array_sort(F.collect_set("c")).alias("cols"))
    counted = sets.groupBy("cols").agg(F.count(F.lit(1)).alias("n"))
    both = counted.select("n", F.explode("cols").alias("a"), "cols").select("n", "a", F.explode("cols").alias("b"))
    common = both.where("a < b").groupBy("a", "b").agg(F.sum("n").alias("common"))
    # one row per column of the catalog; NULL counts as a value
    sizes = held.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"))
    left, right = (sizes.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("known").alias(f"known_{x}")) for x in "ab")
    pairs = left.join(right, F.col("a") < F.col("b")).join(common, ["a", "b"], "left").na.fill(0, ["common"])
    only = F.when(F.col("n_a") > F.col("n_b"), F.col("known_b")).otherwise(F.col("known_a")) - F.col("common")
    return pairs.select("a", "b", "n_a", "n_b", only.alias("misses"), (only <= max_miss).alias("contained"))


# --- content types ------------------------------------------------------------------------------

# fixed values: texts that stand for a missing value, and two-value domains read as boolean
MISSING = ("", " ", "  ", "None", "NONE", "none", "nil", "NULL", "Null", "null", "inf", "-inf", "+inf")
BOOLEAN_PAIRS = (
    ("0", "1"), ("f", "t"), ("false", "true"), ("n", "y"), ("no", "yes"), ("f", "m"),
    ("female", "male"), ("f", "s"), ("fail", "success"), ("b", "g"), ("bad", "good"),
    ("cancelled", "completed"), ("l", "r"), ("left", "right"),
)
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: A year from 1500 to 2099.
YEAR = r"^(1[5-9]\d{2}|20\d{2})$"
#: What stands for a part of a date, and the forms of dates that are recognised.
DATE_PARTS = {
    "year": r"\d{4}",
    "short": r"\d{4}|\d{2}",
    "day": r"\d{1,2}",
    "nth": r"\d{1,2}(?:st|nd|rd|th)?",
    "month": "|".join(
        f"{name[:3]}(?:{name[3:]})?" if name not in ("may", "september") else {"may": "may", "september": "sept?(?:ember)?"}[name]
        for name in "january february march april may june july august september october november december".split()
    ),
    "clock": r"\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?",
    "cut": "[-_/]",
    "gap": r"[\s,-]",
    "comma": r",?\s",
}
DATE_FORMS = (
    "<year><cut><day><cut><day>",
    "<day><cut><day><cut><short>",
    "<year><cut><day><cut><day> <clock>",
    "<day><cut><day><cut><short> <clock>",
    "<clock>",
    "<month><gap><short>",
    "<nth><gap><month><gap><short>",
    "<month><gap><nth><comma><short>",
)
DATE = "(?i)^(" + "|".join(re.sub("<([a-z]+)>", lambda m: f"(?:{DATE_PARTS[m[1]]})", form) for form in DATE_FORMS) + ")$"


def infer_content_type(values: DataFrame) -> DataFrame:
    """``kind`` per column from its distinct values: boolean, text, number, date, year or unknown.

    All distinct values are looked at.  One odd value is forgiven in columns with more than seven.
    Years need a year-like column name.
    """
    value = F.col("value")
    usable = value.isNotNull() & ~value.isin(*MISSING)
    low = F.lower(value)
    name = F.lower(F.replace("column_name", F.lit("_"), F.lit(" ")))
    stats = values.groupBy("table_name", "column_name").agg(
        F.count_if(usable).alias("n_distinct"),
        F.min(F.when(usable, low)).alias("lo"),
        F.max(F.when(usable, low)).alias("hi"),
        F.count_if(usable & value.rlike(YEAR)).alias("years"),
        F.count_if(usable & value.rlike(NUMBER)).alias("numbers"),
        F.count_if(usable & ~value.rlike(NUMBER) & value.rlike(DATE)).alias("dates"),
    )
    pair = reduce(
        Column.__or__, [(F.col("lo") == a) & (F.col("hi") == b) for a, b in BOOLEAN_PAIRS]
    )
    n = F.col("n_distinct")
    odd = n - F.col("numbers") - F.col("dates")
    forgiven = F.when(n > 7, 1).otherwise(0)
    says_year = (name == "founded") | name.rlike(r"\byear\b")
    says_time = name.rlike(r"( date| time)$|^(data|time|duration)$")
    kind = (
        F.when((n == 0) & says_time, "date")
        .when((n == 0) & says_year, "year")
        .when(n == 0, "unknown")
        .when((n == 2) & pair, "boolean")
        .when(odd > forgiven, "text")
        .when(n < 2, "unknown")
        .when(F.col("dates") > F.col("numbers"), "date")
        .when((F.col("years") >= n - forgiven) & says_year, "year")
        .when(says_time, "date")
        .otherwise("number")
    )
    return stats.select("table_name", "column_name", "n_distinct", kind.alias("kind"))


# --- keys ---------------------------------------------------------------------------------------


def key_columns(cat_keys: DataFrame) -> DataFrame:
    """Primary-key columns and both ends of every foreign key."""
    ends = F.explode(F.array_compact(F.array("column_id", "ref_column_id")))
    return cat_keys.select("db_id", ends.alias("column_id")).distinct()


def resolve_foreign_keys(fk_names: DataFrame, cat_columns: DataFrame) -> DataFrame:
    """``(db_id, table, column, ref_table, ref_column)`` names to column ids."""
    ids = cat_columns.select("db_id", "table_name", "column_name", "column_id")
    src = ids.toDF("db_id", "table", "column", "column_id")
    dst = ids.toDF("db_id", "ref_table", "ref_column", "ref_column_id")
    return (
        fk_names.join(src, ["db_id", "table", "column"])
        .join(dst, ["db_id", "ref_table", "ref_column"])
        .select("db_id", F.lit("fk").alias("kind"), "column_id", "ref_column_id")
    )


def key_equivalence(cat_keys: DataFrame) -> DataFrame:
    """Connected keys map to the smallest column id of their component.

    Rounds of minimum-label exchange with a jump to the label's own label, so long chains close in
    few rounds; every round is checkpointed, and the loop ends when no label changes.
    """
    fk = cat_keys.where("kind = 'fk'").select("db_id", F.col("column_id").alias("a"), F.col("ref_column_id").alias("b"))
    edges = cut_lineage(
        fk.unionByName(fk.select("db_id", F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct()
    )
    labels = fk.select("db_id", F.explode(F.array("a", "b")).alias("column_id")).distinct()
    labels = cut_lineage(labels.withColumn("root_id", F.col("column_id")))
    while True:
        # map-side minimum first: a hub column's edges combine before the shuffle
        seen = (
            edges.join(labels.withColumnRenamed("column_id", "b"), ["db_id", "b"])
            .groupBy("db_id", F.col("a").alias("column_id"))
            .agg(F.min("root_id").alias("seen"))
        )
        near = labels.join(seen, ["db_id", "column_id"], "left").select(
            "db_id", "column_id", F.col("root_id").alias("old"), F.least("root_id", "seen").alias("near")
        )
        hop = near.select("db_id", F.col("column_id").alias("near"), F.col("near").alias("far"))
        step = cut_lineage(
            near.join(hop, ["db_id", "near"], "left").select(
                "db_id", "column_id", "old", F.least("near", "far").alias("root_id")
            )
        )
        labels = step.select("db_id", "column_id", "root_id")
        if step.where("old <> root_id").isEmpty():
            return labels


# --- schema text --------------------------------------------------------------------------------


def reserved_words(spark: SparkSession) -> list[str]:
    """SQL keywords known to the session, upper case."""
    return [r["keyword"].upper() for r in spark.sql("SELECT keyword FROM sql_keywords()").collect()]


def quoted_identifier(name: Column, reserved: Sequence[str]) -> Column:
    """Backticks around reserved words and names with special characters."""
    special = name.rlike(r"[^a-zA-Z0-9_]") | F.upper(name).isin(*reserved)
    return F.when(special, F.concat(F.lit("`"), name, F.lit("`"))).otherwise(name)


def _joined(parts: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["text"]), sep)


def example_list(cat_values: DataFrame, cat_columns: DataFrame, limit: int = 6) -> DataFrame:
    """First ``limit`` distinct example values per column as list text; text values are quoted."""
    kinds = normalize_types(cat_columns).select(
        F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"), "kind", "column_id", "db_id"
    )
    first = cat_values.groupBy("table_name", "column_name", "value").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("table_name", "column_name").orderBy("rank")
    kept = first.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= limit)
    shown = F.when(F.col("kind") == "number", F.col("value")).otherwise(_quoted_value(F.col("value")))
    return (
        kept.join(kinds, ["table_name", "column_name"])
        .groupBy("db_id", "column_id")
        .agg(_joined(F.struct(F.col("_at").alias("i"), shown.alias("text")), ", ").alias("examples"))
        .withColumn("examples", F.concat(F.lit("["), "examples", F.lit("]")))
    )


def render_ddl(
    cat_tables: DataFrame,
    cat_columns: DataFrame,
    cat_keys: DataFrame,
    cat_values: DataFrame,
    reserved: Sequence[str],
    comment: str = "display",
) -> DataFrame:
    """``(db_id, ddl)``: CREATE TABLE text with types, comments, example values and keys."""
    ident = lambda c: quoted_identifier(F.col(c), reserved)
    cols = cat_columns.where("table_id >= 0").join(
        example_list(cat_values, cat_columns), ["db_id", "column_id"], "left"
    )
    said, name = F.lower(comment), F.lower("column_name")
    silent = (
        (name == said) | (name == F.replace(said, F.lit(" "), F.lit("_")))
        | (name == F.replace(said, F.lit(" "), F.lit(""))) | (F.trim(said) == "")
    )
    head = F.concat(F.lit("    "), ident("column_name"), F.lit(" "), "declared_type", F.lit(","))
    shown = F.when(F.col("examples").isNotNull(), F.concat(F.lit("example: "), "examples"))
    tail = F.when(silent, F.coalesce(F.concat(F.lit(" -- "), shown), F.lit(""))).otherwise(
        F.concat(F.lit(" -- "), comment, F.coalesce(F.concat(F.lit(", "), shown), F.lit("")))
    )
    column_lines = cols.select(
        "db_id", "table_id", F.lit(0).alias("section"), F.col("column_id").alias("i"), F.concat(head, tail).alias("text")
    )
    named = cat_columns.select("db_id", "column_id", "table_id", "table_name", "column_name")
    pk = (
        cat_keys.where("kind = 'pk'").select("db_id", "column_id").distinct()
        .join(named, ["db_id", "column_id"])
        .groupBy("db_id", "table_id")
        .agg(_joined(F.struct(F.col("column_id").alias("i"), ident("column_name").alias("text")), ", ").alias("keys"))
        .select(
            "db_id", "table_id", F.lit(1).alias("section"), F.lit(0).alias("i"),
            F.concat(F.lit("    PRIMARY KEY ("), "keys", F.lit("),")).alias("text"),
        )
    )
    ref = named.select("db_id", F.col("column_id").alias("ref_column_id"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))
    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    fk = (
        cat_keys.where("kind = 'fk'").select("db_id", "column_id", "ref_column_id").distinct()
        .join(named, ["db_id", "column_id"])
        .join(ref, ["db_id", "ref_column_id"])
        .select(
            "db_id", "table_id", F.lit(2).alias("section"), F.col("column_id").alias("i"),
            F.concat(
                F.lit("    CONSTRAINT fk_"), plain("table_name"), F.lit("_"), plain("column_name"),
                F.lit(" FOREIGN KEY ("), ident("column_name"), F.lit(") REFERENCES "), ident("ref_table"),
                F.lit(" ("), ident("ref_column"), F.lit("),"),
            ).alias("text"),
        )
    )
    body = (
        column_lines.unionByName(pk).unionByName(fk)
        .groupBy("db_id", "table_id")
        .agg(_joined(F.struct("section", "i", "text"), "\n").alias("body"))
    )
    tables = body.join(cat_tables, ["db_id", "table_id"]).select(
        "db_id", F.col("table_id").alias("i"),
        F.concat(
            F.lit("CREATE TABLE "), ident("table_name"), F.lit(" (\n"),
            F.regexp_replace("body", ",$", ""), F.lit("\n);"),
        ).alias("text"),
    )
    return tables.groupBy("db_id").agg(_joined(F.struct("i", "text"), "\n\n").alias("ddl"))


def _draw(seed: int, *parts: Column | str) -> Column:
    """Seeded hash text; its order is the random order of whatever ``parts`` names."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).cast("binary"))


def _below(draw: Column, n: int) -> Column:
    """0 to ``n - 1`` from the first digits of a hash text."""
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("bigint") % n


def _schema_arrays(cat_columns: DataFrame, cat_keys: DataFrame) -> DataFrame:
    """``(db_id, cols)``: the columns of a database with lower-case names and key flags, as one array."""
    keys = key_columns(cat_keys).withColumn("is_key", F.lit(True))
    cols = cat_columns.join(keys, ["db_id", "column_id"], "left").select(
        "db_id", "column_id", F.lower("column_name").alias("low"), F.coalesce("is_key", F.lit(False)).alias("is_key")
    )
    return cols.groupBy("db_id").agg(F.collect_list(F.struct("column_id", "low", "is_key")).alias("cols"))


def _on_database(questions: DataFrame, schema: DataFrame) -> DataFrame:
    """Every question with the row of its database.

    The key is pinned on both sides: a database that is a literal would be folded out of the condition, and the
    join become a product that computes the catalog again for every part of the questions.  The row is metadata
    and goes to the questions: dealt by the key, all questions of a database would meet in one task.
    """
    left = pinned(questions, _db=F.col("db_id"))
    return left.join(F.broadcast(pinned(schema, _db=F.col("db_id")).drop("db_id")), "_db").drop("_db")


def _choose_columns(joined: DataFrame, seed: int, cap: int) -> DataFrame:
    """``joined`` with ``_chosen``, an array of (spare, h, column_id): the columns shown for its question."""
    question = F.col("question_id").cast("string")
    tagged = pinned(
        joined,
        _all=F.transform(
            "cols",
            lambda c: F.struct(
                (~(c["is_key"] | F.contains("_sql", c["low"]))).alias("spare"),
                _draw(seed, question, F.lit("column"), c["column_id"].cast("string")).alias("h"),
                c["column_id"].alias("column_id"),
            ),
        ),
    )
    # needed columns sort before spare ones, spare ones by their hash: the answer is a prefix
    counted = pinned(tagged, _sorted=F.array_sort("_all"), _needed=F.size(F.filter("_all", lambda c: ~c["spare"])))
    share = _below(_draw(seed, question, F.lit("share")), 10) + 1
    room = F.greatest(F.lit(0), F.lit(cap) - F.col("_needed"))
    extra = F.least(F.floor(share * (F.size("_sorted") - F.col("_needed")) / 10).cast("int"), room)
    return pinned(counted, _chosen=F.slice("_sorted", F.lit(1), F.col("_needed") + extra)).drop("_all", "_sorted", "_needed")


def training_columns(
    questions: DataFrame, cat_columns: DataFrame, cat_keys: DataFrame, seed: int, cap: int = 225
) -> DataFrame:
    """Columns shown for a training question: keys, columns named in its SQL, and a random share.

    The share is one of 10 %..100 % by a seeded hash of the question; the total stays within
    ``cap`` unless the needed columns alone exceed it.  Rows: ``question_id, column_id, needed``.
    """
    # the catalog of a database as one array: every question reads it in place
    schema = _schema_arrays(cat_columns, cat_keys)
    joined = _on_database(dealt(questions.select("question_id", "db_id", F.lower("sql").alias("_sql")), "question_id"), schema)
    chosen = _choose_columns(joined, seed, cap).select("question_id", F.explode("_chosen").alias("c"))
    return chosen.select("question_id", "c.column_id", (~F.col("c.spare")).alias("needed"))


def _quoted_value(value: Column) -> Column:
    """A text value as it stands in an example list."""
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(single)


def _schema_tree(
    cat_tables: DataFrame, cat_columns: DataFrame, cat_keys: DataFrame, cat_values: DataFrame, reserved: Sequence[str], comment: str
) -> DataFrame:
    """``(db_id, tables)``: per database one nested array of tables, their columns and foreign keys, ready to be written."""
    ident = lambda c: quoted_identifier(F.col(c), reserved)
    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    low = lambda c: F.lower(c).alias(c)
    values = cat_values.groupBy("table_name", "column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda v: v["value"]).alias("samples")
    )
    said, name = F.lower(comment), F.lower("column_name")
    silent = (
        (name == said) | (name == F.replace(said, F.lit(" "), F.lit("_")))
        | (name == F.replace(said, F.lit(" "), F.lit(""))) | (F.trim(said) == "")
    )
    pk = cat_keys.where("kind = 'pk'").select("db_id", "column_id", F.lit(True).alias("pk")).distinct()
    named = cat_columns.select("db_id", "column_id", "table_id", "table_name", "column_name")
    ref = named.select("db_id", F.col("column_id").alias("ref_column_id"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))
    line = F.concat(
        F.lit("    CONSTRAINT fk_"), plain("table_name"), F.lit("_"), plain("column_name"), F.lit(" FOREIGN KEY ("), ident("column_name"),
        F.lit(") REFERENCES "), ident("ref_table"), F.lit(" ("), ident("ref_column"), F.lit("),"),
    )
    fk = cat_keys.where("kind = 'fk'").select("db_id", "column_id", "ref_column_id").distinct().join(named, ["db_id", "column_id"]).join(ref, ["db_id", "ref_column_id"])
    fk = fk.groupBy("db_id", "column_id").agg(F.array_sort(F.collect_set(line)).alias("fks"))
    kinds = normalize_types(cat_columns.where("table_id >= 0"))
    cols = (
        kinds.withColumns({"_t": low("table_name"), "_c": low("column_name")})
        .join(values.select(F.col("table_name").alias("_t"), F.col("column_name").alias("_c"), "samples"), ["_t", "_c"], "left")
        .join(pk, ["db_id", "column_id"], "left").join(fk, ["db_id", "column_id"], "left")
    )
    none = F.array().cast("array<string>")
    column = F.struct(
        "column_id", ident("column_name").alias("ident"), F.concat(F.lit("    "), ident("column_name"), F.lit(" "), "declared_type", F.lit(",")).alias("head"),
        F.coalesce(comment, F.lit("")).alias("comment"), F.coalesce(silent, F.lit(True)).alias("silent"), (F.col("kind") == "number").alias("number"),
        F.coalesce("samples", none).alias("samples"), F.coalesce("pk", F.lit(False)).alias("pk"), F.coalesce("fks", none).alias("fks"),
    )
    tables = cols.groupBy("db_id", "table_id").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    tables = tables.join(cat_tables.select("db_id", "table_id", ident("table_name").alias("ident")), ["db_id", "table_id"])
    return tables.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("table_id", "ident", "columns"))).alias("tables"))


def question_schemas(
    questions: DataFrame,
    cat_tables: DataFrame,
    cat_columns: DataFrame,
    cat_keys: DataFrame,
    cat_values: DataFrame,
    reserved: Sequence[str],
    matches: DataFrame | None = None,
    training: bool = True,
    seed: int = 42,
    cap: int = 225,
    limit: int = 6,
    comment: str = "display",
    hide_comments: bool = False,
) -> DataFrame:
    """``(question_id, db_id, ddl, n_chars)``: CREATE TABLE text of a question's database as the question needs it, and its length.

    For ``training`` a question (with its ``sql``) gets the columns of ``training_columns`` and its tables in
    seeded order; otherwise it gets all of them in order.  Tables without a column are left out.  Up to
    ``limit`` different examples stand beside a column, those of ``matches(question_id, column_id, rank,
    value)`` before the sampled ones.  With ``hide_comments`` each table draws a share of 0 %..100 % per
    question, and that share of its columns shows the comment; else it shows unless it repeats the name.

    The catalog is metadata: one nested value per database goes to the tasks, which write the texts of an Arrow
    batch at once, so a question's row carries its own text, never a row per catalog column.  Every draw is an
    md5 of seed, question and item.
    """
    # one row per database
    tree = _schema_tree(cat_tables, cat_columns, cat_keys, cat_values, reserved, comment)
    if training:
        tree = _on_database(tree, _schema_arrays(cat_columns, cat_keys))
    catalogs = {row["db_id"]: row for row in tree.toArrow().to_pylist()}
    read = ["question_id", "db_id", F.col("question_id").cast("string").alias("_id"), *[F.lower("sql").alias("_sql")] * training]
    asked = dealt(questions.select(*read), "question_id")
    if matches is not None:
        per_column = matches.groupBy("question_id", "column_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda m: m["value"]).alias("values")
        )
        found = per_column.groupBy("question_id").agg(F.collect_list(F.struct("column_id", "values")).alias("_found"))
        asked = asked.join(found, "question_id", "left")
    key = asked.schema["question_id"].dataType.simpleString()
    write = schema_texts(catalogs, training, hide_comments, seed, cap, limit)
    return asked.mapInArrow(write, f"question_id {key}, db_id string, ddl string, n_chars bigint")


# fixed values: layout of the two schema-text styles
STYLES = {
    "verbose": {"db": "Database: {}. ", "table": ("Table: ", ". Columns: "), "table_sep": ". ", "sep": ", ", "values": (" (", ")")},
    "compact": {"db": " | {}", "table": (" | ", " : "), "table_sep": "", "sep": " , ", "values": (" ( ", " )")},
}


def serialize_schema(
    cat_columns: DataFrame, matches: DataFrame | None = None, style: str = "compact", with_db_id: bool = True
) -> DataFrame:
    """``(db_id, text)``; ``matches(db_id, column_id, rank, value)`` adds matched values."""
    s = STYLES[style]
    cols = cat_columns.where("table_id >= 0")
    text = F.lower("column_name")
    if matches is not None:
        found = matches.groupBy("db_id", "column_id").agg(
            _joined(F.struct(F.col("rank").alias("i"), F.col("value").alias("text")), s["sep"]).alias("vals")
        )
        cols = cols.join(found, ["db_id", "column_id"], "left")
        left, right = s["values"]
        text = F.concat(text, F.coalesce(F.concat(F.lit(left), "vals", F.lit(right)), F.lit("")))
    left, mid = s["table"]
    tables = cols.groupBy("db_id", "table_id", "table_name").agg(
        _joined(F.struct(F.col("column_id").alias("i"), text.alias("text")), s["sep"]).alias("cols")
    )
    whole = tables.groupBy("db_id").agg(
        _joined(
            F.struct(
                F.col("table_id").alias("i"),
                F.concat(F.lit(left), F.lower("table_name"), F.lit(mid), "cols").alias("text"),
            ),
            s["table_sep"],
        ).alias("text")
    )
    if with_db_id:
        before, after = s["db"].split("{}")
        whole = whole.withColumn("text", F.concat(F.lit(before), "db_id", F.lit(after), "text"))
    return whole


def distinct_schemas(examples: DataFrame, schema: str = "schema", ordinal: str = "ordinal") -> DataFrame:
    """One schema per database: that of its first example."""
    return examples.groupBy("db_id").agg(F.min_by(schema, ordinal).alias(schema))
