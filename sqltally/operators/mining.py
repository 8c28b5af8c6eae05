"""Mining SQL and answers out of response text, and reports over SQL logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltally.functions.once import pinned
from sqltally.functions.text import last_match, occurrences, outside_quotes, squeeze, strip

# fixed values: response markers, tags and the text of an empty prediction
BLOCK = r"(?s)```sql\s*(.*?)\s*```"
ANSWER = r"(?s)<answer>(.*?)</answer>"
THINK = r"(?s)<think>(.*?)</think>"
MARKERS = ("Assistant:", "<|im_start|>assistant")
TAGS = ("<think>", "</think>", "<answer>", "</answer>")
ERROR_SQL = "Error SQL"

#: Slot fills of a question made by one row.
FILL_STRETCH = 65_536

# a quoted literal, and a number standing alone (not part of a word, an alias or a name)
STRING_LITERAL = r"'[^']*'|\"[^\"]*\""
NUMBER_LITERAL = r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])"


def clean_sql(sql: Column, plug_value: bool = False) -> Column:
    """Comments, tabs and newlines removed, split operators and current-year calls repaired.

    ``plug_value`` turns the placeholder text ``value`` into ``1``.
    """
    out = F.regexp_replace(sql, r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, r"(?m)--.*$", "")
    out = strip(F.regexp_replace(out, r"[\n\t]", " "))
    for broken, whole in (("> =", ">="), ("< =", "<="), ("! =", "!=")):
        out = F.replace(out, F.lit(broken), F.lit(whole))
    out = F.regexp_replace(out, r"(?i)year\s*\(\s*curdate\s*\(\s*\)\s*\)\s*", "2020")
    if plug_value:
        out = F.replace(out, F.lit("value"), F.lit("1"))
    return F.when(out == "", ERROR_SQL).otherwise(out)


def extract_sql(response: Column, blank: str = "") -> Column:
    """The last fenced SQL block, or ``blank``."""
    found = strip(F.coalesce(last_match(response, BLOCK), F.lit("")))
    return F.when(found == "", blank).otherwise(found)


def mine_candidates(responses: DataFrame, blank: str = "", plug_value: bool = False) -> DataFrame:
    """One row per distinct candidate of a question, with its sample count and first index.

    ``responses(question_id, responses ARRAY<STRING>)``; ``blank='SELECT'`` is the list variant.
    """
    each = responses.select("question_id", F.posexplode("responses").alias("ix", "response"))
    return (
        each.select("question_id", "ix", clean_sql(extract_sql(F.col("response"), blank), plug_value).alias("sql"))
        .groupBy("question_id", "sql")
        .agg(F.count(F.lit(1)).alias("n_samples"), F.min("ix").alias("cand_id"))
    )


def format_audit(responses: DataFrame) -> DataFrame:
    """Structure check per response: ``ok``, first failing ``reason``, answer, think and SQL text.

    The body starts after the first assistant marker; a missing marker is a bad format.
    """
    text = F.col("response")
    at = [F.locate(m, text) for m in MARKERS]
    body = F.when(at[0] > 0, F.substring(text, at[0] + len(MARKERS[0]), F.length(text))).when(
        at[1] > 0, F.substring(text, at[1] + len(MARKERS[1]), F.length(text))
    )
    found = responses.withColumn("body", body).withColumns(
        {
            "answer": strip(last_match(F.col("body"), ANSWER)),
            "think": strip(last_match(F.col("body"), THINK)),
        }
    )
    once = F.lit(True)
    for tag in TAGS:
        once = once & (occurrences(F.col("body"), tag) == 1)
    first = [F.locate(t, F.col("body")) for t in TAGS]
    in_order = (first[0] <= first[1]) & (first[1] <= first[2]) & (first[2] <= first[3])
    sql = strip(last_match(F.col("answer"), r"(?s)```sql(.*?)```"))
    reason = (
        F.when(F.col("body").isNull(), "no header")
        .when(~once, "tag count")
        .when(~in_order, "tag order")
        .when(F.coalesce(F.col("sql"), F.lit("")) == "", "no sql")
    )
    return (
        found.withColumn("sql", sql)
        .withColumn("reason", reason)
        .withColumn("ok", F.col("reason").isNull())
        .drop("body")
    )


def format_rates(audit: DataFrame, source: str = "source") -> DataFrame:
    """Failure counts and shares by source and reason, with totals per source and overall."""
    per_reason = audit.groupBy(source, F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )
    every = per_reason.withColumn(source, F.explode(F.array(F.col(source), F.lit("all"))))
    counts = every.groupBy(source, "reason").agg(F.sum("n").alias("n"))
    # one row per source and reason: at most five reasons per source
    total = F.sum("n").over(Window.partitionBy(source))
    return counts.withColumn("share", F.col("n") / total)


# --- SQL logs ---------------------------------------------------------------------------------


def drop_distinct(sql: Column) -> Column:
    """DISTINCT removed outside quotes."""
    return outside_quotes(sql, lambda part: F.regexp_replace(part, r"(?i)\bdistinct\b", ""))


def template_of(sql: Column, slot: str = "value") -> Column:
    """Lower-case text without DISTINCT, literals replaced by ``slot``, white space squeezed.

    Quoted text is masked first, so the later steps cannot touch it.
    """
    masked = F.regexp_replace(sql, STRING_LITERAL, slot)
    plain = F.regexp_replace(masked, r"(?i)\bdistinct\b|[;\t]", "")
    return squeeze(F.lower(F.regexp_replace(plain, NUMBER_LITERAL, slot)))


def literals_of(sql: Column) -> Column:
    """String literals, then numbers outside quotes, in order of appearance."""
    strings = F.regexp_extract_all(sql, F.lit(f"({STRING_LITERAL})"), F.lit(1))
    bare = F.regexp_replace(sql, STRING_LITERAL, " ")
    return F.concat(strings, F.regexp_extract_all(bare, F.lit(f"({NUMBER_LITERAL})"), F.lit(1)))


def query_templates(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Queries grouped by template: count, slots and number of distinct literals."""
    # the template is made once per query, before its literals become rows
    each = pinned(log.select(sql), template=template_of(F.col(sql))).select(
        "template", F.posexplode_outer(literals_of(F.col(sql))).alias("ix", "lit")
    )
    # one pass: equal literals of a template are combined before the shuffle
    return (
        each.groupBy("template", "lit")
        .agg(F.count_if(F.coalesce("ix", F.lit(0)) == 0).alias("n"), F.max("ix").alias("last"))
        .groupBy("template")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.max("last") + 1, F.lit(0)).alias("slots"),
            F.count("lit").alias("n_literals"),
        )
    )


def fill_slots(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Every way to put the gold literals into the prediction's slots: values ^ slots rows.

    Fill ``i`` reads its values from the base-``values`` digits of ``i`` in integer arithmetic.  The
    fills of a question are made in stretches, so that no row holds more than FILL_STRETCH of them;
    more than 2^63 fills are an overflow error.
    """
    slot = "\u0001"
    plain = F.regexp_replace(F.col(pred), STRING_LITERAL, slot)
    masked = F.regexp_replace(plain, NUMBER_LITERAL, slot)
    base = pairs.select(
        "question_id",
        F.split(masked, slot, -1).alias("parts"),
        F.array_sort(F.array_distinct(literals_of(F.col(gold)))).alias("values"),
    ).withColumn("slots", F.size("parts") - 1)
    # weights[k] = values ^ k, the last one is the number of fills
    nv = F.size("values").cast("long")
    powers = F.aggregate(
        F.slice("parts", F.lit(2), F.greatest(F.col("slots"), F.lit(0))),
        F.array(F.lit(1).cast("long")),
        lambda seen, _: F.concat(seen, F.array(F.element_at(seen, -1) * nv)),
    )
    base = pinned(base, weights=powers).withColumn("n_fills", F.element_at("weights", -1)).where("n_fills > 0")
    last = F.call_function("div", F.col("n_fills") - 1, F.lit(FILL_STRETCH))
    some = base.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    some = some.withColumn("_from", F.col("_from") * FILL_STRETCH)
    upto = F.least(F.col("_from") + FILL_STRETCH, F.col("n_fills")) - 1
    fills = some.withColumn("fill_id", F.explode(F.sequence("_from", upto)))
    # slot s (from the left) takes the digit of weight values^(slots-1-s)
    digit = F.transform(
        F.slice("parts", F.lit(2), F.greatest(F.col("slots"), F.lit(0))),
        lambda part, s: F.concat(
            F.element_at(
                "values",
                (F.call_function("div", F.col("fill_id"), F.element_at("weights", F.col("slots") - s)) % nv + 1).cast("int"),
            ),
            part,
        ),
    )
    text = F.concat(F.element_at("parts", 1), F.array_join(digit, ""))
    return fills.select("question_id", "fill_id", "n_fills", text.alias("sql"))


def literal_usage(log: DataFrame, sql: str = "sql") -> DataFrame:
    """(table, column, value) of comparisons and BETWEEN bounds, with frequencies.

    In comparisons a ``T1.``-style alias counts as no table.  Columns are upper-cased, quotes removed.
    """
    # matches start at a name's first character only; the parts are cut out of the short match
    name = r"(?<![\w.])(?:[A-Za-z_]\w*\.)?[A-Za-z_]\w*"
    value = r"(?:'[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?)"
    compared = rf"({name}\s*(?:<=|>=|<>|!=|=|<|>|(?i:\blike\b))\s*{value})"
    ranged = rf"(?i)({name}\s+between\s+[^\s;]+\s+and\s+[^\s;]+)"
    hits = [F.regexp_extract_all(F.col(sql), F.lit(p), F.lit(1)) for p in (compared, ranged)]
    found = log.select(
        F.explode(
            F.concat(
                F.transform(hits[0], lambda h: F.struct(F.lit(False).alias("ranged"), h.alias("h"))),
                F.transform(hits[1], lambda h: F.struct(F.lit(True).alias("ranged"), h.alias("h"))),
            )
        ).alias("m")
    ).select("m.ranged", "m.h")
    column = F.regexp_extract("h", r"^[\w.]+", 0)
    bounds = F.split(F.regexp_replace("h", r"(?i)^\S+\s+between\s+", ""), r"(?i)\s+and\s+")
    right = F.array(F.regexp_replace("h", r"(?i)^[\w.]+\s*(?:[<>=!]+|like)\s*", ""))
    dotted = F.contains("name", F.lit("."))
    table = F.when(dotted, F.lower(F.element_at(F.split("name", r"\."), 1)))
    each = (
        found.select("ranged", column.alias("name"), F.explode(F.when(F.col("ranged"), bounds).otherwise(right)).alias("v"))
        .select(
            # an alias such as T1 names no table in a comparison
            F.when(F.col("ranged") | ~table.rlike(r"^t\d$"), table).alias("table"),
            F.upper(F.element_at(F.split("name", r"\."), -1)).alias("column"),
            F.regexp_replace("v", r"^['\"`]|['\"`]$", "").alias("value"),
        )
    )
    return each.groupBy("table", "column", "value").agg(F.count(F.lit(1)).alias("n"))


#: keywords of the profile; group and order count only before "by" (fixed values)
KEYWORDS = (
    r"\b(where|group(?=\s+by\b)|having|order(?=\s+by\b)|asc|desc|limit|except|union|intersect"
    r"|or|not|in|like)\b"
)


def query_keywords(log: DataFrame, sql: str = "sql") -> DataFrame:
    """``log`` with the sorted distinct ``keywords`` of its query, found outside quotes."""
    bare = F.lower(F.regexp_replace(F.col(sql), STRING_LITERAL, " "))
    found = F.regexp_extract_all(bare, F.lit(KEYWORDS), F.lit(1))
    return log.withColumn("keywords", F.array_sort(F.array_distinct(found)))


def keyword_profile(log: DataFrame, sql: str = "sql") -> tuple[DataFrame, DataFrame]:
    """Share of queries per keyword, and counts of keyword pairs used together."""
    tagged = query_keywords(log, sql).select("keywords")
    # equal keyword sets are counted first: at most 2^14 rows go on
    sets = tagged.groupBy("keywords").agg(F.count(F.lit(1)).alias("m"))
    # the total rides along with those few rows, so the log is read once
    counted = sets.withColumn("total", F.sum("m").over(Window.partitionBy(F.lit(0))))
    share = (
        counted.select(F.explode("keywords").alias("keyword"), "m", "total")
        .groupBy("keyword")
        .agg(F.sum("m").alias("n"), F.max("total").alias("total"))
        .select("keyword", "n", (F.col("n") / F.col("total")).alias("share"))
    )
    pairs = (
        sets.select("m", F.explode("keywords").alias("a"), "keywords")
        .select("m", "a", F.explode("keywords").alias("b"))
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.sum("m").alias("n"))
    )
    return share, pairs
