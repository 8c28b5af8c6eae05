"""Accuracy metrics, component matching, difficulty and efficiency scores.

Component tables are long: ``components(question_id, side, scope, clause, pos, item, item_no_agg)``
with ``side`` in {pred, gold}.  ``scope`` is ``main`` or the name of a set operation's nested query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltally.functions.ordering import with_rank
from sqltally.functions.skew import salted_join


def execution_accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))


def accuracy_by_level(scored: DataFrame, level: str) -> DataFrame:
    """Accuracy and count per level, with a ``total`` row."""
    return _with_total(
        scored.rollup(level).agg(
            F.grouping(level).alias("_all"),
            F.count(F.lit(1)).alias("n"),
            F.avg("correct").alias("accuracy"),
        ),
        level,
    )


def _with_total(rolled: DataFrame, level: str) -> DataFrame:
    label = F.when(F.col("_all") == 1, F.lit("total")).otherwise(F.col(level))
    return rolled.withColumn(level, label).drop("_all")


def trimmed_mean(
    df: DataFrame, keys: Sequence[str], col: str, k: float = 3.0, strict: bool = False
) -> DataFrame:
    """Mean of the values within ``k`` population deviations of the group mean.

    The bounds are exclusive.  A group of identical values keeps all of them unless ``strict``,
    which drops them and leaves a NULL mean.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(
        F.avg(col).alias("_m"),
        F.stddev_pop(col).alias("_s"),
        (F.min(col) == F.max(col)).alias("_flat"),
    )
    # identical values: fix the mean and deviation so that rounding cannot leak in
    inside = (F.abs(F.col(col) - F.col("_m")) < k * F.col("_s")) & ~F.col("_flat")
    if not strict:
        inside = inside | F.col("_flat")
    kept = salted_join(df, stats, keys).withColumn("_keep", F.when(inside, F.col(col)))
    return kept.groupBy(*keys).agg(F.avg("_keep").alias("mean"))


def efficiency_score(
    timings: DataFrame, scored: DataFrame, level: str, strict: bool = False
) -> DataFrame:
    """``100 * avg(sqrt(ratio))`` by level and in total.

    ``timings(question_id, rep, gold_s, pred_s)``; the ratio of a question is the trimmed mean of
    gold / pred time, and 0 if its answer is wrong or was never timed.
    """
    ratio = trimmed_mean(
        timings.withColumn("ratio", F.col("gold_s") / F.col("pred_s")),
        ["question_id"],
        "ratio",
        strict=strict,
    )
    per_question = scored.join(ratio, "question_id", "left").withColumn(
        "score",
        F.when(F.col("correct") == 1, F.sqrt(F.coalesce("mean", F.lit(0.0)))).otherwise(F.lit(0.0)),
    )
    return _with_total(
        per_question.rollup(level).agg(
            F.grouping(level).alias("_all"),
            F.count(F.lit(1)).alias("n"),
            (F.avg("score") * 100).alias("score"),
        ),
        level,
    )


# --- difficulty -------------------------------------------------------------------------------


def hardness(components: DataFrame) -> DataFrame:
    """easy / medium / hard / extra per question from clause counts of its main query.

    Every scope besides ``main`` is one nested query.  Clauses counted in ``components``: ``where``, ``group``, ``order``, ``limit``, ``table``,
    ``select``; ``connective`` items (``or``), ``op`` items (``like``), ``nested`` and ``agg``
    (one row per aggregated unit).
    """

    scoped = "scope" in components.columns
    scope = F.coalesce(F.col("scope"), F.lit("main")) if scoped else F.lit("main")

    def n(clause: str, item: str | None = None) -> Column:
        hit = (F.col("clause") == clause) & (scope == "main")
        if item is not None:
            hit = hit & (F.col("item") == item)
        return F.count_if(hit)

    def some(name: str) -> Column:
        return (F.col(name) > 0).cast("int")

    def many(name: str) -> Column:
        return (F.col(name) > 1).cast("int")

    # fixed values: the limits of the four levels
    counts = components.groupBy("question_id").agg(
        *[n(c).alias(f"n_{c}") for c in ("where", "group", "order", "limit", "table", "select", "nested", "agg")],
        F.count_distinct(F.when(scope != "main", scope)).alias("n_scopes"),
        n("connective", "or").alias("n_or"),
        n("op", "like").alias("n_like"),
    )
    extra_tables = F.greatest(F.col("n_table") - 1, F.lit(0))
    clauses = (
        some("n_where") + some("n_group") + some("n_order") + some("n_limit")
        + extra_tables + F.col("n_or") + F.col("n_like")
    )
    others = many("n_agg") + many("n_select") + many("n_where") + many("n_group")
    c, o, nested = F.col("clauses"), F.col("others"), F.col("nested")
    flat = nested == 0
    level = (
        F.when((c <= 1) & (o == 0) & flat, "easy")
        .when(flat & (((o <= 2) & (c <= 1)) | ((c <= 2) & (o < 2))), "medium")
        .when(
            (flat & (o > 2) & (c <= 2))
            | (flat & (c > 2) & (c <= 3) & (o <= 2))
            | ((c <= 1) & (o == 0) & (nested <= 1)),
            "hard",
        )
        .otherwise("extra")
    )
    return counts.select(
        "question_id", clauses.alias("clauses"), F.greatest("n_nested", "n_scopes").alias("nested"), others.alias("others")
    ).withColumn("level", level)


# --- component matching -----------------------------------------------------------------------


def _multiset_hits(components: DataFrame, item: str) -> DataFrame:
    """Multiset overlap per question: sum over items of min(pred count, gold count)."""
    return (
        components.groupBy("question_id", item)
        .agg(
            F.count_if(F.col("side") == "pred").alias("p"),
            F.count_if(F.col("side") == "gold").alias("g"),
        )
        .groupBy("question_id")
        .agg(F.sum(F.least("p", "g")).alias("hit"), F.sum("p").alias("pred_n"), F.sum("g").alias("label_n"))
    )


def component_overlap(components: DataFrame, clause: str) -> DataFrame:
    """Label and prediction totals, overlap, and overlap without aggregate / operator."""
    part = components.where(F.col("clause") == clause)
    loose = _multiset_hits(part, "item_no_agg").select("question_id", F.col("hit").alias("hit_loose"))
    return (
        _multiset_hits(part, "item")
        .join(loose, "question_id")
        .select("question_id", "label_n", "pred_n", "hit", "hit_loose")
    )


def group_overlap(components: DataFrame) -> DataFrame:
    """Group-by columns compared without their table prefix."""
    part = components.where(F.col("clause") == "group").withColumn(
        "item",
        F.when(F.contains("item", F.lit(".")), F.split_part("item", F.lit("."), F.lit(2))).otherwise(
            F.col("item")
        ),
    )
    return _multiset_hits(part, "item").select("question_id", "label_n", "pred_n", "hit")


def _lists(components: DataFrame, clauses: Sequence[str]) -> DataFrame:
    """Ordered item list per question, side and clause, as an additive digest plus size.

    The digest sums a hash of (position, item), so no list is ever collected.
    """
    return (
        components.where(F.col("clause").isin(*clauses))
        .groupBy("question_id")
        .agg(
            *[
                F.sum(
                    F.when(
                        (F.col("clause") == c) & (F.col("side") == s),
                        F.xxhash64(F.lit(salt), "pos", F.coalesce("item", F.lit("\u0000"))).cast("decimal(38,0)"),
                    )
                ).alias(f"{c}_{s}_{salt}")
                for c in clauses
                for s in ("pred", "gold")
                for salt in (0, 1)
            ],
            *[
                F.count_if((F.col("clause") == c) & (F.col("side") == s)).alias(f"{c}_{s}_n")
                for c in clauses
                for s in ("pred", "gold")
            ],
        )
    )


def _same_list(clause: str) -> Column:
    same = F.col(f"{clause}_pred_n") == F.col(f"{clause}_gold_n")
    for salt in (0, 1):
        same = same & F.col(f"{clause}_pred_{salt}").eqNullSafe(F.col(f"{clause}_gold_{salt}"))
    return same


def clause_equal(components: DataFrame, clause: str) -> DataFrame:
    """All-or-nothing match of ``having`` (with equal group columns) or ``order``.

    ``order`` items carry direction and keys in order; both sides must agree on being limited.
    Label and prediction totals are 1 if the side groups (or orders) at all.
    """
    if clause == "having":
        lists, base = _lists(components, ["group", "having"]), "group"
        match = (F.col("group_pred_n") > 0) & (F.col("group_gold_n") > 0)
        match = match & _same_list("group") & _same_list("having")
    else:
        lists, base = _lists(components, ["order", "limit"]), "order"
        limited = (F.col("limit_pred_n") > 0) == (F.col("limit_gold_n") > 0)
        match = (F.col("order_gold_n") > 0) & _same_list("order") & limited
    return lists.select(
        "question_id",
        (F.col(f"{base}_gold_n") > 0).cast("int").alias("label_n"),
        (F.col(f"{base}_pred_n") > 0).cast("int").alias("pred_n"),
        match.cast("int").alias("hit"),
    )


def connective_match(components: DataFrame) -> DataFrame:
    """Sets of and/or connectives: 1,1,1 if equal, else the set sizes and 0."""
    both = (
        components.where(F.col("clause") == "connective")
        .groupBy("question_id", "item")
        .agg(
            F.max((F.col("side") == "pred").cast("int")).alias("p"),
            F.max((F.col("side") == "gold").cast("int")).alias("g"),
        )
        .groupBy("question_id")
        .agg(
            F.sum("p").alias("p"), F.sum("g").alias("g"), F.bool_and(F.col("p") == F.col("g")).alias("same")
        )
    )
    one = F.lit(1).cast("long")
    return both.select(
        "question_id",
        F.when(F.col("same"), one).otherwise(F.col("p")).alias("label_n"),
        F.when(F.col("same"), one).otherwise(F.col("g")).alias("pred_n"),
        F.col("same").cast("long").alias("hit"),
    )


def keyword_match(components: DataFrame) -> DataFrame:
    """Keyword-set overlap (``clause = 'keyword'``)."""
    words = components.where(F.col("clause") == "keyword").dropDuplicates(["question_id", "side", "item"])
    return _multiset_hits(words, "item").select("question_id", "label_n", "pred_n", "hit")


def all_or_nothing(label_n: str = "label_n", pred_n: str = "pred_n", hit: str = "hit") -> Column:
    """1 when totals agree and everything is hit, else 0 (used for acc, rec and f1 alike)."""
    return ((F.col(pred_n) == F.col(label_n)) & (F.col(hit) == F.col(pred_n))).cast("int")


def exact_match(overlaps: DataFrame, tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per-component scores, and per-question exact match.

    ``overlaps(question_id, component, label_n, pred_n, hit)``; ``tables`` are component rows
    (``side``, ``item``) whose sorted lists must agree wherever the gold side names a table.
    """
    score = all_or_nothing()
    partial = overlaps.select(
        "question_id", "component", "label_n", "pred_n",
        score.alias("acc"), score.alias("rec"), score.alias("f1"),
    )
    exact = partial.groupBy("question_id").agg(F.min("f1").alias("exact"))
    if tables is not None:
        same = _multiset_hits(main_scope(tables), "item").select(
            "question_id",
            ((F.col("label_n") == 0) | ((F.col("hit") == F.col("label_n")) & (F.col("pred_n") == F.col("label_n")))).alias("same"),
        )
        exact = exact.join(same, "question_id", "left").select(
            "question_id",
            F.when(F.coalesce("same", F.lit(True)), F.col("exact")).otherwise(0).alias("exact"),
        )
    return partial, exact


def main_scope(components: DataFrame) -> DataFrame:
    """Components of the main query; a table without ``scope`` has no other."""
    if "scope" not in components.columns:
        return components
    return components.where(F.coalesce(F.col("scope"), F.lit("main")) == "main")


#: Component rows that are scored in one task.
TASK_ROWS = 50_000


def _in_tasks(df: DataFrame) -> int:
    """Tasks for the rows of ``df``, so that the groups and sorts of one task stay as large on any input."""
    return max(1, -(-df.count() // TASK_ROWS))


def component_scores(components: DataFrame, questions: DataFrame) -> DataFrame:
    """Label/pred/hit per question for every component of the main query, set operations included.

    Components of nested scopes count as set operations (``IUEN``) and nowhere else.
    """
    tasks = _in_tasks(components)
    flat = _flat_scores(main_scope(components).repartition(tasks, "question_id"), questions.repartition(tasks, "question_id"))
    zero = F.lit(0).cast("long")
    if "scope" not in components.columns:
        none = questions.select("question_id", F.lit("IUEN").alias("component"), zero.alias("label_n"), zero.alias("pred_n"), zero.alias("hit"))
        return flat.unionByName(none)
    nested = questions.select("question_id").join(nested_match(components), "question_id", "left")
    counted = [F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("label_n", "pred_n", "hit")]
    return flat.unionByName(nested.select("question_id", F.lit("IUEN").alias("component"), *counted))


def _flat_scores(components: DataFrame, questions: DataFrame) -> DataFrame:
    """Label/pred/hit per question for every component but the set operations.

    Three passes instead of one per component: item counts, counts without aggregate, and ordered
    lists.  All end grouped by question, so joining them needs no further shuffle.
    """
    clause = F.col("clause")
    part = components.where(clause.isin("select", "where", "group", "connective", "keyword"))
    bare = F.when(
        (clause == "group") & F.contains("item", F.lit(".")), F.split_part("item", F.lit("."), F.lit(2))
    ).otherwise(F.col("item"))
    is_set = clause.isin("connective", "keyword")

    def counted(df: DataFrame, item: Column) -> DataFrame:
        p, g = F.count_if(F.col("side") == "pred"), F.count_if(F.col("side") == "gold")
        # connectives and keywords are sets: an item counts once per side
        once = lambda n: F.when(is_set, F.least(n, F.lit(1))).otherwise(n)
        return df.groupBy("question_id", "clause", item.alias("item")).agg(once(p).alias("p"), once(g).alias("g"))

    def totals(df: DataFrame, clauses: Sequence[str], tag: str) -> DataFrame:
        aggs = []
        for c in clauses:
            here = F.col("clause") == c
            aggs += [
                F.sum(F.when(here, F.col("g")).otherwise(0)).alias(f"{c}{tag}_label"),
                F.sum(F.when(here, F.col("p")).otherwise(0)).alias(f"{c}{tag}_pred"),
                F.sum(F.when(here, F.least("p", "g")).otherwise(0)).alias(f"{c}{tag}_hit"),
            ]
        return df.groupBy("question_id").agg(*aggs)

    strict = totals(counted(part, bare), ("select", "where", "group", "connective", "keyword"), "")
    loose_part = components.where(clause.isin("select", "where"))
    loose = totals(counted(loose_part, F.col("item_no_agg")), ("select", "where"), "_loose")
    lists = _lists(components, ["group", "having", "order", "limit"])
    wide = (
        questions.select("question_id")
        .join(strict, "question_id", "left")
        .join(loose, "question_id", "left")
        .join(lists, "question_id", "left")
    )
    counts = [c for c in wide.columns if c.endswith(("_n", "_label", "_pred", "_hit")) and not c[-1].isdigit()]
    wide = wide.na.fill(0, counts)

    def row(name: str, label: Column, pred: Column, hit: Column) -> Column:
        return F.struct(
            F.lit(name).alias("component"), label.cast("long").alias("label_n"),
            pred.cast("long").alias("pred_n"), hit.cast("long").alias("hit"),
        )

    def triple(name: str, c: str) -> Column:
        return row(name, F.col(f"{c}_label"), F.col(f"{c}_pred"), F.col(f"{c}_hit"))

    having = (F.col("group_pred_n") > 0) & (F.col("group_gold_n") > 0) & _same_list("group") & _same_list("having")
    limited = (F.col("limit_pred_n") > 0) == (F.col("limit_gold_n") > 0)
    order = (F.col("order_gold_n") > 0) & _same_list("order") & limited
    # equal connective sets count as one of one, empty sets included
    links = F.col("connective_label"), F.col("connective_pred"), F.col("connective_hit")
    same_links = (links[0] == links[2]) & (links[1] == links[2])
    one = F.lit(1)
    rows = [
        triple("select", "select"), triple("select(no AGG)", "select_loose"),
        triple("where", "where"), triple("where(no OP)", "where_loose"),
        triple("group(no Having)", "group"),
        row("group", F.col("group_gold_n") > 0, F.col("group_pred_n") > 0, having),
        row("order", F.col("order_gold_n") > 0, F.col("order_pred_n") > 0, order),
        row(
            "and/or",
            F.when(same_links, one).otherwise(links[1]),
            F.when(same_links, one).otherwise(links[0]),
            same_links,
        ),
        triple("keywords", "keyword"),
    ]
    return wide.select("question_id", F.inline(F.array(*rows)))


def nested_match(components: DataFrame, scopes: Sequence[str] = ("intersect", "except", "union")) -> DataFrame:
    """Set operations of the main query: nested queries on each side, and how many match exactly.

    The components of a nested query carry its ``scope``: the operation, or a path such as ``union/except``
    for a set operation inside it.  Each scope is scored like a query.  A nested query matches exactly if
    its own components do and each of its set operations stands on both sides and matches exactly in
    turn, hence if that holds for all scopes that begin with its path: one grouping at any depth.
    """
    nested = components.where(F.forall(F.split("scope", "/"), lambda part: part.isin(*scopes)))
    ids = F.struct("question_id", "scope")
    # dealt once: all groups and joins of the scores are by this key
    keyed = nested.select(
        ids.alias("question_id"), "side", "clause", "pos", "item", "item_no_agg"
    ).repartition(_in_tasks(nested), "question_id")
    sides = keyed.groupBy("question_id").agg(
        F.max((F.col("side") == "gold").cast("int")).alias("label_n"),
        F.max((F.col("side") == "pred").cast("int")).alias("pred_n"),
    )
    scored = _flat_scores(keyed, keyed.select("question_id").distinct())
    _, exact = exact_match(scored, keyed.where(F.col("clause") == "table"))
    own = (F.col("label_n") == 1) & (F.col("pred_n") == 1) & (F.coalesce("exact", F.lit(0)) == 1)
    return (
        sides.join(exact, "question_id", "left")
        .groupBy("question_id.question_id", F.split_part("question_id.scope", F.lit("/"), F.lit(1)).alias("_root"))
        .agg(F.max("label_n").alias("label_n"), F.max("pred_n").alias("pred_n"), F.bool_and(own).cast("int").alias("hit"))
        .groupBy("question_id")
        .agg(F.sum("label_n").alias("label_n"), F.sum("pred_n").alias("pred_n"), F.sum("hit").alias("hit"))
    )


def canonicalize_components(
    components: DataFrame, key_map: DataFrame, mask_values: bool = True, mask_distinct: bool = True
) -> DataFrame:
    """Values and DISTINCT masked, foreign-key columns replaced by their group's root column.

    ``components`` carries ``column_id``, ``value`` and ``is_distinct`` next to the clause columns.
    ``key_map(column_id, root_id)`` is the key equivalence of the catalog.
    """
    out = salted_join(components, key_map, ["column_id"], "left").withColumn(
        "column_id", F.coalesce("root_id", "column_id")
    )
    if mask_values:
        out = out.withColumn("value", F.lit(None).cast(components.schema["value"].dataType))
    if mask_distinct:
        out = out.withColumn("is_distinct", F.lit(None).cast("boolean"))
    return out.drop("root_id")


def with_empty_predictions(components: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions x sides, a side without any component (unparsed prediction) kept with NULL items."""
    grid = questions.select(
        "question_id", F.explode(F.array(F.lit("gold"), F.lit("pred"))).alias("side")
    )
    return grid.join(components, ["question_id", "side"], "left").withColumn(
        "parsed", F.col("clause").isNotNull().cast("int")
    )


def partial_scores(partial: DataFrame, level: str, compat: bool = False) -> DataFrame:
    """Mean accuracy / recall / F1 per component by level and for all.

    Accuracy averages rows with predictions, recall rows with labels.  When both are 0 the F1 is 0
    (1 with ``compat``).
    """
    rolled = (
        partial.groupBy("component", level)
        .agg(
            F.sum(F.when(F.col("pred_n") > 0, F.col("acc"))).alias("a"),
            F.count_if(F.col("pred_n") > 0).alias("an"),
            F.sum(F.when(F.col("label_n") > 0, F.col("rec"))).alias("r"),
            F.count_if(F.col("label_n") > 0).alias("rn"),
        )
    )
    every = rolled.withColumn(level, F.explode(F.array(F.col(level), F.lit("all"))))
    acc = F.coalesce(F.try_divide(F.sum("a"), F.sum("an")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.sum("r"), F.sum("rn")), F.lit(0.0))
    return (
        every.groupBy("component", level)
        .agg(acc.cast("double").alias("acc"), rec.cast("double").alias("rec"))
        .withColumn(
            "f1",
            F.when(
                (F.col("acc") == 0) & (F.col("rec") == 0), F.lit(1.0 if compat else 0.0)
            ).otherwise(
                # guarded division: both branches are planned
                F.try_divide(2 * F.col("acc") * F.col("rec"), F.col("acc") + F.col("rec"))
            ),
        )
    )


# --- sessions ---------------------------------------------------------------------------------


def turn_accuracy(scored: DataFrame, session: str = "session_id", turn: str = "turn_ix") -> DataFrame:
    """Accuracy by position in the session: ``turn 1`` .. ``turn 4``, ``turn > 4``."""
    ranked = with_rank(scored, [turn], [session], "_pos")
    label = F.when(
        F.col("_pos") < 4, F.concat(F.lit("turn "), (F.col("_pos") + 1).cast("string"))
    ).otherwise("turn > 4")
    return ranked.groupBy(label.alias("turn")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy")
    )


def joint_accuracy(scored: DataFrame, session: str = "session_id") -> DataFrame:
    """Share of sessions with every turn correct."""
    return (
        scored.groupBy(session)
        .agg(F.min("correct").alias("ok"))
        .agg(F.count(F.lit(1)).alias("sessions"), F.avg("ok").alias("accuracy"))
    )
